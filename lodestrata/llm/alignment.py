"""Alignment of two tokenizers' tokens by packed bitsets of token ends.

The ends of both sides' tokens are bits over the bytes of a batch of texts.  Their AND is the shared cuts, which
part the texts into groups; popcounts up to a byte tell how many tokens of a side end there, and so map cuts to
ranges of tokens.  The OR's stretches each lie in one token of either side: they are the links."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from . import piece_bpe, token_counts
from .blocks import Blocks
from .common import Guard, kept, scratch, small_batches, stage

#: Bytes of texts that are aligned at once (a longer text alone).
PART_BYTES = 2 << 20


class Bits:
    """A bitset with the number of set bits before each of its words."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.upto = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @staticmethod
    def at(places: np.ndarray, n: int) -> Bits:
        marks = np.zeros((n // 64 + 2) * 64, dtype=np.uint8)  # ranks are asked up to n + 1
        marks[places] = 1
        return Bits(np.packbits(marks, bitorder="little").view("<u8"))

    def rank(self, places: np.ndarray) -> np.ndarray:
        """How many bits are set before each place."""
        word, bit = places >> 6, (places & 63).astype(np.uint64)
        return self.upto[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def select(self) -> np.ndarray:
        """The places of all set bits."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


class Aligned:
    """The tokens of both sides of several texts, one text after another, their groups and links.

    A text's tokens are a[a_text[k]:a_text[k + 1]], and likewise for b and groups.  Group g has the tokens
    a[a_group[g]:a_group[g + 1]] and likewise for b.  Link k is of the tokens link_a[k] and link_b[k]."""

    def __init__(self, a: list[np.ndarray], b: list[np.ndarray], surface_a: np.ndarray, surface_b: np.ndarray):
        size = lambda own: np.array([len(x) for x in own], dtype=np.int64)
        none = np.zeros(0, dtype=np.int32)
        self.a, self.b = np.concatenate([*a, none]), np.concatenate([*b, none])
        self.a_text, self.b_text = (np.concatenate([[0], np.cumsum(size(x))]) for x in (a, b))
        end_a, end_b = np.cumsum(surface_a[self.a]), np.cumsum(surface_b[self.b])
        n = int(end_a[-1]) if len(end_a) else 0
        left, right = Bits.at(end_a, n), Bits.at(end_b, n)
        shared = Bits(left.words & right.words)
        cuts = shared.select()
        self.a_group, self.b_group = (np.concatenate([[0], x.rank(cuts + 1)]) for x in (left, right))
        text_end = np.concatenate([[0], end_a])[self.a_text]
        self.groups = shared.rank(text_end + 1)
        stretch = Bits(left.words | right.words).select()
        self.link_a, self.link_b = left.rank(stretch), right.rank(stretch)
        self.links = np.searchsorted(self.link_a, self.a_text)


def _lengths(surface: list[bytes]) -> np.ndarray:
    return np.array([len(x) for x in surface], dtype=np.int64)


class Aligner:
    def __init__(self, a: str, b: bytes):
        self.a, self.b = token_counts.loaded(a), piece_bpe.loaded(b)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=b)
        self.size_a, self.size_b = _lengths(self.a.surface), _lengths(self.b.surface)
        top = max(len(self.size_a), len(self.size_b))
        self.width = len(str(top)) + 1
        #: The digits of each id, with room for what follows them.
        self.digits = np.array([str(k).ljust(self.width) for k in range(top)], dtype=f"S{self.width}").view(np.uint8).reshape(top, self.width)
        self.n_digits = np.array([len(str(k)) for k in range(top)], dtype=np.int64)

    def _encode_b(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids under b.  Texts are cut where no merge crosses; the library encodes the new words of all texts at once."""
        known, mark = self.b._words, piece_bpe.SPACE
        cut = [self.b.chunks(mark + t.replace(" ", mark)) if t else [] for t in texts]
        used = set().union(*cut)
        if len(known) + len(used) > piece_bpe.CACHE:
            known.clear()
        # The library puts a space before what it encodes, so it is given the words that begin with one.
        fit = lambda w: w[0] == mark and 1 < len(w) <= 40
        others = {w: self.b._encode_word(w) for w in used.difference(known) if not fit(w)}
        new = [w for w in used.difference(known, others) if fit(w)]
        ids = self.library.encode([w[1:].replace(mark, " ") for w in new], num_threads=1) if new else []
        known.update((w, array("i", x).tobytes()) for w, x in zip(new, ids, strict=True))
        known.update(others)
        out = [np.frombuffer(b"".join(map(known.__getitem__, own)), dtype=np.int32) for own in cut]
        for w in others:
            if len(w) > 40:
                del known[w]
        return out

    def parts(self, texts: list[str | None]) -> Iterator[tuple[int, int, Aligned]]:
        """The alignment of texts[i:j], stretch by stretch.  Null and empty texts have no tokens, nor have those
        where the bytes of either side's tokens aren't a space and the text."""
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size < PART_BYTES):
                size += len(texts[j] or "")
                j += 1
            own = [" " + t if t else "" for t in texts[i:j]]
            a = self.a.encode(own)
            b = self._encode_b(texts[i:j])
            for k, t in enumerate(own):
                raw = t.encode()
                if not t or self.size_a[a[k]].sum() != len(raw) or self.size_b[b[k]].sum() != len(raw) or (piece_bpe.SPACE in t and self._differs(raw, b[k])):
                    a[k] = b[k] = np.zeros(0, dtype=np.int32)
            yield i, j, Aligned(a, b, self.size_a, self.size_b)
            i = j

    def _differs(self, raw: bytes, ids: np.ndarray) -> bool:
        """Only the model's mark of a space can stand in a text and in its tokens as something else."""
        return b"".join(map(self.b.surface.__getitem__, ids.tolist())) != raw

    def written(self, x: Aligned) -> list[str]:
        """For each text `a1,a2|b1;a3|b2,b3`: the ids of its groups, those of a before those of b."""
        n_a, n_b = np.diff(x.a_group), np.diff(x.b_group)
        group_a, group_b = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)
        # A token's place: behind all of its side before it, and what the other side has before it.
        at_a, at_b = np.arange(len(x.a)) + x.b_group[group_a], np.arange(len(x.b)) + x.a_group[group_b + 1]
        ids, after = np.zeros(len(x.a) + len(x.b), dtype=np.int64), np.full(len(x.a) + len(x.b), ord(","), dtype=np.uint8)
        ids[at_a], ids[at_b] = x.a, x.b
        after[at_a[x.a_group[1:] - 1]] = ord("|")
        after[at_b[x.b_group[1:] - 1]] = ord(";")
        rows = self.digits[ids]
        size = self.n_digits[ids]
        rows[np.arange(len(ids)), size] = after
        flat = rows[np.arange(self.width) <= size[:, None]].tobytes().decode("ascii")
        ends = np.concatenate([[0], np.cumsum(size + 1)])[(x.a_text + x.b_text)]
        return [flat[s:e][:-1] for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


_LOADED: dict[int, Aligner] = {}


def _aligner(a: str, b: bytes) -> Aligner:
    key = hash((a, b))
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Aligner(a, b)
    return _LOADED[key]


def _sent(docs: DataFrame, a: str, b: str):
    with open(a, encoding="utf-8") as one, open(b, "rb") as two:
        return docs.sparkSession.sparkContext.broadcast((one.read(), two.read()))


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.astype(np.int32)))


def align(docs: DataFrame, a: str, b: str) -> DataFrame:
    """docs with a_ids, b_ids, a_ends and b_ends: the ids of space + text under the byte-level BPE JSON a and of text
    under the SentencePiece BPE model b, and for each shared cut how many tokens of either side end up to it; group
    k is the tokens between the k-th and the next of these numbers.

    Null and empty texts, and texts whose joined tokens of b differ from the text (they hold U+2581), have empty
    arrays.  Rows are aligned one by one: repeated rows stay and are aligned alike, an empty table gives no rows,
    other columns pass through whatever their names, and columns named as the added ones are replaced."""
    guard, sent = Guard(docs, ["text"]), _sent(docs, a, b)
    small_batches(docs.sparkSession, 500)
    more = StructType.fromDDL("a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>")
    schema = StructType([*guard.df.schema.fields, *more.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*sent.value)
        for batch in batches:
            for i, j, x in aligner.parts(batch.column("text").to_pylist()):
                ends = [x.a_group[1:] - np.repeat(x.a_text[:-1], np.diff(x.groups)), x.b_group[1:] - np.repeat(x.b_text[:-1], np.diff(x.groups))]
                own = [_lists(x.a, x.a_text), _lists(x.b, x.b_text), *(_lists(e, x.groups) for e in ends)]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, *own], names=schema.names)

    return guard.restore(guard.df.mapInArrow(run, schema), more.names)


DIGEST = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, text binary"


def _digest(docs: DataFrame, a: str, b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, text) of each document; text holds the distinct linked
    pairs of ids in order, as id of a times 2**32 + id of b, and then how many links each has, as int64 and int32."""
    sent = _sent(docs, a, b)
    small_batches(docs.sparkSession, 500)
    docs = docs.select("doc_id", "text")
    schema = StructType([docs.schema["doc_id"], *StructType.fromDDL(DIGEST).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*sent.value)
        for batch in batches:
            for i, j, x in aligner.parts(batch.column("text").to_pylist()):
                pairs = x.a[x.link_a].astype(np.int64) << 32 | x.b[x.link_b]
                packed = []
                for s, e in zip(x.links[:-1].tolist(), x.links[1:].tolist(), strict=True):
                    own, n = np.unique(pairs[s:e], return_counts=True)
                    packed.append(own.tobytes() + n.astype(np.int32).tobytes())
                hashes = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in aligner.written(x)]
                sizes = [pa.array(np.diff(y), pa.int64()) for y in (x.a_text, x.b_text, x.groups, x.links)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), *sizes, pa.array(hashes, pa.string()), pa.array(packed, pa.binary())], names=schema.names)

    return docs.mapInArrow(run, schema)


def _unpacked(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The row, pair and number of links of what _digest() packed."""
    raw = rows.column("text").to_pylist()
    m = np.array([len(x) // 12 for x in raw], dtype=np.int64)
    pairs = np.frombuffer(b"".join([x[: 8 * k] for x, k in zip(raw, m.tolist(), strict=True)]), dtype=np.int64)
    n = np.frombuffer(b"".join([x[8 * k :] for x, k in zip(raw, m.tolist(), strict=True)]), dtype=np.int32)
    return np.repeat(np.arange(len(raw)), m), pairs, n


def _asked(rows: pa.Table) -> pa.Table:
    """The distinct pairs of a block, and how many links each has there."""
    _, pairs, n = _unpacked(rows)
    own, at = np.unique(pairs, return_inverse=True)
    block = rows.column("_block")[0].as_py()
    return pa.table({"_block": pa.array(np.full(len(own), block), pa.int64()), "pair": own, "n": pa.array(np.bincount(at, n, len(own)).astype(np.int64))})


def link_counts(asked: DataFrame) -> DataFrame:
    """(pair, count, best): how many links of the corpus hold a pair of ids, and whether no other pair of its id of b
    has more."""
    counts = asked.groupBy("pair").agg(F.sum("n").alias("count"))
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy(F.expr("pair & 4294967295L"))))


def score(docs: DataFrame, a: str, b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each document.

    The count of a pair of ids is how many links of all documents hold it; n_best are the links whose pair has
    the highest count of its id of b, ties included; count_sum is the sum of counts over links; groups_sha256 is of
    the groups' ids as `a1,a2|b1;a3|b2,b3`.  Texts are encoded once: the distinct linked pairs of each document
    are written in blocks, and blocks ask for the counts of their distinct pairs.  Texts without tokens (see
    align()) have zeros and '' ; repeated rows stay, and each adds to the counts; a null doc_id passes through; an
    empty table gives no rows; other columns of docs are ignored."""
    with scratch():
        blocks = Blocks(_digest(docs, a, b))
        asked = stage(blocks.map(["text"], _asked, "_block long, pair long, n long"), "alignment-pairs")
        counts = stage(link_counts(asked), "alignment-counts").withColumnRenamed("pair", "_pair")
        answers = asked.join(counts.hint("merge"), F.col("pair") == F.col("_pair")).select("_block", "pair", "count", "best")
        columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
        schema = StructType([*(blocks.df.schema[c] for c in columns)]).add("n_best", LongType()).add("count_sum", LongType())

        def run(rows: pa.Table, told: pa.Table) -> pa.Table:
            row, pairs, n = _unpacked(rows)
            told = told.sort_by("pair")
            at = np.searchsorted(told.column("pair").to_numpy(), pairs)
            count, best = told.column("count").to_numpy(), told.column("best").to_numpy(zero_copy_only=False)
            n = n.astype(np.int64)
            sums = [np.zeros(rows.num_rows, dtype=np.int64) for _ in range(2)]
            if len(pairs):
                np.add.at(sums[0], row, n * best[at])
                np.add.at(sums[1], row, n * count[at])
            return pa.table([*(rows.column(c) for c in columns), *map(pa.array, sums)], names=schema.names)

        found = kept(stage(blocks.join([*columns, "text"], answers, run, schema), "alignment"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
