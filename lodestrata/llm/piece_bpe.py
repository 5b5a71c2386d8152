"""Encoding and decoding with SentencePiece BPE models by a merge-type prefix table.

Every prefix of a text has one encoding, and the encoding of a longer prefix extends that of the prefix
its last token leaves.  So each prefix needs only its last token: of the tokens that end there (found by
an Aho-Corasick automaton), the one that is compatible with the last token of what stands before it.  Two
tokens are compatible if merging the characters of both gives just these two.  Ids are then recovered from
the end.  The work is linear in the text, whatever its length."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .common import Guard, small_batches

SPACE = "▁"
#: Entries of the caches of one worker; a full cache is emptied.
CACHE = 300_000
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE, _UNUSED = 1, 2, 3, 4, 6, 5


class PieceBpe:
    """Encodes and decodes as the sentencepiece library does for a BPE model with an identity normaliser,
    a dummy prefix, kept white space and byte fallback."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        spec, kinds = proto.normalizer_spec, {p.type for p in proto.pieces}
        if proto.trainer_spec.model_type != 2 or spec.name != "identity" or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces or not proto.trainer_spec.byte_fallback or kinds & {_USER, _UNUSED}:
            raise ValueError("only BPE models with byte fallback, a dummy prefix and no normalisation are supported")
        self.score = {p.piece: p.score for p in proto.pieces if p.type == _NORMAL}
        self.id = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == _NORMAL}
        self.piece = {i: p for p, i in self.id.items()}
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == _BYTE}
        self.surface = [b""] * len(proto.pieces)
        for i, p in enumerate(proto.pieces):
            if p.type == _NORMAL:
                self.surface[i] = p.piece.replace(SPACE, " ").encode()
            elif p.type == _BYTE:
                self.surface[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type == _UNKNOWN:
                self.surface[i] = " ⁇ ".encode()
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        #: Pairs of characters that stand together in some piece; no merge crosses another pair.
        self.joined = {p[k : k + 2] for p in self.id for k in range(len(p) - 1)}
        if any(a != SPACE and (a + SPACE) in self.joined for a in {p[0] for p in self.joined}):
            raise ValueError("pieces with inner white space are not supported")
        newline = any("\n" in p for p in self.id)
        self.chunks = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+" if newline else f"{SPACE}*[^{SPACE}\n]+|\n|{SPACE}+").findall
        self._pairs: dict[tuple[int, int], bool] = {}
        self._ends: dict[int, tuple[list[tuple[str, float]], list[tuple[str, float]]] | None] = {}
        self._parts: dict[str, list[int]] = {}
        self._words: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """Plain BPE: merge the adjacent pair of the best score, the leftmost of equals, until none is a piece."""
        parts, score = list(text), self.score.get
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _spines(self, token: int) -> tuple[list[tuple[str, float]], list[tuple[str, float]]] | None:
        """The pieces that stand at the left and at the right end of a token while it is merged, each with
        the score of the merge that takes it up; None if no merges give the token or if their scores rise."""
        if token not in self._ends:
            parts, at, taken, steps = list(self.piece[token]), 0, self.score.get, []
            while len(parts) > 1:
                best, at = None, -1
                for k in range(len(parts) - 1):
                    x = taken(parts[k] + parts[k + 1])
                    if x is not None and (best is None or x > best):
                        best, at = x, k
                if at < 0:
                    break
                steps.append((best, at == 0, at == len(parts) - 2, parts[0], parts[-1]))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            falls = all(x[0] > y[0] for x, y in zip(steps, steps[1:], strict=False))
            ends = ([(x[3], x[0]) for x in steps if x[1]], [(x[4], x[0]) for x in steps if x[2]])
            for way in ends:
                way.append((self.piece[token], -np.inf))
            self._ends[token] = ends if len(parts) == 1 and falls else None
        return self._ends[token]

    def _compatible(self, left: int, right: int) -> bool:
        """Whether right can follow left; -1 on the left stands for the start, -2 for a character of no piece.

        As scores fall, the ends of both tokens grow piece by piece.  They are compatible unless, while two
        pieces face one another, their union has a better score than the merges that take up either."""
        found = self._pairs.get((left, right))
        if found is None:
            if len(self._pairs) >= 2 * CACHE:
                self._pairs.clear()
            one, two = self._spines(left) if left >= 0 else None, self._spines(right)
            if left < 0 and two is not None:
                found = True
            elif one is None or two is None:
                before = [self.piece[left]] if left >= 0 else []
                found = self.merged("".join(before) + self.piece[right]) == [*before, self.piece[right]]
            else:
                found, i, j, score, ends, starts = True, 0, 0, self.score.get, one[1], two[0]
                while True:
                    (a, until_a), (b, until_b) = ends[i], starts[j]
                    s = score(a + b)
                    if s is not None and s > until_a and s >= until_b:
                        found = False
                        break
                    if i == len(ends) - 1 and j == len(starts) - 1:
                        break
                    if until_a >= until_b:
                        i += 1
                    else:
                        j += 1
            self._pairs[left, right] = found
        return found

    def _encode_part(self, text: str) -> list[int]:
        # last[j] and length[j] tell the last token of the prefix of j characters; the automaton gives the
        # tokens by where they end, longer ones first.
        last, length, pairs = [-1], [0], self._pairs
        for end, (n, token) in self.automaton.iter(text):
            if end < len(last) - 1:
                continue
            while len(last) <= end:
                last.append(-2)
                length.append(1)
            left = last[end + 1 - n]
            fits = pairs.get((left, token))
            if fits or fits is None and self._compatible(left, token):
                last.append(token)
                length.append(n)
        while len(last) <= len(text):
            last.append(-2)
            length.append(1)
        out, j = [], len(text)
        while j:
            if last[j] >= 0:
                out.append(last[j])
            else:
                out.extend(self.byte_id[b] for b in reversed(text[j - 1].encode()))
            j -= length[j]
        return out[::-1]

    def _encode_word(self, word: str) -> bytes:
        """The ids of one chunk as the bytes of an int32 array; parts that no merge joins are encoded apart."""
        ids, at = [], 0
        for k in range(1, len(word) + 1):
            if k == len(word) or word[k - 1 : k + 1] not in self.joined:
                part, at = word[at:k], k
                got = self._parts.get(part)
                if got is None:
                    got = self._encode_part(part)
                    if len(part) <= 40:
                        if len(self._parts) >= CACHE:
                            self._parts.clear()
                        self._parts[part] = got
                ids += got
        out = array("i", ids).tobytes()
        if len(word) <= 40:
            if len(self._words) >= CACHE:
                self._words.clear()
            self._words[word] = out
        return out

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=np.int32)
        get, make = self._words.get, self._encode_word
        return np.frombuffer(b"".join([get(w) or make(w) for w in self.chunks(SPACE + text.replace(" ", SPACE))]), dtype=np.int32)

    def forget(self, least: int = 50_000) -> None:
        """Empties caches of that many entries, so that an idle worker holds little."""
        for cache in (self._words, self._parts, self._pairs):
            if len(cache) >= least:
                cache.clear()

    def decode(self, ids: np.ndarray) -> str:
        surface = self.surface
        out = b"".join([surface[i] for i in ids.tolist()])
        first = next((i for i in ids.tolist() if surface[i]), None)
        if out[:1] == b" " and first in self.piece:
            out = out[1:]
        return out.decode("utf-8", "replace")


_LOADED: dict[int, PieceBpe] = {}


def loaded(model: bytes) -> PieceBpe:
    """One instance in each Python worker, so that tasks share its caches."""
    key = hash(model)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = PieceBpe(model)
    return _LOADED[key]


def _map(table: DataFrame, model_path: str, added: list[tuple[str, str]]) -> DataFrame:
    guard = Guard(table, ["text"] if added[0][0] == "ids" else ["ids"])
    docs, spark = guard.df, table.sparkSession
    small_batches(spark, 500)
    with open(model_path, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())
    schema = StructType([*docs.schema.fields, *StructType.fromDDL(", ".join(map(" ".join, added))).fields])
    names = [n for n, _ in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(sent.value)
        for batch in batches:
            new = {}
            if "ids" in names:
                ids = [bpe.encode(x) for x in batch.column("text").to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                new["ids"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int32)))
            else:
                ids = [np.array(x or [], dtype=np.int32) for x in batch.column("ids").to_pylist()]
            if "decoded" in names:
                new["decoded"] = pa.array([bpe.decode(x) for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(new[n] for n in names)], names=schema.names)
        bpe.forget()

    return guard.restore(docs.mapInArrow(run, schema), [n for n, _ in added])


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """docs with ids, the token ids of the whole text, without begin or end ids.

    Null and empty texts have no ids.  Rows are encoded one by one: repeated rows give equal ids, other
    columns pass through, but columns named ids or decoded are replaced."""
    return _map(docs, model_path, [("ids", "array<int>")])


def decode(tokens: DataFrame, model_path: str) -> DataFrame:
    """tokens with decoded, the text of ids (null ids: empty), as the library decodes them."""
    return _map(tokens, model_path, [("decoded", "string")])


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """docs with ids and decoded, in one pass."""
    return _map(docs, model_path, [("ids", "array<int>"), ("decoded", "string")])
