"""Interpolated modified Kneser-Ney models over character n-grams of an open alphabet.

An n-gram is a string of code points; the counts of a corpus are rows of a Spark table, one for each n-gram
seen, and stay there.  The texts to be scored are in blocks: each block asks for the distinct n-grams that it
holds, the requests are joined with the model by n-gram, shard against shard, and the answers go to their
block, which adds up its documents.  So what is shuffled is one row for each distinct n-gram of a block
instead of one for each of its characters, and no machine ever holds the model.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import Blocks
from .common import stage

ORDER = 4
#: Stands before a text ORDER - 1 times.
BOUNDARY = "\x02"
#: Characters of an alphabet at most, so that an n-gram is a number below 2**64; a block with more of them
#: is read under several alphabets, one after the other.
RADIX = 65535
#: Characters handled at once, which bounds a worker's memory whatever the length of a text.
SLICE = 1 << 20
_POWER = [np.uint64(RADIX**k) for k in range(ORDER + 1)]
_R = np.uint64(RADIX)


class Alphabet:
    """Numbers for characters, given in the order in which they come."""

    def __init__(self) -> None:
        self.ids, self.known = np.zeros(0x110000, dtype=np.uint16), np.zeros(0x110000, dtype=bool)
        self.codes = np.array([ord(BOUNDARY)], dtype=np.uint32)
        self.known[ord(BOUNDARY)] = True

    def add(self, codes: np.ndarray) -> bool:
        """Takes in different characters; False, and nothing changes, if there is no room for all."""
        new = codes[~self.known[codes]]
        if len(self.codes) + len(new) > RADIX:
            return False
        self.ids[new] = np.arange(len(self.codes), len(self.codes) + len(new))
        self.known[new] = True
        self.codes = np.concatenate([self.codes, new])
        return True

    def strings(self, keys: np.ndarray, n: int) -> pa.Array:
        """The n-grams of n characters that stand behind numbers."""
        out, rest = np.empty((len(keys), n), dtype="<u4"), keys.copy()
        for k in range(n - 1, -1, -1):
            out[:, k] = self.codes[(rest % _R).astype(np.int64)]
            rest //= _R
        return pa.array(out.view(f"<U{n}").ravel() if n else np.full(len(keys), ""), pa.string())


Span = tuple[int, str, int, int]


def _slices(spans: Iterable[Span], size: int) -> Iterator[list[Span]]:
    """Spans (row, text, from, to), cut where need be, in lists of at most `size` characters with their
    contexts."""
    held: list[Span] = []
    room = size
    for row, text, a, b in spans:
        while a < b:
            if room < ORDER:
                yield held
                held, room = [], size
            to = min(b, a + room - ORDER + 1)
            held.append((row, text, a, to))
            room -= to - a + ORDER - 1
            a = to
    if held:
        yield held


def _codes(spans: list[Span]) -> np.ndarray:
    """The characters of spans, each after its context."""
    pad = BOUNDARY * (ORDER - 1)
    parts = (pad + text[:b] if a == 0 else (pad + text[max(0, a - ORDER + 1) : b])[a - b - ORDER + 1 :] for _, text, a, b in spans)
    return np.frombuffer("".join(parts).replace("\0", "\ufffd").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _different(codes: np.ndarray) -> np.ndarray:
    seen = np.zeros(0x110000, dtype=bool)
    seen[codes] = True
    return np.flatnonzero(seen)


def _fitting(texts: Iterable[str | None]) -> Iterator[tuple[list[Span], np.ndarray, np.ndarray]]:
    """Slices with their characters and the different ones among them, never too many for an alphabet."""
    for some in _slices(((k, t, 0, len(t)) for k, t in enumerate(texts) if t), SLICE):
        codes = _codes(some)
        chars = _different(codes)
        if len(chars) < RADIX:
            yield some, codes, chars
        else:
            for small in _slices(some, RADIX - 1):
                codes = _codes(small)
                yield small, codes, _different(codes)


def grams(texts: Iterable[str | None]) -> Iterator[tuple[Alphabet, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of texts: the alphabet, the rows in a slice, where each one's n-grams begin, and the n-gram that
    ends at each character, as a number.  Empty texts have no rows.  NUL is read as U+FFFD."""
    alphabet = Alphabet()
    for spans, codes, chars in _fitting(texts):
        if not alphabet.add(chars):
            alphabet = Alphabet()
            alphabet.add(chars)
        numbers = alphabet.ids[codes].astype(np.uint64)
        keys = numbers.copy()
        for k in range(1, ORDER):
            keys[k:] += numbers[:-k] * _POWER[k]
        length = np.array([b - a for *_, a, b in spans])
        first = np.cumsum(length + ORDER - 1) - length - ORDER + 1
        own = np.ones(len(keys), dtype=bool)
        own[first[:, None] + np.arange(ORDER - 1)] = False
        yield alphabet, np.array([row for row, *_ in spans]), np.cumsum(length) - length, keys[own]


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    out, at = np.unique(np.concatenate(keys), return_inverse=True)
    return out, np.bincount(at, np.concatenate(counts), len(out)).astype(np.int64)


def counted(texts: Iterable[str | None]) -> Iterator[tuple[Alphabet, np.ndarray, np.ndarray]]:
    """The distinct n-grams of texts and their counts, for each alphabet."""
    last, keys, counts = None, [], []
    for alphabet, _, _, own in grams(texts):
        if keys and alphabet is not last:
            yield last, *_merged(keys, counts)
            keys, counts = [], []
        last = alphabet
        x, n = np.unique(own, return_counts=True)
        keys.append(x)
        counts.append(n)
    if keys:
        yield last, *_merged(keys, counts)


def counts(blocks: Blocks, known: DataFrame, kinds: list[str]) -> DataFrame:
    """(kinds..., x, n): how often each n-gram x stands in the documents of each kind.

    known(_block, doc_id, kinds...) has the documents to count, each once; kinds are small integers."""

    def run(docs: pa.Table, own: pa.Table) -> pa.Table:
        kind_of = dict(zip(own.column("doc_id").to_pylist(), zip(*(own.column(k).to_pylist() for k in kinds), strict=True), strict=True))
        texts: dict[tuple, list] = {}
        for doc_id, text in zip(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist(), strict=True):
            if doc_id in kind_of:
                texts.setdefault(kind_of[doc_id], []).append(text)
        parts = []
        for kind in sorted(texts):
            for alphabet, keys, n in counted(texts[kind]):
                parts.append(pa.table([*(pa.array(np.full(len(keys), k, np.int32)) for k in kind), alphabet.strings(keys, ORDER), pa.array(n)], names=[*kinds, "x", "n"]))
        empty = pa.table([*(pa.array([], pa.int32()) for _ in kinds), pa.array([], pa.string()), pa.array([], pa.int64())], names=[*kinds, "x", "n"])
        return pa.concat_tables([empty, *parts])

    found = blocks.join(["doc_id", "text"], known, run, ", ".join([*(f"{k} int" for k in kinds), "x string", "n long"]))
    return found.groupBy(*kinds, "x").agg(F.sum("n").alias("n"))


def levels(counts: DataFrame) -> DataFrame:
    """(part, x, k, c) of the n-grams x of every order k that stand in counts(part, x, n): the count of those
    of the highest order, of the others the number of different characters before them."""
    top = counts.select("part", "x", F.lit(ORDER).alias("k"), F.col("n").alias("c"))
    longer = counts.select("part", F.explode(F.array(*(F.substring("x", -k, k) for k in range(2, ORDER + 1)))).alias("y")).distinct()
    lower = longer.groupBy("part", F.expr("substring(y, 2)").alias("x")).agg(F.count("*").alias("c"))
    return top.unionByName(lower.select("part", "x", F.length("x").alias("k"), "c"))


def discounts(n1: float, n2: float, n3: float, n4: float) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more, from the numbers of n-grams counted so."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    raw = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.05), k) for k, d in enumerate(raw, 1))


def discounted(counts: DataFrame, by: tuple[str, ...] = ("part", "k")) -> DataFrame:
    """counts(by..., c) with the discount d of each count; the classes by which discounts differ are few."""
    numbers = counts.groupBy(*by).agg(*(F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2, 3, 4))).collect()
    d = F.lit(None).cast("double")
    for r in numbers:
        own = F.lit(True)
        for name in by:
            own = own & (F.col(name) == r[name])
        one, two, more = discounts(r.n1, r.n2, r.n3, r.n4)
        d = F.when(own, F.when(F.col("c") == 1, one).when(F.col("c") == 2, two).otherwise(more)).otherwise(d)
    return counts.withColumn("d", d)


def _context() -> Column:
    return F.expr("left(x, k - 1)")


def parts(counts: DataFrame) -> DataFrame:
    """(part, x, k, q, h, gamma) of every n-gram of every order: p(x) = q + gamma * p(x less its first
    character), where h is its context; of a context's n-grams that were not seen, q is 0."""
    all_levels = stage(levels(counts), "ngram-levels")
    each = discounted(all_levels).withColumn("h", _context())
    contexts = each.groupBy("part", "h").agg(F.sum("c").alias("total"), F.sum("d").alias("left")).withColumnsRenamed({"part": "_part", "h": "_h"})
    met = each.join(contexts.hint("merge"), (F.col("part") == F.col("_part")) & (F.col("h") == F.col("_h")))
    return met.select("part", "x", "k", ((F.col("c") - F.col("d")) / F.col("total")).alias("q"), "h", (F.col("left") / F.col("total")).alias("gamma"))


def symbols(counts: DataFrame) -> dict[int, int]:
    """The number of different characters that each part's n-grams end with, and one for all others."""
    ends = counts.groupBy("part").agg(F.count_distinct(F.substring("x", -1, 1)).alias("n"))
    return {r.part: r.n + 1 for r in ends.collect()}


def probabilities(found: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """(part, x, h, p) of the n-grams of the highest order in parts(), each order on top of the one below."""
    base = F.lit(None).cast("double")
    for part, n in sizes.items():
        base = F.when(F.col("part") == part, 1.0 / n).otherwise(base)
    now = found.where("k = 1").select("part", "x", "h", (F.col("q") + F.col("gamma") * base).alias("p"))
    for k in range(2, ORDER + 1):
        lower = now.select(F.col("part").alias("_part"), F.col("x").alias("_x"), F.col("p").alias("_p"))
        met = found.where(F.col("k") == k).join(lower.hint("merge"), (F.col("part") == F.col("_part")) & (F.expr("substring(x, 2)") == F.col("_x")))
        now = met.select("part", "x", "h", (F.col("q") + F.col("gamma") * F.col("_p")).alias("p"))
    return now


def requests(blocks: Blocks, lowest: int) -> DataFrame:
    """(_block, x): the distinct n-grams of each block, of the highest order, and the shorter ones that they
    back off to, with their contexts; of the context alone, if that is what `lowest` admits."""

    def run(docs: pa.Table) -> pa.Table:
        found = [pa.array([""] if lowest == 0 else [], pa.string())]
        for alphabet, keys, _ in counted(docs.column("text").to_pylist()):
            found.append(alphabet.strings(keys, ORDER))
            for k in range(max(lowest, 1), ORDER):
                # A suffix is an n-gram of a lower order; what stands before its last character is its context.
                shorter = context(suffix(keys, k + 1))
                shorter = shorter if lowest == ORDER - 1 else np.concatenate([shorter, suffix(keys, k)])
                found.append(alphabet.strings(np.unique(shorter), k))
        x = pa.concat_arrays(found)
        return pa.table([pa.repeat(docs.column("_block")[0], len(x)), x], names=["_block", "x"])

    return blocks.map(["text"], run, "_block long, x string")


def answers(asked: DataFrame, model: DataFrame) -> DataFrame:
    """The requests that the model(x, values...) has, with its values."""
    return asked.join(model.withColumnRenamed("x", "_x").hint("merge"), F.col("x") == F.col("_x")).drop("_x")


class Lookup:
    """The values of a block's answers by order and number, under one alphabet."""

    def __init__(self, alphabet: Alphabet, table: pa.Table, values: list[str]):
        x = table.column("x").combine_chunks()
        length = pc.utf8_length(x).to_numpy(zero_copy_only=False)
        codes = np.zeros((len(x), ORDER), dtype="<u4")
        if len(x):
            codes[:] = x.to_numpy(zero_copy_only=False).astype(f"<U{ORDER}").view("<u4").reshape(-1, ORDER)
        filled = np.arange(ORDER) < length[:, None]
        known = (alphabet.known[codes] | ~filled).all(axis=1)
        every = np.column_stack([np.zeros((len(x), 0)), *(table.column(v).to_numpy().astype(np.float64) for v in values)])
        self.keys, self.values = [], []
        for n in range(ORDER + 1):
            own = np.flatnonzero(known & (length == n))
            keys = np.zeros(len(own), dtype=np.uint64)
            for k in range(n):
                keys = keys * _R + alphabet.ids[codes[own, k]]
            # Answers may come twice where a block has several alphabets.
            keys, at = np.unique(keys, return_index=True)
            self.keys.append(keys)
            self.values.append(every[own[at]])

    def __call__(self, n: int, keys: np.ndarray) -> np.ndarray:
        """A row of values for each n-gram of n characters, NaN where there is none."""
        if not len(self.keys[n]):
            return np.full((len(keys), self.values[n].shape[1]), np.nan)
        at = np.minimum(np.searchsorted(self.keys[n], keys), len(self.keys[n]) - 1)
        return np.where((self.keys[n][at] == keys)[:, None], self.values[n][at], np.nan)


def suffix(keys: np.ndarray, n: int) -> np.ndarray:
    return keys % _POWER[n] if n < ORDER else keys


def context(keys: np.ndarray) -> np.ndarray:
    return keys // _R
