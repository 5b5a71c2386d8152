"""Fuzzy line deduplication: MinHash over character shingles, banding, exact Jaccard verification, and
connected components of which one line each is kept."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Guard, kept, scratch, small_batches, stage
from .graph import bucket_pieces, components, dealt_pieces, whole_groups

SHINGLE, SIMILARITY = 8, 0.8
#: A pair of similarity s shares a band with probability 1 - (1 - s**ROWS)**BANDS: 0.998 at 0.8.
BANDS, ROWS = 12, 4
#: Lines of a bucket that are compared with one another at once.
CHUNK = 256
_SLICE = 1 << 18
#: Characters whose hashes are computed at once: their arrays stay in a core's cache.
_CACHED = 1 << 15
#: Shingles of groups of lines that are compared at once.
_TOGETHER = 1 << 17
#: Lines of groups whose pairs are counted at once, all of them.
_FEW = 4
#: Rows (key, h1) that are packed at once, and packs by ranges of keys for each partition.
_PACKED, _PACKS = 1 << 20, 4
_U = np.uint64
_FAMILIES = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
_EMPTY = np.uint32(0xFFFFFFFF)


def normal(line: str) -> str:
    """What lines are compared by: lower case, single spaces."""
    low = line.lower()
    # Of white space, only the space itself is printable.
    return low.strip(" ") if "  " not in low and low.isprintable() else " ".join(low.split())


def lines(text: str | None) -> list[tuple[int, str]]:
    """The number and the normal form of each line that isn't blank."""
    low = (text or "").lower()
    if "  " not in low and low.replace("\n", "").isprintable():  # so is every line
        found = enumerate(x.strip(" ") for x in low.split("\n"))
    else:
        found = enumerate(map(normal, (text or "").split("\n")))
    return [x for x in found if x[1]]


def shingles(line: str) -> frozenset[str]:
    return frozenset(line[k : k + SHINGLE] for k in range(max(1, len(line) - SHINGLE + 1)))


def _portions(found: list[str]) -> Iterator[list[str]]:
    """Stretches of found of about _CACHED characters."""
    ends = np.cumsum([len(x) for x in found])
    cuts = [0, *np.flatnonzero(np.diff(ends // _CACHED)) + 1, len(found)]
    return (found[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if a < b)


def _codes(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of the SHINGLE characters from each place of lines of SHINGLE characters or more on, and the
    number of places of each line."""
    each = [_some_codes(x) for x in _portions(found)]
    return np.concatenate([h for h, _ in each]), np.concatenate([n for _, n in each])


def _some_codes(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    length = np.array([len(x) for x in found])
    h = np.frombuffer("".join(found).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(_U)
    factor, step = _FAMILIES[0], 1
    while step < SHINGLE:  # of two halves, each time
        h = h[:-step] * factor + h[step:]
        factor, step = factor * factor, 2 * step
    inside = np.ones(len(h), dtype=bool)
    inside[(np.cumsum(length)[:-1, None] - np.arange(1, SHINGLE)).ravel()] = False
    h = h[inside]
    h ^= h >> _U(32)
    h *= _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(29)
    return h, length - SHINGLE + 1


def similar_roots(h: np.ndarray, length: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """For each line, one of its group that similar lines of it connect it with: the same for all of a component.

    h has the hashes of the lines' shingles one after the other, length how many each has, cuts where groups of
    lines begin, and end last.  Groups are searched at once while they have about _TOGETHER shingles."""
    members = np.diff(cuts)
    root = np.arange(len(length))
    for few in (True, False):
        group = (members <= _FEW) == few
        line = np.flatnonzero(np.repeat(group, members))
        if len(line):
            own, size = h[np.repeat(np.repeat(group, members), length)], length[line]
            root[line] = line[_searched(own, size, np.append(0, np.cumsum(members[group])), _roots_of_few if few else _roots)]
    return root


def _searched(h: np.ndarray, length: np.ndarray, cuts: np.ndarray, search: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    ends = np.concatenate([[0], np.cumsum(length)])[cuts]
    root = np.arange(len(length))
    a = 0
    while a < len(cuts) - 1:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + _TOGETHER, side="right")) - 1)
        root[cuts[a] : cuts[b]] = cuts[a] + search(h[ends[a] : ends[b]], length[cuts[a] : cuts[b]], np.diff(cuts[a : b + 1]))
        a = b
    return root


def _marked(h: np.ndarray, length: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.uint64]:
    """The sorted distinct shingles of lines, and a mask of the low bits, which number the line.

    A shingle is known by its hash without the few bits that number the lines, and by its group."""
    n = len(length)
    low = _U((1 << (n - 1).bit_length()) - 1)
    x = h ^ np.repeat((group.astype(_U) + _U(1)) * _FAMILIES[0], length)
    x &= ~low
    x |= np.repeat(np.arange(n, dtype=_U), length)
    x.sort()
    return x[np.concatenate([[True], x[1:] != x[:-1]])], low


def _roots_of_few(h: np.ndarray, length: np.ndarray, members: np.ndarray) -> np.ndarray:
    """similar_roots() of groups of _FEW lines at most: a shingle's lines stand side by side, so what lines share is
    counted for all pairs."""
    n, group = len(length), np.repeat(np.arange(len(members)), members)
    x, low = _marked(h, length, group)
    line = (x & low).view(np.int64)
    x &= ~low
    size = np.bincount(line, minlength=n)
    common = np.zeros(n * _FEW, dtype=np.int64)
    for d in range(1, int(members.max())):
        at = np.flatnonzero(x[d:] == x[:-d])
        apart = line[at + d] - line[at]
        common += np.bincount((line[at] * _FEW + apart)[apart < _FEW], minlength=n * _FEW)
    common = common.reshape(n, _FEW)
    pairs = []
    for d in range(1, min(_FEW, n)):
        c = common[:-d, d]
        pairs.append(np.flatnonzero((group[d:] == group[:-d]) & (c >= SIMILARITY * (size[d:] + size[:-d] - c) - 1e-9)))
    root = np.arange(n)
    for _ in range(1, _FEW):
        for d, a in enumerate(pairs, 1):
            root[a + d] = least = np.minimum(root[a], root[a + d])
            root[a] = np.minimum(root[a], least)
    return root


def _roots(h: np.ndarray, length: np.ndarray, members: np.ndarray) -> np.ndarray:
    """similar_roots() of groups of so many members.  In each round every group marks one line's shingles, and what
    it shares with its other lines is counted for all groups at once."""
    n = len(length)
    group = np.repeat(np.arange(len(members)), members)
    x, low = _marked(h, length, group)
    value = np.concatenate([[0], np.cumsum((x[1:] ^ x[:-1]) > low)])
    marked = np.zeros(value[-1] + 1, dtype=np.int32)
    x = (x & low).view(np.int64) << 32 | value
    x.sort()
    at, size = x & 0xFFFFFFFF, np.bincount(x >> 32, minlength=n)
    begins = np.cumsum(size) - size
    held, own, starts = np.arange(n), at, begins  # lines that may be left, and their shingles
    root, rest, waiting = np.arange(n), np.ones(n, dtype=bool), np.zeros(n, dtype=bool)
    while True:
        # Of each group with lines left, one that was found and waits, else its first.
        open_ = np.zeros(len(members), dtype=bool)
        open_[group[rest]] = True
        waiting &= open_[group]
        chosen = _firsts(np.flatnonzero(waiting), group)
        open_[group[chosen]] = False
        chosen = np.concatenate([chosen, _firsts(np.flatnonzero(rest & open_[group]), group)])
        rest[chosen] = waiting[chosen] = False
        if not rest.any():
            return root
        front = np.full(len(members), -1)
        front[group[chosen]] = chosen
        if 2 * size[rest].sum() < len(own):
            held = np.flatnonzero(rest)
            own = at[_ranges(begins[held], size[held])]
            starts = np.cumsum(size[held]) - size[held]
        values = at[_ranges(begins[chosen], size[chosen])]
        marked[values] = 1
        common = np.add.reduceat(marked[own], starts)
        marked[values] = 0
        by = front[group[held]]
        found = rest[held] & (by >= 0) & (common >= SIMILARITY * (size[held] + size[by] - common) - 1e-9)
        by, found = by[found], held[found]
        root[found] = root[by]
        rest[found], waiting[found] = False, True


def _firsts(some: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The first of each group of some sorted lines."""
    return some[np.flatnonzero(np.diff(group[some], prepend=-1))]


def _ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(begins - ends + sizes, sizes) + np.arange(ends[-1])


def _ids(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes of lines as two longs."""
    raw = b"".join(xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in found)
    return tuple(np.frombuffer(raw, dtype=">i8").astype(np.int64).reshape(-1, 2).T) if found else (np.zeros(0, np.int64),) * 2


def band_keys(found: list[str]) -> np.ndarray:
    """A row of BANDS keys for each line, which must have SHINGLE characters or more."""
    return np.concatenate([_some_keys(x) for x in _portions(found)])


def _some_keys(found: list[str]) -> np.ndarray:
    """Each of ROWS hash families puts a line's shingles into BANDS bins and keeps the least value of each; a
    bin without shingles takes that of the next bin that has some.  Band j holds bin j of every family."""
    h, length = _some_codes(found)
    base = np.repeat(np.arange(len(found)) * BANDS, length)
    signature = np.full((ROWS, len(found) * BANDS), _EMPTY, dtype=np.uint32)
    where = np.empty(len(h), dtype=np.int64)
    for f, factor in enumerate(_FAMILIES):
        g = h * factor
        g ^= g >> _U(31)
        # Two families of each product: the upper bits of one half tell the bin, the other half is the value.
        halves, quarters = g.view("<u4").reshape(-1, 2), g.view("<u2").reshape(-1, 4)
        for side, (quarter, half) in enumerate(((3, 0), (1, 1))):
            np.multiply(quarters[:, quarter], BANDS, out=where, dtype=np.int64)
            where >>= 16
            where += base
            np.minimum.at(signature[2 * f + side], where, np.ascontiguousarray(halves[:, half]))
    signature = signature.reshape(ROWS, len(found), BANDS)
    filled = signature.copy()
    for k in range(1, BANDS):
        gap = filled == _EMPTY
        if not gap.any():
            break
        filled[gap] = np.roll(signature, -k, axis=2)[gap]
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=_U), filled.shape[1:]).copy()
    for own in filled:
        key = (key ^ own) * _FAMILIES[0]
        key ^= key >> _U(30)
    return key.view(np.int64)


def _tag() -> Column:
    """Tells apart the documents that share a doc_id, or have none."""
    return F.xxhash64("text")


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, line, n, h1, h2) of each line that isn't blank; n: how many such lines its document has.
    A document without any gives one row whose line and hashes are null."""
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lines(x) for x in batch.column("text").to_pylist()]
            each = np.array([len(x) for x in found], dtype=np.int64)
            row = np.repeat(np.arange(len(found)), np.maximum(each, 1))
            none = each[row] == 0
            flat = [x for one in found for x in one or [(0, "")]]
            h1, h2 = _ids([x for _, x in flat])
            own = [batch.column(c).take(pa.array(row)) for c in ("doc_id", "tag")]
            line = np.array([k for k, _ in flat], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*own, pa.array(line, mask=none), pa.array(each[row], pa.int32()), pa.array(h1, mask=none), pa.array(h2, mask=none)], names=["doc_id", "tag", "line", "n", "h1", "h2"])

    return docs.select("doc_id", _tag().alias("tag"), "text").mapInArrow(run, f"doc_id {kind}, tag long, line int, n int, h1 long, h2 long")


def _parts(spark: SparkSession) -> int:
    return _PACKS * int(spark.conf.get("spark.sql.shuffle.partitions"))


def _packs(found: Iterator[tuple[np.ndarray, np.ndarray]], parts: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, h1) as (part, pack): what has keys of one of so many equal ranges is packed, sorted by key."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def done() -> pa.RecordBatch:
        key, h1 = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(key.view(_U))
        x = np.stack([key[order], h1[order]], axis=1)
        part = (x[:, 0].view(_U) >> _U(32)) * _U(parts) >> _U(32)
        cuts = np.flatnonzero(np.diff(part, prepend=_U(parts)))
        ends = np.append(cuts, len(x)) * x.strides[0]
        pack = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(x)])
        return pa.RecordBatch.from_arrays([pa.array(part[cuts].astype(np.int32)), pack], names=["part", "pack"])

    for one in found:
        held.append(one)
        if sum(len(key) for key, _ in held) >= _PACKED:
            yield done()
            held = []
    if held:
        yield done()


def bands(docs: DataFrame) -> DataFrame:
    """_packs() of (key, h1) for each band of each line of SHINGLE characters or more."""
    parts = _parts(docs.sparkSession)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held: dict[str, None] = {}  # different lines; repeats from one slice to the next go later
        size = 0

        def done() -> tuple[np.ndarray, np.ndarray]:
            some = [*held]
            h1, _ = _ids(some)
            return band_keys(some).ravel(), np.repeat(h1, BANDS)

        for batch in batches:
            for text in batch.column("text").to_pylist():
                for _, x in lines(text):
                    if len(x) >= SHINGLE and x not in held:
                        held[x] = None
                        size += len(x)
                        if size >= _SLICE:
                            yield done()
                            held, size = {}, 0
        if held:
            yield done()

    return docs.select("text").mapInArrow(lambda batches: _packs(keys(batches), parts), "part int, pack binary")


def shared(rows: DataFrame) -> DataFrame:
    """The distinct rows (key, h1) whose key has two h1 at least, of rows as they are or in _packs().

    Spark moves and sorts packs and no rows; a task holds the rows of one range of keys at a time."""
    n, parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), _parts(rows.sparkSession)
    if "pack" not in rows.columns:
        rows = rows.mapInArrow(lambda batches: _packs(((b.column("key").to_numpy(), b.column("h1").to_numpy()) for b in batches), parts), "part int, pack binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, _ in whole_groups(batches, ["part"]):
            x = np.frombuffer(b"".join(some.column("pack").to_pylist()), dtype=np.int64).reshape(-1, 2)
            order = np.argsort(x[:, 0])
            x = x[order[_met(x[order, 0])]]
            x = x[np.lexsort((x[:, 1], x[:, 0]))]
            x = x[np.append(True, (x[1:] != x[:-1]).any(axis=1))] if len(x) else x
            x = x[_met(x[:, 0])]
            yield pa.RecordBatch.from_arrays([pa.array(x[:, k].copy()) for k in (0, 1)], names=["key", "h1"])

    return rows.repartition(n, "part").sortWithinPartitions("part").mapInArrow(run, "key long, h1 long")


def _met(key: np.ndarray) -> np.ndarray:
    """Which of sorted keys equal a neighbour."""
    same = key[1:] == key[:-1]
    return np.append(same, False) | np.append(False, same) if len(key) else np.zeros(0, dtype=bool)


def distinct_buckets(rows: DataFrame) -> DataFrame:
    """rows(key, h1) of one key for each set of lines: bands that put the same lines together ask for the
    same comparisons.  Sets are told apart by their size and two 64-bit sums of their members' hashes."""
    marks = rows.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("h1")).alias("x"), F.bit_xor(F.xxhash64("h1", F.lit(1))).alias("y"))
    one = stage(marks.groupBy("n", "x", "y").agg(F.min("key").alias("_key")).select("_key"), "line-buckets")
    return rows.join(one.hint("merge"), F.col("key") == F.col("_key"), "left_semi")


def _node() -> Column:
    return F.concat(F.lpad(F.hex("h1"), 16, "0"), F.lpad(F.hex("h2"), 16, "0"))


def links(docs: DataFrame, buckets: DataFrame, near: DataFrame) -> DataFrame:
    """Edges (a, b) between lines, as 32 hex digits, that connect just what verified pairs connect.

    buckets has the lines (key, h1) that are compared, near tells where each distinct one of these (h1, h2) first
    stands, as `at` (doc_id, line, tag)."""
    places = near.groupBy("at.doc_id", "at.tag").agg(F.collect_list("at.line").alias("_lines")).withColumnsRenamed({"doc_id": "_id", "tag": "_tag"})
    met = docs.select("doc_id", "text", _tag().alias("tag")).join(places.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag"))).select("doc_id", "tag", "text", "_lines")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            found = []
            for *own, text, some in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tag", "text", "_lines")), strict=True):
                if own == last:  # repeated rows follow one another; a line met twice would do no harm
                    continue
                last = own
                every = (text or "").split("\n")
                found += [normal(every[k]) for k in some if k < len(every)]
            h1, h2 = _ids(found)
            yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array(found, pa.string())], names=["_h1", "h2", "x"])

    texts = met.mapInArrow(take, "_h1 long, h2 long, x string")
    # Buckets are cut into pieces before their texts are met, which are read, made and sorted once.
    pieces = bucket_pieces(buckets, "key", F.col("h1"), CHUNK, carry=["h1"])
    pieces = pieces.join(texts.hint("merge"), F.col("h1") == F.col("_h1")).select("key", "left", "right", _node().alias("node"), "x")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, cuts in whole_groups(batches, ["key", "left", "right"]):
            h, length = _codes(part.column("x").to_pylist())
            root = similar_roots(h, length, np.array(cuts))
            own = np.flatnonzero(root != np.arange(len(root)))
            node = part.column("node").combine_chunks()
            yield pa.RecordBatch.from_arrays([node.take(pa.array(own)), node.take(pa.array(root[own]))], names=["a", "b"])

    return dealt_pieces(pieces, "key").mapInArrow(verify, "a string, b string")


def removed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """occurrences(), and (doc_id, tag, lines): the sorted numbers of the lines that go."""
    with scratch():
        every = kept(stage(occurrences(docs), "lines"))
        first = F.min(F.struct("doc_id", "line", "tag")).alias("at")
        firsts = stage(every.where("line is not null").groupBy("h1", "h2").agg(first, F.count("*").alias("n")), "line-firsts")
        buckets = stage(distinct_buckets(stage(shared(bands(docs)), "line-buckets")), "line-buckets")
        wanted = buckets.select(F.col("h1").alias("_h")).distinct()
        near = stage(firsts.select("h1", "h2", "at").join(wanted.hint("merge"), F.col("h1") == F.col("_h"), "left_semi"), "line-near")
        connected = stage(components(links(docs, buckets, near)), "line-components").withColumnRenamed("node", "_node")
        fuzzy = near.withColumn("node", _node()).join(connected.hint("merge"), F.col("node") == F.col("_node")).select("h1", "h2", "at", "component")
        fuzzy = stage(fuzzy, "line-fuzzy")
        least = fuzzy.groupBy("component").agg(F.min("at").alias("keep")).withColumnRenamed("component", "_c")
        fuzzy = fuzzy.join(least, F.col("component") == F.col("_c")).select("h1", "h2", "keep")
        exact = firsts.where("n > 1").select("h1", "h2", F.col("at").alias("keep"))
        # A line that is both repeated and connected takes its component's place, the smaller one.  Written, so
        # that Spark can split what occurs most often.
        goal = kept(stage(exact.unionByName(fuzzy).groupBy("h1", "h2").agg(F.min("keep").alias("keep")), "line-goals"))
    goal = goal.withColumnsRenamed({"h1": "_h1", "h2": "_h2"})
    gone = every.join(goal.hint("merge"), (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))).where(~F.struct("doc_id", "line", "tag").eqNullSafe(F.col("keep")))
    return every, gone.groupBy("doc_id", "tag").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def dedup(docs: DataFrame) -> DataFrame:
    """One row per document, a doc_id with a text: doc_id, n_lines, n_removed, removed (numbers of the lines
    that go, from 0).

    Lines are what stands between newlines; blank ones aren't counted and stay.  Lines are compared by
    their normal form: equal ones, and those whose sets of SHINGLE-character shingles have a Jaccard
    similarity of SIMILARITY or more, are linked; of each component the line of the smallest (doc_id, line)
    stays.  Shorter lines are linked only with equal ones.  Null and empty texts have no lines.  Rows that
    share doc_id and text are one document: repeated rows keep the same lines.  Unlike texts that share a
    doc_id, or have none, are documents of their own; where they tie, a hash of the text decides.  A null
    doc_id comes before all others.  Other columns are ignored."""
    every, gone = removed(docs)
    counts = every.groupBy("doc_id", "tag").agg(F.max("n").alias("n_lines"))
    gone = gone.withColumnsRenamed({"doc_id": "_id", "tag": "_tag"})
    out = counts.join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag")), "left")
    lost = F.coalesce("lines", F.array().cast("array<int>"))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size(lost).cast("long").alias("n_removed"), lost.alias("removed"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs without the lines that go, in the columns of docs (n_chars told anew); a document that had lines
    and loses all of them goes."""
    _, gone = removed(docs)
    guard = Guard(docs, ["doc_id", "text", "n_chars"])
    gone = gone.withColumnsRenamed({"doc_id": "_id", "tag": "_tag"})
    met = guard.df.join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (_tag() == F.col("_tag")), "left")
    numbered = F.transform(F.split("text", "\n"), lambda x, k: F.when(F.array_contains("lines", k), F.lit(None)).otherwise(x))
    text = F.when(F.col("lines").isNull(), F.col("text")).otherwise(F.array_join(F.filter(numbered, lambda x: x.isNotNull()), "\n"))
    out = met.withColumn("text", text).where(F.col("lines").isNull() | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return guard.restore(out)
