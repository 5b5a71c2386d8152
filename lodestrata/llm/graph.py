"""Links: exact search of large buckets in bounded pieces, and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of equal keys of sorted batches, also where they cross from one batch to the next."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        first, end = tuple(c[0] for c in columns), tuple(c[-1] for c in columns)
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if held and (k or first != last):
                yield pa.concat_tables(held).combine_chunks()
                held = []
            held.append(part.slice(a, b - a))
        last = end
    if held:
        yield pa.concat_tables(held).combine_chunks()


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Stretches of sorted batches that end where a run of equal keys ends, and where their runs begin, and
    end last; small runs come many at a time."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        part = pa.concat_tables(held)
        cuts = _cuts(part, keys)
        if len(cuts) > 2:
            yield part.slice(0, cuts[-2]), cuts[:-1]
            held = [part.slice(cuts[-2])]
    if held:
        part = pa.concat_tables(held)
        yield part, _cuts(part, keys)


def _cuts(part: pa.Table, keys: list[str]) -> list[int]:
    new = np.zeros(part.num_rows, dtype=bool)
    for k in keys:
        c = part.column(k).to_numpy()
        new[1:] |= c[1:] != c[:-1]
    return [0, *np.flatnonzero(new).tolist(), part.num_rows]


def met(left: DataFrame, right: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """Their join by shuffles.  Either side grows with the input, and what is broadcast passes through the driver whole
    and stays there until it is collected, once for each round."""
    return left.join(right.hint("merge"), on, how)


def bucket_pieces(rows: DataFrame, key: str, member: Column, size: int, useful: Column | None = None, carry: list[str] | None = None) -> DataFrame:
    """rows in buckets of two or more by key, as (key, left, right, chunk, carried columns).

    A bucket of n rows is dealt by the hash of `member` into ceil(n / size) chunks; every pair of chunks,
    and each chunk with itself, is a piece (key, left, right) of about 2 * size rows at most, so every pair
    of a bucket meets in some piece and none is ever gathered whole.  useful: an aggregate that must hold
    for a bucket to matter."""
    kept = F.count("*") > 1 if useful is None else (F.count("*") > 1) & useful
    sizes = rows.groupBy(key).agg(F.count("*").alias("_n"), kept.alias("_kept")).where("_kept")
    sizes = sizes.select(F.col(key).alias("_key"), F.ceil(F.col("_n") / size).cast("int").alias("_chunks"))
    own = F.pmod(F.xxhash64(member, F.lit(7)), F.col("_chunks")).cast("int")
    dealt = met(rows, sizes, F.col(key) == F.col("_key")).withColumn("chunk", own)
    others = F.transform(F.sequence(F.lit(0), F.col("_chunks") - 1), lambda c: F.struct(F.least(c, F.col("chunk")).alias("left"), F.greatest(c, F.col("chunk")).alias("right")))
    return dealt.withColumn("_piece", F.explode(others)).select(key, "_piece.left", "_piece.right", "chunk", *(carry or []))


def dealt_pieces(pieces: DataFrame, key: str) -> DataFrame:
    """The pieces (key, left, right), each in one partition and its rows together."""
    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pieces.repartition(n, key, "left", "right").sortWithinPartitions(key, "left", "right")


def search_pieces(pieces: DataFrame, key: str, run: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """run() on each piece (key, left, right), many to a task."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, [key, "left", "right"]):
            if group.num_rows > 1:
                yield from run(group)

    return dealt_pieces(pieces, key).mapInArrow(each, schema)


def spanning(n: int, linked: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The root of each of n nodes, by breadth-first search: linked(some, others) is a boolean matrix."""
    root, rest = np.arange(n), np.arange(n)
    while len(rest):
        start, rest = rest[0], rest[1:]
        front = np.array([start])
        while len(front) and len(rest):
            found = np.zeros(len(rest), dtype=bool)
            for at in range(0, len(front), 256):
                found |= linked(front[at : at + 256], rest).any(axis=0)
            front, rest = rest[found], rest[~found]
            root[front] = start
    return root


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, component) for each node of edges(a, b): the smallest node reachable.

    Alternating large-star and small-star rounds; each replaces the edges by at most as many, joins and
    minima are by node, and a round's edges are written to the shared folder.  Null ends are ignored."""
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for k in range(2 * most):
        if k % 2 == 0:
            both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumnRenamed("a", "_a")
            new = met(both, least, F.col("a") == F.col("_a")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            least = now.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "_a")
            new = met(now, least, F.col("a") == F.col("_a")).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        new = stage(new.where("a <> b").distinct(), "edges")
        unstage(now)
        now = new
        if k % 2:
            ends = now.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("b").alias("a"), F.lit(0).alias("up"), F.lit(1).alias("down")))
            each = ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
            # Settled if every node points once, to nodes that point nowhere.
            if not each.where("up > 1 or (up = 1 and down = 1)").limit(1).collect():
                break
    else:
        raise RuntimeError("components did not settle")
    # Stars: each node points to its smallest; the smallest is its own.
    return now.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("component")), F.struct(F.col("b").alias("node"), F.col("b").alias("component")))).alias("x")).select("x.*").distinct()
