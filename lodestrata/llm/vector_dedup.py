"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors of cosine c lie at squared distance 2 - 2c.  Rotated vectors are cut into blocks of a few
dimensions; vectors within a squared distance lie, in some block, within its proportional share.  Each
block is range-joined on a grid over its first coordinates: a vector goes to every cell that the ball of
the block's radius around it touches, so two vectors that close meet in the home cell of either."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, scratch, small_batches, stage
from .graph import bucket_pieces, components, search_pieces

COSINE = 0.98
#: Dimensions of a block, dimensions of its grid, and the side of a cell as a multiple of the radius.
BLOCK, GRID, SIDE = 8, 2, 3.0
CHUNK = 4096
_ROWS = 256
#: Guards candidates, not links, against rounding.
_SLACK = 1e-9
_EDGE = 1e-11


def rotation(dim: int) -> np.ndarray:
    """A fixed random orthogonal matrix, which spreads every difference evenly over the blocks."""
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _distances(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return (one * one).sum(axis=1)[:, None] + (two * two).sum(axis=1)[None, :] - 2 * (one @ two.T)


def _within(one: np.ndarray, two: np.ndarray, turn: np.ndarray, limit: float) -> np.ndarray:
    """Whether vectors lie within a squared distance after `turn`.  Too close to the limit for products of
    matrices, whose rounding depends on their shapes, each pair is worked out by itself, so that every piece
    in which it meets comes to the same answer."""
    d = _distances(one @ turn, two @ turn)
    found = d <= limit
    for i, j in np.argwhere(np.abs(d - limit) < _EDGE):
        own = ((one[i] - two[j])[:, None] * turn).sum(axis=0)
        found[i, j] = (own * own).sum() <= limit
    return found


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def valid(vectors: DataFrame) -> DataFrame:
    """The rows of vectors whose embedding holds finite numbers only."""
    broken = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.coalesce(~broken & (F.size("embedding") > 0), F.lit(False)))


def dimensions(vectors: DataFrame) -> list[int]:
    """The lengths of vectors, of which a table has few."""
    return sorted(r[0] for r in vectors.select(F.size("embedding").alias("d")).distinct().collect()) or [1]


def dimension(vectors: DataFrame) -> int:
    """The one length that all vectors have."""
    found = dimensions(vectors)
    if len(found) > 1:
        raise ValueError(f"vectors of different lengths: {found}")
    return found[0]


def _grid(dim: int, cosine: float) -> list[tuple[int, int, float]]:
    """(first dimension, end, share of the squared distance) of each block."""
    cuts = [(at, min(at + BLOCK, dim)) for at in range(0, dim, BLOCK)]
    return [(a, b, (2 - 2 * cosine) * (b - a) / dim + _SLACK) for a, b in cuts]


def _mix(*parts: np.ndarray) -> np.ndarray:
    key = np.zeros(len(parts[0]), dtype=np.uint64)
    for p in parts:
        key = (key ^ p.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def spread(reps: DataFrame, dim: int, cosine: float) -> DataFrame:
    """A row (key, block, home, rep, label, copies, embedding) for each block and cell that a vector goes to."""
    turn, blocks = rotation(dim), _grid(dim, cosine)
    names = ["key", "block", "home", "rep", "label", "copies", "embedding"]
    kind = dict(reps.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            turned = _unit(_matrix(batch.column("embedding"), dim)) @ turn
            label = batch.column("label").to_numpy()
            for k, (a, b, share) in enumerate(blocks):
                radius = np.sqrt(share)
                x = turned[:, a : min(a + GRID, b)]
                home, low, high = (np.floor((x + d) / (SIDE * radius)).astype(np.int64) for d in (0, -radius, radius))
                for step in np.ndindex(*(2,) * x.shape[1]):
                    own = np.flatnonzero(((np.array(step) == 0) | (high > low)).all(axis=1))
                    cell = (low + np.array(step))[own]
                    at_home = (cell == home[own]).all(axis=1)
                    key = _mix(label[own], np.full(len(own), k), *cell.T)
                    rest = [batch.column(c).take(pa.array(own)) for c in names[3:]]
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(own), k, dtype=np.int32)), pa.array(at_home), *rest], names=names)

    return reps.mapInArrow(run, f"key long, block int, home boolean, rep long, label long, copies long, embedding {kind['embedding']}")


def _linked(group: pa.Table, block: int, dim: int, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """reps, the copies each is linked with, and each one's root, for the pairs that this piece must find:
    linked, not within an earlier block's share, one at home here (the other too, or of the larger rep),
    and of different chunks if there are two."""
    blocks = _grid(dim, cosine)
    x, turn = _unit(_matrix(group.column("embedding").combine_chunks(), dim)), rotation(dim)
    rep, copies, chunk = (group.column(c).to_numpy() for c in ("rep", "copies", "chunk"))
    home = group.column("home").to_numpy(zero_copy_only=False)
    cross = group.column("left")[0] != group.column("right")[0]
    n = np.zeros(len(rep), dtype=np.int64)
    root = np.arange(len(rep))
    a, b, share = blocks[block]
    for at in range(0, len(rep), _ROWS):
        own = slice(at, at + _ROWS)
        found = _within(x[own], x, turn[:, a:b], share)
        # Searched from the smaller rep, in its home cell.
        found &= home[own][:, None] & (rep[own][:, None] < rep[None, :])
        if cross:
            found &= chunk[own][:, None] != chunk[None, :]
        rows, columns = np.flatnonzero(found.any(axis=1)), np.flatnonzero(found.any(axis=0))
        if not len(rows):
            continue
        sub = found[np.ix_(rows, columns)]
        for c, d, limit in blocks[:block]:
            sub &= ~_within(x[own][rows], x[columns], turn[:, c:d], limit)
        sub &= x[own][rows] @ x[columns].T >= cosine
        n[rows + at] += sub @ copies[columns]
        n[columns] += sub.T @ copies[rows + at]
        for i in np.flatnonzero(sub.any(axis=1)):
            met = np.unique(root[np.append(columns[sub[i]], rows[i] + at)])
            if len(met) > 1:
                root[np.isin(root, met[1:])] = met[0]
    return rep, n, root


def links(reps: DataFrame, dim: int, cosine: float = COSINE) -> DataFrame:
    """For representatives (rep, label, copies, embedding), rep and label longs: (rep, n, to).  Rows of a rep
    add up in n to the copies of the others that it is linked with; its edges to `to` connect just what the
    links connect."""
    small_batches(reps.sparkSession, 1000)
    carry = ["block", "home", "rep", "label", "copies", "embedding"]
    pieces = bucket_pieces(spread(reps, dim, cosine), "key", F.col("rep"), CHUNK, carry=carry)

    def run(group: pa.Table) -> Iterator[pa.RecordBatch]:
        # Different cells share a key only by a collision of hashes.
        block, label = group.column("block").to_numpy(), group.column("label").to_numpy()
        for k, of in {*zip(block.tolist(), label.tolist(), strict=True)}:
            own = group if (block == k).all() and (label == of).all() else group.take(pa.array(np.flatnonzero((block == k) & (label == of))))
            rep, n, root = _linked(own, k, dim, cosine)
            some = np.flatnonzero(n)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(n[some]), pa.array(rep[root[some]])], names=["rep", "n", "to"])

    return search_pieces(pieces, "key", run, "rep long, n long, to long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors of equal, non-null labels are linked if their cosine in double precision is `cosine` or more.
    n_links counts the other rows that a row is linked with; component_id is the smallest vec_id reachable.
    Vectors that are null, empty or zero, or hold null or non-finite components, or have no label, link with
    nothing and are components of their own, as is a row with a null vec_id (component_id null).  Rows with
    equal vectors and labels are compared once and linked with one another.  Vectors of different lengths
    aren't linked.  Rows that share a vec_id are counted one by one, each by its own vector.  Labels may be of
    any type that can be compared.  An empty table gives no rows.  Other columns are ignored."""
    slim = vectors.select("vec_id", "label", "embedding")
    # Minus zero equals zero.
    plain = F.transform("embedding", lambda x: F.when(x == 0, F.lit(0).cast(dict(slim.dtypes)["embedding"][6:-1])).otherwise(x))
    good = valid(slim).where(F.col("label").isNotNull() & F.exists("embedding", lambda x: x != 0)).withColumn("embedding", plain)
    # A representative has a number of its own, written with it: a vec_id may stand for several.
    groups = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    with scratch():
        reps = stage(groups.withColumn("rep", F.monotonically_increasing_id()), "vector-reps")
        slim_reps = reps.select("rep", F.xxhash64("label").alias("label"), "copies", "embedding")
        found = None
        for dim in dimensions(reps):
            some = links(slim_reps.where(F.size("embedding") == dim), dim, cosine)
            found = some if found is None else found.unionByName(some)
        found = stage(found, "vector-links")
        connected = components(found.select(F.col("rep").alias("a"), F.col("to").alias("b")))
        others = found.groupBy("rep").agg(F.sum("n").alias("n")).withColumnRenamed("rep", "_rep")
        named = reps.join(others, F.col("rep") == F.col("_rep"), "left").join(connected, F.col("rep") == F.col("node"), "left")
        named = kept(stage(named.select("label", "embedding", "first", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")), "vector-groups"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id")).withColumnRenamed("component", "_component")
    named = named.join(least, F.col("component") == F.col("_component")).select(F.col("label").alias("_label"), F.col("embedding").alias("_embedding"), "n_links", "component_id")
    met = good.join(named.hint("merge"), (F.col("label") == F.col("_label")) & (F.col("embedding") == F.col("_embedding"))).select("vec_id", "n_links", "component_id")
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.size("embedding") > 0, F.lit(False))
    broken = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists("embedding", lambda x: x != 0)
    rest = slim.where(~usable | F.coalesce(broken, F.lit(True))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return met.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
