"""Exact top-k search by distributed histogram selection.

Every query is scored against every row, block against block.  Global histograms of the scores are refined
until they tell each query's k-th score; then the scores above it, and as many at it as are missing, are
filtered out, ties going to the smaller id."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stage, unstage
from .graph import sorted_groups
from .vector_dedup import dimension, valid

K, SCALE = 20, 64
#: Rows of a block of candidates and of queries on average, and bins of a histogram.
CANDIDATES, QUERIES, BINS = 4096, 512, 256
_ROWS = 128


def _blocks(rows: DataFrame, n: int, dim: int) -> DataFrame:
    """(block, ids, matrix, most): rows(vec_id, embedding) dealt by a hash of vec_id into n blocks, each one
    row; most is the greatest length of a vector."""
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(n)).cast("int"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["block"]):
            ids = group.column("vec_id").to_numpy().astype(np.int64)
            flat = pc.list_flatten(group.column("embedding").combine_chunks()).to_numpy(zero_copy_only=False).astype(np.float64)
            x = np.floor(SCALE * flat.reshape(-1, dim))
            most = float(np.sqrt((x * x).sum(axis=1)).max())
            columns = [pa.array([group.column("block")[0].as_py()], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([x.astype("<f8").tobytes()], pa.binary()), pa.array([most])]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "ids", "matrix", "most"])

    return dealt.repartition(parts, "block").sortWithinPartitions("block", "vec_id").mapInArrow(run, "block int, ids binary, matrix binary, most double")


def _scores(row: dict, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Some queries' positions, their ids, the candidates' ids and the scores, own candidates marked as -2**62."""
    q, c = (np.frombuffer(row[k], dtype="<f8").reshape(-1, dim) for k in ("q_matrix", "c_matrix"))
    q_ids, c_ids = (np.frombuffer(row[k], dtype=np.int64) for k in ("q_ids", "c_ids"))
    for at in range(0, len(q), _ROWS):
        some = slice(at, at + _ROWS)
        got = (q[some] @ c.T).astype(np.int64)
        got[q_ids[some][:, None] == c_ids[None, :]] = -(1 << 62)
        yield np.arange(at, min(at + _ROWS, len(q))), q_ids[some], c_ids, got


def search(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """Each query's k highest scores: query_id, rank, vec_id, score.

    Components become floor(64 x); the score is the inner product.  Queries are rows where is_query holds;
    candidates are all rows but those of the query's own vec_id; equal scores go to the smaller vec_id; a
    query with fewer candidates has them all.  Rows without vec_id and vectors that are null or empty or hold
    null or non-finite components take no part.  A repeated query is answered once; repeated candidates
    count one by one.  Vectors of different lengths, and scores beyond 2**53, raise an error.  Other columns
    are ignored."""
    spark = vectors.sparkSession
    small_batches(spark, 1000)
    rows = valid(vectors.select("vec_id", "embedding", is_query.alias("_query")))
    n, n_q = rows.agg(F.count("*"), F.count_if("_query")).first()
    dim = dimension(rows)
    candidates = stage(_blocks(rows.drop("_query"), max(1, -(-n // CANDIDATES)), dim), "topk-rows")
    queries = stage(_blocks(rows.where("_query").dropDuplicates(["vec_id"]).drop("_query"), max(1, -(-n_q // QUERIES)), dim), "topk-queries")
    most = [df.agg(F.max("most")).first()[0] or 0.0 for df in (candidates, queries)]
    reach = int(most[0] * most[1]) + 1
    if reach >= 1 << 53:
        raise ValueError("scores beyond 2**53 are not exact in double precision")
    blocks = lambda df: max(1, -(-(n if df is candidates else n_q) // (CANDIDATES if df is candidates else QUERIES)))
    sides = [
        df.select(F.col("block").alias(f"{p}_block"), F.col("ids").alias(f"{p}_ids"), F.col("matrix").alias(f"{p}_matrix"), F.explode(F.sequence(F.lit(0), F.lit(blocks(other) - 1))).alias("_other"))
        for df, other, p in ((queries, candidates, "q"), (candidates, queries, "c"))
    ]

    def meet(state: DataFrame) -> DataFrame:
        """Every block of queries, with its state, with every block of candidates."""
        left = sides[0].join(state.hint("merge"), F.col("q_block") == F.col("s_block"))
        right = sides[1].withColumnRenamed("_other", "_q")
        return left.join(right.hint("merge"), (F.col("q_block") == F.col("_q")) & (F.col("_other") == F.col("c_block"))).select("q_block", "q_ids", "q_matrix", "low", "need", "c_ids", "c_matrix")

    def packed(state: DataFrame) -> DataFrame:
        """(s_block, low, need): a block's state in the order of its queries' ids; a block has a bounded
        number of queries."""
        pairs = F.array_sort(F.collect_list(F.struct("query_id", "low", "need")))
        one = state.groupBy(F.col("q_block").alias("s_block")).agg(pairs.alias("s"))
        return one.select("s_block", F.col("s.low").alias("low"), F.col("s.need").alias("need"))

    ids = queries.select("block", "ids")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                own = np.frombuffer(raw, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), block, dtype=np.int32)), pa.array(own)], names=["q_block", "query_id"])

    state = ids.mapInArrow(unpack, "q_block int, query_id long").select("q_block", "query_id", F.lit(-reach).cast("long").alias("low"), F.lit(k).cast("long").alias("need"))
    state, span = stage(state, "topk-state"), 2 * reach + 1
    while span > 1:
        width = -(-span // BINS)

        def histogram(batches: Iterator[pa.RecordBatch], span: int = span, width: int = width) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    low = np.array(row["low"], dtype=np.int64)
                    for at, q_ids, _, got in _scores(row, dim):
                        off = got - low[at][:, None]
                        inside = (off >= 0) & (off < span)
                        cell = np.arange(len(at))[:, None] * BINS + off // width
                        count = np.bincount(cell[inside], minlength=len(at) * BINS)
                        some = np.flatnonzero(count)
                        columns = [np.full(len(some), row["q_block"], dtype=np.int32), q_ids[some // BINS], (some % BINS).astype(np.int32), count[some]]
                        yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["q_block", "query_id", "bin", "n"])

        parts = meet(packed(state)).mapInArrow(histogram, "q_block int, query_id long, bin int, n long")
        sums = parts.groupBy("q_block", "query_id", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("q_block", "query_id").orderBy(F.desc("bin"))
        upto = sums.withColumn("above", F.sum("n").over(down) - F.col("n")).withColumnsRenamed({"q_block": "_block", "query_id": "_id"})
        met = state.join(upto, (F.col("q_block") == F.col("_block")) & (F.col("query_id") == F.col("_id")), "left").where(F.col("bin").isNull() | (F.col("above") < F.col("need")))
        # The lowest bin that still begins above the k-th score holds it (or the last, of too few).
        found = met.groupBy("q_block", "query_id", "low", "need").agg(F.min(F.struct("bin", "above")).alias("b"))
        new = stage(found.select("q_block", "query_id", (F.col("low") + F.coalesce("b.bin", F.lit(0)) * width).alias("low"), (F.col("need") - F.coalesce("b.above", F.lit(0))).alias("need")), "topk-state")
        unstage(state)
        state, span = new, width

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                low, need = np.array(row["low"], dtype=np.int64), np.array(row["need"], dtype=np.int64)
                for at, q_ids, c_ids, got in _scores(row, dim):
                    keep = got > low[at][:, None]
                    # Candidates stand in the order of their ids.
                    tie = got == low[at][:, None]
                    keep |= tie & (np.cumsum(tie, axis=1) <= need[at][:, None])
                    i, j = np.nonzero(keep)
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[i]), pa.array(c_ids[j]), pa.array(got[i, j])], names=["query_id", "vec_id", "score"])

    hits = meet(packed(state)).mapInArrow(select, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
