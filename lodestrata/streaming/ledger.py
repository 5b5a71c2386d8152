"""Streams: the decision ledger's latest state, deduplication, event-time windows and rates."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def deduplicated(events: DataFrame, key: str, at: str, delay: str = "1 day") -> DataFrame:
    """Each key once, as long as its repeats come within the delay."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def windowed(events: DataFrame, at: str, by: list[str], value: str, length: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Counts and sums by event-time window; late rows beyond the delay are dropped."""
    w = F.window(at, length)
    return events.withWatermark(at, delay).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, at: str, by: list[str], gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    s = F.session_window(at, gap)
    return events.withWatermark(at, delay).groupBy(s.alias("s"), *by).agg(F.count("*").alias("n")).select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), *by, "n")


def sliding_counts(events: DataFrame, at: str, by: list[str], length: str, slide: str, delay: str = "1 hour") -> DataFrame:
    """Counts over overlapping windows, as rate limits take them."""
    return events.withWatermark(at, delay).groupBy(F.window(at, length, slide).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


#: Folders that the followed ledger's keys are dealt into by their hash.
BUCKETS = 64


def follow_ledger(entries: DataFrame, path: str, checkpoint: str, key: str, kind: str, at: str, tie: str, correction: str) -> StreamingQuery:
    """Keeps, under path, the latest valid decisions of an append-only ledger: latest_followed().

    Of each key the state is its latest decision of each kind and its last correction, which is all that later entries
    can be judged by.  A batch merges with the state of the buckets that its keys fall into, and writes these buckets
    anew, as files of its own number; so it costs what it touches and not what was said before.  A batch that is run
    again after a failure reads the versions before it and writes the same."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(F.col(key)), F.lit(BUCKETS)).cast("int")
        dealt = batch.withColumn("_bucket", bucket)
        touched = sorted(r[0] for r in dealt.select("_bucket").distinct().collect())
        if not touched:
            return
        before = _versions(spark, path, batch, number).where(F.col("_bucket").isin(touched)).drop("_v")
        every = before.unionByName(dealt)
        last = Window.partitionBy(key, kind).orderBy(F.desc(at), F.desc(tie))
        kept = every.withColumn("_since", F.max(F.when(F.col(kind) == correction, F.col(at))).over(Window.partitionBy(key)))
        kept = kept.where((F.col(kind) == correction) | F.col("_since").isNull() | (F.col(at) > F.col("_since"))).drop("_since")
        kept = kept.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
        kept.write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/state/_v={number}")

    return entries.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, path: str, like: DataFrame, upto: int | None) -> DataFrame:
    """The state's newest rows of each bucket, of the versions before `upto`."""
    schema = type(like.schema)([*like.schema.fields]).add("_v", "long").add("_bucket", "integer")
    if upto == 0:
        return spark.createDataFrame([], schema)
    found = spark.read.schema(schema).option("basePath", f"{path}/state").option("ignoreMissingFiles", "true")
    try:
        rows = found.parquet(f"{path}/state")
    except AnalysisException:
        return spark.createDataFrame([], schema)
    rows = rows if upto is None else rows.where(F.col("_v") < upto)
    newest = rows.select("_bucket", "_v").distinct().groupBy(F.col("_bucket").alias("_b")).agg(F.max("_v").alias("_newest"))
    return rows.join(newest, (F.col("_bucket") == F.col("_b")) & (F.col("_v") == F.col("_newest"))).drop("_b", "_newest")


def latest_followed(spark: SparkSession, path: str, like: DataFrame, kind: str, correction: str) -> DataFrame:
    """The latest valid decisions that follow_ledger() keeps under path, in the columns of like."""
    return _versions(spark, path, like, None).where(F.col(kind) != correction).select(*like.columns)
