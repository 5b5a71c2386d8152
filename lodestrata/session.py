"""Sessions and tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_OWN: dict[str, str] = {}


def build(app: str = "lodestrata", master: str | None = None, **settings: str) -> SparkSession:
    """A session with UTC, ANSI arithmetic and adaptive execution; partitions are left to the cluster."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for key, value in (fixed | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where the setting is absent and all runs on one
    machine, as in tests."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = _OWN.setdefault(context.applicationId, f"file://{tempfile.mkdtemp(prefix='lodestrata-')}")
    return found.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/lodestrata/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """df written to the shared folder as Parquet and read again: its lineage ends there."""
    path = fresh_path(df.sparkSession, "staged")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a partition of spread().
SPREAD = 1 << 20


def partitions(df: DataFrame) -> int:
    """As many as keep about SPREAD rows of df in each."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // SPREAD))


def spread(df: DataFrame, *keys: str, like: DataFrame | None = None) -> DataFrame:
    """df dealt by keys over as many partitions as keep about SPREAD rows of it, or of like, in each, so that what a task
    holds does not grow with the input.  Both sides of a join must be dealt alike, or Spark deals one anew."""
    return df.repartition(partitions(df if like is None else like), *keys)
