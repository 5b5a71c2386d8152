"""What the operators share: tables, staging in the shared folder, bounded Arrow batches."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only where that is
    unset and all runs on one machine, as in tests."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = f"file://{tempfile.mkdtemp(prefix='lodestrata-')}"
        found = _OWN[app]
    return found.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/lodestrata/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"


#: By identity, what is written within a scratch, held so that no other takes its identity, and how it is deleted.
_SCRATCH: list[dict[int, tuple[object, Callable[[], None]]]] = []


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """What is written within is deleted at the end, but for what kept() takes out."""
    _SCRATCH.append({})
    try:
        yield
    finally:
        for _, discard in _SCRATCH.pop().values():
            discard()


def disposable(thing: object, discard: Callable[[], None]) -> None:
    if _SCRATCH:
        _SCRATCH[-1][id(thing)] = thing, discard


def kept(thing: DataFrame) -> DataFrame:
    """thing, which outlives the scratch within which it was written and belongs to the one around it."""
    found = _SCRATCH[-1].pop(id(thing), None)
    if found and len(_SCRATCH) > 1:
        _SCRATCH[-2][id(thing)] = found
    return thing


def stage(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there, and a lost executor costs
    a reread."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    disposable(out, lambda: delete(spark, path))
    return out


def unstage(df: DataFrame) -> None:
    """Deletes what stage() wrote, once nothing reads it any more."""
    delete(df.sparkSession, df._staged_at)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds what a Python worker holds of long texts at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def with_columns(df: DataFrame, inputs: list[str], schema: str, make: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """The columns `inputs` followed by those of `schema`, which make() computes batch by batch."""
    from pyspark.sql.types import StructType

    kept = df.select(*inputs)
    added = StructType.fromDDL(schema)
    names = [*inputs, *added.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *make(batch)], names=names)

    return kept.mapInArrow(run, StructType([*kept.schema.fields, *added.fields]))


class Guard:
    """A table whose needed columns keep their names while all others stand under names of their own, so that
    columns which an operator adds can't clash with them."""

    def __init__(self, df: DataFrame, needed: list[str]):
        self.columns, self.names = df.columns, {c: c if c in needed else f"_x{k}_" for k, c in enumerate(df.columns)}
        self.df = df.select(*(F.col(f"`{c}`").alias(name) for c, name in self.names.items()))

    def restore(self, df: DataFrame, added: list[str] | None = None) -> DataFrame:
        """df in the columns and types of the table, and the added ones (which replace equal names)."""
        added = added or []
        return df.select(*(F.col(self.names[c]).alias(c) for c in self.columns if c not in added), *added)
