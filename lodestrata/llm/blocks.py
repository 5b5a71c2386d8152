"""Documents in blocks: texts are written once, what is looked up for them comes to their blocks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from .common import delete, disposable, fresh_path, small_batches

#: Bytes of text after which a block ends (a longer text is a block of its own), and what a row counts at least.
BLOCK_BYTES, ROW_BYTES = 16 << 20, 64

Run = Callable[[pa.Table, pa.Table], pa.Table]


class Blocks:
    """docs with the columns _block and _row, as a table bucketed by _block in the shared folder.

    A block is a stretch of one input partition, so making blocks moves no text between machines.  The table
    is grouped by block, and joined with other rows by block, without an exchange of its own: only the other
    rows are shuffled."""

    def __init__(self, docs: DataFrame):
        self.spark = docs.sparkSession
        small_batches(self.spark)
        schema = StructType([*docs.schema.fields]).add("_block", LongType()).add("_row", IntegerType())

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, row, size = TaskContext.get().partitionId() << 32, 0, 0
            for batch in batches:
                blocks, rows = [], []
                for n in pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist():
                    n = max(n, ROW_BYTES)
                    if size and size + n > BLOCK_BYTES:
                        block, row, size = block + 1, 0, 0
                    blocks.append(block)
                    rows.append(row)
                    row, size = row + 1, size + n
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(blocks, pa.int64()), pa.array(rows, pa.int32())], names=schema.names)

        self.name, self.path = f"lodestrata_{uuid.uuid4().hex}", fresh_path(self.spark, "blocks")
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        docs.mapInArrow(deal, schema).write.format("parquet").option("compression", "zstd").option("path", self.path).bucketBy(buckets, "_block").saveAsTable(self.name)
        self.df = self.spark.table(self.name)
        disposable(self, self.drop)

    def drop(self) -> None:
        """Deletes the table, once nothing reads it any more."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete(self.spark, self.path)

    def map(self, columns: list[str], run: Callable[[pa.Table], pa.Table], schema: str | StructType) -> DataFrame:
        """run() on the given columns of each block, in the order of its rows."""
        return self.df.select("_block", "_row", *columns).groupBy("_block").applyInArrow(lambda t: run(t.sort_by("_row")), schema)

    def join(self, columns: list[str], other: DataFrame, run: Run, schema: str | StructType) -> DataFrame:
        """run() on the given columns of each block and on the rows of other with its _block."""
        own = self.df.select("_block", "_row", *columns).groupBy("_block")
        other = other.select(*(F.col(c).alias(c) for c in other.columns))  # it may come from this very table
        return own.cogroup(other.groupBy("_block")).applyInArrow(lambda t, o: run(t.sort_by("_row"), o), schema)

    def labelled(self, labels: DataFrame) -> DataFrame:
        """(_block, doc_id, columns of labels) of the blocks' documents with a row in labels(_id, ...)."""
        met = self.df.select("_block", "doc_id").distinct().join(labels.hint("merge"), F.col("doc_id") == F.col("_id"))
        return met.drop("_id")
