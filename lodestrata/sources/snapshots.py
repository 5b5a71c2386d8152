"""Snapshots and decisions under a commit log: what was written counts from the moment its log entry exists.

A log is a folder of numbered entries.  An entry is created only if its number is free, so of two writers that saw the
same last number one fails and looks again.  Data are written first, under names of their own; a writer that dies
before its entry leaves the last state in force."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(Exception):
    """Another writer was faster, or what the writer expected no longer holds."""


class Log:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def entries(self) -> list[dict]:
        """The entries in their order."""
        folder = self._path("log")
        if not self._fs.exists(folder):
            return []
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(folder) if not s.getPath().getName().startswith("."))
        return [json.loads(bytes(self._read(f"log/{n}"))) for n in names]

    def _read(self, name: str) -> bytes:
        with_ = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toByteArray(with_)
        finally:
            with_.close()

    def commit(self, number: int, entry: dict) -> None:
        """Makes entry the one of this number; Conflict if there is one."""
        try:
            out = self._fs.create(self._path(f"log/{number:020d}"), False)
        except Exception as e:
            if "AlreadyExists" in str(e):
                raise Conflict(f"entry {number} is taken") from e
            raise
        try:
            out.write(bytearray(json.dumps(entry).encode()))
        finally:
            out.close()

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)


def content_hash(df: DataFrame, volatile: tuple[str, ...] = ()) -> str:
    """A hash of a table's rows, whatever their order, and of its columns but the volatile ones: the number of rows and
    two sums of parts of the rows' hashes, which tasks add up."""
    names = sorted(c for c in df.columns if c not in volatile)
    own = F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in names)), {"ignoreNullFields": "false"}), 256)
    part = lambda at: F.coalesce(F.sum(F.conv(F.substring(own, at, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string")
    told = df.select(F.concat_ws("-", F.count(F.lit(1)).cast("string"), part(1), part(16))).first()[0]
    return reduce(lambda a, b: f"{a}|{b}", names, told)


class Snapshots:
    """Imports of sets of tables, of which exactly one is active."""

    def __init__(self, spark: SparkSession, root: str):
        self.log, self.spark = Log(spark, root), spark

    def active(self) -> dict | None:
        """The last entry: hash, folder and names of the active snapshot's tables."""
        found = self.log.entries()
        return found[-1] if found else None

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.log.root}/{self.active()['folder']}/{name}")

    def take(self, tables: dict[str, DataFrame], required: tuple[str, ...] = (), volatile: tuple[str, ...] = (), keep: int = 5) -> tuple[dict, bool]:
        """Imports tables and makes them active; the entry, and whether anything was written.

        Tables that equal a kept snapshot's but for volatile columns make that one active again.  Of older snapshots
        the `keep` most recent stay.  Missing required tables raise ValueError before anything is written."""
        missing = [n for n in required if n not in tables]
        if missing:
            raise ValueError(f"missing tables: {missing}")
        entries = self.log.entries()
        known = reduce(lambda found, e: found | {e["hash"]: e}, self._kept(entries, keep), {})
        told = json.dumps({n: content_hash(df, volatile) for n, df in sorted(tables.items())}, sort_keys=True)
        if told in known:
            if entries[-1]["hash"] != told:
                self.log.commit(len(entries), known[told])
            return known[told], False
        entry = {"hash": told, "folder": f"data/{uuid.uuid4().hex}", "tables": sorted(tables)}
        for name, df in tables.items():
            df.write.parquet(f"{self.log.root}/{entry['folder']}/{name}")
        self.log.commit(len(entries), entry)
        now = [*entries, entry]
        stays = {e["folder"] for e in self._kept(now, keep)}
        for folder in {e["folder"] for e in now} - stays:
            self.log.delete(folder)
        return entry, True

    @staticmethod
    def _kept(entries: list[dict], keep: int) -> list[dict]:
        """The `keep` snapshots that were active last."""
        last = {e["folder"]: k for k, e in enumerate(entries)}
        return [entries[k] for k in sorted(last.values())[-keep:]]


# The most keys of a bulk decision, and the queue it may touch.
BULK, BULK_QUEUE = 200, "KNOWN"


class Decisions:
    """An append-only ledger(decision_id, key, subject, stage, decision, reviewer, at) in batches under a log."""

    COLUMNS = "decision_id string, key string, subject string, stage string, decision string, reviewer string, at timestamp"

    def __init__(self, spark: SparkSession, root: str):
        self.log, self.spark = Log(spark, root), spark

    def ledger(self, entries: list[dict] | None = None) -> DataFrame:
        folders = [f"{self.log.root}/{e['folder']}" for e in (self.log.entries() if entries is None else entries)]
        return self.spark.read.schema(self.COLUMNS).parquet(*folders) if folders else self.spark.createDataFrame([], self.COLUMNS)

    def latest(self, stage: str, entries: list[dict] | None = None) -> DataFrame:
        """(key, subject, token): the id of the last decision of a stage on each subject."""
        own = self.ledger(entries).where(F.col("stage") == stage)
        return own.groupBy("key", "subject").agg(F.max(F.struct("at", "decision_id")).getField("decision_id").alias("token"))

    def approve_all(self, items: DataFrame, asked: DataFrame, stage: str, reviewer: str, at: Column, ineligible: Callable[[], Column] | None = None) -> int:
        """Approves all keys of asked(key, token) among items(key, queue, subject, ...) in one stage, or none; how many.

        token is the last decision of the key's subject and stage that the reviewer saw, null for none.  Refused are
        more than BULK keys, repeated ones, keys that aren't in the queue, those that ineligible() gives a reason for,
        those of which the reviewer has decided another stage, and those whose last decision is another one now."""
        keys = asked.select("key", "token").limit(BULK + 1).collect()
        if not keys or len(keys) > BULK or len({r.key for r in keys}) < len(keys):
            raise ValueError(f"a bulk decision takes 1 to {BULK} different keys")
        entries = self.log.entries()
        reason = ineligible() if ineligible else F.lit(None).cast("string")
        mine = items.where(F.col("queue") == BULK_QUEUE).select(F.col("key").alias("_key"), "subject", reason.alias("_reason"))
        last = self.latest(stage, entries).select(F.col("key").alias("_k"), F.col("subject").alias("_s"), F.col("token").alias("_now"))
        other = self.ledger(entries).where((F.col("stage") != stage) & (F.col("reviewer") == reviewer)).select(F.col("key").alias("_ok"), F.col("subject").alias("_os")).distinct()
        met = asked.join(mine, F.col("key") == F.col("_key"), "left")
        met = met.join(last, (F.col("key") == F.col("_k")) & (F.col("subject") == F.col("_s")), "left")
        met = met.join(other, (F.col("key") == F.col("_ok")) & (F.col("subject") == F.col("_os")), "left")
        fault = (
            F.when(F.col("_key").isNull(), "unknown or in another queue")
            .when(F.col("_reason").isNotNull(), F.col("_reason"))
            .when(F.col("_ok").isNotNull(), "the reviewer has decided another stage")
            .when(~F.col("token").eqNullSafe(F.col("_now")), "a newer decision exists")
        )
        met = met.withColumn("_fault", fault)
        faults = met.where("_fault is not null").select("key", "_fault").orderBy("key").collect()
        if faults:
            stale = all(r._fault == "a newer decision exists" for r in faults)
            raise (Conflict if stale else ValueError)({r.key: r._fault for r in faults})
        made = {"decision_id": F.expr("uuid()"), "key": F.col("key"), "subject": F.col("subject"), "stage": F.lit(stage), "decision": F.lit("approved"), "reviewer": F.lit(reviewer), "at": at.cast("timestamp")}
        entry = {"folder": f"data/{uuid.uuid4().hex}", "keys": len(keys)}
        met.select(*(c.alias(n) for n, c in made.items())).write.parquet(f"{self.log.root}/{entry['folder']}")
        try:
            self.log.commit(len(entries), entry)
        except Conflict:
            self.log.delete(entry["folder"])
            raise
        return len(keys)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, byte_length, sha256) of all files below a folder, hashed where they are read."""
    root = Log(spark, path)
    base = root._fs.makeQualified(root._path("")).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_replace("path", rf"^.*?\Q{base.split(':', 1)[-1].lstrip('/')}\E/", "").alias("file"), F.col("length").alias("byte_length"), F.sha2("content", 256).alias("sha256"))


def root_hash(rows: DataFrame) -> str:
    """One hash of a manifest: of the sorted hashes of 256 groups of files, each of its sorted lines."""
    line = F.concat_ws(" ", "sha256", F.col("byte_length").cast("string"), "file")
    groups = rows.select(F.substring(F.sha2("file", 256), 1, 2).alias("g"), line.alias("line")).groupBy("g").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("line")), "\n"), 256).alias("h"))
    return groups.select(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("g", "h"))), lambda x: x["h"]), "\n"), 256)).first()[0]


def verify(rows: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """(file, fault) where the files below a folder differ from their manifest: missing, changed or unlisted."""
    now = manifest(spark, path).select(F.col("file").alias("_file"), F.col("sha256").alias("_sha"))
    met = rows.join(now, F.col("file") == F.col("_file"), "full")
    fault = F.when(F.col("_file").isNull(), "missing").when(F.col("file").isNull(), "unlisted").when(F.col("sha256") != F.col("_sha"), "changed")
    return met.select(F.coalesce("file", "_file").alias("file"), fault.alias("fault")).where("fault is not null")
