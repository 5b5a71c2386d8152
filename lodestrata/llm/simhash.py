"""SimHash near-duplicates, found through deletion-variant signatures of two segments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Guard, kept, scratch, small_batches, stage, with_columns
from .graph import bucket_pieces, components, met, search_pieces, spanning

BITS, SEGMENTS, SEED, SHINGLE = 64, 2, 42, 3
WIDTH = BITS // SEGMENTS
#: With d differing bits in all, some segment differs in at most d // SEGMENTS of them: one.
DISTANCE = 3
#: Rows of a bucket that are compared with one another at once.
CHUNK = 2048
_AT_ONCE = 1 << 15


def fingerprint(text: bytes | None) -> int:
    """A bit is set if it is set in the XXH64 of over half the word shingles; 0 for a text without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - SHINGLE + 1)
    length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.concatenate([[0], np.cumsum(length[:-1] + 1)])
    ends = starts + length
    first, last = starts[:n].tolist(), ends[min(SHINGLE, len(words)) - 1 :].tolist()
    votes, digest = np.zeros(BITS, dtype=np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, _AT_ONCE):
        some = range(at, min(n, at + _AT_ONCE))
        h = np.fromiter((digest(joined[first[i] : last[i]], SEED) for i in some), dtype=np.uint64, count=len(some))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int32)
    return int(((votes * 2 > n).astype(np.uint64) << np.arange(BITS, dtype=np.uint64)).sum())


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """docs with a column fp, a fingerprint as signed long."""
    small_batches(docs.sparkSession)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = batch.column("text").cast(pa.large_binary()).to_pylist()
        return [pa.array(np.fromiter(map(fingerprint, texts), dtype=np.uint64, count=len(texts)).view(np.int64))]

    return with_columns(docs, docs.columns, "fp long", make)


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) that connect just the fingerprints which links of at most DISTANCE bits connect.

    prints has distinct fp.  Each segment of a fingerprint is indexed whole and with each single bit struck
    out; two fingerprints whose segments differ by at most one bit share a key.  A struck-out bucket
    matters only where both values of the bit occur."""
    variants = []
    for s in range(SEGMENTS):
        value = F.shiftrightunsigned("fp", s * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1))
        variants.append(F.struct((value + F.lit(s << 40)).alias("key"), F.lit(-1).alias("bit")))
        for i in range(WIDTH):
            struck = value.bitwiseAND(F.lit(((1 << WIDTH) - 1) ^ (1 << i))) + F.lit((s << 40) | ((i + 1) << 32))
            variants.append(F.struct(struck.alias("key"), F.getbit(value, F.lit(i)).cast("int").alias("bit")))
    # Few small partitions grow by two orders here, so they are dealt out first; by a hash of fp, as Spark leaves
    # out an exchange by fp itself after an aggregate by fp, and then merges its small partitions.
    dealt = prints.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp"))
    rows = dealt.select("fp", F.explode(F.array(*variants)).alias("v")).select("v.key", "v.bit", "fp")
    useful = (F.min("bit") == -1) | (F.min("bit") < F.max("bit"))
    pieces = bucket_pieces(rows, "key", F.col("fp"), CHUNK, useful, ["fp"])

    def run(group: pa.Table) -> Iterator[pa.RecordBatch]:
        x = group.column("fp").to_numpy().view(np.uint64)
        root = spanning(len(x), lambda some, others: np.bitwise_count(x[some][:, None] ^ x[others][None, :]) <= DISTANCE)
        own = np.flatnonzero(root != np.arange(len(x)))
        if len(own):
            yield pa.RecordBatch.from_arrays([pa.array(x[own].view(np.int64)), pa.array(x[root[own]].view(np.int64))], names=["a", "b"])

    return search_pieces(pieces, "key", run, "a long, b long")


def groups(prints: DataFrame) -> DataFrame:
    """(fp, first, component, component_id) for prints(fp, first): first is the smallest doc_id of a
    fingerprint, component the smallest of all fingerprints connected with it, component_id their smallest
    doc_id, which may be null or shared by components."""
    with scratch():
        connected = components(links(prints.select("fp"))).withColumnRenamed("node", "_fp")
        named = met(prints, connected, F.col("fp") == F.col("_fp"), "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
        named = kept(stage(named, "simhash-groups"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id")).withColumnRenamed("component", "_c")
    return met(named, least, F.col("component") == F.col("_c")).select("fp", "first", "component", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, kept.

    Fingerprints of at most DISTANCE differing bits are linked; component_id is the smallest doc_id
    reachable.  Null and empty texts have fingerprint zero, which links like any other.  A row with a null
    doc_id takes part but never names a component, so component_id is null if no row reachable has one.
    Repeated rows share all columns; kept marks rows whose doc_id is component_id.  Only doc_id and text
    are read."""
    marked = stage(with_fingerprint(docs.select("doc_id", "text")).drop("text"), "simhash")
    found = groups(marked.groupBy("fp").agg(F.min("doc_id").alias("first"))).select(F.col("fp").alias("_fp"), "component_id")
    out = met(marked, found, F.col("fp") == F.col("_fp"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def keep_first(docs: DataFrame) -> DataFrame:
    """docs with one row of each component, that with the smallest doc_id, in the columns of docs; one with a
    null doc_id only where no row of the component has any.

    Null and empty texts have fingerprint zero and link like any other, so one of them all stays.  Of rows that
    tie (repeated rows, or unlike texts of one fingerprint and doc_id) any one stays.  An empty table gives no
    rows; columns of any name are kept."""
    slim = stage(with_fingerprint(docs.select("doc_id", "text")).drop("text"), "simhash")
    found = groups(slim.groupBy("fp").agg(F.min("doc_id").alias("first")))
    stays = found.where(F.col("first").eqNullSafe(F.col("component_id"))).groupBy("component", "component_id").agg(F.min("fp").alias("_fp"))
    guard = Guard(docs, ["doc_id", "text"])
    out = met(with_fingerprint(guard.df), stays, (F.col("fp") == F.col("_fp")) & F.col("doc_id").eqNullSafe(F.col("component_id")))
    return guard.restore(out.dropDuplicates(["fp"]))
