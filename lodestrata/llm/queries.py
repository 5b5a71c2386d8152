"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, license_scan, line_dedup, mixing, periodic, piece_bpe, quality, simhash, token_counts, topk, toxicity, vector_dedup, warc
from .common import fresh_path, table


def piece_model() -> str:
    """The path of the public 32k piece model."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def byte_vocabulary() -> str:
    """The path of the public byte-level 50k vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["base"])
    joined = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda x: x["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda x: x["first_word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda x: x["first_word"])).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("spans")).alias("labels"),
        # Half for any license, the rest by the share of the words that tell it.
        F.when(F.size("spans") > 0, 0.5 + 0.5 * F.col("covered") / F.col("n_words")).otherwise(0.0).alias("score"),
    )


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = piece_bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), piece_model())
    return tokens.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = warc.write(table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))
    return warc.read(spark, target).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words, of one document in ten with a tail that repeats its first words; a null doc_id changes none."""
    h, n = 0 if doc_id is None else zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(table(spark, sf_dir, "documents"), repeated_tail)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count(table(spark, sf_dir, "documents").select("doc_id", "text"), byte_vocabulary())
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.score(table(spark, sf_dir, "documents"), byte_vocabulary(), piece_model())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_toxicity, op3_vector_dedup, op4_license_scan, op5_topk, op6_simhash, op7_line_dedup, op8_mixing, op9_piece_bpe, op10_warc, op11_periodic, op12_token_counts, op13_alignment)}


_VECTORS = "select vec_id, label, {0} v from embeddings where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"
#: Links by brute force, and the smallest vec_id that recursion reaches.
OP3_SQL = f"""
with recursive v as ({_VECTORS.format("embedding::double[]")}),
good as (select vec_id, label, v, sqrt(list_dot_product(v, v)) size from v where label is not null and list_dot_product(v, v) > 0),
link as (select a.vec_id a, b.vec_id b from good a join good b on a.label = b.label and a.vec_id <> b.vec_id
  where list_dot_product(a.v, b.v) / (a.size * b.size) >= 0.98),
reach as (select a, b from link union select r.a, l.b from reach r join link l on r.b = l.a),
least as (select a, min(b) b from reach group by a),
n as (select a, count(*) n from link group by a)
select e.vec_id, coalesce(n.n, 0)::bigint n_links, least(coalesce(least.b, e.vec_id), e.vec_id)::bigint component_id, least(coalesce(least.b, e.vec_id), e.vec_id) = e.vec_id kept
from embeddings e left join n on n.a = e.vec_id left join least on least.a = e.vec_id
"""
OP5_SQL = f"""
with v as ({_VECTORS.format("list_transform(embedding, lambda x: floor(64 * x::double))")}),
s as (select q.vec_id query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int "rank", vec_id, score from s
qualify row_number() over (partition by query_id order by score desc, vec_id) <= 20
"""
#: Ten hexadecimal digits are eight of base 32.
OP10_SQL = """
with p as (select page_id, strlen(coalesce(html, ''))::bigint n, sha1(coalesce(html, '')) h from pages),
d as (select page_id, n, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 1 + 10 * (i // 8), 10))::bigint >> (35 - 5 * (i % 8))) & 31)::int + 1, 1)), '') payload_digest from p),
f as (select *, min(page_id) over (partition by payload_digest) first from d)
select page_id, n payload_bytes, payload_digest, case when page_id = first then 'response' else 'revisit' end record_type, case when page_id <> first then first end refers_to from f
"""


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that SQL can express; the tests hold the others against brute force."""
    return {"op3_vector_dedup": OP3_SQL, "op5_topk": OP5_SQL, "op10_warc": OP10_SQL}
