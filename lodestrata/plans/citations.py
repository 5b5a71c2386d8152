"""Queries of citations, fingerprints, proofs and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import hashing
from lodestrata.functions import text as X
from lodestrata.operators import matching, segmentation
from lodestrata.session import table


def _citation() -> Column:
    n = F.col("o_orderkey")
    return F.concat(F.lit("Section "), (n % 90 + 1).cast("string"), F.lit("A("), (n % 4 + 1).cast("string"), F.lit(")(b)"))


def citation_lists(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("o_orderkey")
    text = F.concat(F.lit("Sections "), (n % 9).cast("string"), F.lit(", "), (n % 7).cast("string"), F.lit("A and "), (n % 9).cast("string"))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(X.expand_citations(text), ",").alias("refs"))


def split_cells(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    cell = F.concat(F.col("p_name"), F.lit(" ;; "), F.col("p_brand"), F.lit("\n "), F.col("p_type"))
    return p.select("p_partkey", F.posexplode(X.split_acts(cell)).alias("place", "act"))


def markdown_cleanup(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    text = F.concat(F.lit("**See** [the page]("), F.col("url"), F.lit(") and `"), F.col("page_id").cast("string"), F.lit("`"))
    return p.select("page_id", X.strip_markdown(text).alias("plain"), F.array_join(X.markdown_urls(text), " ").alias("urls"))


def build_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    return p.select("page_id", hashing.processing_fingerprint(F.col("html"), "1.0", "statute", ["treaty", "malay"]).alias("fingerprint"))


def subject_hashes(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select("c_custkey", hashing.subject_hash({"segment": F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")), "nation": F.col("c_nationkey"), "name": F.col("c_name")}).alias("subject"))


def proof_texts(spark: SparkSession, d: str) -> DataFrame:
    """Orders as findings whose span ids are nations, some missing."""
    o, n = table(spark, d, "orders"), table(spark, d, "nation")
    findings = o.select(F.col("o_orderkey").alias("id"), F.array(F.col("o_custkey") % 30, F.col("o_orderkey") % 30).alias("span_ids"))
    return matching.proofs(findings, n.select(F.col("n_nationkey").cast("long").alias("span_id"), F.col("n_name").alias("text")))


def reading_disagreement(spark: SparkSession, d: str) -> DataFrame:
    """The numbers that a page's markup and its neighbour's disagree on."""
    p = table(spark, d, "pages")
    one, two = p.select("page_id", F.col("url").alias("text")), p.select((F.col("page_id") + 1).alias("page_id"), F.col("url").alias("text"))
    return matching.token_disagreement(one, two, ["page_id"], "[0-9]+").select("page_id", F.array_join("apart", ",").alias("apart"))


def master_audit(spark: SparkSession, d: str) -> DataFrame:
    line, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    rows = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("act"), (F.col("o_custkey") % 7 + 1).cast("int").alias("article"), F.col("o_orderpriority").alias("host"), F.when(F.col("o_orderstatus") == "P", 404).otherwise(200).alias("status"), F.when(F.col("o_orderkey") % 10 != 0, F.date_format("o_orderdate", "yyyy")).alias("years"))
    official = spark.createDataFrame([("1-URGENT",), ("2-HIGH",)], "domain string")
    return matching.audit(rows, official, line.select(F.col("l_orderkey").alias("law"), F.col("l_linenumber").alias("section"))).groupBy("check", "verdict").agg(F.count("*").alias("n"))


def grammar_choice(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("grammar")).agg(F.count("*").alias("n"))
    return segmentation.best_grammar(hits, F.lit("R"))


def contents_dropped(spark: SparkSession, d: str) -> DataFrame:
    """The turns of a conversation from the user's last one on."""
    return segmentation.after_last(table(spark, d, "conversations"), ["conv_id"], "turn", F.col("role") == "user").select("conv_id", "turn", "role")


def first_occurrences(spark: SparkSession, d: str) -> DataFrame:
    return segmentation.occurrence_distinct(table(spark, d, "events"), ["user_id"], "event_type", "event_id")


def review_needed(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")
    need = X.needs_review(1 - F.col("l_discount") * 3, F.col("l_tax") > 0.07, F.col("l_quantity") > 49, F.col("l_returnflag"))
    return line.groupBy(need.alias("review")).agg(F.count("*").alias("n"))


def usable_units(spark: SparkSession, d: str) -> DataFrame:
    unit = X.usable_unit(F.col("line"))
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.where(unit.isNotNull()).groupBy("doc_id").agg(F.count("*").alias("units"), F.sum(F.length(unit)).alias("chars"))


_COMPONENT = "select '{0}' role, count(*) filter (regexp_matches(lower(text), '(^|[^a-z]){1}')) docs from documents"

QUERIES = {
    "citation_lists": (citation_lists, "with n as (select o_orderkey, 's' || (o_orderkey % 9)::varchar a, 's' || (o_orderkey % 7)::varchar || 'A' b from orders) select o_orderkey, a || ',' || b refs from n"),
    "split_cells": (split_cells, "select p_partkey, 0::int place, p_name act from part union all select p_partkey, 1, p_brand from part union all select p_partkey, 2, p_type from part"),
    "markdown_cleanup": (markdown_cleanup, "select page_id, 'See the page and ' || page_id::varchar plain, url urls from pages"),
    "build_fingerprints": (build_fingerprints, "select page_id, sha256(sha256(html) || chr(31) || '1.0' || chr(31) || 'statute' || chr(31) || 'malay,treaty' || chr(31)) fingerprint from pages"),
    "subject_hashes": (subject_hashes, "select c_custkey, sha256('{\"name\":\"' || c_name || '\",\"nation\":' || c_nationkey::varchar || ',\"segment\":' || case when c_custkey % 3 <> 0 then '\"' || c_mktsegment || '\"' else 'null' end || '}') subject from customer"),
    "proof_texts": (proof_texts, "with a as (select o_orderkey id, 0 p, o_custkey % 30 s from orders union all select o_orderkey, 1, o_orderkey % 30 from orders) select id, coalesce(string_agg(n_name, ' ' order by p), '') proof_text, count(*) filter (n_nationkey is null) missing from a left join nation on s = n_nationkey group by 1"),
    "reading_disagreement": (reading_disagreement, "with t as (select page_id, list_distinct(regexp_extract_all(url,'[0-9]+',0)) t from pages), m as (select a.page_id, a.t x, coalesce(b.t, []) y from t a left join t b on b.page_id + 1 = a.page_id) select page_id, array_to_string(list_sort(list_concat(list_filter(x, lambda v: not list_contains(y, v)), list_filter(y, lambda v: not list_contains(x, v)))), ',') apart from m"),
    "master_audit": (master_audit, "with r as (select o_orderkey id, o_custkey % 7 + 1 article, o_orderpriority host, o_orderstatus = 'P' dead, o_orderkey % 10 = 0 undated from orders) select 'host' as \"check\", 'WARN' verdict, count(*) n from r where host not in ('1-URGENT','2-HIGH') union all select 'article', 'ERROR', count(*) from r where not exists (select 1 from lineitem where l_orderkey = id and l_linenumber = article) union all select 'link', 'ERROR', count(*) from r where dead having count(*) > 0 union all select 'timeframe', 'WARN', count(*) from r where undated having count(*) > 0"),
    "grammar_choice": (grammar_choice, "with h as (select l_orderkey doc_id, l_returnflag grammar, count(*) n from lineitem group by 1, 2) select doc_id, grammar, n from h qualify row_number() over (partition by doc_id order by n desc, (grammar = 'R') desc, grammar) = 1"),
    "contents_dropped": (contents_dropped, "with m as (select *, max(turn) filter (role = 'user') over (partition by conv_id) t from conversations) select conv_id, turn, role from m where t is null or turn >= t"),
    "first_occurrences": (first_occurrences, "select user_id, event_type, min(event_id) event_id from events group by 1, 2"),
    "review_needed": (review_needed, "select 1 - l_discount * 3 < 0.8 or l_tax > 0.07 or l_quantity > 49 review, count(*) n from lineitem group by 1"),
    "usable_units": (usable_units, "with l as (select doc_id, unnest(string_split(text, chr(10))) line from documents) select doc_id, count(*) units, sum(length(substr(line,1,20000)))::bigint chars from l where length(trim(line)) >= 30 group by 1"),
}
