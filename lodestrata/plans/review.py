"""Queries of the review family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import review
from lodestrata.session import table

_CASES = ("exports are banned unless allowed", "a warrant is needed", "subject to consent", "nothing to see")


def _case(k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, _CASES)), (k % len(_CASES) + 1).cast("int"))


def _decisions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    indicator = F.element_at(F.array(*map(F.lit, ("P6-I1", "P7-I5", "P6-I2"))), (k % 3 + 1).cast("int"))
    snippet = F.when(k % 7 == 0, "not in it").when(k % 7 == 1, F.upper(_case(k))).otherwise(_case(k))
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source", (k % 5 > 0).alias("applies"), (k % 100 / 100).alias("confidence"), indicator.alias("indicator"), snippet.alias("snippet"), F.concat_ws(" ", _case(k), F.col("text")).alias("context"))


_DECIDED = "select doc_id, text, lang, source, doc_id % 5 > 0 applies, doc_id % 100 / 100 confidence, ['P6-I1','P7-I5','P6-I2'][doc_id % 3 + 1] indicator, ['exports are banned unless allowed','a warrant is needed','subject to consent','nothing to see'][doc_id % 4 + 1] said from documents"
_REASONS = f"select *, list_filter([case when doc_id % 11 = 0 and not applies then 'known-anchor-rejected' end, case when doc_id % 11 <> 0 and doc_id % 13 = 0 and not applies then 'expected-anchor-rejected' end, case when applies and doc_id % 7 = 0 and not contains(trim(regexp_replace(lower(said || ' ' || text), '\\s+', ' ', 'g')), 'not in it') then 'snippet-not-source-locatable' end, case when applies and confidence < 0.72 then 'low-confidence-positive' end, case when applies and doc_id % 11 = 0 and confidence < 0.8 then 'low-confidence-known-anchor' end, case when applies and indicator = 'P6-I1' and regexp_matches(lower(said || ' ' || text), ' unless | except |subject to|provided that') then 'ban-vs-condition-ambiguity' end, case when applies and indicator = 'P7-I5' and regexp_matches(lower(said || ' ' || text), 'warrant|court order|judicial|without consent') then 'judicial-access-ambiguity' end], lambda x: x is not null) reasons from ({_DECIDED})"


def _reasons(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    reasons = review.escalation_reasons(*map(F.col, ("applies", "confidence", "indicator", "snippet", "context")), k % 11 == 0, k % 13 == 0)
    return _decisions(spark, d).withColumn("reasons", reasons)


def escalations(spark: SparkSession, d: str) -> DataFrame:
    return _reasons(spark, d).select("doc_id", F.array_join("reasons", ",").alias("reasons"))


def escalation_counts(spark: SparkSession, d: str) -> DataFrame:
    return _reasons(spark, d).select("indicator", F.explode("reasons").alias("reason")).groupBy("indicator", "reason").agg(F.count("*").alias("n"))


def recovered_anchors(spark: SparkSession, d: str) -> DataFrame:
    anchors = table(spark, d, "labels").where("quality = 1").select("doc_id")
    out = review.recover_anchors(_decisions(spark, d), anchors, "doc_id")
    return out.select("doc_id", "applies", "confidence", "recovered", F.sha2("snippet", 256).alias("snippet_sha"))


def absence_rows(spark: SparkSession, d: str) -> DataFrame:
    """Order priorities as indicators, nations as economies."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    priorities = o.select(F.col("o_orderpriority").alias("indicator")).distinct().withColumn("regulatory", ~F.col("indicator").startswith("5"))
    nations = c.select(F.col("c_nationkey").alias("economy")).distinct()
    found = o.where("o_totalprice > 250000").join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("economy"), F.col("o_orderpriority").alias("indicator"))
    law = table(spark, d, "nation").select(F.col("n_nationkey").alias("economy"), F.col("n_name").alias("law")).where("economy % 3 > 0")
    return review.absences(nations.crossJoin(F.broadcast(priorities)), found, priorities.select("indicator").crossJoin(F.broadcast(law)))  # five priorities


def page_evidence(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    place = F.when(k % 3 == 0, F.concat(F.lit("Page "), k.cast("string"))).when(k % 3 == 1, F.lit("#pr4-"))
    fault = review.page_evidence_fault(place, F.when(k % 4 == 0, "exact").when(k % 4 == 1, "near"), k % 5 == 0)
    return table(spark, d, "pages").groupBy(fault.alias("fault")).agg(F.count("*").alias("n"))


def page_span_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order as spans of a page."""
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("double")
    spans = table(spark, d, "lineitem").select("l_orderkey", (q * 11).alias("x0"), (n * 20.0).alias("y0"), (q * 11 + F.col("l_discount") * 1000 - 20).alias("x1"), (n * 20.0 + 12).alias("y1"))
    out = review.page_metrics(spans, ["l_orderkey"], F.lit(600.0 * 800.0))
    return out.withColumn("text_area", F.round("text_area", 8))


def mean_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Tokens without a confidence don't count; an item without any has none."""
    k = F.col("event_id")
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.avg(F.when((k % 4 > 0) & (F.col("user_id") % 7 > 0), F.col("value"))), 6).alias("confidence"), F.count("*").alias("tokens"))


def restamped(spark: SparkSession, d: str) -> DataFrame:
    """Orders as provisions, customers' receipts as builds; a third of the receipts tell other counts."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("economy"), F.col("o_orderstatus").alias("fingerprint"), F.lit("g1").alias("generation"))
    counts = o.groupBy("economy", "fingerprint").agg(F.count("*").alias("n"))
    old = counts.select("economy", "fingerprint", (F.col("n") + 1).alias("unit_count"), F.lit("g0").alias("generation"))
    done = counts.where("economy % 3 > 0").select("economy", "fingerprint", F.when(F.col("economy") % 3 == 1, F.col("n")).otherwise(F.lit(0)).cast("long").alias("unit_count"), F.lit("g1").alias("generation"))
    return review.restamp(o, review.complete_build(old, done), "g2").groupBy("economy", "generation").agg(F.count("*").alias("n"))


def alignment_modes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    line = F.substring_index("text", "\n", 1)
    return docs.select("doc_id", F.array_join(F.transform(review.alignment_targets(F.when(F.col("doc_id") % 4 > 0, F.col("text")), line), lambda x: x["mode"]), ",").alias("modes"))


def failure_lines(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    return table(spark, d, "pages").select("page_id", review.failure_line(F.when(k % 2 == 0, "P6-I1"), F.when(k % 3 > 0, F.concat(F.lit("Act "), k.cast("string"))), F.when(k % 5 > 0, "not found"), F.when(k % 7 > 0, F.col("url"))).alias("line"))


def shown_properties(spark: SparkSession, d: str) -> DataFrame:
    props = F.create_map(F.lit("text"), F.col("text"), F.lit("lang"), F.col("lang"), F.lit("secret"), F.col("source"))
    kept = review.allowed_properties(props, ("text", "lang"))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(F.map_keys(kept)), ",").alias("names"), F.sha2(F.element_at(kept, "text"), 256).alias("text_sha"), F.length(review.display(F.col("text"), 1400)).cast("long").alias("shown"))


def refuter_verdicts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    found = p.select(F.col("p_brand").alias("indicator"), F.col("p_type").alias("law"), F.col("p_partkey").alias("article"), F.when(F.col("p_size") > 25, "NEW").otherwise("KNOWN").alias("tag"))
    verdicts = p.where("p_size > 20").select(F.col("p_brand").alias("indicator"), F.col("p_type").alias("law"), F.col("p_partkey").alias("article"), F.lit("v2").alias("version"), F.col("p_name").alias("verdict"), F.lit(True).alias("fresh"))
    return review.with_verdicts(found, verdicts, "v2").select("article", "tag", "usable", "verdict")


def register_ids(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    url = F.when(k % 3 > 0, F.concat(F.lit("https://www.legislation.gov.au/C"), F.lpad((k % 9000 + 1000).cast("string"), 4, "0"), F.lit("A"), F.lpad(k.cast("string"), 5, "0"), F.lit("/latest"))).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", review.title_id(url).alias("title"))


def status_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Statuses across segments, one column for each status."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    met = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    out = met.groupBy("c_mktsegment").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return out.select("c_mktsegment", *(F.coalesce(s, F.lit(0)).alias(f"n_{s.lower()}") for s in "FOP"))


def same_act_sections(spark: SparkSession, d: str) -> DataFrame:
    """The sections of each act, told once and not for each candidate."""
    sections = F.array_sort(F.collect_set("l_suppkey"))
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.size(sections).cast("long").alias("n"), F.sha2(F.array_join(sections.cast("array<string>"), ","), 256).alias("sections"))


def finding_key_map(spark: SparkSession, d: str) -> DataFrame:
    """Findings, different keys and the keys that several share, by supplier nation."""
    s, line = table(spark, d, "supplier"), table(spark, d, "lineitem")
    met = line.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("s_nationkey", F.concat_ws("|", "l_partkey", "l_suppkey").alias("key"))
    return met.groupBy("s_nationkey").agg(F.count("*").alias("findings"), F.count_distinct("key").alias("keys")).withColumn("duplicates", F.col("findings") - F.col("keys"))


def relevant_acts(spark: SparkSession, d: str) -> DataFrame:
    """Acts with a code of the list, or of a name that the gold rows have."""
    p = table(spark, d, "part")
    gold = p.where("p_size > 45").select(F.lower("p_type").alias("_gold")).distinct()
    return p.join(gold, F.lower("p_type") == F.col("_gold"), "left").where(F.col("p_brand").startswith("Brand#1") | F.col("_gold").isNotNull()).select("p_partkey")


def review_context(spark: SparkSession, d: str) -> DataFrame:
    """Queue items with their evidence, master row and score."""
    o, c, line = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "lineitem")
    evidence = line.groupBy("l_orderkey").agg(F.count("*").alias("evidence"), F.max("l_discount").alias("score"))
    met = o.where("o_orderstatus = 'O'").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(evidence, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return met.select("o_orderkey", "c_name", F.coalesce("evidence", F.lit(0)).alias("evidence"), "score")


QUERIES = {
    "escalations": (escalations, f"select doc_id, array_to_string(reasons, ',') reasons from ({_REASONS})"),
    "escalation_counts": (escalation_counts, f"select indicator, reason, count(*) n from (select indicator, unnest(reasons) reason from ({_REASONS})) group by all"),
    "recovered_anchors": (recovered_anchors, f"with g as (select distinct doc_id g from labels where quality = 1), m as (select d.*, g is not null and not applies recovered, case when doc_id % 7 = 0 then 'not in it' when doc_id % 7 = 1 then upper(said) else said end snippet from ({_DECIDED}) d left join g on g = doc_id) select doc_id, applies or recovered applies, case when recovered then least(case when confidence = 0 then 0.5 else confidence end, 0.5) else confidence end confidence, recovered, sha256(case when recovered then text else snippet end) snippet_sha from m"),
    "absence_rows": (
        absence_rows,
        "with i as (select distinct o_orderpriority indicator from orders where o_orderpriority not like '5%'), e as (select distinct c_nationkey economy from customer), f as (select distinct c_nationkey economy, o_orderpriority indicator from orders join customer on o_custkey = c_custkey where o_totalprice > 250000), l as (select n_nationkey economy, n_name law from nation where n_nationkey % 3 > 0) select economy, indicator, law, 'NO_EVIDENCE_FOUND_PENDING_REVIEW' snippet, 0.6::double confidence, law is not null configured from e cross join i anti join f using (economy, indicator) left join l using (economy)",
    ),
    "page_evidence": (page_evidence, "select case when page_id % 3 = 0 and page_id % 4 <> 0 then 'unaligned' when page_id % 5 = 0 then 'readings disagree' end fault, count(*) n from pages group by 1"),
    "page_span_metrics": (page_span_metrics, "select l_orderkey, count(*) spans, round(sum(greatest(l_discount * 1000 - 20, 0) * 12) / 480000.0, 8)::double text_area, count(distinct round_even(l_quantity::double * 11 / 40, 0)) bands from lineitem group by 1"),
    "mean_confidence": (mean_confidence, "select user_id, round(avg(value) filter (event_id % 4 > 0 and user_id % 7 > 0), 6) confidence, count(*) tokens from events group by 1"),
    "restamped": (restamped, "select o_custkey economy, case when o_custkey % 3 = 1 then 'g2' else 'g1' end generation, count(*) n from orders group by all"),
    "alignment_modes": (
        alignment_modes,
        "with n as (select doc_id, case when doc_id % 4 > 0 then trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) else '' end w, trim(regexp_replace(lower(string_split(text, chr(10))[1]), '\\s+', ' ', 'g')) u from documents) select doc_id, array_to_string(list_filter([case when length(w) >= 25 then 'canonical-context' end, case when length(u) >= 25 and (u <> w or length(w) < 25) then 'semantic-unit' end], lambda x: x is not null), ',') modes from n",
    ),
    "failure_lines": (failure_lines, "select page_id, rtrim('ACQUISITION_UNRESOLVED ' || case when page_id % 2 = 0 then 'P6-I1' else '' end || ': ' || case when page_id % 3 > 0 then 'Act ' || page_id else 'unnamed source' end || ' | ' || case when page_id % 5 > 0 then 'not found' else '' end || ' | ' || case when page_id % 7 > 0 then url else '' end, ' |') line from pages"),
    "shown_properties": (shown_properties, "select doc_id, 'lang,text' as names, sha256(substr(text, 1, 320)) text_sha, least(length(text), 1400)::bigint shown from documents"),
    "refuter_verdicts": (refuter_verdicts, "select p_partkey article, case when p_size > 25 then 'NEW' else 'KNOWN' end tag, true usable, case when p_size > 20 then p_name end verdict from part"),
    "register_ids": (register_ids, "select page_id, case when page_id % 3 > 0 then 'C' || lpad((page_id % 9000 + 1000)::varchar, 4, '0') || 'A' || lpad(page_id::varchar, 5, '0') end title from pages"),
    "status_matrix": (status_matrix, "select c_mktsegment, count(*) filter (o_orderstatus = 'F') n_f, count(*) filter (o_orderstatus = 'O') n_o, count(*) filter (o_orderstatus = 'P') n_p from orders join customer on o_custkey = c_custkey group by 1"),
    "same_act_sections": (same_act_sections, "select l_partkey, count(*) n, sha256(string_agg(l_suppkey::varchar, ',' order by l_suppkey)) sections from (select distinct l_partkey, l_suppkey from lineitem) group by 1"),
    "finding_key_map": (finding_key_map, "select s_nationkey, count(*) findings, count(distinct l_partkey || '|' || l_suppkey) keys, count(*) - count(distinct l_partkey || '|' || l_suppkey) duplicates from lineitem join supplier on l_suppkey = s_suppkey group by 1"),
    "relevant_acts": (relevant_acts, "select p_partkey from part where p_brand like 'Brand#1%' or lower(p_type) in (select lower(p_type) from part where p_size > 45)"),
    "review_context": (review_context, "select o_orderkey, c_name, coalesce(n, 0) evidence, score from orders left join customer on o_custkey = c_custkey left join (select l_orderkey, count(*) n, max(l_discount) score from lineitem group by 1) on l_orderkey = o_orderkey where o_orderstatus = 'O'"),
}
