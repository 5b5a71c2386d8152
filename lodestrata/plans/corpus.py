"""Queries of the corpus and review families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions import text as X
from lodestrata.operators import corpus
from lodestrata.operators.curation import first_of
from lodestrata.session import table


def corpus_scan(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    rows = docs.select("doc_id", F.col("lang").alias("economy"), (F.col("n_chars") > 1000).alias("evidence_eligible"), F.when(F.col("doc_id") % 4 == 0, "repealed").otherwise("in_force").alias("legal_status"))
    return corpus.scan(rows, "de")


def domain_whitelist(spark: SparkSession, d: str) -> DataFrame:
    hosts = table(spark, d, "pages").select(X.url_host(F.col("url")).alias("domain"))
    return corpus.whitelist(hosts.where("domain like '%.org'"), hosts.where("domain like 't%'").select(F.concat(F.lit("WWW."), F.upper("domain")).alias("domain")))


def fetch_checks(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    status = F.when(F.col("page_id") % 13 == 0, 403).when(F.col("page_id") % 11 == 0, 404).otherwise(200)
    return p.groupBy(corpus.blocked(status, F.col("html")).alias("blocked"), corpus.media_suffix(F.col("url"), F.when(F.col("page_id") % 5 == 0, "application/PDF")).alias("suffix")).agg(F.count("*").alias("n"))


def page_routing(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    n, images = F.length("html"), F.col("page_id") % 4 == 0
    route = corpus.page_route(n % 2000, 1 - (n % 7) / 1000.0, (n % 50) / 100.0, n % 300, n % 10, images)
    return p.groupBy(route.alias("route")).agg(F.count("*").alias("n"))


def words_to_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of twelve words, read as the runs in which the words of a text stand."""
    texts = table(spark, d, "documents").where("text is not null").select("doc_id", F.split("text", " ").alias("w"))
    runs = F.transform(F.sequence(F.lit(1), F.size("w"), F.lit(12)), lambda k: F.slice("w", k, F.lit(12)))
    words = texts.select("doc_id", F.posexplode(runs).alias("b", "words")).select("doc_id", F.col("b").cast("long").alias("block"), (F.col("b") * 12).alias("k"), "words")
    return corpus.words_to_lines(words, ["doc_id", "block"], "k", "words").select("doc_id", "block", "place", F.sha2("line", 256).alias("sha256"))


def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("version"), "o_orderkey")
    keyed = lambda part: first_of(rows.where(part), ["k"], [F.desc("version"), F.desc("o_orderkey")])
    return corpus.upsert(keyed("o_orderkey % 2 = 0"), keyed("o_orderkey % 2 = 1"), ["k"], "version")


def _units(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("economy"), F.col("l_suppkey").cast("string").alias("law"), F.col("l_partkey").cast("string").alias("section"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("unit_id"))


def graph_counts(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = corpus.derive_graph(_units(spark, d))
    return nodes.groupBy(F.col("label").alias("kind")).agg(F.count("*").alias("n")).unionByName(edges.groupBy(F.col("rel").alias("kind")).agg(F.count("*").alias("n")))


def graph_checks(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    nodes = c.where("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    edges = o.select(F.col("o_custkey").alias("src"), F.col("o_orderstatus").alias("rel"), (F.col("o_custkey") + 1).alias("dst"))
    return corpus.validate_graph(nodes, edges)


def build_pending(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", F.sha2("html", 256).alias("fingerprint"))
    return corpus.pending(p, p.where("page_id % 3 = 0"), "fingerprint").select("page_id")


def expectations_unmet(spark: SparkSession, d: str) -> DataFrame:
    part, line = table(spark, d, "part"), table(spark, d, "lineitem")
    wanted = part.select(F.col("p_partkey").alias("law"), F.substring(F.col("p_size").cast("string"), 1, 1).alias("prefix"))
    return corpus.unmet(wanted, line.select(F.col("l_partkey").alias("law"), F.col("l_quantity").cast("int").cast("string").alias("section"))).groupBy("prefix").agg(F.count("*").alias("n"))


def newest_version(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", F.struct("o_orderdate", "o_orderkey").alias("v"), "o_totalprice")
    return corpus.newest(o, "o_custkey", "v", "o_totalprice").select("o_custkey", "o_totalprice", F.col("v.o_orderkey").alias("o_orderkey"))


def ordered_lookup(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "events").select(F.col("event_id").alias("place"), (F.col("event_id") * 7).alias("o_orderkey"))
    return corpus.ordered_lookup(ids, table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")


def wildcard_approval(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    rules = spark.createDataFrame([(1, "P", "", "hold"), (2, "F", "1-URGENT", "approve"), (3, "", "5-LOW", "reject"), (4, "F", None, "approve"), (5, "", "", "queue")], "n int, status string, priority string, action string")
    return corpus.wildcard_rules(rows, rules, ["status", "priority"], "n")


def run_summary(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")
    models = F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("m"), F.col("l_linenumber").cast("string")))), ",")
    return line.groupBy("l_suppkey").agg(F.count("*").alias("rows"), F.count_if(F.col("l_returnflag") == "N").alias("new"), F.count_if(F.col("l_returnflag") == "R").alias("known"), models.alias("models"))


def first_gold_score(spark: SparkSession, d: str) -> DataFrame:
    """The first parseable score of each key, in the order of the source."""
    e = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 == 0, F.lit("n/a")).otherwise(F.col("value").cast("int").cast("string")).alias("score"))
    return e.withColumn("score", F.expr("try_cast(score as double)")).where("score is not null").groupBy("user_id").agg(F.min_by("score", "event_id").alias("score"))


def coverage_manifest(spark: SparkSession, d: str) -> DataFrame:
    """The instruments of each supplier in first-seen order with their first artifact."""
    line = table(spark, d, "lineitem").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", F.year("l_shipdate").alias("year"))
    first = first_of(line, ["l_suppkey", "year"], [F.col("l_orderkey"), F.col("l_linenumber")])
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "year"))), lambda x: F.concat_ws(":", x["year"].cast("string"), x["l_orderkey"].cast("string"))), ",")
    return first.groupBy("l_suppkey").agg(items.alias("instruments"), F.count("*").alias("n"))


def finding_numbers(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    tag = F.when(F.col("o_orderstatus") == "F", "K").when(F.col("o_orderstatus") == "O", "N").otherwise("A")
    n = F.row_number().over(Window.partitionBy(tag).orderBy("o_orderkey"))
    return o.select("o_orderkey", F.concat(tag, F.lpad(n.cast("string"), 6, "0")).alias("finding_id"))


def strongest_role(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    strength = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "signup", 2).otherwise(1)
    return first_of(e.select("user_id", "event_type", strength.alias("strength"), "event_id"), ["user_id"], [F.desc("strength"), F.col("event_id")])


def best_hints(spark: SparkSession, d: str) -> DataFrame:
    """All rows of the greatest score tuple of each group."""
    line = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    rank = F.rank().over(Window.partitionBy("l_partkey").orderBy(F.desc("l_quantity"), F.desc("l_discount")))
    return line.withColumn("r", rank).where("r = 1").drop("r")


def reviewer_independence(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.countDistinct("event_type").alias("stages"), (F.countDistinct(F.col("event_id") % 4) >= F.countDistinct("event_type")).alias("independent"))


def projection_equality(spark: SparkSession, d: str) -> DataFrame:
    """Rows of either side that the other lacks."""
    o, line = table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")).distinct()
    return o.exceptAll(line).withColumn("side", F.lit("orders")).unionByName(line.exceptAll(o).withColumn("side", F.lit("lines")))


def ordered_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_distinct(X.words(F.col("text"))), " ").alias("words"))


def recent_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "ts", "event_type")


def growth_by_month(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("since"))
    n = first.groupBy(F.date_format("since", "yyyy-MM").alias("month")).agg(F.count("*").alias("joined"))
    return n.withColumn("total", F.sum("joined").over(Window.orderBy("month")))


_W = "list_filter(regexp_split_to_array(translate(lower(text),'äçèéêíñóöüáâúîô','aceeeinoouaauio'),'[^\\p{L}\\p{N}]+'), lambda w: w <> '')"
_H = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)', 1)), '^www\\.', '')"

QUERIES = {
    "corpus_scan": (corpus_scan, "select doc_id, lang economy, true evidence_eligible, 'in_force' legal_status from documents where lang = 'de' and n_chars > 1000 and doc_id % 4 <> 0"),
    "domain_whitelist": (domain_whitelist, f"select distinct h as \"domain\" from (select {_H} h from pages) where h like '%.org' or h like 't%'"),
    "fetch_checks": (fetch_checks, "select page_id % 13 = 0 or page_id % 11 <> 0 and (regexp_matches(lower(substr(html,1,4000)),'(captcha|are you a robot)') or strlen(html) < 2000) blocked, case when contains(lower(url),'.pdf') or page_id % 5 = 0 then '.pdf' when contains(lower(url),'.epub') then '.epub' else '.html' end suffix, count(*) n from pages group by 1, 2"),
    "page_routing": (page_routing, "with n as (select length(html) n, page_id % 4 = 0 i from pages) select case when n % 2000 < 25 and i then 'SCANNED' when n % 2000 < 25 then 'REVIEW' when n % 7 > 5 then 'REVIEW' when i and n % 50 < 3 then 'MIXED' when n % 300 > 250 or n % 10 > 8 then 'NATIVE_COMPLEX' else 'NATIVE_SIMPLE' end route, count(*) n from n group by 1"),
    "words_to_lines": (words_to_lines, "with w as (select doc_id, unnest(range(len(p))) k, unnest(p) word from (select doc_id, string_split(text,' ') p from documents)) select doc_id, (k // 12)::bigint block, min(k)::int place, sha256(string_agg(word,' ' order by k)) sha256 from w group by 1, 2"),
    "upsert_latest": (upsert_latest, "select o_custkey k, o_orderdate as \"version\", o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey % 2 desc, o_orderkey desc) = 1"),
    "graph_counts": (graph_counts, "with u as (select l_returnflag e, l_suppkey l, l_partkey s, l_orderkey o, l_linenumber n from lineitem) select 'Instrument' kind, count(distinct (e,l)) n from u union all select 'Section', count(distinct (e,l,s)) from u union all select 'HAS_SECTION', count(distinct (e,l,s)) from u union all select 'Provision', count(distinct (o,n)) from u union all select 'HAS_PROVISION', count(distinct (e,l,s,o,n)) from u"),
    "graph_checks": (graph_checks, "with n as (select c_custkey id from customer where c_acctbal > 0), e as (select o_custkey src, o_orderstatus rel, o_custkey+1 dst from orders) select 'missing src' as \"check\", count(*) n from e where src not in (select id from n) union all select 'missing dst', count(*) from e where dst not in (select id from n) union all select 'duplicate node', count(*) from (select id from n group by id having count(*) > 1) union all select 'duplicate edge', count(*) from (select 1 from e group by src, rel, dst having count(*) > 1)"),
    "build_pending": (build_pending, "select page_id from pages where sha256(html) not in (select sha256(html) from pages where page_id % 3 = 0)"),
    "expectations_unmet": (expectations_unmet, "with u as (select p_partkey law, substr(p_size::varchar,1,1) prefix from part) select prefix, count(*) n from u where not exists (select 1 from lineitem where l_partkey = law and starts_with(l_quantity::int::varchar, prefix)) group by 1"),
    "newest_version": (newest_version, "select o_custkey, o_totalprice, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1"),
    "ordered_lookup": (ordered_lookup, "select o_orderkey, event_id place, o_orderstatus from events join orders on o_orderkey = event_id * 7"),
    "wildcard_approval": (wildcard_approval, "with r as (select o_orderkey id, case when o_orderstatus='P' then 1 when o_orderstatus='F' and o_orderpriority='1-URGENT' then 2 when o_orderpriority='5-LOW' then 3 when o_orderstatus='F' then 4 else 5 end::int \"rule\" from orders) select id, \"rule\", case \"rule\" when 1 then 'hold' when 2 then 'approve' when 3 then 'reject' when 4 then 'approve' else 'queue' end \"action\" from r"),
    "run_summary": (run_summary, "select l_suppkey, count(*) as \"rows\", count(*) filter (l_returnflag='N') as \"new\", count(*) filter (l_returnflag='R') known, string_agg(distinct 'm' || l_linenumber::varchar, ',' order by 'm' || l_linenumber::varchar) models from lineitem group by 1"),
    "first_gold_score": (first_gold_score, "select user_id, arg_min(trunc(value)::double, event_id) score from events where event_id % 3 <> 0 group by 1"),
    "coverage_manifest": (coverage_manifest, "with f as (select l_suppkey, year(l_shipdate) y, l_orderkey, l_linenumber from lineitem qualify row_number() over (partition by l_suppkey, year(l_shipdate) order by l_orderkey, l_linenumber) = 1) select l_suppkey, string_agg(y::varchar || ':' || l_orderkey::varchar, ',' order by l_orderkey, l_linenumber, y) instruments, count(*) n from f group by 1"),
    "finding_numbers": (finding_numbers, "with t as (select o_orderkey, case o_orderstatus when 'F' then 'K' when 'O' then 'N' else 'A' end t from orders) select o_orderkey, t || lpad((row_number() over (partition by t order by o_orderkey))::varchar, 6, '0') finding_id from t"),
    "strongest_role": (strongest_role, "select user_id, event_type, case event_type when 'purchase' then 3 when 'signup' then 2 else 1 end::int strength, event_id from events qualify row_number() over (partition by user_id order by strength desc, event_id) = 1"),
    "best_hints": (best_hints, "select l_partkey, l_orderkey, l_linenumber, l_quantity, l_discount from lineitem qualify rank() over (partition by l_partkey order by l_quantity desc, l_discount desc) = 1"),
    "reviewer_independence": (reviewer_independence, "select user_id, strftime(ts,'%Y-%m-%d') as \"day\", count(distinct event_type) stages, count(distinct event_id % 4) >= count(distinct event_type) independent from events group by 1, 2"),
    "projection_equality": (projection_equality, "select o_orderkey k, 'orders' side from orders where o_orderkey not in (select l_orderkey from lineitem) union all select distinct l_orderkey, 'lines' from lineitem where l_orderkey not in (select o_orderkey from orders)"),
    "ordered_distinct": (ordered_distinct, f"with w as (select doc_id, {_W} w from documents), u as (select doc_id, unnest(range(len(w))) k, unnest(w) x from w), f as (select doc_id, x, min(k) k from u group by 1, 2) select d.doc_id, coalesce(string_agg(x, ' ' order by k), '') words from documents d left join f using (doc_id) group by 1"),
    "recent_rows": (recent_rows, "select event_id, ts, event_type from events order by ts desc, event_id desc limit 20"),
    "growth_by_month": (growth_by_month, "with f as (select o_custkey, min(o_orderdate) s from orders group by 1), n as (select strftime(s,'%Y-%m') as \"month\", count(*) joined from f group by 1) select \"month\", joined, sum(joined) over (order by \"month\")::bigint total from n"),
}
