"""Queries of the matching, curation and ledger families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import hashing
from lodestrata.functions import text as X
from lodestrata.operators import curation, matching
from lodestrata.session import spread, table


def law_identity_match(spark: SparkSession, d: str) -> DataFrame:
    """Part names as laws against types as laws."""
    part = table(spark, d, "part")
    pairs = matching.law_pairs(part.select(F.concat_ws(" ", "p_type", F.lit("Act")).alias("law")), part.select(F.concat_ws(" ", F.lit("The"), F.col("p_type"), F.lit("(Amendment) Law")).alias("law")))
    return pairs


def section_base_parse(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    number = (F.col("page_id") % 900 + 1).cast("string")
    ref = F.concat(F.lit("s. "), number, F.lit("A(1)"))
    schedule = F.concat(F.lit("Schedule "), number, F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(", cl. "), number)).otherwise(""))
    return pages.select("page_id", X.section_base(ref).alias("base"), X.base_ref(ref).alias("ref"), X.section_base(schedule).alias("schedule"), X.section_base(F.concat(F.lit("Act "), F.lit(1990) + F.col("page_id") % 30)).alias("year"))


def section_ladder_join(spark: SparkSession, d: str) -> DataFrame:
    """Recorded parts as sections; each line's part stands for a child section."""
    wanted = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("section"), F.col("p_brand").alias("brand"))
    found = table(spark, d, "lineitem").select(F.concat_ws(".", F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string")).alias("section"))
    return matching.section_hits(wanted, found, []).groupBy("brand").agg(F.count("*").alias("n"), F.countDistinct("section").alias("sections"))


def _recorded(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "lineitem").where("l_returnflag = 'R'")
    return keys.select(F.col("l_partkey").alias("law"), F.col("l_suppkey").alias("section"))


def new_known_tag(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").where("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("law"), F.col("l_suppkey").alias("section"))
    return matching.tag_new_known(rows, _recorded(spark, d)).select("id", "line", "tag", F.when(F.col("known_sections").isNotNull(), F.size("known_sections").cast("long")).alias("known_sections"))


def anchor_injection(spark: SparkSession, d: str) -> DataFrame:
    line, part = table(spark, d, "lineitem"), table(spark, d, "part")
    keys = part.select(F.col("p_partkey").alias("law"))
    candidates = line.where("l_quantity > 45").select(F.col("l_partkey").alias("law")).distinct()
    anchors = part.where("p_size > 30").select((F.col("p_partkey") * 2).alias("law"))
    both, _ = matching.inject_anchors(candidates, anchors, keys, ["law"])
    return both


def anchor_holes(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    anchors = part.where("p_size > 30").select((F.col("p_partkey") * 2).alias("law"))
    keys = part.select(F.col("p_partkey").alias("law"))
    return matching.inject_anchors(keys.limit(0), anchors, keys, ["law"])[1]


def recall_adjudication(spark: SparkSession, d: str) -> DataFrame:
    line, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    anchors = orders.select(F.col("o_orderkey").alias("law"), F.when(F.col("o_orderkey") % 11 != 0, F.lit(1)).alias("section"), F.substring("o_orderpriority", 1, 1).alias("indicator"))
    emitted = line.where("l_quantity > 25").select(F.col("l_orderkey").alias("law"), F.col("l_linenumber").alias("section"), F.when(F.col("l_returnflag") == "N", "1").otherwise("2").alias("indicator"))
    corpus = line.where("l_discount > 0.02").select(F.col("l_orderkey").alias("law"), F.col("l_linenumber").alias("section"))
    return matching.adjudicate(anchors, emitted, corpus).groupBy("outcome", "failure").agg(F.count("*").alias("n"))


def recall_by_stage(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").withColumnRenamed("doc_id", "_id")
    trace = docs.join(labels, F.col("doc_id") == F.col("_id")).select("lang", "source", (F.col("n_chars") > 2000).alias("candidate"), (F.col("quality") == 1).alias("screen"), (F.col("toxic") == 1).alias("gate"))
    return matching.stage_recall(trace, "lang", "source", ["candidate", "screen", "gate"])


def acquisition_unresolved(spark: SparkSession, d: str) -> DataFrame:
    seeds = table(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    attempts = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), (F.col("o_orderstatus") == "F").alias("ok"), F.concat_ws(" ", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("detail"), F.struct("o_orderdate", "o_orderkey").alias("at"))
    return matching.unresolved(seeds, attempts, ["key"])


def ban_vs_conditional_anti(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("law"), F.when(F.col("l_suppkey") % 7 != 0, F.col("l_suppkey")).alias("section"), F.when(F.col("l_returnflag") == "R", "P6-I1").when(F.col("l_returnflag") == "A", "P6-I4").otherwise("P6-I2").alias("indicator"))
    return matching.without_conditional_bans(rows, "P6-I1", "P6-I4").groupBy("indicator").agg(F.count("*").alias("n"), F.sum("law").alias("laws"))


def curate_diverse_topk(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order's customer segment and flag; diverse by status, by value and key."""
    line = table(spark, d, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus", "l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", F.date_format("l_shipdate", "yyyy").alias("kind"))
    limit = F.when(F.col("l_returnflag") == "R", 3).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    out = curation.curate(line, ["l_suppkey", "l_returnflag"], "kind", [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], limit)
    return out.where("chosen").select("l_suppkey", "l_returnflag", "l_orderkey", "l_linenumber", "kind", "place")


def _ledger(spark: SparkSession, d: str) -> DataFrame:
    """Events as decisions: a user's day is the key, the event type tells the stage."""
    e = table(spark, d, "events")
    return e.select("event_id", F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "dd")).alias("key"), F.col("event_type").alias("stage"), "ts", F.when(F.col("value") > 20, "approved").when(F.col("value") < 3, "rejected").otherwise("open").alias("decision"), (F.col("event_id") % 5).alias("reviewer"))


_LEDGER = "ledger as (select event_id, user_id::varchar || '-' || strftime(ts,'%d') key, event_type stage, ts, case when value > 20 then 'approved' when value < 3 then 'rejected' else 'open' end decision, event_id % 5 reviewer from events)"
_LATEST = f"with {_LEDGER}, fix as (select key, max(ts) since from ledger where stage = 'error' group by key), latest as (select l.* from ledger l left join fix using (key) where stage <> 'error' and (since is null or ts > since) qualify row_number() over (partition by key, stage order by ts desc, event_id desc) = 1)"


def latest_decision_wins(spark: SparkSession, d: str) -> DataFrame:
    return curation.latest_decisions(_ledger(spark, d), "key", "stage", "ts", "event_id", "error")


def effective_review(spark: SparkSession, d: str) -> DataFrame:
    names = F.when(F.col("stage") == "click", "citation").when(F.col("stage") == "view", "mapping").otherwise("status")
    return curation.effective_review(latest_decision_wins(spark, d).withColumn("stage", names).where("stage <> 'status' or decision <> 'open'"), "key")


def first_wins_dedupe(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")
    return curation.first_of(line, ["l_partkey", "l_suppkey"], [F.col("l_orderkey"), F.col("l_linenumber")])


def decision_merge_overlay(spark: SparkSession, d: str) -> DataFrame:
    latest = _ledger(spark, d)
    cols = ["key", "decision"]
    pick = lambda kind: latest.where(F.col("stage") == kind).groupBy("key").agg(F.max("decision").alias("decision"))
    return curation.overlay(pick("signup"), pick("view"), pick("click"), ["key"], ["decision"]).select(*cols)


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderstatus").alias("subject"))


def _decisions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").cast("string").alias("key"), F.when(F.col("value") > 10, "F").otherwise("O").alias("subject"), F.when(F.col("event_type") == "view", "approved").otherwise("rejected").alias("decision"))


def replay_join(spark: SparkSession, d: str) -> DataFrame:
    return curation.replay(_decisions(spark, d), _subjects(spark, d), "key")[0]


def replay_unknown_keys(spark: SparkSession, d: str) -> DataFrame:
    return curation.replay(_decisions(spark, d), _subjects(spark, d), "key")[1].groupBy("reason").agg(F.count("*").alias("n"))


def finding_keys(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select("o_orderkey", hashing.key(F.col("o_custkey"), F.col("o_orderstatus"), F.col("o_orderpriority")).alias("finding_key"), hashing.normal_key(F.col("o_orderpriority"), F.col("o_custkey")).alias("recall_key"))


def page_slice(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return curation.page(turns, [F.col("conv_id"), F.col("turn")], 3)


def ledger_union_sorted(spark: SparkSession, d: str) -> DataFrame:
    """Two kinds of entries in one time line."""
    e = table(spark, d, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("at"))
    o = table(spark, d, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"))
    return e.unionByName(o).orderBy(F.desc("at"), "kind", "id").limit(100)


def queue_progress(spark: SparkSession, d: str) -> DataFrame:
    return _ledger(spark, d).groupBy("stage").agg(F.count_if(F.col("decision") != "open").alias("decided"), F.count("*").alias("total"))


def evidence_filters(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    some = c.where(F.lower("c_mktsegment") == "building")
    return o.join(some, F.col("o_custkey") == F.col("c_custkey"), "left_semi").where(F.startswith("o_orderpriority", F.lit("1")) & (F.lower("o_orderstatus") == "f")).select("o_orderkey", "o_totalprice")


def free_text_search(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.where(F.contains(F.lower(F.concat_ws(" ", "text", "source", "lang")), F.lit("license"))).select("doc_id", "source")


def rank_custom_order(spark: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return table(spark, d, "orders").select("o_orderkey", rank.alias("queue"), "o_totalprice").orderBy("queue", F.desc("o_totalprice"), "o_orderkey").limit(50)


def stratified_quota(spark: SparkSession, d: str) -> DataFrame:
    out = curation.quota_sample(table(spark, d, "events"), "event_type", {"click": 8, "view": 8, "error": 3}, [F.desc("value"), F.col("event_id")])
    return out.select("event_type", "event_id", "place")


def final_row_errors(spark: SparkSession, d: str) -> DataFrame:
    """All failing checks of an order in one list."""
    o = table(spark, d, "orders")
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    out = o.join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    checks = {"status": F.col("o_orderstatus") == "P", "price": F.col("o_totalprice") < 5000, "lines": F.coalesce("n", F.lit(0)) < 2, "priority": F.startswith("o_orderpriority", F.lit("5"))}
    found = F.array_compact(F.array(*(F.when(c, name) for name, c in checks.items())))
    return out.select("o_orderkey", F.array_join(found, ",").alias("errors")).where("errors <> ''")


def coverage_complete(spark: SparkSession, d: str) -> DataFrame:
    """Orders all of whose parts were found among large lines."""
    line = table(spark, d, "lineitem")
    found = line.where("l_quantity > 10").select(F.col("l_partkey").alias("_p")).distinct()
    found = spread(found, "_p", like=line)
    each = spread(line.select("l_orderkey", "l_partkey"), "l_partkey").join(found, F.col("l_partkey") == F.col("_p"), "left").groupBy("l_orderkey").agg(F.bool_and(F.col("_p").isNotNull()).alias("complete"))
    return each.groupBy("complete").agg(F.count("*").alias("n"))


QUERIES = {
    "law_identity_match": (law_identity_match, "select distinct p_type || ' Act' as \"left\", 'The ' || p_type || ' (Amendment) Law' as \"right\" from part"),
    "section_base_parse": (section_base_parse, "with n as (select page_id, (page_id % 900 + 1)::varchar n from pages) select page_id, n || 'A' base, 's. ' || n || 'a' \"ref\", 'sch' || n || case when page_id % 2 = 0 then 'cl' || n else '' end schedule, null::varchar as \"year\" from n"),
    "section_ladder_join": (section_ladder_join, "select p_brand brand, count(*) n, count(distinct p_partkey) sections from part join lineitem on l_partkey = p_partkey group by 1"),
    "new_known_tag": (new_known_tag, "with r as (select l_partkey law, list(distinct l_suppkey) s from lineitem where l_returnflag = 'R' group by 1) select l_orderkey id, l_linenumber line, case when list_contains(s, l_suppkey) then 'KNOWN' else 'NEW' end tag, len(s)::bigint known_sections from lineitem left join r on law = l_partkey where l_returnflag <> 'R'"),
    "anchor_injection": (anchor_injection, "with c as (select distinct l_partkey law from lineitem where l_quantity > 45), a as (select distinct p_partkey*2 law from part where p_size > 30) select law, false injected from c union all select p_partkey, true from part where p_partkey in (select law from a) and p_partkey not in (select law from c)"),
    "anchor_holes": (anchor_holes, "select distinct p_partkey*2 law from part where p_size > 30 and p_partkey*2 not in (select p_partkey from part)"),
    "recall_adjudication": (
        recall_adjudication,
        "with a as (select o_orderkey law, case when o_orderkey % 11 <> 0 then 1 end section, substr(o_orderpriority,1,1) ind from orders), e as (select l_orderkey law, l_linenumber section, list(distinct case when l_returnflag='N' then '1' else '2' end) u from lineitem where l_quantity > 25 group by 1,2), c as (select distinct l_orderkey law, l_linenumber section from lineitem where l_discount > 0.02), o as (select case when a.section is null then 'GOLD_REF_UNPARSEABLE' when list_contains(u, ind) then 'MATCHED' when u is not null then 'EMITTED_OTHER_INDICATOR' when c.law is not null then 'IN_CORPUS_NOT_EMITTED' else 'NOT_IN_CORPUS' end outcome from a left join e on a.law=e.law and a.section=e.section left join c on a.law=c.law and a.section=c.section) select outcome, case outcome when 'GOLD_REF_UNPARSEABLE' then 'GOLD_ERROR' when 'EMITTED_OTHER_INDICATOR' then 'MAPPING' when 'IN_CORPUS_NOT_EMITTED' then 'STRUCTURE' when 'NOT_IN_CORPUS' then 'ACQUISITION' end failure, count(*) n from o group by 1, 2",
    ),
    "recall_by_stage": (recall_by_stage, "with t as (select lang, source, bool_or(n_chars > 2000) c, bool_or(quality = 1) s, bool_or(toxic = 1) g from documents join labels using (doc_id) group by 1, 2) select lang, count(*) anchors, round(avg(c::int),4) candidate, round(avg(s::int),4) screen, round(avg(g::int),4) gate from t group by 1"),
    "acquisition_unresolved": (acquisition_unresolved, "with a as (select o_custkey key, bool_or(o_orderstatus='F') ok, arg_max(o_orderpriority || ' ' || o_orderkey::varchar, (o_orderdate, o_orderkey)) detail from orders group by 1) select c_custkey key, coalesce(detail,'never attempted') detail from customer left join a on key = c_custkey where not coalesce(ok,false)"),
    "ban_vs_conditional_anti": (ban_vs_conditional_anti, "with r as (select l_partkey law, case when l_suppkey % 7 <> 0 then l_suppkey end section, case l_returnflag when 'R' then 'P6-I1' when 'A' then 'P6-I4' else 'P6-I2' end indicator from lineitem) select indicator, count(*) n, sum(law)::bigint laws from r where indicator <> 'P6-I1' or not exists (select 1 from r x where x.indicator = 'P6-I4' and x.law = r.law and x.section is not distinct from r.section) group by 1"),
    "curate_diverse_topk": (
        curate_diverse_topk,
        "with f as (select *, strftime(l_shipdate,'%Y') kind, row_number() over (partition by l_suppkey, l_returnflag, strftime(l_shipdate,'%Y') order by l_extendedprice desc, l_orderkey, l_linenumber) = 1 f from lineitem), p as (select *, (row_number() over (partition by l_suppkey, l_returnflag order by f desc, l_extendedprice desc, l_orderkey, l_linenumber))::int place from f) select l_suppkey, l_returnflag, l_orderkey, l_linenumber, kind, place from p where place <= case l_returnflag when 'R' then 3 when 'A' then 1 else 2 end",
    ),
    "latest_decision_wins": (latest_decision_wins, f"{_LATEST} select event_id, key, stage, ts, decision, reviewer from latest"),
    "effective_review": (
        effective_review,
        f"{_LATEST}, n as (select key, case stage when 'click' then 'citation' when 'view' then 'mapping' else 'status' end st, decision, reviewer from latest), m as (select * from n where st <> 'status' or decision <> 'open'), e as (select key, bool_or(decision='rejected') no, max(decision) filter (st='citation') c, max(decision) filter (st='mapping') m, max(decision) filter (st='status') s, max(reviewer) filter (st='citation') cb, max(reviewer) filter (st='mapping') mb from m group by key) select key, case when no then 'rejected' when c='approved' and m='approved' and s='approved' and cb <> mb then 'approved' else 'pending' end state from e",
    ),
    "first_wins_dedupe": (first_wins_dedupe, "select l_partkey, l_suppkey, l_orderkey, l_linenumber, l_quantity from lineitem qualify row_number() over (partition by l_partkey, l_suppkey order by l_orderkey, l_linenumber) = 1"),
    "decision_merge_overlay": (decision_merge_overlay, f"with {_LEDGER}, p as (select stage, key, max(decision) decision from ledger group by 1, 2) select t.key, coalesce(b.decision, c.decision, t.decision) decision from (select * from p where stage='signup') t left join (select * from p where stage='click') b using (key) left join (select * from p where stage='view') c on c.key = t.key"),
    "replay_join": (replay_join, "select event_id::varchar key, case when value > 10 then 'F' else 'O' end subject, 'approved' decision from events join orders on o_orderkey = event_id where event_type = 'view' and o_orderstatus = case when value > 10 then 'F' else 'O' end"),
    "replay_unknown_keys": (replay_unknown_keys, "with m as (select case when o_orderkey is null then 'unknown key' when o_orderstatus <> case when value > 10 then 'F' else 'O' end then 'stale subject' end reason from events left join orders on o_orderkey = event_id) select reason, count(*) n from m where reason is not null group by 1"),
    "finding_keys": (finding_keys, "select o_orderkey, sha256(o_custkey::varchar || chr(31) || o_orderstatus || chr(31) || o_orderpriority) finding_key, sha256(trim(regexp_replace(lower(o_orderpriority),'\\s+',' ','g')) || '|' || o_custkey::varchar) recall_key from orders"),
    "page_slice": (page_slice, "select conv_id, turn, role, (row_number() over (order by conv_id, turn))::int as \"row\" from conversations qualify \"row\" > 100 and \"row\" <= 150"),
    "ledger_union_sorted": (ledger_union_sorted, "select * from (select 'event' kind, event_id id, ts as \"at\" from events union all select 'order', o_orderkey, o_orderdate from orders) order by \"at\" desc, kind, id limit 100"),
    "queue_progress": (queue_progress, f"with {_LEDGER} select stage, count(*) filter (decision <> 'open') decided, count(*) total from ledger group by 1"),
    "evidence_filters": (evidence_filters, "select o_orderkey, o_totalprice from orders where o_custkey in (select c_custkey from customer where lower(c_mktsegment) = 'building') and starts_with(o_orderpriority,'1') and lower(o_orderstatus) = 'f'"),
    "free_text_search": (free_text_search, "select doc_id, source from documents where contains(lower(text || ' ' || source || ' ' || lang), 'license')"),
    "rank_custom_order": (rank_custom_order, "select o_orderkey, case o_orderstatus when 'P' then 0 when 'O' then 1 else 2 end queue, o_totalprice from orders order by queue, o_totalprice desc, o_orderkey limit 50"),
    "stratified_quota": (stratified_quota, "select event_type, event_id, (row_number() over (partition by event_type order by value desc, event_id))::int place from events qualify place <= case event_type when 'click' then 8 when 'view' then 8 when 'error' then 3 else 0 end"),
    "final_row_errors": (final_row_errors, "with n as (select l_orderkey, count(*) n from lineitem group by 1), e as (select o_orderkey, array_to_string(list_filter([case when o_orderstatus='P' then 'status' end, case when o_totalprice < 5000 then 'price' end, case when coalesce(n,0) < 2 then 'lines' end, case when starts_with(o_orderpriority,'5') then 'priority' end], lambda x: x is not null), ',') errors from orders left join n on l_orderkey = o_orderkey) select * from e where errors <> ''"),
    "coverage_complete": (coverage_complete, "with f as (select distinct l_partkey p from lineitem where l_quantity > 10), e as (select l_orderkey, bool_and(p is not null) complete from lineitem left join f on p = l_partkey group by 1) select complete, count(*) n from e group by 1"),
}
