"""Queries over documents, pages and turns: structure, gates, scores, graphs, time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions import text as X
from lodestrata.operators import gates, graph, scoring, segmentation
from lodestrata.session import spread, table

EXCEPTIONS = "(nicht|pas|not|sin)"


def html_sections(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", F.posexplode(segmentation.html_sections(F.col("html"))).alias("section", "body"))
    return pages


def html_clean_text(spark: SparkSession, d: str) -> DataFrame:
    clean = X.clean_markup(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.sha2(clean, 256).alias("sha256"), F.length(clean).cast("long").alias("n"))


def html_links(spark: SparkSession, d: str) -> DataFrame:
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return table(spark, d, "pages").select("page_id", F.explode(links).alias("href")).groupBy("href").agg(F.countDistinct("page_id").alias("pages"), F.count("*").alias("n"))


def url_host_official(spark: SparkSession, d: str) -> DataFrame:
    """Hosts that are or lie below a listed domain."""
    host = X.url_host(F.col("url"))
    pages = table(spark, d, "pages").select("page_id", host.alias("host"))
    listed = pages.groupBy("host").count().where("count >= 2").select(F.regexp_replace("host", r"^[^.]*\.", "").alias("domain")).distinct()
    up = pages.select("page_id", F.explode(X.host_suffixes(F.col("host"))).alias("_s")).join(listed, F.col("_s") == F.col("domain"), "left_semi").select(F.col("page_id").alias("_p")).distinct()
    return pages.join(up, F.col("page_id") == F.col("_p"), "left").select("page_id", "host", F.col("_p").isNotNull().alias("official"), X.is_government(F.col("host")).alias("government"))


def domain_frequency(spark: SparkSession, d: str) -> DataFrame:
    host = X.url_host(F.col("url"))
    return table(spark, d, "pages").groupBy(F.array_join(F.slice(F.split(host, r"\."), -2, 2), ".").alias("domain"), X.is_government(host).alias("government")).agg(F.count("*").alias("n"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "line"))


def repeated_line_furniture(spark: SparkSession, d: str) -> DataFrame:
    """Pages are runs of three lines."""
    lines = _lines(spark, d).select("doc_id", F.floor(F.col("page") / 3).alias("page"), (F.col("page") % 3 / 2).alias("place"), "line")
    return segmentation.repeated_furniture(lines)


def heading_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    """Each turn with the number of the user's latest turn."""
    turns = table(spark, d, "conversations")
    return segmentation.carry_forward(turns, ["conv_id"], [F.col("turn")], F.when(F.col("role") == "user", F.col("turn"))).select("conv_id", "turn", "heading")


def segment_between_headings(spark: SparkSession, d: str) -> DataFrame:
    out = segmentation.segments(table(spark, d, "conversations"), ["conv_id"], "turn", "text", F.col("role") == "user")
    return out.select("conv_id", "segment", "first", "rows", F.sha2("body", 256).alias("body_sha"))


def span_offsets(spark: SparkSession, d: str) -> DataFrame:
    return segmentation.span_offsets(table(spark, d, "conversations"), ["conv_id"], "turn", "text").select("conv_id", "turn", "start", "end")


def neighbour_repair(spark: SparkSession, d: str) -> DataFrame:
    letter = F.when(F.col("turn") % 3 == 1, F.lit("")).otherwise(F.char(F.lit(97) + F.col("turn") % 20))
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.floor(F.col("turn") / 4).alias("number"), letter.alias("suffix"))
    return segmentation.suffix_repair(rows, ["conv_id"], "turn", "number", "suffix")


def interval_span_bind(spark: SparkSession, d: str) -> DataFrame:
    """Lines shipped within 30 days of their order: an equality join with an interval."""
    o, line = table(spark, d, "orders"), table(spark, d, "lineitem")
    within = (F.col("l_shipdate") >= F.col("o_orderdate")) & (F.col("l_shipdate") <= F.col("o_orderdate") + F.expr("interval 30 days"))
    return o.join(line, (F.col("o_orderkey") == F.col("l_orderkey")) & within).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


def reference_extract(spark: SparkSession, d: str) -> DataFrame:
    refs = F.regexp_extract_all(F.lower("url"), F.lit("/(en|fr|de|es)/([0-9]+)"), F.lit(0))
    return table(spark, d, "pages").select("page_id", F.explode(refs).alias("path"))


def gate_location(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("page_id"), F.col("page_id").cast("string")
    place = F.when(k % 5 == 0, F.concat(F.lit("#PR"), n, F.lit("a-"))).when(k % 5 == 1, F.lit("Page 4")).when(k % 5 == 2, F.lit("see #pr9")).when(k % 5 == 3, F.lit("#sc7-"))
    section = F.concat(F.lit("s. "), n, F.when(k % 2 == 0, F.lit("A(1)")).otherwise(F.lit("B")))
    return table(spark, d, "pages").select("page_id", gates.g2_location(place, X.section_base(section)).alias("g2"))


def gate_currentness(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "in_force").when(F.col("o_orderstatus") == "O", "repealed")
    date = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("undated")
    return o.groupBy(gates.g4_currentness(status, date).alias("g4")).agg(F.count("*").alias("n"))


def gate_modality(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    k = F.col("doc_id") % 7
    claim = F.when(k < 2, "the law prohibits export").when(k < 4, "a requirement").when(k == 4, "storage is mandated").otherwise("none")
    said = F.when(k == 0, "shallow mustard").when(k == 1, "Consent is Required").when(k == 2, "they May Not export").when(k == 3, "an operator may keep records")
    return docs.select("doc_id", gates.g6_modality(claim, said, F.col("text")).alias("g6"))


def gate_dangling_refs(spark: SparkSession, d: str) -> DataFrame:
    """Lines as references to parts that the supplier's list lacks."""
    line, part = table(spark, d, "lineitem"), table(spark, d, "part")
    edges = line.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    return graph.dangling(edges, part.where("p_size > 5").select(F.col("p_partkey").alias("node"))).groupBy("dst").agg(F.count("*").alias("n"))


def gate_dangling(spark: SparkSession, d: str) -> DataFrame:
    """Provisions that refer to their own act, to another one, and to sections that the act lacks."""
    k = F.col("doc_id")
    said = F.concat(F.lit("See section "), (k % 30).cast("string"), F.when(k % 3 == 0, F.lit(" of the Contracts Act.")).when(k % 3 == 1, F.lit(" of this Act.")).otherwise(F.lit("A.")), F.lit(" And Section "), (k % 7).cast("string"), F.lit(". "), F.col("text"))
    sections = F.when(k % 5 > 0, F.transform(F.sequence(F.lit(1), F.lit(20)), lambda x: x.cast("string")))
    return table(spark, d, "documents").select("doc_id", gates.g8_dangling(said, sections).alias("g8"), F.array_join(gates.g8_lost(said, sections), ",").alias("lost"))


#: Provisions for the query of the seventh gate, which the documents don't hold by themselves.
PROVISIONS = (
    "An organisation must not transfer any personal data to a place outside the country except as prescribed.",
    "An organisation may transfer personal data outside the country.",
    "A company must retain every record for at least 5 years.",
    "The Registrar need only keep a former name in the register for 5 years.",
    "An employer shall keep the records of employees.",
    "A provider must maintain its servers within the country as a condition of its licence.",
    "An authorised officer may search computer data under a warrant issued by a magistrate.",
    "The Attorney-General may issue a warrant authorising access to computer data.",
    "Every register of documents must be kept at the local office.",
)
INDICATORS = ("P6-I1", "P6-I2", "P6-I3", "P6-I4", "P7-I3", "P7-I5", "P7-I1")


def gate_fit(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    said = F.element_at(F.array(*map(F.lit, PROVISIONS)), (k % len(PROVISIONS) + 1).cast("int"))
    indicator = F.element_at(F.array(*map(F.lit, INDICATORS)), (k % len(INDICATORS) + 1).cast("int"))
    law = F.when(k % 11 == 0, "Data Bill 2024").otherwise("Data Billing Act")
    return table(spark, d, "documents").select("doc_id", gates.g7_fit(indicator, said, F.col("text"), law).alias("g7"))


def gate_overall(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    one = gates.g1_contained(F.substring("text", 5, 40), F.col("text"))
    two = F.when(F.lower("text").rlike("license"), "WARN").otherwise("PASS")
    three = F.when(F.col("lang") == "es", "FAIL").otherwise("PASS")
    return docs.groupBy(gates.overall(one, two, three).alias("overall")).agg(F.count("*").alias("n"))


def score_band(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels")
    votes = [F.col("quality").cast("double"), F.col("toxic").cast("double"), (F.col("doc_id") % 3 / 2.0).cast("double")]
    band = scoring.score_band(votes, (F.col("doc_id") % 2).cast("double"), F.when(F.col("doc_id") % 5 != 0, F.col("quality").cast("double")))
    return labels.select("doc_id", *(c.alias(k) for k, c in band.items()))


def agreement_alpha(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels")
    return scoring.nominal_alpha(labels.select(F.col("doc_id").alias("unit"), F.col("quality").alias("value")).unionByName(labels.where("doc_id % 9 <> 0").select(F.col("doc_id").alias("unit"), (1 - F.col("toxic")).alias("value"))))


def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_type", F.when(F.col("value") > 1, F.col("value") > 15).alias("against"))
    return scoring.majority(e, ["user_id", "event_type"], F.col("against"))


def ops_stats(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").withColumnRenamed("doc_id", "_id")
    met = docs.join(labels, F.col("doc_id") == F.col("_id"), "left")
    return met.groupBy("lang", "source").agg(F.count("*").alias("units"), F.count_if(F.col("quality") == 1).alias("eligible"), F.round(F.avg("quality"), 4).alias("confidence"), F.max("n_chars").alias("longest"))


def status_histogram(spark: SparkSession, d: str) -> DataFrame:
    return scoring.histogram(table(spark, d, "orders"), ["o_orderpriority"], "o_orderstatus")


def cost_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Lines as model calls: quantity and prices as tokens; totals by flag and overall."""
    line = table(spark, d, "lineitem")
    cost = scoring.token_cost(F.col("l_extendedprice"), F.col("l_quantity") * 100, F.col("l_quantity"), 1 + F.col("l_tax"), 2 + F.col("l_discount"), F.col("l_linestatus") == "F")
    return line.withColumn("cost", cost).rollup("l_returnflag").agg(F.count("*").alias("calls"), F.round(F.sum("cost"), 4).alias("cost"))


def revenue_by_month(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_totalprice > 0")
    return o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.round(F.sum("o_totalprice"), 2)).select("month", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))


def graph_two_hop(spark: SparkSession, d: str) -> DataFrame:
    """From region 0 over nations to customers."""
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    edges = n.select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst")).unionByName(c.select(F.concat(F.lit("n"), "c_nationkey").alias("src"), F.concat(F.lit("c"), "c_custkey").alias("dst")))
    nodes = graph.expand(edges, spark.createDataFrame([("r0",)], "node string"), 2)
    return nodes.groupBy("hop").agg(F.count("*").alias("nodes")).unionByName(graph.induced(edges, nodes).agg(F.lit(-1).alias("hop"), F.count("*").alias("nodes")))


def graph_path_match(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    found = graph.paths(c.select(F.col("c_nationkey").alias("src"), F.col("c_custkey").alias("dst")), o.select(F.col("o_custkey").alias("src"), F.col("o_orderpriority").alias("dst")))
    return found.groupBy("a", "c").agg(F.count("*").alias("paths"))


def cross_reference_edges(spark: SparkSession, d: str) -> DataFrame:
    """Links of a page to pages whose host begins with the word they name."""
    refs = F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))
    pages = table(spark, d, "pages")
    edges = pages.select(F.col("page_id").alias("src"), F.explode(F.array_distinct(refs)).alias("word"))
    host = pages.select(F.col("page_id").alias("dst"), F.element_at(F.split(X.url_host(F.col("url")), r"\."), 1).alias("_w"))
    return edges.join(host, F.col("word") == F.col("_w")).select("src", "word", "dst")


def json_props(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").groupBy(k.alias("k"), "event_type").agg(F.count("*").alias("n"))


def sliding_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user beyond 3 within the hour before."""
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("at").rangeBetween(-3600, 0)
    return table(spark, d, "events").select("event_id", "user_id", at.alias("at")).withColumn("n", F.count("*").over(w)).where("n > 3").select("event_id", "user_id", "n")


def tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    day = F.window(F.col("ts").cast("timestamp"), "1 day")
    return table(spark, d, "events").groupBy(day.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def session_counts(spark: SparkSession, d: str) -> DataFrame:
    s = F.session_window(F.col("ts").cast("timestamp"), "30 minutes")
    each = table(spark, d, "events").groupBy(s, "user_id").agg(F.count("*").alias("n"))
    return each.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def unicode_metrics(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.round(X.unicode_quality(F.col("text")), 6).alias("quality"), X.legal_function(F.col("text")).alias("kind"), X.open_ending(F.col("text")).alias("ending"))


def cer_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Character and word error rates of each whole text against a reading of it that takes rn for m, 1 for l, and loses
    full stops.

    What a text costs is long beside its reading, so texts are dealt over all tasks, however few row groups hold them."""
    reading = F.translate(F.replace("text", F.lit("m"), F.lit("rn")), "l.", "1")
    rates = X.error_rates(reading, F.col("text"))
    share = lambda edits, of: F.round(F.coalesce(F.col(edits), F.lit(0)) / F.greatest(F.coalesce(F.col(of), F.lit(0)), F.lit(1)), 6)
    docs = spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id").select("doc_id", *(c.alias(k) for k, c in rates.items()))
    return docs.select("doc_id", share("char_edits", "chars").alias("cer"), share("word_edits", "words").alias("wer"))


def snippet_closure(spark: SparkSession, d: str) -> DataFrame:
    """Passages of labelled rules written from a document's words (all of them for every other document), found again
    from fragments: of a rule, of a list's introduction and item, of a note, of an open end, and of nothing."""
    k = F.col("doc_id")
    words = F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z]+", " "), " "), lambda w: w != "")
    w = F.array_join(F.when(k % 2 == 0, words).otherwise(F.slice(words, 1, 30)), " ")
    source = F.concat(F.lit("Heading words (1) The officer may "), w, F.lit(" for it. (2) A separate rule "), w, F.lit(" where: (a) it is late. (b) it is so; and (c) it ends. Note 1 says so. Tail of (it and"))
    snippet = F.element_at(F.array(*map(F.lit, ("Officer may", "A  separate rule", "Note 1 says", "Tail of", "zz missing", "it is late"))), (F.floor(k / 2) % 6 + 1).cast("int"))
    rows = table(spark, d, "documents").select("doc_id", snippet.alias("snippet"), source.alias("source"))
    return segmentation.closure(rows).select("doc_id", "code", "start", "end")


CLOSURE_SQL = """with d as (select doc_id, list_filter(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' '), lambda w: w <> '') w from documents),
w as (select doc_id, doc_id // 2 % 6 k, array_to_string(case when doc_id % 2 = 0 then w else list_slice(w, 1, 30) end, ' ') w from d),
p as (select doc_id, k, 14 a, 14 + length('(1) The officer may ' || w || ' for it.') b, 14 + length('(1) The officer may ' || w || ' for it. (2) A separate rule ' || w || ' where: (a) it is late. (b) it is so; and (c) it ends.') c from w),
s as (select *, case k when 0 then a when 1 then b + 1 when 2 then c + 1 when 3 then c + 17 when 5 then b + 1 end s, case k when 0 then b when 1 then c when 2 then c + 16 when 3 then c + 32 when 5 then c end e from p)
select doc_id, case when k = 4 then 'FAIL_UNBALANCED_STRUCTURE' when k = 3 then 'FAIL_DANGLING_CONNECTOR' when e - s > 3000 then 'FAIL_CLOSURE_OVER_HARD_LIMIT' when e - s > 700 then 'PASS_LONG_BUT_CLOSED' else 'PASS_CLOSED' end code, s::int "start", e::int "end" from s"""


def section_parse(spark: SparkSession, d: str) -> DataFrame:
    """The running numbers of a conversation's turns as headings, some out of order."""
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), (F.length("text") % 60).cast("int").alias("number"), F.when(F.length("text") % 7 == 0, "A").otherwise("").alias("suffix"))
    return segmentation.monotonic_sections(rows)


def page_window_bind(spark: SparkSession, d: str) -> DataFrame:
    """Two turns joined as a unit, searched in windows of a conversation's turns."""
    turns = table(spark, d, "conversations")
    nxt = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    units = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("unit_id"), F.col("conv_id").alias("volume"), F.concat_ws(" ", "text", nxt).alias("text"))
    return segmentation.page_windows(units, turns.select(F.col("conv_id").alias("volume"), F.col("turn").alias("page"), "text"))


_TAGS = "trim(regexp_replace(regexp_replace({0}, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"
_HOST = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)', 1)), '^www\\.', '')"
_GOV = "(regexp_matches(h,'(^|\\.)gov(\\.[a-z]{2})?$') or regexp_matches(h,'(^|\\.)(parliament|legislation)\\.'))"

WINDOW_SQL = """with t as (select conv_id, turn, text, row_number() over (partition by conv_id order by turn) i, lead(text) over (partition by conv_id order by turn) nxt from conversations),
u as (select conv_id * 1000 + turn unit_id, conv_id volume, concat_ws(' ', text, nxt) text from t),
w as (select a.conv_id, a.i, n, string_agg(b.text, ' ' order by b.i) txt, min(b.turn) f, max(b.turn) l from t a, range(1, 7) r(n), t b where a.conv_id = b.conv_id and b.i >= a.i and b.i < a.i + n group by all having count(*) = n)
select unit_id, volume, f "first", l "last" from u join w on volume = conv_id and contains(txt, text) qualify row_number() over (partition by unit_id order by n, i) = 1"""

QUERIES = {
    "html_sections": (html_sections, f"with s as (select page_id, regexp_extract_all(html, '(?s)<p(?:\\s[^>]*)?>(.*?)</p>', 1) p from pages) select page_id, (i-1)::int section, {_TAGS.format('p[i]')} body from (select page_id, p, unnest(range(1, len(p)+1)) i from s)"),
    "html_clean_text": (html_clean_text, "with c as (select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html,'<[^>]*>',' ','g'),'&lt;','<'),'&gt;','>'),'&quot;','\"'),'&#39;',''''),'&nbsp;',' '),'&amp;','&'),'[\\s\\x{00A0}\\x{2009}\\x{202F}]+',' ','g')) t from pages) select page_id, sha256(t) sha256, length(t)::bigint n from c"),
    "html_links": (html_links, "with l as (select page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) href from pages) select href, count(distinct page_id) pages, count(*) n from l group by 1"),
    "url_host_official": (url_host_official, f"with p as (select page_id, {_HOST} h from pages), d as (select distinct regexp_replace(h,'^[^.]*\\.','') dom from (select h from p group by h having count(*) >= 2)) select page_id, h host, exists (select 1 from d where h = dom or ends_with(h, '.' || dom)) official, {_GOV} government from p"),
    "domain_frequency": (domain_frequency, f"with p as (select {_HOST} h from pages) select array_to_string(string_split(h,'.')[-2:], '.') \"domain\", {_GOV} government, count(*) n from p group by 1, 2"),
    "repeated_line_furniture": (repeated_line_furniture, "with l0 as (select doc_id, unnest(range(len(p))) k, unnest(p) line from (select doc_id, string_split(text, chr(10)) p from documents)), l as (select doc_id, k // 3 pg, k % 3 k, line from l0), m as (select doc_id, pg, trim(regexp_replace(regexp_replace(lower(line),'[0-9]+','#','g'),'\\s+',' ','g')) print from l where k <> 1), t as (select doc_id, count(distinct pg) total from l group by 1) select m.doc_id, print, count(distinct pg) pages from m join t on t.doc_id = m.doc_id where print <> '' group by 1, 2, total having count(distinct pg) >= greatest(2, ceil(total*0.3))"),
    "heading_carry_forward": (heading_carry_forward, "select conv_id, turn, last_value(case when role='user' then turn end ignore nulls) over (partition by conv_id order by turn rows unbounded preceding) heading from conversations"),
    "segment_between_headings": (segment_between_headings, "with s as (select *, sum((role='user')::int) over (partition by conv_id order by turn rows unbounded preceding)::bigint segment from conversations) select conv_id, segment, min(turn) as \"first\", count(*) as \"rows\", sha256(string_agg(text, chr(10) order by turn)) body_sha from s group by 1, 2"),
    "span_offsets": (span_offsets, "select conv_id, turn, coalesce(s,0)::bigint as start, (coalesce(s,0)+length(text))::bigint as \"end\" from (select conv_id, turn, text, sum(length(text)+1) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) s from conversations)"),
    "neighbour_repair": (neighbour_repair, "with r as (select conv_id, turn, floor(turn/4)::bigint number, case when turn % 3 = 1 then '' else chr((97 + turn % 20)::int) end suffix from conversations), w as (select *, lag(suffix) over x b, lead(suffix) over x a, lag(number) over x nb, lead(number) over x na from r window x as (partition by conv_id order by turn)) select conv_id, turn, number, suffix, case when suffix = '' and nb = number and na = number and b <> '' and a <> '' and unicode(a) - unicode(b) = 2 then chr(unicode(b)+1) else suffix end repaired from w"),
    "interval_span_bind": (interval_span_bind, "select o_orderpriority, count(*) n from orders join lineitem on o_orderkey = l_orderkey and l_shipdate between o_orderdate and o_orderdate + interval 30 days group by 1"),
    "reference_extract": (reference_extract, "select page_id, unnest(regexp_extract_all(lower(url), '/(en|fr|de|es)/([0-9]+)', 0)) path from pages"),
    "gate_location": (gate_location, "with p as (select page_id, page_id::varchar || case when page_id % 2 = 0 then 'a' else 'b' end b, coalesce(case page_id % 5 when 0 then '#pr' || page_id || 'a-' when 1 then 'page 4' when 2 then 'see #pr9' when 3 then '#sc7-' end, '') p from pages) select page_id, case when starts_with(p,'#pr') or starts_with(p,'#sc') then case when contains(p,b) then 'PASS' else 'FAIL' end when contains(p,'page') or contains(p,'vol') then 'PASS' else 'WARN' end g2 from p"),
    "gate_currentness": (gate_currentness, "select case when o_orderstatus = 'P' then 'WARN' when o_orderstatus <> 'F' then 'FAIL' when o_orderkey % 2 <> 0 then 'WARN' else 'PASS' end g4, count(*) n from orders group by 1"),
    "gate_modality": (gate_modality, "select doc_id, case when doc_id % 7 in (0,3,4) and not regexp_matches(lower(substr(text,1,1500)),'\\bmust\\b|\\bshall\\b|is required|are required|\\bmay not\\b') then 'WARN' else 'PASS' end g6 from documents"),
    "gate_dangling_refs": (gate_dangling_refs, "select l_partkey dst, count(*) n from lineitem where l_partkey not in (select p_partkey from part where p_size > 5) group by 1"),
    "gate_dangling": (
        gate_dangling,
        "with r as (select doc_id k, lower(substr('See section ' || (doc_id % 30) || case doc_id % 3 when 0 then ' of the Contracts Act.' when 1 then ' of this Act.' else 'A.' end || ' And Section ' || (doc_id % 7) || '. ' || text, 1, 3000)) t from documents), o as (select k, list_filter(list_distinct([case when k % 3 = 1 then (k % 30)::varchar when k % 3 = 2 then (k % 30) || 'A' end, (k % 7)::varchar] || list_transform(regexp_extract_all(substr(t, strpos(t, ' and section ') + 14), 'section\\s+(\\d{1,3}[a-z]{0,2})', 1), lambda x: upper(x))), lambda s: s is not null and not list_contains(list_transform(range(1, 21), lambda x: x::varchar), s)) l from (select k, t from r)) select k doc_id, case when k % 5 > 0 and len(l) > 0 then 'WARN' else 'PASS' end g8, case when k % 5 > 0 then array_to_string(list_sort(l), ',') else '' end lost from o",
    ),
    "gate_fit": (gate_fit, None),
    "gate_overall": (gate_overall, "with g as (select trim(substr(text,5,40)) <> '' and contains(trim(regexp_replace(lower(text),'\\s+',' ','g')), trim(regexp_replace(lower(substr(text,5,40)),'\\s+',' ','g'))) a, contains(lower(text),'license') b, lang from documents) select case when not a or lang='es' then 'FAIL' when b then 'WARN' else 'PASS' end overall, count(*) n from g group by 1"),
    "score_band": (score_band, "with v as (select doc_id, quality::double q, toxic::double t, (doc_id % 3 / 2.0)::double m, (doc_id % 2)::double o, case when doc_id % 5 <> 0 then quality::double end g from labels) select doc_id, least(o,q,t,m) low, greatest(o,q,t,m) high, greatest(o,q,t,m)-least(o,q,t,m) spread, abs(o-g) divergence, greatest(o,q,t,m)-least(o,q,t,m) >= 0.5 or coalesce(o<>g,false) review from v"),
    "agreement_alpha": (agreement_alpha, "with r as (select doc_id u, quality v from labels union all select doc_id, 1-toxic from labels where doc_id % 9 <> 0), c as (select u, v, count(*) n from r group by 1,2), s as (select u, sum(n) m, sum(n*n) q from c group by 1), a as (select sum((m*m-q)/(m-1)) filter (m>1) apart, sum(m) filter (m>1) paired, count(*) units from s), e as (select sum(n) t, sum(n*n) q from (select v, count(*) n from r group by 1)) select round(1-(apart/paired)/((t*t-q)/(t*(t-1))),3)::double alpha, units, t::bigint ratings from a, e"),
    "majority_vote": (majority_vote, "with v as (select user_id, event_type, case when value > 1 then value > 15 end a from events), n as (select user_id, event_type, count(*) filter (a) refuted, count(a) votes from v group by 1,2) select *, case when refuted >= 2 then 'RECOMMEND-REJECT' when refuted = 0 then 'RECOMMEND-KEEP' else 'SPLIT-REVIEW' end verdict from n"),
    "ops_stats": (ops_stats, "select lang, source, count(*) units, count(*) filter (quality=1) eligible, round(avg(quality),4) confidence, max(n_chars) longest from documents left join labels using (doc_id) group by 1,2"),
    "status_histogram": (status_histogram, "with n as (select o_orderpriority, coalesce(o_orderstatus,'') v, count(*) n from orders group by 1,2) select o_orderpriority, string_agg(v || ':' || n::varchar, ',' order by v || ':' || n::varchar) hist from n group by 1"),
    "cost_rollup": (cost_rollup, "with c as (select l_returnflag, l_extendedprice i, least(l_quantity*100, l_extendedprice) k, l_quantity o, 1+l_tax p, 2+l_discount q, l_linestatus='F' b from lineitem), t as (select l_returnflag, ((i-k)*p + k*p*0.1::double + o*q)/1e6 * case when b then 0.5::double else 1 end cost from c) select l_returnflag, count(*) calls, round(sum(cost),4) cost from t group by rollup(l_returnflag)"),
    "revenue_by_month": (revenue_by_month, "select strftime(o_orderdate,'%Y-%m') as \"month\", round(sum(o_totalprice) filter (o_orderstatus='F'),2) f, round(sum(o_totalprice) filter (o_orderstatus='O'),2) o, round(sum(o_totalprice) filter (o_orderstatus='P'),2) p from orders where o_totalprice > 0 group by 1"),
    "graph_two_hop": (graph_two_hop, "with n as (select * from nation where n_regionkey = 0), c as (select * from customer where c_nationkey in (select n_nationkey from n)) select 0::int hop, 1::bigint nodes union all select 1, (select count(*) from n) union all select 2, (select count(*) from c) union all select -1, (select count(*) from n) + (select count(*) from c)"),
    "graph_path_match": (graph_path_match, "select c_nationkey a, o_orderpriority c, count(distinct c_custkey) paths from customer join orders on o_custkey = c_custkey group by 1, 2"),
    "cross_reference_edges": (cross_reference_edges, f"with e as (select distinct page_id src, unnest(regexp_extract_all(html,'href=\"/([^\"]*)\"',1)) word from pages), h as (select page_id dst, string_split({_HOST},'.')[1] w from pages) select src, word, dst from e join h on word = w"),
    "json_props": (json_props, "select (props->>'$.k')::bigint k, event_type, count(*) n from events group by 1, 2"),
    "sliding_rate_limit": (sliding_rate_limit, "with e as (select event_id, user_id, epoch(date_trunc('second', ts))::bigint a from events), n as (select event_id, user_id, count(*) over (partition by user_id order by a range between 3600 preceding and current row) n from e) select event_id, user_id, n from n where n > 3"),
    "tumbling_counts": (tumbling_counts, "select strftime(ts,'%Y-%m-%d') as \"day\", event_type, count(*) n, round(sum(value),4) total from events group by 1, 2"),
    "session_counts": (session_counts, "with g as (select user_id, ts, case when ts - lag(ts) over w < interval 30 minutes then 0 else 1 end f from events window w as (partition by user_id order by ts)), s as (select user_id, sum(f) over (partition by user_id order by ts rows unbounded preceding) s from g), c as (select user_id, s, count(*) n from s group by 1, 2) select user_id, count(*) sessions, max(n) longest from c group by 1"),
    "unicode_metrics": (unicode_metrics, None),
    "cer_metrics": (cer_metrics, None),
    "snippet_closure": (snippet_closure, CLOSURE_SQL),
    "section_parse": (section_parse, None),
    "page_window_bind": (page_window_bind, WINDOW_SQL),
}
