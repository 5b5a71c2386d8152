"""Queries of the rules over names, facts, citations and findings.

The tables hold no legal texts, so each query writes some from their values and from phrases that between them reach
every branch of its rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions import legal
from lodestrata.functions import text as X
from lodestrata.operators import curation, gates, graph, matching, references, review, scoring
from lodestrata.session import table


def _pick(k: Column | str, values: tuple) -> Column:
    k = F.col(k) if isinstance(k, str) else k
    return F.element_at(F.array(*(F.lit(v) for v in values)), (k % len(values) + 1).cast("int"))


def _sql(k: str, values: tuple) -> str:
    quoted = ", ".join("null" if v is None else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'" for v in values)
    return f"[{quoted}][({k}) % {len(values)} + 1]"


NAMES = ("Act", "Billing Act", "Data Bill", "Exposure Draft Rules", "Consultation on data", "A Discussion Paper", "Trade Agreement", "RCEP", "Treaty of words", "Commentary", "Client Alert", "Weblog Act", "Blog", "Corporate policy", "Company Policy", "Legal update")
KINDS = ("statute", " Act ", "treaty", "bill", "draft", "consultation", "international_agreement", "commentary", "company_policy", "news", None)
STATUSES = ("in_force", None, "in_force", "repealed", "in_force")


def eligibility_reason(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    name = F.concat_ws(" ", F.substring_index("text", " ", 1), _pick(k, NAMES))
    reason = gates.eligibility(name, _pick(F.floor(k / 3), KINDS), _pick(F.floor(k / 7), STATUSES))
    return table(spark, d, "documents").select("doc_id", reason.alias("reason"), reason.isNull().alias("eligible"))


def _eligibility_sql() -> str:
    denied = " ".join(f"when kind = '{k}' then '{v}'" for k, v in gates.INELIGIBLE_TYPES.items())
    named = " ".join(f"when regexp_matches(name, '{p}'){' and kind is distinct from ' + chr(39) + 'treaty' + chr(39) if r == 'INTERNATIONAL_AGREEMENT' else ''} then '{r}'" for r, p in gates.INELIGIBLE_NAMES)
    return f"""with r as (select doc_id, concat_ws(' ', string_split(text, ' ')[1], {_sql("doc_id", NAMES)}) as name, lower(trim({_sql("doc_id // 3", KINDS)})) kind, coalesce({_sql("doc_id // 7", STATUSES)}, 'unknown') status from documents),
c as (select doc_id, case {denied} {named} when status <> 'in_force' then 'STATUS_' || upper(status) when kind is null or kind not in {gates.ELIGIBLE_TYPES} then 'UNSUPPORTED_SOURCE_TYPE' end reason from r)
select doc_id, reason, reason is null eligible from c"""


def draft_watermark_docs(spark: SparkSession, d: str) -> DataFrame:
    """Pages of five lines, some marked as drafts; customers stand for documents that may have no pages."""
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    page = F.floor(F.col("place") / 5)
    mark = F.when(F.col("place") % 5 == 0, _pick(F.col("doc_id") + page, ("", "  Exposure  DRAFT ", "draft of words", "", "Draft", "a draft", "", "")))
    pages = docs.groupBy("doc_id", page.alias("page")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", F.concat_ws("\n", mark, "line").alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    both = table(spark, d, "documents").select("doc_id").unionByName(table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("doc_id")))
    return gates.content_eligibility(pages, ["doc_id"], both)


DRAFT_SQL = f"""with l as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 place from documents),
p as (select doc_id, place // 5 page, string_agg(case when place % 5 = 0 then ['', '  Exposure  DRAFT ', 'draft of words', '', 'Draft', 'a draft', '', ''][(doc_id + place // 5) % 8 + 1] || chr(10) || line else line end, chr(10) order by place) text from l group by 1, 2),
n as (select doc_id, count(*) filter (regexp_matches(text, '{gates.DRAFT_PAGE}')) draft_pages, count(*) pages from p group by 1),
a as (select doc_id from documents union select c_custkey from customer)
select a.doc_id, coalesce(draft_pages, 0) draft_pages, coalesce(pages, 0) pages, case when pages is null then 'EMPTY_DOCUMENT' when draft_pages >= 2 and draft_pages / pages >= 0.1 then 'BILL_OR_DRAFT_CONTENT' end reason from a left join n using (doc_id)"""

FACTS = ("", "Current version", "Repealed by", "it ceased to be in force", "superseded", "was replaced by", "not yet in force", "commences on", "a Bill", "Latest compilation, superseded in part", "unrepealed words in force", None)
DATES, TOLD = ("2024-01-01", "", None, "5 Mar 2024"), (None, "", None, None, "in_force", None, None)


def status_cascade(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    fact = _pick(k, FACTS)
    found = gates.resolve_status(fact, _pick(F.floor(k / 5), DATES), _pick(F.floor(k / 3), TOLD))
    url = F.when(k % 6 != 0, F.col("source"))
    return table(spark, d, "documents").select("doc_id", *(c.alias(n) for n, c in found.items()), gates.status_allows_final(found["status"], found["conflict"], url, fact).alias("final"))


def _status_sql() -> str:
    markers = " ".join(f"when regexp_matches(low, '{p}') then '{n}'" for n, p, _ in gates.STATUS_MARKERS)
    return f"""with f as (select doc_id, source, {_sql("doc_id", FACTS)} fact, {_sql("doc_id // 5", DATES)} since, {_sql("doc_id // 3", TOLD)} told from documents),
s as (select *, lower(coalesce(fact, '')) low from f),
r as (select *, case when told <> '' then told {markers} when since <> '' and regexp_matches(low, '{gates.IN_FORCE}') then 'in_force' else 'unknown' end status from s),
c as (select *, status = 'in_force' and regexp_matches(low, '{gates.CONTRADICTS}') conflict from r)
select doc_id, status, conflict, case when told <> '' then 'official structured status field' when status = 'repealed' then 'official fact contains repeal marker' when status = 'superseded' then 'official fact contains supersession marker'
  when status = 'not_yet_effective' then 'official fact contains future-commencement marker' when status = 'draft' then 'official fact identifies a bill/draft' when status = 'in_force' then 'official current/latest compilation assertion plus date' else 'no sufficient official legal-status assertion' end as rule,
  status = 'in_force' and not conflict and doc_id % 6 <> 0 and coalesce(fact, '') <> '' and coalesce(source, '') <> '' final from c"""


INDICATORS = (*scoring.SCORES, "P9-I1")


def indicator_score(spark: SparkSession, d: str) -> DataFrame:
    """Lines as evidence of suppliers, the first seven indicators for each; all indicators are scored."""
    line = table(spark, d, "lineitem")
    k = F.col("l_partkey") + F.col("l_linenumber")
    rows = line.select(
        F.col("l_suppkey").alias("supplier"), _pick(k, INDICATORS).alias("indicator"), F.when(F.col("l_quantity") > 40, "n/a").when(F.col("l_quantity") < 5, "").when(F.col("l_quantity") < 7, None).otherwise("s. 1").alias("section"),
        F.when(F.col("l_returnflag") == "R", "Horizontal: all").when(F.col("l_returnflag") == "A", "Sectoral").alias("coverage"), F.when(F.col("l_linestatus") == "F", "it is COURT-GATED").alias("notes"),
    )
    every = table(spark, d, "supplier").select(F.col("s_suppkey").alias("supplier"), F.explode(F.array(*map(F.lit, INDICATORS))).alias("indicator"))
    return scoring.indicator_scores(rows, ["supplier"], every)


def _score_sql() -> str:
    names = "[" + ", ".join(f"'{n}'" for n in INDICATORS) + "]"
    three = " ".join(f"when indicator = '{n}' then case when n_real = 0 then {a} when flat then {c} else {b} end" for n, (a, b, c) in scoring.SCORES.items())
    return f"""with e as (select l_suppkey supplier, {_sql("l_partkey + l_linenumber", INDICATORS)} indicator, l_returnflag = 'R' flat, l_linestatus = 'F' gated from lineitem where l_quantity <= 40 and l_quantity >= 7),
g as (select supplier, indicator, count(*) n, bool_or(flat) flat, bool_and(gated) gated from e group by 1, 2),
a as (select s_suppkey supplier, unnest({names}) indicator from supplier),
m as (select supplier, indicator, coalesce(n, 0) n_real, coalesce(flat, false) flat, coalesce(gated, false) gated from a left join g using (supplier, indicator))
select supplier, indicator, n_real as "real", flat horizontal, (case when indicator = 'P7-I5' and gated then 0 {three} else 0 end)::double score from m"""


ALIASES = ("(PDPA) & Part (No. 12)", "(Act 854-A)", "(Interception and Access) Rules", "(AB2.C/D-E) Act", "( act 12 ) of", "(No 7b) [x]", "(Draft (Two)) É", "A & B Act 12-3")
ALIAS_SQL = "\\(\\s*(?:[A-Z][A-Z0-9.&/-]{1,14}|(?i:Act|No\\.?)\\s*[0-9]+(?i:[A-Z-]*))\\s*\\)"


def law_name_normalize(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat_ws(" ", F.col("p_name"), _pick("p_partkey", ALIASES), F.col("p_brand"))
    family = X.family(X.law_tokens(F.concat_ws(" ", name, F.lit("Amending No a123 2010 amended"))))
    return table(spark, d, "part").select("p_partkey", X.normalize_law_name(name).alias("name"), X.normalize_law(name).alias("plain"), F.array_join(X.law_tokens(name), " ").alias("tokens"), F.array_join(family, " ").alias("family"))


LAW_SQL = f"""with p as (select p_partkey, concat_ws(' ', p_name, {_sql("p_partkey", ALIASES)}, p_brand) n from part),
q as (select p_partkey, trim(regexp_replace(replace(lower(regexp_replace(n, '{ALIAS_SQL}', ' ', 'g')), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) "name", trim(regexp_replace(regexp_replace(lower(n), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) plain from p),
t as (select *, list_filter(list_distinct(string_split(plain, ' ')), lambda t: t not in ('act','acts','the','of','and','a','an','no','pu','')) t from q)
select p_partkey, "name", plain, array_to_string(list_sort(t), ' ') tokens, array_to_string(list_sort(list_distinct(list_concat(list_filter(t, lambda x: x not in ('amendment', 'amending') and not regexp_full_match(x, '[0-9]+|[a-z][0-9]+')), ['amended']))), ' ') family from t"""

#: Prose, with the reference that each holds.
PROSE = (
    "A person must not transfer data outside the country under Section 26(1)",
    "Data means what Article 2 ( a ) says",
    "See also Rule 7 on any transfer abroad, which is prohibited",
    "Regulations 2021 apply",
    "A bank must keep records for seven years as Sec 12A asks",
    "It applies to Clause 3 only",
    "Schedule 4 has forms on retention, as set out in Schedule 5B",
    "Seksyen 12A dan Perkara 5",
    "Rule 8 of the house",
)
SCORES = ("1", "0", "x")


def reference_roles(spark: SparkSession, d: str) -> DataFrame:
    """Each document's sentence behind one that prohibits transfers abroad, and before one that says nothing."""
    k = F.col("doc_id")
    text = F.concat(F.lit("One must not send data abroad. "), _pick(k, PROSE), F.lit(". "), F.regexp_replace("text", "[^a-z]+", " "))
    rows = table(spark, d, "documents").select("doc_id", text.alias("text"), F.lit("Data Act; Word (Amendment) Act 2010").alias("acts"), _pick(F.floor(k / 3), ("P6-I1", "P7-I3", "P7-I1", None)).alias("indicator"), _pick(F.floor(k / 2), SCORES).alias("score"))
    return references.mentions(rows, ["doc_id"]).select("doc_id", "ref", "role", F.array_join("laws", "/").alias("laws"))


#: (prose, reference, role where its indicator is content or absent, indicators that are, what laws are named)
_EXPECTED = (
    (0, "s. 26(1)", "operative", "'P6-I1'", True),
    (1, "Art. 2(a)", "definition", "'P6-I1', 'P7-I3'", True),
    (2, "r. 7", "supporting", "'P6-I1'", False),
    (4, "s. 12A", "operative", "'P7-I3'", False),
    (5, "cl. 3", "operative", "'P6-I1'", True),
    (6, "Sch. 4", "operative", "'-'", False),
    (6, "Sch. 5B", "supporting", "'-'", False),
    (7, "s. 12A", "operative", "'-'", False),
    (7, "Art. 5", "operative", "'-'", False),
)


def _roles_sql() -> str:
    values = ", ".join(f"({p}, '{ref}', '{role}', [{fits}], {str(named).lower()})" for p, ref, role, fits, named in _EXPECTED)
    return f"""with k as (select doc_id, doc_id % {len(PROSE)} p, {_sql("doc_id // 3", ("P6-I1", "P7-I3", "P7-I1", None))} i, {_sql("doc_id // 2", SCORES)} s from documents),
e(p, ref, role, fits, named) as (values {values}),
n as (select *, case when s = 'x' then true when i = 'P7-I1' then s = '0' else s = '1' end expected from k)
select doc_id, ref, case when not expected then 'negative_evidence' when role <> 'operative' or i is null or i = 'P7-I1' or list_contains(fits, i) then role else 'supporting' end as role, case when named then 'data act' else '' end laws from n join e using (p)
union all select doc_id, 'reg. 2021', 'instrument_title', '' from n where p = 3"""


RAW = ("Indicator 6.4", "7.10", "13.2", "Local storage requirements", "Conditional-flow  regimes", "Data protection impact assessment or data protection officer requirements", "v6.4.1", "none", None)
CODES = ("P6-I4", "P7-I10", None, "P6-I2", "P6-I4", "P7-I4", "P4-I1", None, None)
PILLARS, PILLAR_CODES = ("6", "7.0", "13", "x", "", None, "12.9"), ("P6-I?", "P7-I?", None, None, None, None, "P12-I?")


def indicator_codes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    expected = X.expects_anchor(F.when(k % 4 == 0, F.lit("n/a")).otherwise((F.col("p_size") % 3 / 2.0).cast("string")), k % 2 == 0)
    return table(spark, d, "part").select("p_partkey", X.indicator_code(_pick(k, RAW), _pick(F.floor(k / 2), PILLARS)).alias("code"), expected.alias("expected"))


CODES_SQL = f"select p_partkey, coalesce({_sql('p_partkey', CODES)}, {_sql('p_partkey // 2', PILLAR_CODES)}) code, case when p_partkey % 4 = 0 then true when p_partkey % 2 = 0 then p_size % 3 > 0 else p_size % 3 < 2 end expected from part"


def citation_paths(spark: SparkSession, d: str) -> DataFrame:
    n, m = (F.col("o_orderkey") % 90 + 1).cast("string"), (F.col("o_orderkey") % 4 + 91).cast("string")
    forms = [F.concat(F.lit("Section "), n, F.lit("A("), m, F.lit(")(b)")), F.concat(F.lit("Sch "), n, F.lit(", cl. "), m, F.lit("(1)")), F.concat(F.lit("reg "), n, F.lit("(iv)")), F.concat(F.lit("Art. "), n, F.lit("."), m), F.lit("Part IV, Division B of Chapter X"), F.concat(F.lit("Schedule "), n, F.lit(" section "), n), F.lit("words")]
    x = F.element_at(F.array(*forms), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(legal.citation_path(x), "|").alias("path"), X.citation_tier(x).alias("tier"))


PATHS_SQL = """with n as (select o_orderkey, o_orderkey % 7 k, (o_orderkey % 90 + 1)::varchar n, (o_orderkey % 4 + 91)::varchar m from orders)
select o_orderkey, ['section ' || n || 'A|item (' || m || ')|item (b)', 'Schedule ' || n || '|clause ' || m || '|item (1)', 'regulation ' || n || '|item (iv)', 'article ' || n || '.' || m, 'Part IV|Division B|Chapter X', 'Schedule ' || n, ''][k + 1] path,
  case when k < 3 then '[verify-pinpoint]' else '[verify]' end tier from n"""


def component_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.explode(legal.rule_components(F.concat(F.lit("Unless it is so, data means words. If due, Note 1: see section 5. "), F.col("text")))).alias("c"))
    return docs.groupBy("c.role").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


def _component_sql() -> str:
    each = " union all ".join(f"select '{role}' as role, doc_id, len(regexp_extract_all(t, '{p}')) c from d" for role, p in legal.COMPONENTS.items())
    return f"with d as (select doc_id, 'Unless it is so, data means words. If due, Note 1: see section 5. ' || text t from documents), e as ({each} union all select 'principal_rule', doc_id, 1 from d) select role, sum(c)::bigint n, count(*) filter (c > 0) docs from e group by 1 having sum(c) > 0"


SAID = ("The purpose is to govern", "One must notify an incident", "a risk assessment", "a standard", "Records are kept; retain at least 5 years", "computerised data", "without a warrant they search premises", "an authorised officer", "words only", "NO_EVIDENCE_FOUND")
OF = ("P7-I1", "P7-I3", "P7-I5", "P6-I2")


def curated_findings(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")
    k = F.col("l_partkey") + F.col("l_linenumber")
    rows = line.select(
        F.col("l_returnflag").alias("economy"), _pick("l_linenumber", OF).alias("indicator"), F.col("l_suppkey").alias("law"), F.concat(F.lit("s. "), F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string"), F.when(k % 3 == 0, "(1)").otherwise("")).alias("section"),
        _pick(k, SAID).alias("snippet"), F.when(k % 7 == 0, "it may intercept").alias("rationale"), F.when(F.col("l_quantity") > 3, "NEW").otherwise("KNOWN").alias("tag"), _pick(F.floor(k / 2), ("exact", "none", None, "anchor")).alias("alignment"),
        F.array_repeat(F.lit("r"), (k % 3).cast("int")).alias("risks"), F.col("l_discount").cast("double").alias("confidence"),
    )
    return curation.curate_findings(rows).where("chosen").select("economy", "indicator", "law", "section", "legal_function", "place")


def _curated_sql() -> str:
    kinds = " ".join(f"when regexp_matches(low, '{p}') then '{n}'" for n, p in X.LEGAL_FUNCTIONS)
    direct = " or ".join(f"(indicator = '{n}' and regexp_matches(low, '{p}'))" for n, p in X.DIRECT.items())
    return f"""with f as (select l_returnflag economy, {_sql("l_linenumber", OF)} indicator, l_suppkey law, 's. ' || l_orderkey::varchar || '.' || l_linenumber::varchar || case when (l_partkey + l_linenumber) % 3 = 0 then '(1)' else '' end as section, l_partkey + l_linenumber k, l_quantity > 3 fresh, l_discount::double confidence from lineitem),
g as (select *, {_sql("k", SAID)} snippet, {_sql("k // 2", ("exact", "none", None, "anchor"))} alignment from f),
h as (select *, lower(snippet || ' ' || case when k % 7 = 0 then 'it may intercept' else '' end) low, coalesce(alignment in ('exact', 'anchor'), false) aligned from g),
i as (select *, case {kinds} else 'other' end legal_function, ({direct})::int direct, fresh and snippet <> 'NO_EVIDENCE_FOUND' new from h),
j as (select *, row_number() over (partition by economy, indicator, law, legal_function order by aligned desc, direct desc, k % 3, confidence desc, (k % 3 = 0) desc, section desc) own from i where new),
p as (select *, (row_number() over (partition by economy, indicator, law order by (own = 1) desc, aligned desc, direct desc, k % 3, confidence desc, (k % 3 = 0) desc, section desc))::int place from j)
select economy, indicator, law, section, legal_function, place from p where place <= case indicator when 'P7-I1' then 1 when 'P7-I3' then 3 else 2 end
union all select economy, indicator, law, section, legal_function, null from i where not new"""


def citation_readings(spark: SparkSession, d: str) -> DataFrame:
    """A citation against readings of it that are right, lose a token, move one, or are empty."""
    a, b = (F.col("o_orderkey") % 90).cast("string"), (F.col("o_custkey") % 50 + 100).cast("string")
    truth = F.concat(F.lit("s. "), a, F.lit("(iv) and "), b, F.lit("B"))
    reading = F.element_at(F.array(truth, F.concat(a, F.lit(" (iv) and")), F.concat(b, F.lit("B, "), a, F.lit("(iv)")), F.lit("")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", F.round(X.citation_accuracy(reading, truth), 6).alias("accuracy"), (X.citation_tokens(reading) != X.citation_tokens(truth)).alias("apart"))


def structure_accuracy(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("act"), F.array("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("path"), "l_quantity")
    return matching.structure_accuracy(line.select("act", "path"), line.where("l_quantity > 25").select("act", "path"), ["act"])


def gate_exception_outside(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    snippet = _pick(k, ("One must go", "One must go UNLESS late", "Subject to this"))
    text = F.concat_ws(" ", _pick(F.floor(k / 2), ("", "Unless late.", "provided that", "exceptional", "Notwithstanding")), F.col("text"))
    return table(spark, d, "documents").select("doc_id", gates.g5_exceptions(F.when(F.col("lang") == "en", "P6-I1").otherwise("P7-I1"), snippet, text).alias("g5"))


EXCEPTION_SQL = f"""with t as (select doc_id, lang, {_sql("doc_id", ("One must go", "One must go UNLESS late", "Subject to this"))} s, {_sql("doc_id // 2", ("", "Unless late.", "provided that", "exceptional", "Notwithstanding"))} || ' ' || text t from documents),
h as (select doc_id, lang, regexp_matches(t, '{gates.EXCEPTIONS}') and not regexp_matches(s, '{gates.EXCEPTIONS}') h from t)
select doc_id, case when h and lang = 'en' then 'FAIL' when h then 'WARN' else 'PASS' end g5 from h"""


def act_references(spark: SparkSession, d: str) -> DataFrame:
    """Orders as acts whose provisions name sections of their own act, of this act, and of another one."""
    line = table(spark, d, "lineitem")
    n = F.col("l_linenumber").cast("string")
    text = F.concat(F.lit("See section "), n, F.lit("b, Section 9 of this Act, section 8 of the Word Act 2010, and "), F.repeat(F.lit("x "), F.when(F.col("l_linenumber") == 7, 1500).otherwise(1)), F.lit("section 77"))
    edges = graph.section_references(line.select(F.concat_ws("-", F.col("l_orderkey").cast("string"), n).alias("id"), F.lit("AU").alias("economy"), F.col("l_orderkey").cast("string").alias("law"), text.alias("text")))
    return edges.select("src", "dst")


def structure_floor(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their lines as units, and up to forty pages."""
    units = table(spark, d, "lineitem").where("l_quantity > 10").groupBy(F.col("l_orderkey").alias("_k")).agg(F.count("*").alias("units"))
    met = table(spark, d, "orders").join(units, F.col("o_orderkey") == F.col("_k"), "left")
    return met.select("o_orderkey", gates.structure_too_thin(F.col("units"), F.when(F.col("o_custkey") % 9 != 0, F.col("o_custkey") % 41)).alias("thin"))


def screen_survivors(spark: SparkSession, d: str) -> DataFrame:
    """Customers of a segment as candidates by balance, screened by decisions that orders stand for."""
    c = table(spark, d, "customer")
    place = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey"))
    candidates = c.select(F.col("c_mktsegment").alias("indicator"), place.alias("place"), "c_custkey")
    o = table(spark, d, "orders").select((F.col("o_orderkey") % 20).alias("batch"), (F.col("o_custkey") % 15 - 1).alias("index"), (F.col("o_orderstatus") == "F").alias("relevant"), "o_orderpriority")
    decisions = o.withColumn("indicator", _pick(F.length("o_orderpriority"), ("BUILDING", "AUTOMOBILE", "MACHINERY", "HOUSEHOLD", "FURNITURE"))).drop("o_orderpriority")
    return review.screened(candidates, decisions).groupBy("indicator", "c_custkey").agg(F.count("*").alias("n"))


SCREEN_SQL = f"""with c as (select c_mktsegment i, c_custkey, row_number() over (partition by c_mktsegment order by c_acctbal desc, c_custkey) place from customer),
o as (select o_orderkey % 20 b, o_custkey % 15 - 1 k, {_sql("length(o_orderpriority)", ("BUILDING", "AUTOMOBILE", "MACHINERY", "HOUSEHOLD", "FURNITURE"))} i from orders where o_orderstatus = 'F')
select c.i indicator, c_custkey, count(*) n from c join o on c.i = o.i and place <= 200 and (place - 1) // 12 = b and (place - 1) % 12 = k group by 1, 2"""


def consolidated_runs(spark: SparkSession, d: str) -> DataFrame:
    """Lines of seven runs, which repeat parts of suppliers."""
    line = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("economy"), F.col("l_suppkey").alias("law"), F.col("l_partkey").alias("section"), F.col("l_linenumber").alias("run"), F.col("l_orderkey").alias("place"))
    found = review.consolidated(line, ["economy", "law", "section"], "run", "place", {"R": 0, "A": 1}, "economy", ["law"])
    return found.select("economy", "law", "section", "run", "place", "economy_rank")


def realigned_units(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as volumes and turns as pages; pairs of turns as units, some already aligned, some not found."""
    turns = table(spark, d, "conversations")
    nxt = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    said = F.when(F.col("turn") % 4 == 3, F.concat("text", F.lit(" zz"))).otherwise(F.concat_ws(" ", "text", nxt))
    units = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("unit_id"), _pick(F.col("conv_id"), ("A", "B", "A")).alias("law"), F.col("conv_id").alias("volume"), said.alias("text"), _pick("turn", ("none", "exact", None)).alias("alignment"))
    found = review.realigned(units, turns.select(F.col("conv_id").alias("volume"), F.col("turn").alias("page"), "text"), "A", "v2")
    return found.select("unit_id", "volume", "first", "last", "alignment", "version")


REALIGN_SQL = f"""with t as (select conv_id, turn, text, row_number() over (partition by conv_id order by turn) i, lead(text) over (partition by conv_id order by turn) nxt from conversations),
u as (select conv_id * 1000 + turn unit_id, conv_id volume, case when turn % 4 = 3 then text || ' zz' else concat_ws(' ', text, nxt) end as text from t where {_sql("conv_id", ("A", "B", "A"))} = 'A' and turn % 3 <> 1),
w as (select a.conv_id, a.i, n, string_agg(b.text, ' ' order by b.i) txt, min(b.turn) f, max(b.turn) l from t a, range(1, 7) r(n), t b where a.conv_id = b.conv_id and b.i >= a.i and b.i < a.i + n group by all having count(*) = n)
select unit_id, volume, f "first", l "last", 'exact' alignment, 'v2' as version from u join w on volume = conv_id and contains(txt, text) qualify row_number() over (partition by unit_id order by n, i) = 1"""

REFERENCES_SQL = """with l as (select l_orderkey::varchar law, l_linenumber n from lineitem), e as (select law, n, unnest([n::varchar || 'B', '9', '77']) s from l)
select distinct law || '-' || n::varchar src, 'section:AU:' || law || ':s. ' || s dst from e where n <> 7 or s <> '77'"""

QUERIES = {
    "eligibility_reason": (eligibility_reason, _eligibility_sql()),
    "draft_watermark_docs": (draft_watermark_docs, DRAFT_SQL),
    "status_cascade": (status_cascade, _status_sql()),
    "indicator_score": (indicator_score, _score_sql()),
    "law_name_normalize": (law_name_normalize, LAW_SQL),
    "reference_roles": (reference_roles, _roles_sql()),
    "indicator_codes": (indicator_codes, CODES_SQL),
    "citation_paths": (citation_paths, PATHS_SQL),
    "component_counts": (component_counts, _component_sql()),
    "curated_findings": (curated_findings, _curated_sql()),
    "citation_readings": (citation_readings, "select o_orderkey, [1.0, 0.666667, 0.333333, 0.0][o_orderkey % 4 + 1]::double accuracy, o_orderkey % 4 > 0 apart from orders"),
    "structure_accuracy": (structure_accuracy, "with p as (select distinct l_orderkey act, l_returnflag, l_linestatus, l_linenumber, l_quantity > 25 hit from lineitem), q as (select act, l_returnflag, l_linestatus, l_linenumber, bool_or(hit) hit from p group by all) select act, count(*) expected, count(*) filter (hit) shared, round(count(*) filter (hit) / count(*), 6)::double accuracy from q group by 1"),
    "gate_exception_outside": (gate_exception_outside, EXCEPTION_SQL),
    "screen_survivors": (screen_survivors, SCREEN_SQL),
    "consolidated_runs": (consolidated_runs, "select l_returnflag economy, l_suppkey law, l_partkey as section, l_linenumber run, l_orderkey place, (case l_returnflag when 'R' then 0 when 'A' then 1 else 9 end)::int economy_rank from lineitem qualify row_number() over (partition by l_returnflag, l_suppkey, l_partkey order by l_linenumber, l_orderkey) = 1"),
    "realigned_units": (realigned_units, REALIGN_SQL),
    "structure_floor": (structure_floor, "with u as (select l_orderkey k, count(*) n from lineitem where l_quantity > 10 group by 1) select o_orderkey, coalesce(n, 0) < greatest(3, case when o_custkey % 9 <> 0 then o_custkey % 41 else 0 end // 5) thin from orders left join u on k = o_orderkey"),
    "act_references": (act_references, REFERENCES_SQL),
}
