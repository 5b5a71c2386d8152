"""Queries of statutes: acts written from the documents' words, parsed back into rule units."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import legal
from lodestrata.operators import markup_acts, statutes
from lodestrata.session import spread, table

TITLE = "Universal Plain Word Act 1979"
#: Sections of a page, and the most sections of an act, whose numbers have three digits.
PER_PAGE, MOST = 10, 900


def _split(docs: DataFrame) -> DataFrame:
    """(doc_id, w, s, m) of docs(doc_id, text): a document's words, how many a section has, and its sections."""
    # Runs of other letters become one space each, so no word is empty but for the only one of a text without any.
    words = F.split(F.nullif(F.trim(F.regexp_replace(F.lower("text"), "[^a-z]+", " ")), F.lit("")), " ")
    docs = docs.select("doc_id", words.alias("w"))
    return docs.withColumn("s", F.greatest(F.lit(20), F.ceil(F.size("w") / MOST)).cast("int")).withColumn("m", F.ceil(F.size("w") / F.col("s")).cast("int"))


def _words(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, k, m, v): the words of section k of m of a document."""
    docs = _split(table(spark, d, "documents"))
    each = docs.select("doc_id", "m", "s", "w", F.explode(F.when(F.size("w") > 0, F.sequence(F.lit(1), F.col("m")))).alias("k"))
    return each.select("doc_id", "m", "k", F.slice("w", (F.col("k") - 1) * F.col("s") + 1, F.col("s")).alias("v"))


def _said(x: Column) -> Column:
    return F.array_join(x, " ")


def _section(mark: Callable[[Column], Column], k: Column, v: Column) -> Column:
    """The text of section k, of words v, under the heading that mark begins."""
    half = F.floor(F.size(v) / 2).cast("int")
    last = (k % PER_PAGE == 0) | (k == F.col("m"))
    lines = [
        F.concat(mark(k.cast("string")), F.lit("Rule on the handling of "), F.element_at(v, 1)),
        F.concat(F.lit("(1) Unless exempt, "), _said(F.slice(v, F.lit(1), half)), F.lit(" (ii) applies.")),
        F.when(k % 7 == 0, F.lit("2. Backward entry of a list")),
        F.when(k % 5 == 0, F.lit("Section 99B removes what the rule says")),
        F.concat(F.lit("  (2) It means "), _said(F.slice(v, half + 1, F.size(v)))),
        F.when(last, F.concat(F.ceil(k / PER_PAGE).cast("string"), F.lit("  "), F.lit(TITLE))),
    ]
    return F.concat_ws("\n", *lines)


def _pages(docs: DataFrame, mark: Callable[[Column], Column], contents: bool) -> DataFrame:
    """(doc_id, page, text) of the acts that documents' words make, written where each document is; page 0 are contents."""
    pages = F.sequence(F.lit(0 if contents else 1), F.ceil(F.col("m") / PER_PAGE).cast("int"))
    each = _split(docs).select("doc_id", "m", "s", "w", F.explode(F.when(F.size("w") > 0, pages)).alias("page"))
    # Sections before the page's own, and the words of each of its own.
    before = ((F.col("page") - 1) * PER_PAGE).cast("int")
    own = F.transform(F.sequence(before, F.least(before + PER_PAGE, F.col("m")) - 1), lambda k: F.slice("w", k * F.col("s") + 1, F.col("s")))
    text = F.array_join(F.transform(own, lambda v, k: _section(mark, before + k + 1, v)), "\n")
    if contents:
        listed = F.transform(F.sequence(F.lit(1), F.col("m")), lambda k: F.concat(k.cast("string"), F.lit(". Listed heading")))
        text = F.when(F.col("page") == 0, F.concat(F.array_join(listed, "\n"), F.lit("\nAn Act to say words."))).otherwise(text)
    return each.select("doc_id", F.col("page").cast("long").alias("page"), text.alias("text"))


def _units(spark: SparkSession, d: str, mark: Callable[[Column], Column], grammar: str | None, contents: bool) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    own = {"economy": F.lit("Malaysia"), "act_name": F.lit(TITLE), "act_ref": F.col("doc_id").cast("string"), "law_number_ref": F.lit(None).cast("string"), "source_url": F.lit("https://x"), "grammar": F.lit(grammar), "citation": F.lit(grammar), "ocr": F.lit(False)}
    acts = docs.select("doc_id", *(c.alias(n) for n, c in own.items()))
    # Texts are dealt as they are, and all else about a document is done where its text is.
    units = statutes.parse(_pages(spread(docs, "doc_id"), mark, contents), acts, dealt=True)
    each = F.struct("id", F.concat_ws("|", "id", "article_section", "location_reference", "text", F.size("rule_components").cast("string")).alias("said"))
    told = F.array_join(F.transform(F.sort_array(F.collect_list(each)), lambda x: x["said"]), "\n")
    return units.groupBy("doc_id").agg(F.count("*").alias("units"), F.sha2(told, 256).alias("said"))


def statute_units(spark: SparkSession, d: str) -> DataFrame:
    """Numbered sections behind a table of contents."""
    return _units(spark, d, lambda k: F.concat(k, F.lit(". ")), None, True)


def treaty_units(spark: SparkSession, d: str) -> DataFrame:
    """Articles with decimals under the treaty grammar."""
    return _units(spark, d, lambda k: F.concat(F.lit("Article "), k, F.lit(".1: ")), "treaty", False)


def malay_units(spark: SparkSession, d: str) -> DataFrame:
    return _units(spark, d, lambda k: F.concat(F.lit("Seksyen "), k, F.lit(". ")), "malay", False)


def _acts(spark: SparkSession, d: str) -> DataFrame:
    own = {"economy": F.lit("Australia"), "act_name": F.lit(TITLE), "act_ref": F.col("doc_id").cast("string"), "law_number_ref": F.lit(None).cast("string"), "last_amended": F.lit(None).cast("string"), "source_url": F.lit("https://x")}
    return table(spark, d, "documents").select("doc_id", *(c.alias(n) for n, c in own.items()))


def _told(units: DataFrame, *columns: Column | str) -> DataFrame:
    each = F.struct("id", F.concat_ws("|", "id", "article_section", *columns).alias("said"))
    told = F.array_join(F.transform(F.sort_array(F.collect_list(each)), lambda x: x["said"]), "\n")
    return units.groupBy("doc_id").agg(F.count("*").alias("units"), F.sha2(told, 256).alias("said"))


def markup_units(spark: SparkSession, d: str) -> DataFrame:
    """Acts in marked-up parts: a part of the act for every ten sections, a chapter for every forty, the last sections of
    each chapter as clauses of a schedule, those of its second half by decimals."""
    own = _words(spark, d)
    half = F.floor(F.size("v") / 2).cast("int")
    head = lambda level, text: F.concat(F.lit(f'<p id="n" class="ActHead{level}">'), text, F.lit("</p>"))
    k, n = F.col("k"), F.col("k").cast("string")
    chapter, place = F.ceil(k / 40).cast("string"), (k - 1) % 40
    number = F.when(place >= 35, F.concat(n, F.lit(".1"))).otherwise(n)
    above = [
        F.when(place == 0, head(1, F.concat(F.lit("Chapter "), chapter, F.lit("—Words")))),
        F.when((place < 30) & (place % 10 == 0), head(2, F.concat(F.lit("Part "), (place / 10 + 1).cast("int").cast("string"), F.lit("&#8212;Of &amp; for")))),
        F.when(place == 30, head(1, F.concat(F.lit("Schedule&#xa0;"), chapter, F.lit("—Forms")))),
        F.when(place % 10 == 5, head(3, F.concat(F.lit("Division "), n))),
    ]
    body = F.concat(
        F.lit("<p class='Subsection'>(1) "), _said(F.slice("v", F.lit(1), half)), F.lit(" under subsection (2) of it.</p><p>(a) an <i>item</i></p>"),
        F.when(k % 3 == 0, "<p class='SubsectionHead'>A topic</p>").otherwise(""),
        F.lit("<p class='subsection'>(2A) means "), _said(F.slice("v", half + 1, F.size("v"))), F.lit("</p>"),
    )
    section = F.concat(F.concat_ws("", *above), head(5, F.concat(F.lit('<a><span class="CharSectno">'), number, F.lit("</span> <span>Rule of "), F.element_at("v", 1), F.lit("</span></a>"))), body)
    parts = own.select("doc_id", "k", section.alias("t")).groupBy("doc_id", F.floor((k - 1) / 15).alias("page")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]), "").alias("text"))
    units = markup_acts.parse(parts, _acts(spark, d))
    return _told(units, "text", F.array_join("hierarchy_path", "/"), "part", "division", F.array_join("hierarchy_labels", ","), "anchor")


def portal_units(spark: SparkSession, d: str) -> DataFrame:
    """Portal pages, each an act of anchored sections; every fourth section has no subsections."""
    own = _words(spark, d)
    half = F.floor(F.size("v") / 2).cast("int")
    k, n = F.col("k"), F.col("k").cast("string")
    anchor = lambda i: F.concat(F.lit('<a name="pr'), n, F.lit(f'-ps{i}-"></a>—({i}) '))
    part = F.when((k - 1) % 10 == 0, F.concat(F.lit('<td class="partNo">PART '), F.ceil(k / 10).cast("string"), F.lit('</td><td class="partHdr x">OF WORDS</td>'))).otherwise("")
    body = F.when(k % 4 == 0, _said(F.col("v"))).otherwise(F.concat(anchor(1), _said(F.slice("v", F.lit(1), half)), anchor(2), _said(F.slice("v", half + 1, F.size("v")))))
    section = F.concat(part, F.lit('<div class="prov1"><td class="prov1Hdr" id="pr'), n, F.lit('-"><b>Rule of '), F.element_at("v", 1), F.lit("</b></td><td><strong>"), n, F.lit(".</strong> "), body, F.lit("</td></div>"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", section.alias("t")))), lambda x: x["t"]), "")
    pages = own.groupBy("doc_id").agg(F.concat(F.lit("<title>Word Act - Portal</title>Current version as at 5 Jul 2024 "), text).alias("text"))
    units = markup_acts.section_units(markup_acts.anchored_sections(pages, " - Portal"), _acts(spark, d))
    return _told(units, "law_name", "text", F.length("raw_context").cast("string"), "part", "heading", "location_reference", "current_as_at")


_WORDS = f"""
with d as (select doc_id, list_filter(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' '), lambda w: w <> '') w from documents),
s as (select doc_id, w, greatest(20, ceil(len(w) / {MOST}.0))::int s from d where len(w) > 0),
k as (select doc_id, w, s, ceil(len(w) / s)::int m, unnest(range(1, ceil(len(w) / s)::int + 1)) k from s),
v as (select doc_id, k, m, list_slice(w, (k - 1) * s + 1, least(k * s, len(w))) v from k)"""

MARKUP_SQL = f"""{_WORDS},
t as (select doc_id, k, ceil(k / 40.0)::int::varchar chapter, (k - 1) % 40 place, k::varchar || case when (k - 1) % 40 >= 35 then '.1' else '' end number, 'Rule of ' || v[1] heading,
  '(1) ' || array_to_string(list_slice(v, 1, len(v) // 2), ' ') || ' under subsection (2) of it. (a) an item' one, '(2A) means ' || array_to_string(list_slice(v, len(v) // 2 + 1, len(v)), ' ') two from v),
u as (select *, case when place < 30 then ['Chapter ' || chapter || '—Words', 'Part ' || (place // 10 + 1)::varchar || '—Of & for'] else ['Schedule ' || chapter || '—Forms'] end up,
  case when place % 10 >= 5 then 'Division ' || (k - place % 10 + 5)::varchar end division from t),
x as (select doc_id, number, place, chapter, heading, up, division, unnest([one, two]) txt, unnest(['1', '2A']) sub, unnest(['a', '']) items from u),
y as (select doc_id, case when place >= 30 and place < 35 then 'sch' || chapter || '-cl' else 's' end || number || '-' || sub ref, case when place >= 30 and place < 35 then 'Sch ' || chapter || ', cl. ' else 's. ' end || number || '(' || sub || ')' art,
  trim(regexp_replace(txt, ' +', ' ', 'g')) txt, array_to_string(list_concat(up, case when division is null then [heading] else [division, heading] end), '/') path, case when place < 30 then up[2] else '' end part, coalesce(division, '') division, items from x),
z as (select doc_id, 'au:' || doc_id::varchar || ':' || ref id, art, txt, path, part, division, items from y where length(txt) >= 30)
select doc_id, count(*) units, sha256(string_agg(concat_ws('|', id, art, txt, path, part, division, items, 'n'), chr(10) order by id)) said from z group by 1"""

PORTAL_SQL = f"""{_WORDS},
t as (select doc_id, k, 'Rule of ' || v[1] heading, 'PART ' || ceil(k / 10.0)::int::varchar || ' OF WORDS' part, k::varchar n,
  -- what stands before the next section belongs to the one before it
  case when k % 10 = 0 and k < m then ' PART ' || (k // 10 + 1)::varchar || ' OF WORDS' else '' end tail, array_to_string(v, ' ') || tail whole,
  '(1) ' || array_to_string(list_slice(v, 1, len(v) // 2), ' ') one, '(2) ' || array_to_string(list_slice(v, len(v) // 2 + 1, len(v)), ' ') || tail two from v),
u as (select *, case when k % 4 = 0 then [whole] else [trim(one), trim(two)] end txts, case when k % 4 = 0 then [''] else ['(1)', '(2)'] end subs from t),
x as (select doc_id, n, heading, part, unnest(txts) txt, unnest(subs) sub, length(array_to_string(txts, chr(10))) raw from u),
y as (select *, 'australia:' || doc_id::varchar || ':pr' || n || '-' || case when sub = '' then '' else 'ps' || sub[2] || '-' end id from x)
select doc_id, count(*) units, sha256(string_agg(concat_ws('|', id, 's. ' || n || sub, 'Word Act', txt, raw::varchar, part, heading, '#pr' || n || '-', '5 Jul 2024'), chr(10) order by id)) said from y group by 1"""


def _sql(heading: str, number: str, template: str, front: str) -> str:
    """What the acts say, told from the words by which they were written."""
    parts = " + ".join(f"len(regexp_extract_all(body, '{p}'))" for p in legal.COMPONENTS.values())
    return f"""{_WORDS},
t as (select doc_id, k, ceil(k / {PER_PAGE}.0)::int page, {number} number, {heading} || 'Rule on the handling of ' || v[1] head,
  '(1) Unless exempt, ' || array_to_string(list_slice(v, 1, len(v) // 2), ' ') || ' (ii) applies.' || case when k % 7 = 0 then ' 2. Backward entry of a list' else '' end || case when k % 5 = 0 then ' Section 99B removes what the rule says' else '' end one,
  '(2) It means ' || array_to_string(list_slice(v, len(v) // 2 + 1, len(v)), ' ') || case when k % {PER_PAGE} = 0 or k = m then ' ' || ceil(k / {PER_PAGE}.0)::int::varchar || ' {TITLE}' else '' end two from v),
c as (select *, regexp_replace(head, '{front}', '') front from t),
b as (select *, trim(regexp_replace(front || ' ' || one || ' ' || two, '\\s+', ' ', 'g')) body from c),
u as (select doc_id, k, page, number, body, unnest([front, one, two]) txt, unnest(['', '(1)', '(2)']) sub from b),
x as (select doc_id, 'ma:' || doc_id::varchar || ':s' || number || replace(replace(sub, '(', '-'), ')', '') id, '{template}' || number || sub art, page, trim(regexp_replace(txt, '\\s+', ' ', 'g')) txt, 1 + {parts} n from u)
select doc_id, count(*) units, sha256(string_agg(id || '|' || art || '|page ' || page::varchar || '|' || txt || '|' || n::varchar, chr(10) order by id)) said from x where length(txt) >= 30 group by 1"""


QUERIES = {
    "markup_units": (markup_units, MARKUP_SQL),
    "portal_units": (portal_units, PORTAL_SQL),
    "statute_units": (statute_units, _sql("k::varchar || '. '", "k::varchar", "s. ", "^[0-9]+\\. ")),
    "treaty_units": (treaty_units, _sql("'Article ' || k::varchar || '.1: '", "k::varchar || '.1'", "Art. ", "^$")),
    "malay_units": (malay_units, _sql("'Seksyen ' || k::varchar || '. '", "k::varchar", "s. ", "^$")),
}
