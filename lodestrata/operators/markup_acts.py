"""Acts from markup: XHTML with heading classes, and portal pages with anchored sections.

Markup is read block by block in its order, and the blocks of a part that stand under one heading are one row; what
stands above a section is told by windows over the headings alone, the last of each level that no higher one has ended;
blocks before a part's first heading belong to the last one before it."""

from __future__ import annotations

import html
import io
import re
import zipfile
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import legal
from lodestrata.session import fresh_path

# The classes and anchors of the two kinds of markup.
PARAGRAPH = re.compile(r"<p\b([^>]*)>(.*?)</p>", re.I | re.S)
CLASS = re.compile(r"\bclass\s*=\s*['\"]([^'\"]+)['\"]", re.I)
HEADING = re.compile(r'class="ActHead([1-5])"', re.I)
SECTION_NUMBER = re.compile(r'class="CharSectno"[^>]*>(?:<[^>]+>)*([\dA-Z.]+)', re.I)
ELEMENT_ID = re.compile(r"\bid=[\"']([^\"']+)[\"']", re.I)
SCHEDULE = r"(?i)^Schedule\s+(\S+)\s*[—–-]"
TOC = r"(?i)^(\d+(?:\.\d+)?[A-Z]{0,3})\s+(.+)$"
SUBSECTION, ITEM = r"(?i)^\((\d{1,3}[A-Z]?)\)\s*", r"(?i)^\(([a-z]{1,3}|[ivxlcdm]+)\)\s*"
CONTAINER = '<div class="prov1">'
SECTION_ID = re.compile(r'class="prov1Hdr"[^>]*id="((?:pr|Sc)[^"]*)"')
SECTION_HEADING = re.compile(r'class="prov1Hdr"[^>]*>(.*?)</td>', re.S)
STRONG_NUMBER = re.compile(r"<strong>\s*([0-9]+[A-Z]*)\.?\s*</strong>")
PART_MARK = re.compile(r'class="part(Hdr|No)[^"]*"[^>]*>(.*?)</td>', re.S)
SUB_ANCHOR = re.compile(r'<a name="((?:pr|Sc)[^"]*?ps(\d+[A-Z]*)-)"\s*>')
TITLE = re.compile(r"<title>([^<]*)</title>")
CURRENT = re.compile(r"Current version as at ([0-9]{1,2} [A-Za-z]{3} [0-9]{4})")

DASH = re.compile(r"^[—–-]\s*")
TAG = re.compile(r"<[^>]+>")
#: Rows that are handed on at once.
ROWS = 4096

BLOCKS = "page long, line long, start long, end long, class string, level int, number string, anchor string, text string"
#: A heading, or what stands before a part's first one, with what is shown of the blocks from it to before the next.
FRAGMENTS = "page long, line long, level int, number_line long, number string, anchor string, text string, lines array<long>, classes array<string>, texts array<string>, toc_lines array<long>, toc_texts array<string>"


def plain(markup: str) -> str:
    """Tags to spaces, entities resolved, white space collapsed."""
    return " ".join(html.unescape(TAG.sub(" ", markup) if "<" in markup else markup).split())


@lru_cache(1024)
def _tag(attributes: str) -> tuple[str, int | None]:
    """A paragraph's class and level."""
    css, head = CLASS.search(attributes), HEADING.search(attributes)
    return (css[1].split() or ["plain"])[0].lower() if css else "plain", int(head[1]) if head else None


def _blocks(page: int, text: str) -> Iterator[tuple]:
    """The paragraphs of one part in order, with their place in its characters."""
    for line, m in enumerate(PARAGRAPH.finditer(text)):
        css, level = _tag(m[1])
        number = anchor = None
        # Most paragraphs have neither; other letters may equal an ASCII one but for their case.
        low = m[0].lower() if m[0].isascii() else ""
        if not low or "charsectno" in low:
            number = SECTION_NUMBER.search(m[0])
        if not low or "id=" in low:
            anchor = ELEMENT_ID.search(m[0])
        yield page, line, m.start(), m.end(), css, level, number and number[1].strip().rstrip("."), anchor and anchor[1], plain(m[2])


def blocks(parts: DataFrame) -> DataFrame:
    """(doc_id, BLOCKS) of parts(doc_id, page, text), the parts of documents of markup; null texts have none."""
    return _mapped(parts, ["page", "text"], BLOCKS, lambda page, text: _blocks(page, text or ""))


def _fragments(page: int, text: str) -> Iterator[tuple]:
    """The FRAGMENTS of one part in order; what no unit shows is left out."""
    own = None
    for _, line, _, _, css, level, number, anchor, said in _blocks(page, text):
        if own is None or level is not None:
            if own:
                yield tuple(own)
            own = [page, line, level, None, None, *((None, None) if level is None else (anchor, said)), [], [], [], [], []]
        if own[4] is None and number is not None:
            own[3:5] = line, number
        if css == "toc5":
            own[10].append(line)
            own[11].append(said)
        if own[2] in (None, 5) and said and not css.startswith(("acthead", "toc")):
            own[7].append(line)
            own[8].append(css)
            own[9].append(said)
    if own:
        yield tuple(own)


def _mapped(df: DataFrame, columns: list[str], ddl: str, found) -> DataFrame:
    """(doc_id, ddl): what found gives for the columns of each row of df, ROWS rows or a little more at a time."""
    schema = type(df.schema)([df.schema["doc_id"], *_schema(ddl)])
    names, arrow = schema.names, _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for values in zip(*(batch.column(c).to_pylist() for c in ("doc_id", *columns)), strict=True):
                rows += [(values[0], *x) for x in found(*values[1:])]
                if len(rows) >= ROWS:
                    yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)), schema=arrow)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)), schema=arrow)

    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return df.select("doc_id", *columns).mapInArrow(run, schema)


def _schema(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).fields


def _arrow(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def containers(files: DataFrame) -> DataFrame:
    """(doc_id, page, text): the markup of zip containers files(doc_id, content), entry by entry in their order;
    other entries and contents that are no zip give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, content in zip(batch.column("doc_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if not content or not zipfile.is_zipfile(io.BytesIO(content)):
                    continue
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for page, name in enumerate(n for n in z.namelist() if n.endswith((".xhtml", ".html"))):
                        yield pa.RecordBatch.from_pydict({"doc_id": [doc], "page": [page], "text": [z.read(name).decode("utf-8", "ignore")]}, schema=_arrow(schema))

    schema = type(files.schema)([files.schema["doc_id"], *_schema("page long, text string")])
    return files.select("doc_id", "content").mapInArrow(run, schema)


def _above(heads: DataFrame) -> DataFrame:
    """Headings of sections with what stands above them: hierarchy (by level), schedule, and whether endnotes have
    begun."""
    w = Window.partitionBy("doc_id").orderBy("page", "line").rowsBetween(Window.unboundedPreceding, 0)
    at = F.struct("page", "line")
    last = lambda cond, value: F.last(F.when(cond, value), ignorenulls=True).over(w)
    level, schedule = F.col("level"), F.regexp_extract("text", SCHEDULE, 1)
    is_schedule = (level < 5) & (schedule != "")
    out = heads.withColumns({f"_l{k}": last(level == k, F.struct(at.alias("at"), "text")) for k in range(1, 5)})
    out = out.withColumns({f"_up{k}": last(level < k, at) for k in range(2, 5)})
    out = out.withColumns({f"_end{k}": last((level <= k) & ~is_schedule, at) for k in range(1, 5)})
    out = out.withColumn("_s", last(is_schedule, F.struct(at.alias("at"), schedule.alias("number"), level.alias("level"))))
    out = out.withColumn("_endnotes", F.coalesce(F.max(F.when((level < 5) & F.col("text").rlike(r"(?i)^Endnotes\b"), True)).over(w), F.lit(False)))
    names = [F.col("_l1.text")] + [F.when(F.col(f"_up{k}").isNull() | (F.col(f"_l{k}.at") > F.col(f"_up{k}")), F.col(f"_l{k}.text")) for k in range(2, 5)]
    ended = F.lit(None).cast("boolean")
    for k in range(1, 5):
        ended = F.when(F.col("_s.level") == k, F.coalesce(F.col(f"_end{k}") > F.col("_s.at"), F.lit(False))).otherwise(ended)
    active = F.when(F.col("_s").isNotNull() & ~ended, F.col("_s.number"))
    return out.withColumns({"hierarchy": F.filter(F.array(*names), lambda x: x.isNotNull()), "_schedule": active}).where("level = 5 and not _endnotes")


def _pieces(number: Column, found: Column) -> Column:
    """array<struct<label, blocks, text>>: what begins with a labelled block of class subsection; blocks before the
    first and topic headings are in none; without any, one piece of all blocks."""
    label = lambda b: F.when(b["class"] == "subsection", F.nullif(F.regexp_extract(b["text"], SUBSECTION, 1), F.lit("")))
    kept = F.transform(F.filter(found, lambda b: b["class"] != "subsectionhead"), lambda b: F.struct(label(b).alias("label"), b.alias("block")))
    whole = F.array(F.struct(number.alias("label"), found.alias("blocks")))

    def step(s: Column, x: Column) -> Column:
        block = F.array(x["block"])
        new = F.concat(s, F.array(F.struct(F.concat(number, F.lit("("), x["label"], F.lit(")")).alias("label"), block.alias("blocks"))))
        last = F.try_element_at(s, F.lit(-1))
        longer = F.concat(F.slice(s, F.lit(1), F.size(s) - 1), F.array(F.struct(last["label"].alias("label"), F.concat(last["blocks"], block).alias("blocks"))))
        return F.when(x["label"].isNotNull(), new).when(F.size(s) > 0, longer).otherwise(s)

    split = F.aggregate(kept, F.slice(whole, 1, 0), step, lambda s: F.when(F.size(s) > 0, s).otherwise(whole))
    return F.transform(split, lambda p: F.struct(p["label"].alias("label"), p["blocks"].alias("blocks"), _joined(p["blocks"]).alias("text")))


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda b: b["text"]), " ")


def parse(parts: DataFrame, acts: DataFrame, prefix: str = "au", least: int = 30, most: int = 20_000) -> DataFrame:
    """The rule units of markup parts(doc_id, page, text) of documents acts(doc_id, economy, act_name, act_ref,
    law_number_ref, source_url).

    A section is a heading of level 5 whose markup tells its number; clauses of schedules are cited by these,
    sections with decimals as such; what follows a heading of endnotes is no law.  Only blocks of class subsection
    begin a subsection.  Documents without acts or such headings give no units."""
    path = fresh_path(parts.sparkSession, "fragments")
    _mapped(parts, ["page", "text"], FRAGMENTS, lambda page, text: _fragments(page, text or "")).write.parquet(path)
    every = parts.sparkSession.read.parquet(path)
    number = F.when(F.col("number").isNotNull(), F.struct("page", F.col("number_line").alias("line"), "number")).alias("number")
    blocks_ = F.transform(F.arrays_zip("lines", "classes", "texts"), lambda x: F.struct(F.col("page").alias("page"), x["lines"].alias("line"), x["classes"].alias("class"), x["texts"].alias("text"))).alias("blocks")
    heads = every.where("level is not null").select("doc_id", "page", "line", "level", "anchor", "text")
    on = (F.col("doc_id") == F.col("_d")) & (F.col("page") == F.col("_p")) & (F.col("line") == F.col("_l"))
    # What stands before a part's first heading belongs to the last one of the parts before.
    before = F.last(F.when(F.col("level").isNotNull(), F.struct("page", "line", "level")), ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("page", "line").rowsBetween(Window.unboundedPreceding, 0))
    led = every.select("doc_id", "page", "line", "level").withColumn("_h", before).where("level is null and _h.level = 5").select(F.col("doc_id").alias("_d"), F.col("page").alias("_p"), F.col("line").alias("_l"), "_h").distinct()
    led = every.where("level is null").select("doc_id", "page", "line", number, blocks_).join(led, on).select("doc_id", F.col("_h.page").alias("page"), F.col("_h.line").alias("line"), "number", "blocks")
    body = every.where("level = 5").select("doc_id", "page", "line", number, blocks_).unionByName(led)
    body = body.groupBy(F.col("doc_id").alias("_d"), F.col("page").alias("_p"), F.col("line").alias("_l"))
    # All that is told of a section comes together before its blocks do, which are shuffled once.
    met = _above(heads).join(body.agg(F.min("number").alias("_n")).where("_n is not null"), on).drop("_d", "_p", "_l")
    number = F.col("_n.number")
    met = met.select("doc_id", "page", "line", "anchor", "hierarchy", F.when(~F.contains(number, F.lit(".")), F.col("_schedule")).alias("schedule"), number.alias("section_number"), F.col("text").alias("_title"))
    tocs = every.select("doc_id", "page", F.explode(F.arrays_zip("toc_lines", "toc_texts")).alias("t")).select("doc_id", "page", F.col("t.toc_lines").alias("line"), F.col("t.toc_texts").alias("text")).where(F.col("text").rlike(TOC))
    hints = tocs.groupBy(F.col("doc_id").alias("_d"), F.regexp_extract("text", TOC, 1).alias("_n")).agg(F.min(F.struct("page", "line", F.trim(F.regexp_extract("text", TOC, 2)).alias("hint"))).alias("_hint"))
    met = met.join(hints, (F.col("doc_id") == F.col("_d")) & (F.col("section_number") == F.col("_n")), "left").drop("_d", "_n")
    own = acts.select(F.col("doc_id").alias("_d"), "economy", "act_name", "act_ref", "law_number_ref", "source_url")
    met = met.join(own, F.col("doc_id") == F.col("_d")).drop("_d")
    shown = F.transform(F.sort_array(F.flatten(F.collect_list("blocks"))), lambda b: F.struct(b["class"].alias("class"), b["text"].alias("text")))
    met = met.join(body.agg(shown.alias("_b")), on).drop("_d", "_p", "_l")
    title = F.trim(F.regexp_replace("_title", F.concat(F.lit(r"^\Q"), "section_number", F.lit(r"\E\s*")), F.lit("")))
    first = lambda word: F.coalesce(F.try_element_at(F.filter("hierarchy", lambda x: x.rlike(rf"(?i)^{word}\b")), F.lit(1)), F.lit(""))
    met = met.withColumns({"heading": F.substring(title, 1, 120), "part": first("Part"), "division": first("Division")})
    each = met.withColumn("piece", F.explode(_pieces(F.col("section_number"), F.col("_b")))).where(F.length("piece.text") >= least)
    heading = F.col("heading")
    flat = F.replace(F.replace(F.col("piece.label"), F.lit("("), F.lit("-")), F.lit(")"), F.lit(""))
    document = F.concat(F.lit(f"{prefix}:"), "act_ref")
    inside = F.col("schedule").isNotNull()
    labels = F.filter(F.transform("piece.blocks", lambda b: F.regexp_extract(b["text"], ITEM, 1)), lambda x: x != "")
    return each.select(
        "doc_id",
        F.concat(document, F.when(inside, F.concat(F.lit(":sch"), "schedule", F.lit("-cl"))).otherwise(":s"), flat).alias("id"),
        document.alias("document_id"),
        "economy",
        F.col("act_name").alias("law_name"),
        "law_number_ref",
        F.when(inside, F.concat(F.lit("Sch "), "schedule", F.lit(", cl. "), "piece.label")).otherwise(F.concat(F.lit("s. "), "piece.label")).alias("article_section"),
        F.substring("piece.text", 1, most).alias("text"),
        F.substring(_joined(F.col("_b")), 1, most).alias("raw_context"),
        "source_url",
        F.lit("unaligned").alias("location_reference"),
        "section_number",
        heading,
        "anchor",
        F.col("_hint.hint").alias("toc_hint"),
        F.concat("hierarchy", F.array(heading)).alias("hierarchy_path"),
        "part",
        "division",
        "schedule",
        F.col("piece.blocks").alias("semantic_blocks"),
        labels.alias("hierarchy_labels"),
    )


SECTIONS = "law_name string, current_as_at string, sec_id string, section_number string, heading string, part string, text string, subsections array<struct<label:string,text:string,anchor:string>>"


def _anchored(page: str, suffix: str) -> Iterator[tuple]:
    """The sections of a portal's page in order."""
    title, current = TITLE.search(page), CURRENT.search(page)
    law = plain(title[1]).replace(suffix, "").strip() if title else ""
    marks = PART_MARK.finditer(page)
    mark, part, number_of_part = next(marks, None), "", ""
    at = page.find(CONTAINER)
    while at >= 0:
        begin, at = at + len(CONTAINER), page.find(CONTAINER, at + 1)
        chunk = page[begin : at if at >= 0 else len(page)]
        while mark and mark.start() < begin:  # both go through the page once
            if mark[1] == "No":
                number_of_part = plain(mark[2])
            else:
                part = f"{number_of_part} {plain(mark[2])}".strip()
            mark = next(marks, None)
        key = SECTION_ID.search(chunk)
        if not key:
            continue
        heading, strong = SECTION_HEADING.search(chunk), STRONG_NUMBER.search(chunk)
        number = strong[1] if strong else key[1].strip("-").removeprefix("pr")
        anchors = [*SUB_ANCHOR.finditer(chunk)]
        ends = [m.start() for m in anchors[1:]] + [len(chunk)]
        subs = [(f"{number}({m[2]})", DASH.sub("", plain(chunk[m.end() : e])), m[1]) for m, e in zip(anchors, ends, strict=False)]
        subs = [s for s in subs if s[1]]
        if not subs:
            whole = plain(chunk[strong.end() if strong else heading.end() if heading else 0 :])
            subs = [(number, whole, key[1])] if whole else []
        yield law, current and current[1], key[1], number, plain(heading[1]) if heading else "", part, "\n".join(s[1] for s in subs), subs


def anchored_sections(pages: DataFrame, suffix: str = "") -> DataFrame:
    """(doc_id, SECTIONS) of pages(doc_id, text): the sections of each portal page with their subsections by anchor,
    under the part whose heading stands before them.  suffix is cut from the title; null texts give none."""
    return _mapped(pages, ["text"], SECTIONS, lambda text: _anchored(text or "", suffix))


def section_units(sections: DataFrame, acts: DataFrame) -> DataFrame:
    """One rule unit for each subsection of anchored_sections() in documents acts(doc_id, economy, act_ref,
    law_number_ref, last_amended, source_url)."""
    own = acts.select(F.col("doc_id").alias("_d"), "economy", "act_ref", "law_number_ref", "last_amended", "source_url")
    # A section's text is told again from its subsections, so that it is not shuffled beside them.
    met = sections.drop("text").join(own, F.col("doc_id") == F.col("_d")).withColumn("text", F.array_join("subsections.text", "\n")).withColumn("sub", F.explode("subsections"))
    document = F.concat(F.lower("economy"), F.lit(":"), "act_ref")
    return met.select(
        "doc_id",
        F.concat(document, F.lit(":"), "sub.anchor").alias("id"),
        document.alias("document_id"),
        "economy",
        "law_name",
        "law_number_ref",
        "last_amended",
        F.concat(F.lit("s. "), "sub.label").alias("article_section"),
        F.col("sub.text").alias("text"),
        F.col("text").alias("raw_context"),
        F.concat("source_url", F.lit("#"), "sec_id").alias("source_url"),
        F.concat(F.lit("#"), "sec_id").alias("location_reference"),
        "heading",
        "part",
        "section_number",
        "current_as_at",
        legal.rule_components(F.col("text")).alias("rule_components"),
    )
