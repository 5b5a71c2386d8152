"""Statutes from the text of pages: sections by grammar, subsections, rule units.

A document's lines are never gathered.  Lines that could be headings are few; whether one is accepted depends on
those accepted before it, so the candidates of each document and pattern are scanned in chunks, as a state machine
whose state is small: chunks run at once from a guess of the state before them, and those that guessed wrong run
again from what their predecessor ended with, until all agree.  A page is cut into its sections' shares by its own
headings and the last one before it, and it is shuffled once, by its document."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from lodestrata.functions import legal
from lodestrata.functions.text import collapse, law_tokens
from lodestrata.session import partitions, staged

LINE_END = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"
#: Candidates of a document and pattern that one chunk has at least but for the last, and lines of a block of them.
CHUNK, BLOCK = 4096, 512
# How far ahead a section's number may be, and how many accepted ones a sibling must differ from.
JUMP, MEMORY = 40, 6
OCR_SUFFIX = r"^(\s{0,6})(\d{1,3})([a-z])(\.\s+.*)$"
#: Pages' columns, and those of acts, by doc_id.
PAGES, ACTS = "doc_id, page, text", "doc_id, economy, act_name, act_ref, law_number_ref, source_url, grammar, citation, ocr"


def lines_of(pages: DataFrame) -> DataFrame:
    """(doc_id, page, line, text) of the lines of pages(doc_id, page, text)."""
    cut = pages.where("text is not null").select("doc_id", "page", F.posexplode(F.split("text", LINE_END)).alias("line", "text"))
    return cut


def repaired(lines: DataFrame, scanned: DataFrame) -> DataFrame:
    """lines with the letters of section numbers in scanned(doc_id) documents repaired: a lower-case letter becomes a
    capital, and one between two letters of the same number that are two apart the letter between them."""
    hits = lines.join(scanned.select("doc_id").distinct(), "doc_id", "left_semi").where(F.col("text").rlike(OCR_SUFFIX))
    part = lambda k: F.regexp_extract("text", OCR_SUFFIX, k)
    w = Window.partitionBy("doc_id").orderBy("page", "line")
    hits = hits.select("doc_id", "page", "line", *(part(k).alias(f"_{k}") for k in (1, 2, 3, 4)))
    before, after = F.ascii(F.upper(F.lag("_3").over(w))), F.ascii(F.upper(F.lead("_3").over(w)))
    same = (F.lag("_2").over(w) == F.col("_2")) & (F.lead("_2").over(w) == F.col("_2"))
    letter = F.when(same & (after - before == 2), F.char(before + 1)).otherwise(F.upper("_3"))
    fixed = hits.select(F.col("doc_id").alias("_d"), F.col("page").alias("_p"), F.col("line").alias("_l"), F.concat("_1", "_2", letter, "_4").alias("_text"))
    met = lines.join(fixed, (F.col("doc_id") == F.col("_d")) & (F.col("page") == F.col("_p")) & (F.col("line") == F.col("_l")), "left")
    return met.select("doc_id", "page", "line", F.coalesce("_text", "text").alias("text"))


def marks(runs: DataFrame) -> DataFrame:
    """(doc_id, page, line, hits, enacting) of the lines of runs(doc_id, page, line, texts) that a pattern takes for a
    heading or that are an enacting title, and of each page's first line; texts are the lines from line on.  A hit's
    pattern is its rank: those of a grammar come before the common ones."""
    met = []
    for name, patterns in legal.SECTION_GRAMMARS.items():
        for k, p in enumerate(patterns):
            hit = F.struct(F.lit(name).alias("grammar"), F.lit(k + 10 * (name == "statute")).alias("pattern"), F.regexp_extract("text", p, 1).alias("number"), F.regexp_extract("text", p, 2).alias("heading"))
            met.append(F.when(F.col("text").rlike(p), hit))
    # A filter over what is exploded would have Spark make it once more; lines that no pattern takes go by one pattern.
    lines = runs.select("doc_id", "page", F.col("line").alias("_from"), F.posexplode_outer("texts").alias("_at", "text"))
    enacting, line = F.col("text").rlike(legal.ENACTING), F.col("_from") + F.col("_at")
    lines = lines.where(F.col("text").rlike(_any_heading()) | enacting | (line == 0))
    return lines.select("doc_id", "page", line.alias("line"), F.filter(F.array(*met), lambda x: x.isNotNull()).alias("hits"), enacting.alias("enacting"))


def _any_heading() -> str:
    """What any pattern of SECTION_GRAMMARS takes."""
    return "^(?:" + "|".join(f"(?:{p.replace('^', '', 1)})" for patterns in legal.SECTION_GRAMMARS.values() for p in patterns) + ")"


def enacted(marked: DataFrame) -> DataFrame:
    """The marks from a document's last enacting title on, which drops its table of contents; all without one."""
    at = F.struct("page", "line")
    start = marked.where("enacting").groupBy(F.col("doc_id").alias("_d")).agg(F.max(at).alias("_start"))
    return marked.join(start, F.col("doc_id") == F.col("_d"), "left").where(F.col("_start").isNull() | (at >= F.col("_start"))).drop("_d", "_start")


def candidates(marked: DataFrame, acts: DataFrame) -> DataFrame:
    """(doc_id, pattern, page, line, number, key) of the marks that a pattern of the document's grammar or of the
    common one takes for a heading."""
    found = marked.where(F.size("hits") > 0).join(acts.select(F.col("doc_id").alias("_d"), F.col("grammar").alias("_grammar"), law_tokens(F.col("act_name")).alias("_act")), F.col("doc_id") == F.col("_d"))
    used = lambda h: (h["grammar"] == "statute") | F.coalesce(F.col("_grammar") == h["grammar"], F.lit(False))
    found = found.select("doc_id", "page", "line", "_act", F.explode(F.filter("hits", used)).alias("h"))
    found = found.where(legal.plausible_heading(F.col("h.heading"), F.col("_act")))
    return found.select("doc_id", "h.pattern", "page", "line", "h.number", legal.section_order(F.col("h.number")).alias("key"))


def _chunked(found: DataFrame) -> DataFrame:
    """found with chunk: whole blocks of lines, cut where CHUNK candidates are full."""
    block = F.floor(F.col("line") / BLOCK)
    sizes = found.groupBy("doc_id", "pattern", "page", block.alias("block")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("doc_id", "pattern").orderBy("page", "block").rowsBetween(Window.unboundedPreceding, -1))
    chunks = sizes.withColumn("chunk", F.floor(F.coalesce(before, F.lit(0)) / CHUNK).cast("int"))
    chunks = chunks.select(*(F.col(c).alias(f"_{c}") for c in ("doc_id", "pattern", "page", "block", "chunk")))
    on = (F.col("doc_id") == F.col("_doc_id")) & (F.col("pattern") == F.col("_pattern")) & (F.col("page") == F.col("_page")) & (block == F.col("_block"))
    return found.join(chunks, on).select(*found.columns, F.col("_chunk").alias("chunk"))


class Monotonic:
    """Accepts headings whose keys rise: by no more than JUMP in their first number, or letter siblings of the
    highest one so far, in any order but each once among the last MEMORY accepted."""

    START = json.dumps([[0, -1, -1, ""], []])

    def __init__(self, state: str):
        top, recent = json.loads(state)
        self.top, self.recent = tuple(top), recent

    def takes(self, number: str, key: tuple) -> bool:
        if self.recent:
            sibling = key[:-1] == self.top[:-1] and key[-1] != self.top[-1]
            if sibling and number in self.recent or not sibling and (key <= self.top or key[0] > self.top[0] + JUMP):
                return False
        elif key[0] == 0:
            return False
        self.recent = [*self.recent, number][-MEMORY:]
        self.top = max(self.top, key)
        return True

    def state(self) -> str:
        return json.dumps([list(self.top), self.recent])


def _scan(found: DataFrame) -> DataFrame:
    """Runs the chunks of found(doc_id, pattern, chunk, state, ...): its accepted rows, and for each chunk one row
    without a line whose state is what the chunk ended with."""
    keys = ["doc_id", "pattern", "chunk"]
    names = [*keys, "page", "line", "number", "state"]
    schema = StructType([StructField(c, found.schema[c].dataType) for c in names])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = machine = None
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(batch.column(c).to_pylist() for c in [*names, "key"]), strict=True):
                if row[:3] != last:
                    if machine:
                        out.append((*last, None, None, None, machine.state()))
                    last, machine = row[:3], Monotonic(row[6])
                key = row[7]
                if machine.takes(row[5], (key["a"], key["b"], key["c"], key["d"])):
                    out.append((*row[:6], None))
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out, strict=True)), strict=True)) if out else {n: [] for n in names}, schema=_arrow(schema))
        if machine:
            yield pa.RecordBatch.from_pydict(dict(zip(names, [[v] for v in (*last, None, None, None, machine.state())], strict=True)), schema=_arrow(schema))

    dealt = found.repartition(*keys).sortWithinPartitions(*keys, "page", "line")
    return dealt.select(*names, "key").mapInArrow(run, schema)


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def accepted(found: DataFrame) -> DataFrame:
    """(doc_id, pattern, page, line, number) of the candidates that Monotonic accepts, in each document and pattern
    in the order of its lines."""
    keys = ["doc_id", "pattern", "chunk"]
    chunks = staged(_chunked(found))
    result = staged(_scan(chunks.withColumn("state", F.lit(Monotonic.START))))
    given = result.where("line is null").select(*keys, F.lit(Monotonic.START).alias("given"), F.col("state").alias("left"))
    while True:
        w = Window.partitionBy("doc_id", "pattern").orderBy("chunk")
        wrong = given.withColumn("due", F.coalesce(F.lag("left").over(w), F.lit(Monotonic.START))).where("due <> given").select(*(F.col(c).alias(f"_{c}") for c in keys), "due")
        if wrong.isEmpty():
            return result.where("line is not null").select("doc_id", "pattern", "page", "line", "number")
        on = [F.col(c) == F.col(f"_{c}") for c in keys]
        again = _scan(chunks.join(wrong, on).withColumn("state", F.col("due")).drop("due", *(f"_{c}" for c in keys)))
        result = staged(result.join(wrong, on, "left_anti").unionByName(again))
        rerun = wrong.select(*(F.col(f"_{c}").alias(c) for c in keys), F.col("due").alias("given"))
        stays = given.join(wrong, on, "left_anti").select(*keys, "given")
        ends = result.where("line is null").select(*(F.col(c).alias(f"_{c}") for c in keys), F.col("state").alias("left"))
        given = staged(stays.unionByName(rerun).join(ends, on).select(*keys, "given", "left"))


def best_headings(found: DataFrame) -> DataFrame:
    """(doc_id, page, line, number) of the pattern that accepts most in a document; of equals the first."""
    n = found.groupBy("doc_id", "pattern").agg(F.count("*").alias("n"))
    best = n.groupBy(F.col("doc_id").alias("_d")).agg(F.min(F.struct((-F.col("n")).alias("n"), "pattern")).alias("best"))
    return found.join(best, (F.col("doc_id") == F.col("_d")) & (F.col("pattern") == F.col("best.pattern"))).select("doc_id", "page", "line", "number")


def _cut(runs: DataFrame, headings: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """(doc_id, h, lines) of the shares that sections have of runs(doc_id, page, line, texts): h is the last of
    headings(doc_id, page, line, number) at or before each of its lines.  Lines before the first heading of a document
    go.  The lines of repeated(doc_id, page) pages are apart, so that they can stand beside their like; others are one
    text.

    Runs meet all headings of their document, which are few, so they are dealt by doc_id alone, as sections and their
    units are after them."""
    each = headings.groupBy(F.col("doc_id").alias("_d")).agg(F.sort_array(F.collect_list(F.struct("page", "line", "number"))).alias("all"))
    if repeated is None:
        each = each.withColumn("twice", F.lit(None).cast(ArrayType(runs.schema["page"].dataType)))
    else:
        each = each.join(repeated.groupBy(F.col("doc_id").alias("_e")).agg(F.collect_list("page").alias("twice")), F.col("_d") == F.col("_e"), "left")
    met = runs.join(each, F.col("doc_id") == F.col("_d"))
    before = F.slice(F.filter("all", lambda h: h["page"] < F.col("page")), -1, 1)
    met = met.withColumn("heads", F.concat(before, F.filter("all", lambda h: h["page"] == F.col("page"))))

    def share(h: Column, k: Column) -> Column:
        first = F.when(h["page"] == F.col("page"), F.greatest(h["line"] - F.col("line"), F.lit(0))).otherwise(F.lit(0))
        end = F.least(F.get("heads", k + 1)["line"] - F.col("line"), F.size("texts"))
        return F.struct(h.alias("h"), first.alias("first"), F.greatest(end - first, F.lit(0)).alias("n"))

    def lines(s: Column) -> Column:
        own, at = F.slice("texts", s["first"] + 1, s["n"]), F.col("line") + s["first"]
        row = lambda line, text: F.struct(F.col("page").alias("page"), line.alias("line"), text.alias("text"))
        apart = F.transform(own, lambda t, k: row(at + k, t))
        return F.struct(s["h"].alias("h"), F.when(F.coalesce(F.array_contains("twice", F.col("page")), F.lit(False)), apart).otherwise(F.array(row(at, F.array_join(own, "\n")))).alias("lines"))

    shares = F.transform(F.filter(F.transform("heads", share), lambda s: s["n"] > 0), lines)
    return met.select("doc_id", F.explode(shares).alias("s")).select("doc_id", "s.h", "s.lines")


def _bodies(shares: DataFrame) -> DataFrame:
    """(doc_id, page, line, number, body) of each section of shares(doc_id, h, lines)."""
    joined = F.array_join(F.transform(F.sort_array(F.flatten(F.collect_list("lines"))), lambda x: x["text"]), "\n")
    return shares.groupBy("doc_id", "h").agg(collapse(joined).alias("body")).select("doc_id", "h.page", "h.line", "h.number", "body")


def sections(lines: DataFrame, headings: DataFrame) -> DataFrame:
    """(doc_id, page, line, number, body) of each heading: the lines from it to before the next, white space
    collapsed.  Lines before a document's first heading are in none."""
    return _bodies(_cut(lines.select("doc_id", "page", "line", F.array("text").alias("texts")), headings))


def pieces(number: Column, body: Column) -> Column:
    """array<struct<label, text>> of a section: its subsections, if two or more stand where the next number is due,
    with what stands before them; else the whole."""
    cut = F.split(body, rf"(?={legal.SUBSECTION})")
    start = F.struct(F.lit(1).alias("due"), F.array(F.struct(number.alias("label"), F.lit("").alias("text"))).alias("found"))

    def step(s: Column, x: Column) -> Column:
        n = F.nullif(F.regexp_extract(x, f"^{legal.SUBSECTION}", 1), F.lit("")).try_cast("int")
        last = F.element_at(s["found"], -1)
        longer = F.concat(F.slice(s["found"], F.lit(1), F.size(s["found"]) - 1), F.array(F.struct(last["label"].alias("label"), F.concat(last["text"], x).alias("text"))))
        label = F.concat(number, F.lit("("), F.regexp_extract(x, f"^{legal.SUBSECTION}", 1), F.lit(")"))
        new = F.concat(s["found"], F.array(F.struct(label.alias("label"), x.alias("text"))))
        due = F.coalesce(n == s["due"], F.lit(False))
        return F.struct((s["due"] + due.cast("int")).alias("due"), F.when(due, new).otherwise(longer).alias("found"))

    whole = F.array(F.struct(number.alias("label"), body.alias("text")))

    def told(found: Column) -> Column:
        trimmed = F.transform(found, lambda x: F.struct(x["label"].alias("label"), F.trim(x["text"]).alias("text")))
        return F.when(F.size(found) > 2, F.filter(trimmed, lambda x: x["text"] != "")).otherwise(whole)

    # Bound by a lambda, so that it is made once.
    return F.flatten(F.transform(F.array(F.aggregate(cut, start, step, lambda s: s["found"])), told))


def rule_units(found: DataFrame, acts: DataFrame, least: int = 30, most: int = 20_000) -> DataFrame:
    """The citable units of found(doc_id, page, number, body) in documents acts(ACTS): one for each piece of `least`
    characters or more, cut at `most`; citation is a grammar's name, whose template the labels take."""
    number = F.upper("number")
    body = F.regexp_replace("body", F.concat(F.lit(r"^\Q"), F.col("number"), F.lit(r"\E\.\s*")), F.lit(""))
    own = acts.select(F.col("doc_id").alias("_d"), "economy", "act_name", "act_ref", "law_number_ref", "source_url", "citation", "ocr")
    met = found.withColumn("body", body).join(own, F.col("doc_id") == F.col("_d"))
    # A section's parts are told once, not again for each of its pieces.
    met = met.withColumn("_raw", F.substring("body", 1, most)).withColumn("_parts", legal.rule_components(F.col("_raw")))
    each = met.withColumn("piece", F.explode(pieces(number, F.col("body")))).where(F.length("piece.text") >= least)
    template = F.lit(legal.CITATION_TEMPLATES["statute"])
    for name, text in legal.CITATION_TEMPLATES.items():
        template = F.when(F.col("citation") == name, F.lit(text)).otherwise(template)
    document = F.concat(F.lower(F.substring("economy", 1, 2)), F.lit(":"), "act_ref")
    return each.select(
        "doc_id",
        F.concat(document, F.lit(":s"), F.replace(F.replace(F.col("piece.label"), F.lit("("), F.lit("-")), F.lit(")"), F.lit(""))).alias("id"),
        document.alias("document_id"),
        "economy",
        F.col("act_name").alias("law_name"),
        "law_number_ref",
        F.concat(template, "piece.label").alias("article_section"),
        F.substring("piece.text", 1, most).alias("text"),
        F.col("_raw").alias("raw_context"),
        "source_url",
        F.concat(F.lit("page "), F.col("page").cast("string")).alias("location_reference"),
        number.alias("section_number"),
        F.when(F.col("ocr"), "ocr").otherwise("native_text").alias("extraction"),
        F.col("_parts").alias("rule_components"),
    )


def parse(pages: DataFrame, acts: DataFrame, dealt: bool = False) -> DataFrame:
    """The rule units of pages(PAGES) of documents acts(ACTS).

    grammar names a grammar of SECTION_GRAMMARS that is tried before the common one, citation the one whose template
    labels take; null for the common one's.  ocr: the text comes from images, so section letters are repaired.
    Documents without acts give no units, nor do null texts or those without headings; repeated pages repeat.

    Pages are read twice.  dealt: they are dealt by doc_id already, so that no text is shuffled here."""
    if acts.where("ocr").isEmpty():
        # Without a filter, for which Spark would make the texts once more.
        runs = pages.select("doc_id", "page", F.lit(0).alias("line"), F.coalesce(F.split("text", LINE_END), F.array().cast("array<string>")).alias("texts"))
    else:
        lines = staged(repaired(lines_of(pages), acts.where("ocr")))
        runs, dealt = lines.select("doc_id", "page", "line", F.array("text").alias("texts")), False
    marked = staged(marks(runs))
    headings = staged(best_headings(accepted(staged(candidates(enacted(marked), acts)))))
    if not dealt:
        # What follows is done by documents, up to whoever groups their units.
        runs = runs.repartition(partitions(marked), "doc_id")
    repeated = marked.where("line = 0").groupBy("doc_id", "page").agg(F.count("*").alias("n")).where("n > 1")
    return rule_units(_bodies(_cut(runs, headings, repeated)), acts)
