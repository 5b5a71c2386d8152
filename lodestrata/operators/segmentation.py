"""Document structure: headings, segments, furniture, spans."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import furniture_print


def carry_forward(rows: DataFrame, by: list[str], order: list[Column], heading: Column, name: str = "heading") -> DataFrame:
    """As-of join: each row with the latest heading before it (its own, if it is one); heading is null on
    other rows."""
    return rows.withColumn(name, F.last(heading, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def segments(rows: DataFrame, by: list[str], order: str, text: str, is_heading: Column) -> DataFrame:
    """One row per segment, from a heading to before the next: number, first row, rows and joined text; rows
    before the first heading are segment 0."""
    number = F.sum(is_heading.cast("int")).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    cut = rows.withColumn("segment", number)
    parts = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(text))))
    out = cut.groupBy(*by, "segment").agg(F.min(order).alias("first"), F.count("*").alias("rows"), parts.alias("_p"))
    return out.withColumn("body", F.array_join(F.transform("_p", lambda p: p[text]), "\n")).drop("_p")


#: The parts of a page, from its top, where headers end and footers begin.
HEADER, FOOTER = 0.15, 0.74


def repeated_furniture(lines: DataFrame, share: float = 0.3) -> DataFrame:
    """(doc_id, print, pages) of lines(doc_id, page, place, line) at the top or the bottom of a page (place
    goes from 0 to 1) that occur on at least max(2, ceil(share * pages)) of a document's pages."""
    edge = (F.col("place") <= HEADER) | (F.col("place") >= FOOTER)
    marked = lines.where(edge).withColumn("print", furniture_print(F.col("line"))).where("print <> ''")
    total = lines.groupBy(F.col("doc_id").alias("_doc")).agg(F.countDistinct("page").alias("total"))
    often = marked.groupBy("doc_id", "print").agg(F.countDistinct("page").alias("pages"))
    met = often.join(total, F.col("doc_id") == F.col("_doc"))
    return met.where(F.col("pages") >= F.greatest(F.lit(2), F.ceil(F.col("total") * F.lit(share)))).select("doc_id", "print", "pages")


def monotonic_sections(headings: DataFrame, jump: int = 40, memory: int = 6) -> DataFrame:
    """headings(doc_id, pos, number, suffix) with accepted: a heading is accepted if its (number, suffix)
    exceeds all accepted so far by no more than `jump`, or if it is a letter sibling of the last one that is
    not among the last `memory` accepted.  Whether a row counts depends on the rows accepted before, so each
    document is one ordered group."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos", kind="stable")
        top, recent, out = (0, ""), [], []
        for number, suffix in zip(group["number"], group["suffix"].fillna(""), strict=True):
            own = (int(number), suffix)
            ahead = own > top and own[0] - top[0] <= jump
            sibling = bool(suffix) and own[0] == top[0] and own not in recent[-memory:]
            out.append(ahead or sibling)
            if out[-1]:
                top = max(top, own)
                recent.append(own)
        return group.assign(accepted=out)

    schema = type(headings.schema)([*headings.schema.fields]).add("accepted", "boolean")
    return headings.groupBy("doc_id").applyInPandas(run, schema)


def expected_subsections(markers: Column) -> Column:
    """The markers of an array of numbers that stand where the next number is due, if two or more do."""
    due = F.aggregate(markers, F.array().cast("array<int>"), lambda kept, m: F.when(m == F.size(kept) + 1, F.concat(kept, F.array(m))).otherwise(kept))
    return F.when(F.size(due) >= 2, due).otherwise(F.array().cast("array<int>"))


def span_offsets(spans: DataFrame, by: list[str], order: str, text: str) -> DataFrame:
    """spans with start and end: running character offsets, one character between spans."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(text) + 1).over(w), F.lit(0))
    return spans.withColumn("start", start).withColumn("end", F.col("start") + F.length(text))


def suffix_repair(rows: DataFrame, by: list[str], order: str, number: str, suffix: str) -> DataFrame:
    """rows with repaired: a missing suffix whose neighbours are two letters of the same number apart."""
    w = Window.partitionBy(*by).orderBy(order)
    before, after = F.lag(suffix).over(w), F.lead(suffix).over(w)
    same = (F.lag(number).over(w) == F.col(number)) & (F.lead(number).over(w) == F.col(number))
    between = F.ascii(after) - F.ascii(before) == 2
    return rows.withColumn("repaired", F.when((F.col(suffix) == "") & same & between, F.char(F.ascii(before) + 1)).otherwise(F.col(suffix)))


def html_sections(html: Column) -> Column:
    """Paragraph texts of a page in their order, tags removed."""
    found = F.regexp_extract_all(html, F.lit(r"(?s)<p(?:\s[^>]*)?>(.*?)</p>"), F.lit(1))
    return F.transform(found, lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, "<[^>]*>", " "), r"\s+", " ")))


#: Pages whose windows page_windows() keeps together.
BLOCK = 8


def page_windows(units: DataFrame, pages: DataFrame, most: int = 6) -> DataFrame:
    """(unit_id, volume, first, last): of the windows of up to `most` consecutive pages whose texts, joined by spaces,
    hold a unit's text, the narrowest and of these the earliest, by volume.

    A window that holds a unit has a page with each of its inner words, so a unit meets the windows around the pages of
    its rarest one only; a unit without inner words meets all windows of its volume.  Both
    are brought together once for all windows that begin in a block of BLOCK pages.  Null units are in no window, null
    pages are empty."""
    order = Window.partitionBy("volume").orderBy("page")
    placed = pages.select("volume", "page", F.coalesce("text", F.lit("")).alias("text"), F.row_number().over(order).alias("at"))
    ahead = F.collect_list(F.struct("page", "text")).over(order.rowsBetween(0, BLOCK + most - 2))
    blocks = placed.select(F.col("volume").alias("_v"), F.col("at").alias("_at"), ahead.alias("ahead")).where((F.col("_at") - 1) % BLOCK == 0)
    words = placed.select(F.col("volume").alias("_v"), "at", F.explode(F.array_distinct(F.split("text", " "))).alias("_w"))
    often = words.groupBy("_v", "_w").agg(F.count("*").alias("n"))
    wanted = units.where("text is not null").select("unit_id", "volume", "text", F.array_distinct(F.slice(F.split("text", " "), 2, F.greatest(F.size(F.split("text", " ")) - 2, F.lit(0)))).alias("inner"))
    some = wanted.where("size(inner) > 0")
    met = some.select("unit_id", "volume", F.size("inner").alias("k"), F.explode("inner").alias("w")).join(often, (F.col("volume") == F.col("_v")) & (F.col("w") == F.col("_w")))
    rarest = met.groupBy("unit_id", "volume", "k").agg(F.count("*").alias("found"), F.min(F.struct("n", "w")).getField("w").alias("w")).where("found = k").select("unit_id", "volume", "w")
    near = rarest.join(words, (F.col("volume") == F.col("_v")) & (F.col("w") == F.col("_w"))).select("unit_id", "volume", F.explode(F.sequence(F.greatest(F.col("at") - most + 1, F.lit(1)), F.col("at"))).alias("start"))
    block = (F.col("start") - 1 - (F.col("start") - 1) % BLOCK + 1).alias("block")
    near = near.groupBy("unit_id", "volume", block).agg(F.collect_set("start").alias("starts"))
    near = near.join(some.select(F.col("unit_id").alias("_u"), F.col("volume").alias("_uv"), "text"), (F.col("unit_id") == F.col("_u")) & (F.col("volume") == F.col("_uv"))).select("unit_id", "volume", "text", "block", "starts")
    one = near.join(blocks, (F.col("volume") == F.col("_v")) & (F.col("block") == F.col("_at")))
    every = F.sequence(F.col("_at"), F.col("_at") + F.least(F.size("ahead"), F.lit(BLOCK)) - 1)
    two = wanted.where("size(inner) = 0").join(blocks, F.col("volume") == F.col("_v")).withColumn("starts", every)
    both = one.select("unit_id", "volume", "text", "_at", "starts", "ahead").unionByName(two.select("unit_id", "volume", "text", "_at", "starts", "ahead"))
    joined = lambda s, n: F.array_join(F.transform(F.slice("ahead", s - F.col("_at") + 1, n), lambda p: p["text"]), " ")
    fits = lambda s: F.sequence(F.lit(1), F.least(F.lit(most), F.size("ahead") - s + F.col("_at")))
    least = lambda s: F.try_element_at(F.filter(fits(s), lambda n: F.contains(joined(s, n), F.col("text"))), F.lit(1))
    found = F.array_min(F.filter(F.transform("starts", lambda s: F.struct(least(s).alias("n"), s.alias("start"))), lambda h: h["n"].isNotNull()))
    hits = both.withColumn("h", found).where("h is not null").withColumn("_k", F.col("h.start") - F.col("_at"))
    page = lambda k: F.element_at("ahead", k)["page"]
    best = hits.groupBy("unit_id", "volume").agg(F.min(F.struct("h.n", "h.start", page(F.col("_k") + 1).alias("first"), page(F.col("_k") + F.col("h.n")).alias("last"))).alias("b"))
    return best.select("unit_id", "volume", "b.first", "b.last")


def closure(rows: DataFrame, hard: int = 3000, soft: int = 700) -> DataFrame:
    """rows(snippet, source) with code, start, end and closed: where the snippet, grown to whole sentences,
    stands in the source."""
    from lodestrata.functions.closure import close

    schema = type(rows.schema)([*rows.schema.fields]).add("code", "string").add("start", "integer").add("end", "integer").add("closed", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [close(a or "", b or "", hard, soft) for a, b in zip(batch.column("snippet").to_pylist(), batch.column("source").to_pylist(), strict=True)]
            new = [pa.array([g[k] for g in got], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=schema.names)

    return rows.mapInArrow(run, schema)


def best_grammar(hits: DataFrame, declared: Column) -> DataFrame:
    """hits(doc_id, grammar, n): each document's grammar of most hits; a declared one wins ties, then the name."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("n"), F.desc(F.coalesce(F.col("grammar") == declared, F.lit(False))), "grammar")
    return hits.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def after_last(rows: DataFrame, by: list[str], order: str, title: Column) -> DataFrame:
    """The rows from the last title on, which drops tables of contents; all rows of a group without one."""
    at = F.max(F.when(title, F.col(order))).over(Window.partitionBy(*by))
    return rows.withColumn("_at", at).where(F.col("_at").isNull() | (F.col(order) >= F.col("_at"))).drop("_at")


def occurrence_distinct(rows: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """Each value of a group once, at its first place."""
    return rows.groupBy(*by, value).agg(F.min(order).alias(order))
