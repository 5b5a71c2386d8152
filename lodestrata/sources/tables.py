"""Sources beyond Spark's own: markdown tables, XLSX sheets, raw artifacts; and the evidence CSV sink."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def column_index(letters: str) -> int:
    """A is 0, Z is 25, AA is 26."""
    out = 0
    for c in letters.upper():
        out = out * 26 + ord(c) - 64
    return out - 1


def _rows(book: zipfile.ZipFile, part: str) -> Iterator[list[str]]:
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{_SHEET}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si")]
    for row in ElementTree.fromstring(book.read(part)).iter(f"{_SHEET}row"):
        cells: list[str] = []
        for cell in row.iter(f"{_SHEET}c"):
            at = column_index(re.match("[A-Za-z]+", cell.get("r", "A"))[0])
            cells += [""] * (at + 1 - len(cells))
            value = cell.find(f"{_SHEET}v")
            text = "" if value is None else value.text or ""
            if cell.get("t") == "s" and text:
                text = shared[int(text)]
            elif cell.get("t") == "inlineStr":
                text = "".join(t.text or "" for t in cell.iter(f"{_SHEET}t"))
            cells[at] = text
        yield cells


def sheets(book: zipfile.ZipFile) -> dict[str, str]:
    """The part of each sheet of a workbook by the sheet's name."""
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    found = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_SHEET}sheet")
    return {s.get("name"): "xl/" + targets[s.get(f"{_REL}id")].removeprefix("/xl/") for s in found}


def read_xlsx(spark: SparkSession, path: str, width: int) -> DataFrame:
    """(path, sheet, row, cells) of all sheets of the workbooks at path, in any file system; cells are
    padded to width.  A workbook is read by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                book = zipfile.ZipFile(io.BytesIO(content))
                for sheet, part in sheets(book).items():
                    rows = [c + [""] * (width - len(c)) for c in _rows(book, part)]
                    columns = [pa.array([name] * len(rows)), pa.array([sheet] * len(rows)), pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["path", "sheet", "row", "cells"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, sheet string, row int, cells array<string>")


class _Sheet(InputPartition):
    def __init__(self, part: str):
        self.part = part


class XlsxReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.width = options["path"], int(options.get("width", 26))

    def partitions(self) -> list[InputPartition]:
        with zipfile.ZipFile(self.path) as book:
            return [_Sheet(name) for name in sheets(book)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with zipfile.ZipFile(self.path) as book:
            for k, cells in enumerate(_rows(book, sheets(book)[partition.part])):
                yield partition.part, k, cells + [""] * (self.width - len(cells))


class XlsxSource(DataSource):
    """spark.read.format('lodestrata_xlsx').option('path', ...): one partition for each sheet of a workbook
    on a disk that all workers see."""

    @classmethod
    def name(cls) -> str:
        return "lodestrata_xlsx"

    def schema(self) -> str:
        return "sheet string, row int, cells array<string>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return XlsxReader(self.options)


def read_markdown_table(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """Rows of the pipe tables whose header has all required columns, as (path, line, map of cells); rows of
    another width than their header are dropped, equal rows kept once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, lines, cells = [], [], []
            for name, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                header, seen = None, set()
                for k, line in enumerate(text.split("\n")):
                    if not line.strip().startswith("|"):
                        header = None
                        continue
                    row = [c.strip() for c in line.strip().strip("|").split("|")]
                    if header is None:
                        header = row
                    elif all(re.fullmatch(":?-+:?", c) for c in row) or len(row) != len(header) or not set(required) <= set(header):
                        continue
                    elif tuple(row) not in seen:
                        seen.add(tuple(row))
                        names.append(name)
                        lines.append(k)
                        cells.append(list(zip(header, row, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(lines, pa.int32()), pa.array(cells, pa.map_(pa.string(), pa.string()))], names=["path", "line", "cells"])

    texts = spark.read.format("binaryFile").load(path).select("path", F.col("content").cast("string").alias("text"))
    return texts.mapInArrow(run, "path string, line int, cells map<string,string>")


def artifact_fault(content: Column, name: Column) -> Column:
    """Why archived bytes can't be used, or null."""
    head = F.lower(F.substring(content.cast("string"), 1, 4000))
    size = F.octet_length(content)
    pdf = F.substring(content, 1, 5) == F.encode(F.lit("%PDF-"), "UTF-8")
    return (
        F.when(size < 32, "too short")
        .when(pdf & ~F.contains(content.cast("string"), F.lit("%%EOF")), "cut off")
        .when(F.lower(name).endswith(".pdf") & ~pdf, "not a PDF")
        .when(head.rlike("(captcha|access denied|sign in to continue)"), "blocked")
        .when(head.rlike("<title>[^<]*(404|not found|error)"), "error page")
    )


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, byte_length, fault) of archived files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("byte_length"), artifact_fault(F.col("content"), F.col("path")).alias("fault"))


#: The columns of the evidence file, in their order.
EVIDENCE_COLUMNS = ("economy", "indicator_id", "law_name", "article_section", "tag", "snippet", "confidence", "source_url", "location_reference", "effective_date", "rationale", "model_version", "reviewer")


def write_evidence_csv(rows: DataFrame, path: str, extra: tuple[str, ...] = ()) -> None:
    """Writes rows as CSV with a header: the required columns, then the extra ones; null becomes empty."""
    missing = [c for c in (*EVIDENCE_COLUMNS, *extra) if c not in rows.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    rows.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in (*EVIDENCE_COLUMNS, *extra))).write.mode("errorifexists").option("emptyValue", "").option("quoteAll", True).csv(path, header=True)


def append_once(ledger: DataFrame, batch: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """The rows of batch that are new; equal repeats vanish, a key with another payload raises an error."""
    old = ledger.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in payload))
    met = batch.dropDuplicates([key, *payload]).join(old, F.col(key) == F.col("_key"), "left")
    same = F.lit(True)
    for c in payload:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    clash = met.where(F.col("_key").isNotNull() & ~same).select(key).unionByName(batch.dropDuplicates([key, *payload]).groupBy(key).count().where("count > 1").select(key)).limit(1).collect()
    if clash:
        raise ValueError(f"key {clash[0][0]} is already recorded with another payload")
    return met.where("_key is null").select(*batch.columns)


def quarantine(rows: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Rows without a reason, and the others with it."""
    marked = rows.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def named_rows(rows: DataFrame) -> DataFrame:
    """(path, sheet, row, cells as a map by header) of rows(path, sheet, row, cells).

    A sheet's header is its first row with a cell that begins with 'act' and one that begins with
    'indicator' or 'pillar'; names are lower-cased, blank ones dropped, and of equal names the first stays."""
    low = F.transform("cells", lambda c: F.lower(F.trim(c)))
    is_header = F.exists(low, lambda c: c.startswith("act")) & F.exists(low, lambda c: c.startswith("indicator") | c.startswith("pillar"))
    head = rows.where(is_header).groupBy("path", "sheet").agg(F.min(F.struct("row", low.alias("names"))).alias("h"))
    met = rows.join(head, ["path", "sheet"]).where(F.col("row") > F.col("h.row"))
    pairs = F.filter(F.arrays_zip(F.col("h.names").alias("k"), F.col("cells").alias("v"), F.sequence(F.lit(0), F.size("cells") - 1).alias("n")), lambda p: F.coalesce(p["k"], F.lit("")) != "")
    first = F.filter(pairs, lambda p: F.array_position(F.col("h.names"), p["k"]) == p["n"] + 1)
    return met.select("path", "sheet", "row", F.map_from_entries(F.transform(first, lambda p: F.struct(p["k"], p["v"]))).alias("cells"))


def known_rows(named: DataFrame, economy: Column) -> DataFrame:
    """(economy, indicator, act, score, references) of named rows, one for each act of a cell; rows without
    an act are dropped."""
    from lodestrata.functions.text import indicator_code, split_acts

    cell = lambda prefix: F.get(F.map_values(F.map_filter("cells", lambda k, v: k.startswith(prefix) & (F.trim(v) != ""))), F.lit(0))
    refs = F.map_values(F.map_filter("cells", lambda k, v: k.startswith("reference") & (F.trim(v) != "")))
    out = named.select(economy.alias("economy"), indicator_code(cell("indicator"), cell("pillar")).alias("indicator"), F.explode(split_acts(cell("act"))).alias("act"), cell("score").alias("score"), refs.alias("references"))
    return out.where("economy is not null and economy <> ''")
