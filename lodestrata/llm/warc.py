"""WARC archives: a deterministic sharded writer and its reader.

Payload digests decide responses and revisits.  Records are laid out in the order of page_id; how far each
reaches in the compressed stream says which file it goes to.  Every file is one task's output, written by
Spark under a temporary name in the target's file system; a manifest and renames by the driver commit it.
A task that is lost is run again and gives the same bytes."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import delete, small_batches, stage, unstage, with_columns

#: Compressed bytes at which a file is full; the record that fills it still goes in.
ROLL = 16 << 20
#: Every record's date, as archives must not depend on when they are written.
DATE = "2024-01-01T00:00:00Z"
LEVEL = 6
_END, _STEP = b"\x00", 4096


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")


def _urn(page_id: int | None, url: str | None, own: str) -> str:
    name = hashlib.sha1(f"{page_id}|{url}|{own}".encode()).hexdigest()
    return f"<urn:uuid:{name[:8]}-{name[8:12]}-5{name[13:16]}-a{name[17:20]}-{name[20:32]}>"


def _member(lines: list[str], block: bytes) -> bytes:
    """A record as one gzip member without a time.  Ends with a zero byte."""
    out = gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", LEVEL, mtime=0)
    # A member ends with the high byte of its length, a zero up to 16 MiB; beyond, an empty member follows.
    return out if out.endswith(_END) else out + gzip.compress(b"", LEVEL, mtime=0)


def information(file: str) -> bytes:
    """The warcinfo record with which an archive opens."""
    block = b"software: lodestrata\r\nformat: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {_urn(None, file, 'warcinfo')}", f"WARC-Date: {DATE}", f"WARC-Filename: {file}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return _member(lines, block)


def record(page_id: int | None, url: str | None, payload: bytes, own: str, refers_to: int | None, refers_url: str | None = None) -> bytes:
    """A WARC/1.1 record with all headers made from its content; a revisit, of the response for page refers_to
    at refers_url, holds the HTTP head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page_id, url, own)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Payload-Digest: sha1:{own}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_urn(refers_to, refers_url, own)}",
            f"WARC-Refers-To-Target-URI: {_clean(refers_url)}",
            f"WARC-Refers-To-Date: {DATE}",
            f"X-Refers-To-Page-ID: {refers_to}",
        ]
    return _member([*lines, "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"], block)


def compressed(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload_digest, payload_bytes, response): each page's record as a response.

    Made twice, for the layout and for the files: equal bytes either time, and less than what storing costs."""
    small_batches(pages.sparkSession, 500)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        own, n, out = [], [], []
        for i, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
            payload = (html or "").encode()
            own.append(digest(payload))
            n.append(len(payload))
            out.append(record(i, url, payload, own[-1], None))
        return [pa.array(own, pa.string()), pa.array(n, pa.int64()), pa.array(out, pa.binary())]

    return with_columns(pages, ["page_id", "url", "html"], "payload_digest string, payload_bytes long, response binary", make).drop("html")


def plan(responses: DataFrame, least_bytes: int = 0) -> DataFrame:
    """One row per page: page_id, url, payload_digest, payload_bytes, response_bytes (compressed, as a
    response), refers_to and refers_url (null for responses)."""
    slim = responses.select("page_id", "url", "payload_digest", "payload_bytes", F.octet_length("response").cast("long").alias("response_bytes"))
    marked = stage(slim, "warc-digests")
    firsts = marked.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes").agg(F.min("page_id").alias("_first"), F.min_by("url", F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")).alias("_url"), F.count("*").alias("_n")).where("_n > 1")
    firsts = firsts.select(F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes"), "_first", "_url")
    out = marked.join(firsts.hint("merge"), (F.col("payload_digest") == F.col("_digest")) & (F.col("payload_bytes") == F.col("_bytes")), "left")
    again = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return out.select(*marked.columns, F.when(again, F.col("_first")).alias("refers_to"), F.when(again, F.col("_url")).alias("refers_url"))


def layout(planned: DataFrame, roll: int) -> DataFrame:
    """(page_id, url, payload_digest, refers_to, refers_url, file, place) of distinct records.

    Records are range-sorted by page_id; `place` counts the compressed bytes before a record, over all
    partitions, and file is place // roll, so neither depends on where the partitions are cut."""
    keys = ["page_id", "payload_digest", "url"]

    def size(batch: pa.RecordBatch) -> list[pa.Array]:
        out = []
        for i, own, url, refers, at, n, response, copies in zip(*(batch.column(c).to_pylist() for c in (*keys, "refers_to", "refers_url", "payload_bytes", "response_bytes", "copies")), strict=True):
            # The length of the payload is all that a revisit tells of it.
            one = response if refers is None else len(record(i, url, bytes(n), own, refers, at))
            out.append(one * copies)
        return [pa.array(out, pa.int64())]

    distinct = planned.groupBy(*keys, "refers_to", "refers_url", "payload_bytes", "response_bytes").agg(F.count("*").alias("copies"))
    sized = with_columns(distinct, distinct.columns, "size long", size).drop("payload_bytes", "response_bytes", "copies")
    n = int(planned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.asc_nulls_first(k) for k in keys]
    # The written partitions carry their number, so that their sums and the sums within agree.
    cut = stage(sized.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "warc-order")
    totals = cut.groupBy("part").agg(F.sum("size").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    place = F.col("before") + F.sum("size").over(Window.partitionBy("part").orderBy(*order)) - F.col("size")
    out = cut.join(before, "part").withColumn("place", place)
    return out.select(*keys, "refers_to", "refers_url", F.floor(F.col("place") / roll).alias("file"), "place")


def write(pages: DataFrame, target: str, least_bytes: int = 0, roll: int = ROLL) -> str:
    """Writes pages(page_id, url, html) to .warc.gz files in the new folder target, in any file system that
    Spark writes to, and returns target.

    Of records with equal payloads of least_bytes or more, that of the smallest page_id is the response and
    the others revisit it; smaller ones are all responses.  Null html counts as empty, a null url as
    about:blank.  Rows that repeat a response's page_id and payload are responses too.  Rows with a null
    page_id come first; they revisit the smallest page_id of their payload and are responses if there is
    none.  A table without rows gives a manifest without files.  Other columns are ignored.  Reruns over
    the same rows give the same files."""
    spark = pages.sparkSession
    whole = compressed(pages)
    placed = stage(layout(plan(whole, least_bytes), roll), "warc-layout")

    def final(batch: pa.RecordBatch) -> list[pa.Array]:
        rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload_digest", "payload_bytes", "refers_to", "refers_url", "response")), strict=True)
        # The writer ends every row with the zero byte that ends a record.
        return [pa.array([(x if refers is None else record(i, url, bytes(n), own, refers, at))[:-1] for i, url, own, n, refers, at, x in rows], pa.binary())]

    def opening(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([information(f"records-{x}")[:-1] for x in batch.column("file").to_pylist()], pa.binary())]

    to = placed.select(F.col("page_id").alias("_id"), F.col("url").alias("_url"), F.col("payload_digest").alias("_digest"), "refers_to", "refers_url", "file", "place")
    met = whole.join(to.hint("merge"), F.col("page_id").eqNullSafe(F.col("_id")) & F.col("url").eqNullSafe(F.col("_url")) & (F.col("payload_digest") == F.col("_digest")))
    columns = ["page_id", "url", "payload_digest", "payload_bytes", "refers_to", "refers_url", "file", "place"]
    met = met.select(*columns, F.when(F.col("refers_to").isNull(), F.col("response")).alias("response"))
    named = F.format_string("%010d", "file").alias("file")
    records = with_columns(met, [*columns, "response"], "record binary", final).select(named, "place", "record")
    firsts = with_columns(placed.select(named).distinct().withColumn("place", F.lit(-1).cast("long")), ["file", "place"], "record binary", opening)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Files are few and large, so their numbers deal them out more evenly than hashes.
    to = F.pmod(F.col("file").cast("long"), F.lit(n)).cast("int")
    dealt = records.unionByName(firsts).repartitionById(n, to).sortWithinPartitions("file", "place").select("file", F.col("record").cast("string").alias("value"))
    temporary = f"{target}/_temporary-records"
    dealt.write.partitionBy("file").option("lineSep", _END.decode()).option("compression", "none").text(temporary)
    _commit(spark, temporary, target, roll)
    unstage(placed)
    return target


def _commit(spark: SparkSession, temporary: str, target: str, roll: int) -> None:
    """Renames the finished files and writes the manifest, itself under a temporary name first."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(temporary)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    listed = []
    for folder in fs.listStatus(root):
        name = folder.getPath().getName()
        if not name.startswith("file="):
            continue
        for k, part in enumerate(sorted(fs.listStatus(folder.getPath()), key=lambda x: x.getPath().getName())):
            final = f"records-{name[5:]}-{k:03d}.warc.gz"
            if not fs.rename(part.getPath(), hadoop.Path(f"{target}/{final}")):
                raise OSError(f"could not commit {final}")
            listed.append({"file": final, "bytes": part.getLen()})
    draft, final = hadoop.Path(f"{target}/_manifest.draft"), hadoop.Path(f"{target}/manifest.json")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps({"roll_bytes": roll, "files": sorted(listed, key=lambda x: x["file"])}, indent=1).encode()))
    out.close()
    if not fs.rename(draft, final):
        raise OSError("could not commit the manifest")
    delete(spark, temporary)


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-cased names) and block of each record of an archive, one gzip member at a time."""
    view, at = memoryview(content), 0
    while at < len(view):
        member, parts = zlib.decompressobj(31), []
        # What follows the member's end is copied, so it is fed in small steps.
        while not member.eof and at < len(view):
            step = view[at : at + _STEP]
            parts.append(member.decompress(step))
            at += len(step) - len(member.unused_data)
        if not member.eof:
            raise ValueError("an archive ends within a record")
        data = b"".join(parts)
        if not data:
            continue
        head, _, block = data.partition(b"\r\n\r\n")
        headers = dict((k.lower(), v) for k, v in (x.split(": ", 1) for x in head.decode().split("\r\n")[1:]))
        n = int(headers["content-length"])
        if block[n:] != b"\r\n\r\n" or headers["warc-block-digest"] != f"sha1:{digest(block[:n])}":
            raise ValueError(f"record {headers.get('warc-record-id')} is damaged")
        yield headers, block[:n]


def read(spark: SparkSession, target: str) -> DataFrame:
    """One row per response or revisit of the archives in target: page_id, url, payload_bytes, payload_digest,
    record_type, refers_to, payload (null for revisits).  Only files that the manifest lists are read, so a
    write that wasn't committed can't be; block and payload digests are checked."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    fields = T.StructType.fromDDL(schema)
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=fields.names)

        for batch in batches:
            for content in batch.column("content").to_pylist():
                for headers, block in parse(content):
                    if (kind := headers["warc-type"]) == "warcinfo":
                        continue
                    own = headers["warc-payload-digest"].removeprefix("sha1:")
                    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                    if payload is not None and (digest(payload) != own or len(payload) != int(headers["x-payload-length"])):
                        raise ValueError(f"the payload of {headers.get('warc-record-id')} is damaged")
                    ids = [int(headers[x]) if x in headers else None for x in ("x-page-id", "x-refers-to-page-id")]
                    rows.append((ids[0], headers["warc-target-uri"], int(headers["x-payload-length"]), own, kind, ids[1], payload))
                    held += len(payload or b"")
                    if held > 8 << 20 or len(rows) >= 1000:
                        yield done()
                        rows, held = [], 0
        if rows:
            yield done()

    manifest = json.loads(spark.read.text(f"{target}/manifest.json", wholetext=True).first().value)
    paths = [f"{target}/{x['file']}" for x in manifest["files"]]
    if not paths:
        return spark.createDataFrame([], fields)
    return spark.read.format("binaryFile").load(paths).select("content").mapInArrow(run, fields)
