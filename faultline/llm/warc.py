"""WARC archives: a writer on Spark's text sink, and a reader that salvages damaged files.

The writer makes one response record for each distinct large payload and revisit records for its repeats, each in a gzip member
of its own, so that damage costs one record. The reader walks an
archive's records, plain or in gzip members. Where a record fails its checks it searches for the next version line or member
that holds a valid record, goes on from there, and logs the bytes between as a quarantined gap.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.plans.runtime import fresh_path, materialize

CRLF = "\r\n"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
MEMBER = b"\x1f\x8b\x08"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Payloads under this size are never revisits.
MIN_REVISIT = 1000
RECORDS = "archive string, at long, kind string, page_id long, url string, refers_to long, payload binary, digest string, payload_length long, gap_end long, reason string"


# --- writing -------------------------------------------------------------------------------------------------------------


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, html, digest, size, refers_to)``: of equal payloads of 1000 bytes or more the largest id is the original.

    Originals that have copies are found without the html and written; the pages then meet them by digest in a plain join.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "utf-8"))).withColumn("size", F.octet_length("html").cast("long"))
    large = rows.where(F.col("size") >= MIN_REVISIT)
    found = large.groupBy("digest").agg(F.max("page_id").alias("original"), F.count("*").alias("copies")).where("copies > 1")
    originals = materialize(found.select(F.col("digest").alias("of"), "original"), "originals")
    refers_to = F.when(F.col("page_id") < F.col("original"), F.col("original")).alias("refers_to")
    return rows.join(originals, (F.col("digest") == F.col("of")) & (F.col("size") >= MIN_REVISIT), "left").select(*rows.columns, refers_to)


def _uuid(key: Column) -> Column:
    h = F.md5(key.cast("string"))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12))


def record_head(rows: DataFrame) -> Column:
    """The headers of a planned row's record, with the empty line that ends them."""
    revisit = F.col("refers_to").isNotNull()
    # a line end in a url would end the header
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "%0A")
    head = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:uuid:"), _uuid(F.col("page_id")), F.lit(">")),
        F.concat(F.lit("WARC-Page-ID: "), F.col("page_id").cast("string")),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.concat(F.lit("WARC-Payload-Length: "), F.col("size").cast("string")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:uuid:"), _uuid(F.col("refers_to")), F.lit(">"), F.lit(CRLF + "WARC-Refers-To-Page-ID: "), F.col("refers_to").cast("string"), F.lit(CRLF + "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("size") + len(HTTP_HEAD)).cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *head), F.lit(CRLF * 2))


def members(records: list[bytes]) -> bytes:
    """A gzip member for each record, all but the last byte, which is 0.

    The last byte is the highest of the member's length. Where that is not 0, after a record of 16 MB or more, an empty member
    follows, whose length is.
    """
    out = b"".join(gzip.compress(r, 6, mtime=0) for r in records)
    if out[-1]:
        out += gzip.compress(b"", mtime=0)
    return out[:-1]


def write(pages: DataFrame, path: str, per_file: int = 1000, file_bytes: int = 16_000_000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes ``pages`` as gzipped WARC archives under ``path``, a member a record, committed as Spark commits any table.

    An archive ends at ``per_file`` records or where ``file_bytes`` of records are passed, so that a reader can take it as one
    value; a larger record stands alone. Null html is an empty payload, a null url an empty one. Rows with a null id are left out.
    Rows that repeat an id are written each by its own payload: as a revisit where a row with a larger id has that payload too,
    else as a response (so rows equal in id and payload are responses both). An empty table writes no record. Payloads of any
    length are whole; other columns are not read.
    """

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for head, html in zip(batch.column(0), batch.column(1), strict=True):
                block = b"" if html.as_py() is None else HTTP_HEAD.encode() + html.as_py().encode()
                data = head.as_py().encode() + block + CRLF.encode() * 2
                if held and (size + len(data) > file_bytes or len(held) >= per_file):
                    yield pa.record_batch([pa.array([members(held)], pa.binary())], names=["value"])
                    held, size = [], 0
                held.append(data)
                size += len(data)
        if held:
            yield pa.record_batch([pa.array([members(held)], pa.binary())], names=["value"])

    rows = plan_records(pages.where(F.col(id_col).isNotNull()), id_col, url_col, html_col)
    # payloads of revisits stay where they are
    made = rows.select(record_head(rows).alias("head"), F.when(F.col("refers_to").isNull(), F.col("html")).alias("html")).mapInArrow(archives, "value binary")
    # the text sink writes bytes as they are, and the line end is an archive's last byte
    made.select(F.col("value").cast("string")).write.option("lineSep", "\x00").option("maxRecordsPerFile", 1).text(path)


# --- reading -------------------------------------------------------------------------------------------------------------


class Bad(Exception):
    """A record that fails a check."""


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at ``at``; Bad if any check fails."""
    if not VERSION.match(data, at):
        raise Bad("no version line")
    head_end = data.find(b"\r\n\r\n", at)
    if head_end < 0:
        raise Bad("headers do not end")
    headers = {}
    for line in data[at:head_end].split(b"\r\n")[1:]:
        name, sep, value = line.partition(b":")
        if not sep:
            raise Bad("header without a colon")
        headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = headers.get("content-length", "")
    if not length.isdigit() or "warc-type" not in headers or "warc-record-id" not in headers:
        raise Bad("a needed header is missing")
    begin, end = head_end + 4, head_end + 4 + int(length)
    if end + 4 > len(data):
        raise Bad("block is cut off")
    if data[end : end + 4] != b"\r\n\r\n":
        raise Bad("block does not end where it says")
    block = data[begin:end]
    digest = headers.get("warc-payload-digest", "")
    if headers["warc-type"] == "response" and digest.startswith("sha1:"):
        body = block.partition(b"\r\n\r\n")[2]
        if hashlib.sha1(body).hexdigest() != digest[5:].lower():
            raise Bad("payload does not match its digest")
    return headers, block, end + 4


def parse_member(data: bytes, at: int) -> tuple[bytes, int]:
    """The contents and end of the gzip member at ``at``; Bad if it does not inflate whole."""
    if data[at : at + 3] != MEMBER:
        raise Bad("no member")
    z, out, k = zlib.decompressobj(31), [], at
    try:
        # in steps, so that what follows the member is not copied for each member
        while not z.eof and k < len(data):
            out.append(z.decompress(data[k : k + 65536]))
            k += 65536
    except zlib.error as e:
        raise Bad(f"member does not inflate: {e}") from None
    if not z.eof:
        raise Bad("member is cut off")
    return b"".join(out), min(k, len(data)) - len(z.unused_data)


def inflated(data: bytes, at: int) -> bytes:
    """What can still be inflated of a damaged gzip member."""
    z, out = zlib.decompressobj(31), []
    try:
        for k in range(at, len(data), 4096):
            out.append(z.decompress(data[k : k + 4096]))
    except zlib.error:
        pass
    return b"".join(out)


def _one(data: bytes, at: int) -> tuple[list[tuple[dict[str, str], bytes]], int]:
    """The valid records that begin at ``at``, one or a member's, and where they end."""
    if data[at : at + 3] != MEMBER:
        headers, block, end = parse_record(data, at)
        return [(headers, block)], end
    inner, end = parse_member(data, at)
    found, k = [], 0
    while k < len(inner):
        headers, block, k = parse_record(inner, k)
        found.append((headers, block))
    return found, end


def salvage(data: bytes) -> Iterator[tuple[int, int, str, dict[str, str], bytes]]:
    """``(start, end, reason, headers, block)`` of an archive: valid records with no reason, gaps with one.

    Of a damaged gzip member the responses that others follow before the damage and whose digest holds are recovered; they and
    the gap have the same bounds.
    """
    starts = [m.start() for m in re.finditer(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08", data)]
    at, nxt = 0, 0
    while at < len(data):
        try:
            found, end = _one(data, at)
        except Bad as e:
            first, reason = at, str(e)
            while nxt < len(starts) and starts[nxt] <= at:
                nxt += 1
            # the next place that looks like a beginning and holds a valid record
            while nxt < len(starts):
                try:
                    _one(data, starts[nxt])
                    break
                except Bad:
                    nxt += 1
            at = starts[nxt] if nxt < len(starts) else len(data)
            if data[first : first + 3] == MEMBER:
                inner, k = inflated(data, first), 0
                try:
                    while (record := parse_record(inner, k))[2] < len(inner):
                        headers, block, k = record
                        if headers["warc-type"] == "response" and headers.get("warc-payload-digest", "").startswith("sha1:"):
                            yield first, at, "", headers, block
                except Bad:
                    pass
            yield first, at, reason, {}, b""
            continue
        for headers, block in found:
            yield at, end, "", headers, block
        at = end
        while nxt < len(starts) and starts[nxt] < at:
            nxt += 1


def read(spark: SparkSession, path: str) -> DataFrame:
    """All archives under ``path``: a row for each record recovered, and one of kind ``gap`` for each quarantined stretch.

    ``archive`` and ``at`` say where; ``gap_end`` and ``reason`` describe a gap. ``payload`` is null for revisits. An archive
    must fit in a task's memory, which the writer's ``file_bytes`` sees to; empty files give no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in RECORDS.split(", ")]
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        types = [kinds[x.split(" ")[1]] for x in RECORDS.split(", ")]
        for batch in batches:
            for i in range(batch.num_rows):
                archive, data, rows, held = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), [], 0
                for start, end, reason, h, block in salvage(data):
                    if reason:
                        rows.append((archive, start, "gap", None, None, None, None, None, None, end, reason))
                    else:
                        number = lambda k, h=h: int(h[k]) if h.get(k, "").isdigit() else None
                        revisit = h["warc-type"] == "revisit"
                        payload = None if revisit else block.partition(b"\r\n\r\n")[2] if h["warc-type"] == "response" else block
                        rows.append((archive, start, h["warc-type"], number("warc-page-id"), h.get("warc-target-uri"), number("warc-refers-to-page-id"), payload, h.get("warc-payload-digest", "").removeprefix("sha1:"), number("warc-payload-length") if revisit else len(payload), None, None))
                        held += len(block)
                    if held > 4_000_000:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame, per_file: int = 1000) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and reads them back: a row for each record and gap, as ``read``."""
    path = fresh_path(pages.sparkSession, "warc")
    write(pages, path, per_file)
    return read(pages.sparkSession, path)


def resolve(records: DataFrame) -> DataFrame:
    """Of ``read``'s rows the records as ``(page_id, url, kind, refers_to, payload_length, digest)``, without payloads.

    Length and digest are those of the full payload: a response's own, a revisit's from the response that it refers to (the
    header's claim where that one was not recovered). Gaps are left out.
    """
    kept = records.where("kind <> 'gap'").select("page_id", "url", "kind", "refers_to", F.coalesce(F.sha1("payload"), "digest").alias("digest"), F.coalesce(F.octet_length("payload").cast("long"), "payload_length").alias("payload_length"))
    kept = materialize(kept, "records")
    originals = kept.where("kind = 'response' and payload_length >= %d" % MIN_REVISIT).select(F.col("page_id").alias("refers_to"), "digest", F.col("payload_length").alias("full")).distinct()
    revisits = kept.where("kind = 'revisit'").join(originals, ["refers_to", "digest"], "left").withColumn("payload_length", F.coalesce("full", "payload_length"))
    return kept.where("kind <> 'revisit'").unionByName(revisits.select(*kept.columns))
