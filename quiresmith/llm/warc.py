"""WARC archives as chunked record tables.

Writing: a payload is cut into rows (record, chunk number, bytes) and each row
becomes one WARC record; a payload of several chunks is a segmented record of
the format (a response with segment number 1, then continuations). Spark's own
text sink writes the records with their CRLF CRLF terminator as line end, so
archives land on any file system that Spark writes, under its commit protocol.
Reading: the text source hands the stream back in pieces between terminators,
in order and without splitting a compressed file; a push parser follows the
lengths in the headers and yields chunk rows with the length and the digest so
far. Neither side ever holds a whole record.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiresmith.llm.common import rows_of
from quiresmith.session import materialize, shared_path

CHUNK_BYTES = 64 * 1024
#: Fixed values of the format.
END = b"\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"
_URN = "urn:x-page:"


def _clean(value: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value or "")


def _record(kind: str, record_id: str, length: int, **fields: object) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in fields.items() if v is not None]
    return "\r\n".join([*lines, f"Content-Length: {length}"]).encode() + END


def _base32(hexes: str) -> str:
    return base64.b32encode(bytes.fromhex(hexes)).decode()


def payload_chunks(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES, min_revisit_bytes: int = 0) -> DataFrame:
    """Chunk rows of pages(page_id, url, html): page_id, url, sha1, payload_bytes, refers_to, chunk_no, chunks, data.

    ``refers_to`` is the smallest page_id with the same payload, where that is
    another page's and the payload has ``min_revisit_bytes`` or more; such
    rows carry no data. Rows of a page follow each other in order.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    full = pages.select("page_id", "url", payload.alias("payload"))
    full = full.withColumn("sha1", F.sha1("payload")).withColumn("payload_bytes", F.length("payload").cast("long"))
    seen = full.select("page_id", "sha1", "payload_bytes").where(F.col("payload_bytes") >= min_revisit_bytes)
    groups = seen.groupBy("sha1", "payload_bytes").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    repeats = seen.join(groups.where("n > 1"), ["sha1", "payload_bytes"]).where("page_id > refers_to")
    # Only the repeats' ids meet the payloads, which stay where they are if these ids are few.
    repeats = materialize(repeats.select("page_id", "sha1", "refers_to").distinct(), "warc-repeats")
    marked = full.join(repeats, ["page_id", "sha1"], "left")
    marked = marked.withColumn("chunks", F.when(F.col("refers_to").isNotNull(), 1).otherwise(F.greatest(F.lit(1), F.ceil(F.col("payload_bytes") / chunk_bytes))).cast("int"))
    dealt = marked.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    data = F.expr(f"substring(payload, chunk_no * {chunk_bytes} + 1, {chunk_bytes})")
    return dealt.select("page_id", "url", "sha1", "payload_bytes", "refers_to", "chunk_no", "chunks", F.when(F.col("refers_to").isNull(), data).alias("data"))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = [_record("warcinfo", "urn:x-archive", 0)]
    for batch in rows_of(batches, 64):
        for r in batch.to_pylist():
            urn, more = f"{_URN}{r['page_id']}", r["chunks"] > 1
            digest = f"sha1:{_base32(r['sha1'])}"
            if r["refers_to"] is not None:
                out.append(_record("revisit", urn, 0, WARC_Target_URI=_clean(r["url"]), WARC_Profile=REVISIT_PROFILE, WARC_Refers_To=f"<{_URN}{r['refers_to']}>", WARC_Payload_Digest=digest, X_Payload_Length=r["payload_bytes"]))
            elif r["chunk_no"] == 0:
                head = _record("response", urn, len(HTTP_HEAD) + len(r["data"]), WARC_Target_URI=_clean(r["url"]), WARC_Payload_Digest=digest, WARC_Segment_Number=1 if more else None, Content_Type="application/http; msgtype=response")
                out.append(head + HTTP_HEAD + r["data"])
            else:
                total = len(HTTP_HEAD) + r["payload_bytes"] if r["chunk_no"] == r["chunks"] - 1 else None
                head = _record("continuation", f"{urn}:{r['chunk_no'] + 1}", len(r["data"]), WARC_Segment_Origin_ID=f"<{urn}>", WARC_Segment_Number=r["chunk_no"] + 1, WARC_Segment_Total_Length=total)
                out.append(head + r["data"])
        yield pa.record_batch([pa.array(out, pa.binary())], ["value"])
        out = []
    if out:
        yield pa.record_batch([pa.array(out, pa.binary())], ["value"])


def write_archives(chunks: DataFrame, path: str) -> None:
    """Write chunk rows as compressed WARC files below ``path``, one per task."""
    records = chunks.mapInArrow(_segments, "value binary").select(F.col("value").cast("string").alias("value"))
    records.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", 0).text(path)


class _Parser:
    """Push parser of one archive: takes bytes, gives chunk rows."""

    def __init__(self) -> None:
        self.buffer, self.left, self.head, self.http, self.record = bytearray(), 0, None, False, None

    def feed(self, data: bytes, rows: list[tuple]) -> None:
        self.buffer += data
        while True:
            if self.head is None:
                at = self.buffer.find(b"WARC/")  # past the end of the record before
                end = self.buffer.find(END, at) if at >= 0 else -1
                if end < 0:
                    return
                lines = bytes(self.buffer[at:end]).decode("utf-8", "replace").split("\r\n")
                del self.buffer[: end + len(END)]
                self.head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
                self.left = int(self.head["content-length"])
                self._open(rows)
            if self.http:
                at = self.buffer.find(END)
                if at < 0 and len(self.buffer) < self.left:
                    return
                if 0 <= at < self.left:
                    del self.buffer[: at + len(END)]
                    self.left -= at + len(END)
                self.http = False
            part = bytes(self.buffer[: self.left])
            if not part and self.left:
                return
            del self.buffer[: len(part)]
            self.left -= len(part)
            done = not self.left
            if self.record is not None:
                self._take(part, done, rows)
            if done:
                self.head = None

    def _open(self, rows: list[tuple]) -> None:
        h, kind = self.head, self.head.get("warc-type")
        if kind == "revisit":
            digest = h.get("warc-payload-digest", "").removeprefix("sha1:")
            rows.append((self._id(h["warc-record-id"]), "revisit", h.get("warc-target-uri"), self._id(h.get("warc-refers-to")), 0, int(h.get("x-payload-length", 0)), digest, True, b""))
            self.record = None
        elif kind == "response":
            self.record = {"id": self._id(h["warc-record-id"]), "uri": h.get("warc-target-uri"), "said": h.get("warc-payload-digest", ""), "no": 0, "bytes": 0, "sha": hashlib.sha1(), "whole": "warc-segment-number" not in h, "segment": 1}
            self.http = h.get("content-type", "").startswith("application/http")
        elif kind == "continuation":
            r = self.record
            if r is None or self._id(h["warc-segment-origin-id"]) != r["id"] or int(h["warc-segment-number"]) != r["segment"] + 1:
                raise ValueError(f"continuation out of place: {h}")
            r["segment"] += 1
            r["whole"] = "warc-segment-total-length" in h
        else:
            self.record = None

    def _take(self, part: bytes, done: bool, rows: list[tuple]) -> None:
        r = self.record
        r["sha"].update(part)
        r["bytes"] += len(part)
        last = done and r["whole"]
        digest = base64.b32encode(r["sha"].digest()).decode()
        if last and r["said"] and r["said"] != f"sha1:{digest}":
            raise ValueError(f"payload of {r['id']} has digest {digest}, the header says {r['said']}")
        if part or last:
            rows.append((r["id"], "response", r["uri"], None, r["no"], r["bytes"], digest, last, part))
            r["no"] += 1
        if last:
            self.record = None

    @staticmethod
    def _id(value: str | None) -> int | None:
        tail = (value or "").strip("<>").removeprefix(_URN)
        return int(tail) if tail.lstrip("-").isdigit() else None

    def close(self) -> None:
        if self.head is not None or self.record is not None:
            raise ValueError("the archive ends within a record")


_CHUNK_ROWS = "page_id long, record_type string, uri string, refers_to long, chunk_no int, payload_bytes long, payload_digest string, last boolean, data binary"
_KINDS = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]


def _parse(with_data: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _CHUNK_ROWS.split(", ")]
        fields = len(names) if with_data else len(names) - 1
        parser, now, rows, held = _Parser(), None, [], 0

        def table() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))[:fields] if rows else [[]] * fields
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, _KINDS)], names[:fields])

        for batch in rows_of(batches, 1024):
            for piece, file in zip(batch.column(0), batch.column(1)):
                if file != now:
                    parser.close()
                    parser, now = _Parser(), file
                before = len(rows)
                parser.feed(piece.as_py() + END, rows)
                held += sum(len(r[-1]) for r in rows[before:]) if with_data else 0
                if held > 8 << 20 or len(rows) >= 4096:
                    yield table()
                    rows, held = [], 0
        parser.close()
        if rows:
            yield table()

    return run


def read_archives(spark: SparkSession, path: str, with_data: bool = True) -> DataFrame:
    """Chunk rows of the archives below ``path``: the payload's length and base32 SHA-1 up to each chunk.

    The row with ``last`` has those of the full payload, which must equal the
    digest in the record's header; a damaged archive is an error. A revisit is
    one last row without data, with its payload's length, digest and response.
    """
    pieces = spark.read.option("lineSep", END.decode()).text(path).select(F.col("value").cast("binary"), F.col("_metadata.file_path").alias("file"))
    kept = _CHUNK_ROWS if with_data else _CHUNK_ROWS.rpartition(", ")[0]
    return pieces.mapInArrow(_parse(with_data), kept)


def round_trip(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES, min_revisit_bytes: int = 0, path: str | None = None, with_data: bool = False) -> DataFrame:
    """Archive pages(page_id, url, html) and read the archives back as chunk rows.

    A null html is an empty payload. Rows that share both payload and smallest
    page_id are all responses, as are rows with a null page_id; an empty table
    gives archives without records. Texts of any length pass in chunks.
    """
    spark = pages.sparkSession
    path = path or shared_path(spark, "warc")
    write_archives(payload_chunks(pages, chunk_bytes, min_revisit_bytes), path)
    return read_archives(spark, path, with_data)
