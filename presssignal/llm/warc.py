"""WARC archives through a chunked record table.

Writing: a page's payload becomes rows (record, chunk number, chunk), each chunk with the digest of
the payload up to its end; a chunk is a WARC record of its own (the first a response, the others
continuations). The payload itself comes as one cell of a row; the reading side never builds a whole oversized
record. Spark's text writer puts the rows
into compressed files, with the blank lines that end a WARC record as its line separator, on whatever file system
Spark can reach, and commits them as any table: a lost executor's files are written anew.

Reading: the text reader splits the files at the same separator; a parser joins the stream again by
each record's own length, piece by piece, and gives back the chunk rows with digests carried on.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presssignal.llm.support import shared_folder

CHUNK_BYTES = 1 << 20
#: Equal payloads at least this long are written once.
REVISIT_BYTES = 1000
DATE = "1970-01-01T00:00:00Z"

# Fixed values of the format.
END = b"\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_BATCH_BYTES = 4 << 20
_OWNER = re.compile(r"<urn:page:(-?\d+|none)")


def first_copies(pages: DataFrame, salts: int = 16) -> DataFrame:
    """(page_id, digest, owner) of the pages whose payload a page with a larger id has too.

    Only digests, lengths and ids are shuffled; one payload may be that of a third of all pages, so the
    lookup of its owner is salted.
    """
    narrow = pages.select("page_id", "digest", "payload_bytes").filter(F.col("payload_bytes") >= REVISIT_BYTES)
    owners = (
        narrow.groupBy("digest", "payload_bytes").agg(F.max("page_id").alias("owner"), F.count("*").alias("n"))
        .filter("n > 1 AND owner IS NOT NULL")
        .select("digest", "payload_bytes", "owner", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    )
    salted = narrow.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int"))
    later = salted.join(owners, ["digest", "payload_bytes", "salt"]).filter(~F.col("page_id").eqNullSafe(F.col("owner")))
    return later.select("page_id", "digest", "owner").distinct()


def chunk_ends(raw: bytes, size: int) -> list[int]:
    """Where to cut UTF-8 text into chunks of at most ``size`` bytes, never inside a character."""
    ends, at = [], 0
    while len(raw) - at > size:
        end = at + size
        while end > at + 1 and raw[end] & 0xC0 == 0x80:
            end -= 1
        ends.append(end)
        at = end
    return [*ends, len(raw)]


def _name(page_id: int | None) -> str:
    return "none" if page_id is None else str(page_id)


def _head(fields: list[tuple[str, object]], length: int) -> str:
    lines = [f"{k}: {v}" for k, v in fields if v is not None]
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {length}", "", ""])


def records(page_id: int | None, url: str | None, raw: bytes, size: int, digest: str, owner: int | None, chunk: int) -> Iterator[str]:
    """The WARC records of one page, without the blank lines at their ends."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    name = _name(page_id)
    target = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    common = [("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if owner is not None:
        fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", f"<urn:page:{name}>"), *common,
                  ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{owner}>"), ("Content-Type", "application/http;msgtype=response")]
        yield _head(fields, len(http)) + http
        return
    ends, so_far, at = chunk_ends(raw, chunk), hashlib.sha1(), 0
    for number, end in enumerate(ends, 1):
        part = raw[at:end]
        so_far.update(part)
        at, parts = end, len(ends) > 1
        fields = [
            ("WARC-Type", "response" if number == 1 else "continuation"),
            ("WARC-Record-ID", f"<urn:page:{name}>" if number == 1 else f"<urn:page:{name}:segment:{number}>"), *common,
            ("WARC-Segment-Number", number if parts else None),
            ("WARC-Segment-Origin-ID", f"<urn:page:{name}>" if number > 1 else None),
            ("WARC-Segment-Total-Length", len(http) + len(raw) if parts and number == len(ends) else None),
            ("X-Digest-So-Far", f"sha1:{so_far.hexdigest()}" if parts else None),
            ("Content-Type", "application/http;msgtype=response" if number == 1 else None),
        ]
        block = (http if number == 1 else "") + part.decode()
        yield _head(fields, (len(http) if number == 1 else 0) + len(part)) + block


def write_archives(pages: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Write a record per row of ``pages`` (page_id, url, html) as gzip-compressed WARC files into ``path``."""
    html = F.coalesce("html", F.lit(""))
    whole = pages.select(
        "page_id", "url", html.alias("html"), F.sha1(html).alias("digest"), F.octet_length(html).cast("long").alias("payload_bytes")
    )
    copies = first_copies(whole).select(F.col("page_id").alias("copy_id"), F.col("digest").alias("copy_digest"), "owner")
    same = F.col("page_id").eqNullSafe(F.col("copy_id")) & (F.col("digest") == F.col("copy_digest"))
    joined = whole.join(copies, same, "left").select(
        "page_id", "url", "digest", "payload_bytes", "owner", F.when(F.col("owner").isNull(), F.col("html")).cast("binary").alias("raw")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for batch in batches:
            for page_id, url, digest, size, owner, raw in zip(*batch.columns):
                for text in records(page_id.as_py(), url.as_py(), raw.as_py() or b"", size.as_py(), digest.as_py(), owner.as_py(), chunk_bytes):
                    out.append(text)
                    held += len(text)
                    if held >= _BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
                        out, held = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    joined.mapInArrow(run, "value string").write.option("lineSep", END.decode()).option("compression", "gzip").option(
        "zlib.compress.level", "BEST_SPEED"
    ).text(path)


class Stream:
    """The bytes of archives, given piece by piece; never more is held than a header and a piece."""

    def __init__(self, pieces: Iterable[bytes]):
        self._pieces, self._buffer = iter(pieces), b""

    def _more(self) -> bool:
        piece = next(self._pieces, None)
        if piece is None:
            return False
        self._buffer += piece
        return True

    def header(self) -> dict[str, str] | None:
        """The fields of the next record, names in lower case; None at the end."""
        while True:
            self._buffer = self._buffer.lstrip(b"\r\n")
            if self._buffer or not self._more():
                break
        while END not in self._buffer:
            if not self._more():
                if self._buffer:
                    raise ValueError("an archive ends within a record's header")
                return None
        head, self._buffer = self._buffer.split(END, 1)
        version, *lines = head.decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record begins at {version[:40]!r}")
        return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}

    def block(self, length: int) -> Iterator[bytes]:
        """The next ``length`` bytes, as they come."""
        while length:
            if not self._buffer and not self._more():
                raise ValueError("an archive ends within a record")
            part, self._buffer = self._buffer[:length], self._buffer[length:]
            length -= len(part)
            yield part


def _page(name: str | None) -> int | None:
    found = _OWNER.match(name or "")
    return int(found[1]) if found and found[1] != "none" else None


def chunks(pieces: Iterable[bytes]) -> Iterator[tuple]:
    """(page_id, record_type, refers_to, chunk_no, payload_bytes, digest, last, payload) per chunk.

    payload_bytes and digest are those of the record's payload up to the end of the chunk; a revisit
    has those of the payload that it refers to. A payload that is not what its header says fails.
    """
    stream, so_far, total = Stream(pieces), hashlib.sha1(), 0
    while (fields := stream.header()) is not None:
        length, kind = int(fields["content-length"]), fields["warc-type"]
        body = stream.block(length)
        if kind not in ("response", "revisit", "continuation"):
            for _ in body:
                pass
            continue
        pending = b""
        if kind != "continuation":
            so_far, total = hashlib.sha1(), 0
            while END not in pending:
                pending += next(body, END)
            http, pending = pending.split(END, 1)
            size = int(re.search(rb"(?im)^content-length: *(\d+)", http)[1])
        page_id = _page(fields["warc-record-id"])
        digest = fields["warc-payload-digest"].removeprefix("sha1:")
        if kind == "revisit":
            yield page_id, kind, _page(fields["warc-refers-to"]), 1, size, digest, True, b""
            continue
        kept = []
        for part in (pending, *body) if pending else body:
            so_far.update(part)
            total += len(part)
            kept.append(part)
        number = int(fields.get("warc-segment-number", 1))
        last = "warc-segment-number" not in fields or "warc-segment-total-length" in fields
        found = so_far.hexdigest()
        if last and (found != digest or total != size):
            raise ValueError(f"page {page_id}: the archive's payload is not the one that was written")
        if not last and fields["x-digest-so-far"] != f"sha1:{found}":
            raise ValueError(f"page {page_id}: chunk {number} is damaged")
        yield page_id, "response", None, number, total, found, last, b"".join(kept)


_CHUNK = "page_id long, record_type string, refers_to long, chunk_no int, payload_bytes long, payload_digest string, last boolean"


def read_chunks(spark: SparkSession, path: str, keep_payload: bool = False) -> DataFrame:
    """The chunk rows of all archives in ``path``; digests are computed anew and checked."""
    schema = _CHUNK + (", payload binary" if keep_payload else "")
    types = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = (value.as_py() + END for batch in batches for value in batch.column(0))
        names, rows, held = [c.split()[0] for c in schema.split(", ")], [], 0

        def batch_of(rows):
            columns = list(zip(*rows)) if rows else [()] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)][: len(names)], names)

        for row in chunks(pieces):
            rows.append(row if keep_payload else row[:-1])
            held += len(row[-1]) if keep_payload else 100
            if held >= _BATCH_BYTES:
                yield batch_of(rows)
                rows, held = [], 0
        yield batch_of(rows)

    # compressed files are not split, so a task always reads whole archives in their order
    lines = spark.read.option("lineSep", END.decode()).text(path)
    return lines.select(F.col("value").cast("binary")).mapInArrow(run, schema)


def archive_pages(pages: DataFrame, path: str | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write the pages as archives and read them back: one row per page.

    Returns page_id, payload_bytes, payload_digest (SHA-1), record_type and refers_to. Of the records
    with equal payloads of at least REVISIT_BYTES the one with the largest page_id is the response,
    with repeated rows of that id; the others are revisits of it. Without a path a new folder in the shared one is used.
    NULL html is an empty payload; a page without an id keeps none and is never referred to; a NULL url leaves out the target. Other
    columns are ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    path = path or shared_folder(spark, "warc")
    write_archives(pages, path, chunk_bytes)
    return read_chunks(spark, path).filter("last").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
