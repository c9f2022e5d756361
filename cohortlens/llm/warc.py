"""WARC archives, written with an index first and read back by byte ranges.

Write. Every page becomes one record of a WARC 1.1 file, a gzip member of its own as is
usual for such archives. Of the records whose payloads are equal, that with the smallest
id is a ``response``; the others are ``revisit`` records that name it and carry no
payload. Each task writes its records to archives of about ``ARCHIVE_BYTES`` and returns
their index rows (archive, offset, length, url, digest, record id), which are written
before anything is read. An attempt names its archives anew, and only the index rows of
the attempt that Spark commits are kept: archives left by lost tasks are never read.

Read. The selected index rows are sorted by (archive, offset); ranges less than ``GAP``
bytes apart become one read of at most ``READ_BYTES`` (or one record), and the records are
cut from it and parsed. Payload bytes and digest are computed from the payload that was
read; a revisit takes them from the response that it names. Archives are opened through
pyarrow file systems, so ``path`` is a URI or an absolute path that these know.

Payloads below ``min_bytes`` are always responses. A null html is an empty payload; null
urls are written as ``about:blank``. A null id comes after all others and is written
as an empty id, so repeated rows and rows with equal ids still give one record each: they
are told apart by a record number. No rows: no archives. Other columns are not read.

Scale. One shuffle by digest of ids only, one of the payloads, by record, to meet their
plan. Equal payloads are found with a partial minimum, so a payload held by a third of all
pages is one row a task; the join back to it is split by adaptive execution. Archives are
bounded in bytes; a task holds one record or a slice of a few MB.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import cut, shared_dir, ship, slices, table

ARCHIVE_BYTES = 16 << 20
#: Ranges closer than this are read at once, in reads of at most READ_BYTES.
GAP, READ_BYTES = 64 << 10, 4 << 20
#: Equal payloads of at least so many bytes are written once.
MIN_BYTES = 0
#: Fixed date, so that equal input gives equal archives.
DATE = "2024-01-01T00:00:00Z"
END = b"\r\n\r\n"

_BASE32_HEX, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: 40 bits at a time."""
    digest = F.sha1(payload)
    five = [F.lpad(F.conv(F.substring(digest, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*five), _BASE32_HEX, _BASE32)


def plan_records(pages: DataFrame, min_bytes: int = MIN_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """What is to be written, without payloads: record, id, url, payload_bytes,
    payload_digest, record_type, refers_to, target (the record a revisit names)."""
    p = pages.select(
        F.monotonically_increasing_id().alias("record"),
        F.col(id_col).alias("id"),
        F.col(url_col).alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"),
    ).select("record", "id", "url", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))
    p = cut(p)  # record numbers stay as they are from here on
    first = F.struct(F.col("id").isNull().alias("none"), "id", "record")
    firsts = p.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes").agg(F.min(first).alias("first"))
    j = p.join(firsts, ["payload_digest", "payload_bytes"], "left")
    again = F.col("first").isNotNull() & (F.col("record") != F.col("first.record"))
    return j.select(
        "record", "id", "url", "payload_bytes", "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first.id")).alias("refers_to"),
        F.when(again, F.col("first.record")).alias("target"),
    )


def _record(x: dict) -> bytes:
    """The record of one row of the plan with its html."""
    copy = x["record_type"] == "revisit"
    body = b"" if copy else (x["html"] or "").encode()
    if not copy and _digest(body) != x["payload_digest"]:
        raise ValueError(f"record {x['record']} is not the page that was planned")
    url = "about:blank" if x["url"] is None else x["url"].replace("\r", " ").replace("\n", " ")
    head = [
        "WARC/1.1", f"WARC-Type: {x['record_type']}", f"WARC-Record-ID: <urn:record:{x['record']}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{x['payload_digest']}", *_id_field("X-Page-ID", x["id"]),
    ]
    if copy:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:record:{x['target']}>", *_id_field("X-Refers-To-Page-ID", x["refers_to"]),
        ]
    else:
        head.append("Content-Type: text/html")
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + END + body + END


def _id_field(name: str, value: str | None) -> list[str]:
    """The header line of an id: percent-encoded, none for a null id."""
    return [] if value is None else [f"{name}: {quote(value, safe='')}"]


def _id_of(fields: dict[str, str], name: str) -> str | None:
    return unquote(fields[name]) if name in fields else None


def _digest(body: bytes) -> str:
    return base64.b32encode(hashlib.sha1(body).digest()).decode()


def _writer(path: str, archive_bytes: int):
    """Writes the rows of a partition to archives in ``path``; yields their index rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(path)
        attempt, number, out, name = uuid.uuid4().hex, 0, None, ""
        try:
            for batch in batches:
                for part in slices(batch, "html"):
                    at: list[tuple[str, int, int]] = []
                    for x in part.to_pylist():
                        if out is not None and out.tell() >= archive_bytes:
                            out.close()
                            out = None
                        if out is None:
                            store.create_dir(folder, recursive=True)
                            name, number = f"{attempt}-{number:05d}.warc.gz", number + 1
                            out = store.open_output_stream(f"{folder}/{name}", compression=None)
                        gz = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = gz.compress(_record(x)) + gz.flush()
                        at.append((name, out.tell(), len(member)))
                        out.write(member)
                    names, offsets, lengths = zip(*at, strict=True)
                    kept = part.select(["record", "id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "target"])
                    yield pa.RecordBatch.from_arrays(
                        [*kept.columns, pa.array(names, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
                        names=[*kept.schema.names, "archive", "offset", "length"],
                    )
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, archive_bytes: int = ARCHIVE_BYTES,
                   id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes ``path``/warc/*.warc.gz and ``path``/index; returns the index: record, id,
    url, payload_bytes, payload_digest, record_type, refers_to, target, archive, offset,
    length."""
    spark = pages.sparkSession
    shared_dir(spark)
    ship(spark)
    plan = plan_records(pages, min_bytes, id_col, url_col, html_col)
    # The same scan gives the same record numbers; each response is checked against its digest.
    payloads = pages.select(F.monotonically_increasing_id().alias("record"), F.col(html_col).alias("html"))
    rows = plan.withColumns({c: F.col(c).cast("string") for c in ("id", "refers_to")}).join(payloads, "record")
    rows = rows.select("record", "id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "target", "html")
    index = rows.mapInArrow(
        _writer(f"{path}/warc", archive_bytes),
        "record long, id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, target long, archive string, offset long, length long",
    )
    kind = pages.schema[id_col].dataType
    index.withColumns({c: F.col(c).cast(kind) for c in ("id", "refers_to")}).write.mode("errorifexists").parquet(f"{path}/index")
    return spark.read.parquet(f"{path}/index")


def _ranges(rows: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Sorted (offset, length) pairs to (begin, end, count) reads."""
    out: list[tuple[int, int, int]] = []
    for offset, length in rows:
        end = offset + length
        if out and offset - out[-1][1] <= GAP and end - out[-1][0] <= READ_BYTES:
            out[-1] = (out[-1][0], max(out[-1][1], end), out[-1][2] + 1)
        else:
            out.append((offset, end, 1))
    return out


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one gzip member."""
    head, _, rest = zlib.decompress(member, 31).partition(END)
    lines = head.decode("utf-8").split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    n = int(fields.get("Content-Length", -1))
    if not lines[0].startswith("WARC/") or rest[n:] != END:
        raise ValueError("not a whole WARC record")
    return fields, rest[:n]


def _reader(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        names = ["record", "page_id", "record_type", "target", "refers_to", "payload_bytes", "payload_digest", "url"] + ["payload"] * with_payload
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()] + [pa.binary()] * with_payload
        for batch in batches:
            files, offsets, lengths = (batch.column(c).to_pylist() for c in ("file", "offset", "length"))
            i = 0
            while i < len(files):
                j = i
                while j < len(files) and files[j] == files[i]:
                    j += 1
                store, path = fs.FileSystem.from_uri(files[i])
                with store.open_input_file(path) as f:
                    for begin, end, count in _ranges(list(zip(offsets[i:j], lengths[i:j], strict=True))):
                        f.seek(begin)
                        block, out = f.read(end - begin), []
                        for k in range(i, i + count):
                            x, body = parse(block[offsets[k] - begin : offsets[k] - begin + lengths[k]])
                            number = lambda s: int(s[len("<urn:record:") : -1])
                            digest = _digest(body)
                            if x["WARC-Type"] == "response" and f"sha1:{digest}" != x["WARC-Payload-Digest"]:
                                raise ValueError(f"digest differs in {files[i]} at {offsets[k]}")
                            copy = x["WARC-Type"] == "revisit"
                            row = (number(x["WARC-Record-ID"]), _id_of(x, "X-Page-ID"), x["WARC-Type"], number(x["WARC-Refers-To"]) if copy else None,
                                   _id_of(x, "X-Refers-To-Page-ID") if copy else None, None if copy else len(body), None if copy else digest, x["WARC-Target-URI"])
                            out.append(row + ((body,) if with_payload else ()))
                        i += count
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return run


def read_records(spark: SparkSession, path: str, selected: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of the ``selected`` index rows (archive, offset, length), read by range."""
    ship(spark)
    asked = selected.select(F.concat(F.lit(f"{path}/warc/"), "archive").alias("file"), "offset", "length")
    # A stated number of parts: index rows are small, what they ask for is not.
    total = asked.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    n = max(1, -(-total // ARCHIVE_BYTES))
    dealt = asked.repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")
    kind = "record long, page_id string, record_type string, target long, refers_to string, payload_bytes long, payload_digest string, url string"
    return dealt.mapInArrow(_reader(with_payload), kind + ", payload binary" * with_payload)


def round_trip(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, id_col: str = "page_id", **cols) -> DataFrame:
    """Writes all pages, reads all archives back; one row for each page."""
    spark = pages.sparkSession
    index = write_archives(pages, path, min_bytes, id_col=id_col, **cols)
    r = cut(read_records(spark, path, index))
    full = r.where("record_type = 'response'").select(F.col("record").alias("target"), F.col("payload_bytes").alias("b"), F.col("payload_digest").alias("d"))
    out = r.join(full, "target", "left")
    kind = pages.schema[id_col].dataType
    return out.select(
        F.col("page_id").cast(kind).alias(id_col), F.coalesce("payload_bytes", "b").alias("payload_bytes"),
        F.coalesce("payload_digest", "d").alias("payload_digest"), "record_type", F.col("refers_to").cast(kind).alias("refers_to"),
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"), f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
