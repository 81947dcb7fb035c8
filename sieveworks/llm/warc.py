"""WARC archives: a writer with revisit records and a splittable reader.

The writer turns every page into a gzip member of its own, as crawl archives have it, and
Spark's text sink writes the members' bytes as they are, with its own commit protocol on
whatever file system the shared folder is. (That sink ends every row with a separator. Each
row is made to end in the NUL that a gzip member ends in, and NUL is the separator.)

The reader lists files and lengths with Spark and deals byte ranges to tasks. A task scans its
range for the gzip magic, takes a place for a member only if it decodes to a WARC header with
a readable length, and owns the records whose members start inside its range, whose bytes it
may follow beyond the range's end.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, hot_join, partitions, shared_folder, small_batches

#: Bytes of payload from which on equal payloads are stored once; bytes of a range; bytes read at once.
REVISIT_FROM, RANGE, BLOCK = 1000, 32 << 20, 1 << 18
MAGIC = b"\x1f\x8b\x08"
_EMPTY = zlib.compressobj(6, zlib.DEFLATED, 31)
_EMPTY_MEMBER = _EMPTY.compress(b"") + _EMPTY.flush()
#: record_type of members that begin as a record and can't be read.
DAMAGED = "damaged"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("page_id", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("refers_to_record", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def record_id(page_id: int | None) -> str:
    """A URN that holds a page id (a version 8 UUID: its last 62 bits and two of version's)."""
    n = (page_id or 0) & ((1 << 64) - 1)
    bits = 0x5349455645 << 88 | 8 << 76 | (n >> 62) << 64 | 0b10 << 62 | (n & ((1 << 62) - 1))
    h = f"{bits:032x}"
    return f"urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"


def page_of(record: str) -> int:
    """The page id in a URN of `record_id`."""
    bits = int(record.rsplit(":", 1)[1].replace("-", ""), 16)
    n = (bits >> 64 & 3) << 62 | bits & ((1 << 62) - 1)
    return n - (1 << 64) if n >> 63 else n


def member(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, level: int = 6) -> bytes:
    """One record as a gzip member that ends in NUL."""
    safe = lambda s: re.sub(r"[\r\n%]", lambda m: f"%{ord(m[0]):02X}", s)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{record_id(page_id)}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    head += [f"WARC-Target-URI: {safe(url)}"] if url is not None else []
    head += ["WARC-Page-Unknown: true"] if page_id is None else []
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    head += [f"WARC-Refers-To: <{record_id(refers_to)}>", f"WARC-Profile: {PROFILE}"] if revisit else []
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packed = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = packed.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + packed.flush()
    return out if out.endswith(b"\0") else out + _EMPTY_MEMBER  # only records of 16 MB and more end otherwise


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, refers_to: of equal payloads the largest page id, if another page holds it.

    Payloads are equal if their SHA-1 and length are; smaller ones than REVISIT_FROM are never
    looked up. Rows that share the largest page id are all responses. What a revisit refers to is
    found without bodies, which move once, dealt by page id.
    """
    body = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", body.alias("html"), F.sha1(F.encode(body, "UTF-8")).alias("digest"))
    keys = cut(rows.filter((F.octet_length("html") >= REVISIT_FROM) & F.col("page_id").isNotNull()).select("page_id", "digest", F.octet_length("html").alias("size")))
    twins = keys.groupBy("digest", "size").agg(F.max("page_id").alias("last"), F.min("page_id").alias("least"), F.count("*").alias("n"))
    twins = cut(twins.filter("least < last").withColumnRenamed("size", "of_size").select("digest", "of_size", "last", "n"))
    refers = hot_join(keys, twins, "digest").filter("size = of_size and page_id < last").select(F.col("page_id").alias("of_page"), F.col("digest").alias("of_digest"), "last").distinct()
    out = rows.join(cut(refers), (F.col("page_id") == F.col("of_page")) & (F.col("digest") == F.col("of_digest")), "left")
    return out.select("page_id", "url", "html", "digest", F.col("last").alias("refers_to"))


def write_archives(pages: DataFrame, path: str, level: int = 6) -> None:
    """Write a record per row of ``pages`` (page_id, url, html) to archives in the folder ``path``.

    A null html is an empty payload, a null url leaves its field out, and a null page_id is
    marked unknown; such a page is always a response. An empty table writes no record. Repeated rows are
    records of their own, a payload of any length is one record, and other columns are not looked at.
    """
    spark = pages.sparkSession
    small_batches(spark)

    @F.pandas_udf("binary")
    def packed(page_id: pd.Series, url: pd.Series, html: pd.Series, digest: pd.Series, refers_to: pd.Series) -> pd.Series:
        none = lambda x: None if x is None or x == "" else int(x)
        return pd.Series([member(none(p), u, h.encode("utf-8", "surrogatepass"), d, none(r), none(r) is not None, level)[:-1] for p, u, h, d, r in zip(page_id, url, html, digest, refers_to, strict=True)], dtype=object)

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))  # noqa: E731  ids as text: pandas has no null integers
    rows = with_revisits(pages).select(packed(text("page_id"), "url", "html", "digest", text("refers_to")).alias("m"))
    rows.select(F.col("m").cast("string")).write.option("lineSep", "\0").text(path)


def _open(path: str):
    """A seekable file on any file system that Arrow knows by its URI."""
    from pyarrow import fs

    uri = re.sub(r"^file:/+", "file:///", path)
    system, name = fs.FileSystem.from_uri(uri) if not uri.startswith("file:") else (fs.LocalFileSystem(), unquote(uri.removeprefix("file://")))
    return system.open_input_file(name)


def _member_at(f, at: int, head: bytes) -> tuple[bytes | None, int] | None:
    """The decoded bytes of the gzip member at ``at`` and its end, or None if there is no WARC record.

    ``head`` holds the first bytes there; a false magic mostly fails within them. A member that
    begins as a WARC record but doesn't decode to its end has no bytes.
    """
    unpack = zlib.decompressobj(31)
    try:
        out = [unpack.decompress(head)]
    except zlib.error:
        return None
    start = out[0][:8]
    if len(out[0]) >= 8 and not start.startswith(b"WARC/1."):
        return None
    read, begun = len(head), start.startswith(b"WARC/1.")
    try:
        while not unpack.eof:
            more = f.read_at(BLOCK, at + read)
            if not more:
                return (None, at + 1) if begun else None
            read += len(more)
            out.append(unpack.decompress(more))
    except zlib.error:
        return (None, at + 1) if begun else None
    body = b"".join(out)
    return (body, at + read - len(unpack.unused_data)) if body.startswith(b"WARC/1.") else None


def parse(data: bytes) -> dict | None:
    """A record's fields, or None if its header is no WARC header of a readable length."""
    head, found, block = data.partition(b"\r\n\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    if not found or not fields.get("content-length", "").isdigit() or len(block) < int(fields["content-length"]):
        return None
    block = block[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    return fields | {"payload": payload, "payload_bytes": int(size[1]) if size else len(payload)}


def records_in(path: str, length: int, start: int, end: int) -> Iterator[tuple]:
    """RECORD tuples of the records whose members start in [start, end) of a file."""
    bare = lambda s: s.strip("<>") if s else None
    with _open(path) as f:
        at, buffer, base = start, b"", start
        while at < end:
            place = buffer.find(MAGIC, at - base)
            if place < 0:
                keep = max(at, base + len(buffer) - len(MAGIC) + 1) if buffer else at
                if keep >= end or keep >= length:
                    return
                fresh = f.read_at(BLOCK, keep)
                if len(fresh) < len(MAGIC):
                    return
                at, base, buffer = keep, keep, fresh
                if buffer.find(MAGIC) < 0 and base + len(buffer) >= length:
                    return
                continue
            at = base + place
            if at >= end:
                return
            head = buffer[place : place + 4096]
            if len(head) < 64:  # near the buffer's end
                head = f.read_at(4096, at)
            found = _member_at(f, at, head)
            record = parse(found[0]) if found and found[0] is not None else None
            if found and record is None:
                yield (path, at, None, DAMAGED, None, None, None, 0, None, None, None)
            if record is None:
                at += 1  # a chance magic, or an empty member
                continue
            digest = re.sub("^sha1:", "", record.get("warc-payload-digest", ""))
            own, refers = bare(record.get("warc-record-id")), bare(record.get("warc-refers-to"))
            page = page_of(own) if own and "warc-page-unknown" not in record else None
            kind = record.get("warc-type")
            yield (path, at, own, kind, record.get("warc-target-uri"), page, base64.b32decode(digest).hex() if len(digest) == 32 else digest or None, record["payload_bytes"], refers, page_of(refers) if refers else None, None if kind == "revisit" else record["payload"])
            at = found[1]
            if at - base > len(buffer):
                base, buffer = at, b""


def read_archives(spark: SparkSession, path: str, span: int = RANGE) -> DataFrame:
    """RECORD rows of all archives below ``path``, in ranges of ``span`` bytes.

    Target URIs come as written (with CR, LF and % escaped by `write_archives`). A member that
    begins as a record but doesn't decode, or lacks a readable length, gives a row with the record_type ``damaged``, its place and
    nothing else, so that a damaged archive shows. A folder without records gives no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    ranges = files.filter("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(span).cast("long"))).alias("start"))
    ranges = ranges.repartition(partitions(spark))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                held, size = [], 0
                for row in records_in(r.path, r.length, r.start, min(r.start + span, r.length)):
                    held.append(row)
                    size += len(row[-1] or b"") + 500
                    if size > 8 << 20:
                        yield _frame(held)
                        held, size = [], 0
                yield _frame(held)

    return ranges.mapInPandas(run, RECORD)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=RECORD.names, dtype=object)
    return out.astype({"page_id": "Int64", "refers_to": "Int64", "offset": "int64", "payload_bytes": "int64"})


def archive(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` to archives (a new shared folder by default) and read their records back."""
    path = path or shared_folder(pages.sparkSession)
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)
