"""WARC archives of page captures: writing, reading, and assembling transactions.

A capture is three records: a request, a response or a revisit of an equal payload, and metadata. Request and metadata
name the response by WARC-Concurrent-To; assembling joins the three through it and gives one nested row per capture.
Archives are written and read by Spark's own sources, so any store that Spark reaches will do. A record's end is found
by its Content-Length alone; payloads may hold anything, also what looks like another record.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Scratch, salted_lookup, table, written

DATE = "2024-01-01T00:00:00Z"
#: Payloads of at least so many bytes are stored once, and revisited by equal ones.
REVISIT_BYTES = 0
#: Captures are written by size, each class in files of its own: up to so many bytes, the last without a bound. A file
#: holds FILE_BYTES at most, uncompressed, or one capture.
SIZE_CLASSES = (1 << 16, 1 << 20, 1 << 24, 1 << 28)
FILE_BYTES = 1 << 28
#: Bytes of a capture's three records besides its payload and its URLs, no less.
HEADER_BYTES = 2048
#: Bytes of payload that the reader gathers before it hands records on.
READ_BYTES = 4 << 20
CRLF = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = "record_id string, kind string, concurrent_to array<string>, refers_to string, target_uri string, date string, page_id long, http_length long, payload_digest string, payload binary"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: each five hexadecimal digits are four letters."""
    letters = F.array(*[F.lit(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"])
    digest = F.sha1(payload)
    out = []
    for i in range(8):
        bits = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        out += [F.get(letters, F.shiftright(bits, s).bitwiseAND(31)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def _header(name: str, value: Column) -> Column:
    """A header line; nothing for a null. Line breaks in a value would end it and are percent-encoded."""
    safe = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit(CRLF)), F.lit(""))


def _record(kind: Column, record_id: Column, headers: list[Column], content_type: Column, block: Column) -> Column:
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"), _header("WARC-Type", kind), _header("WARC-Record-ID", record_id), _header("WARC-Date", F.lit(DATE)), *headers,
        _header("Content-Type", content_type), _header("Content-Length", F.octet_length(block).cast("string")), F.lit(CRLF), block,
    )


def _named(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html"), F.lit(""))
    return pages.select("page_id", "url", payload.alias("payload"), base32_sha1(F.encode(payload, "UTF-8")).alias("digest"), F.octet_length(payload).cast("long").alias("n_bytes"))


def stored_captures(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """``page_id, url, payload, digest, n_bytes, copy``: the captures whose payloads are stored.

    Of captures with equal payloads of at least ``revisit_bytes`` bytes that is the one with the largest id, of these the
    one with the largest URL; null ids and URLs are the least. Payloads are reduced to one per digest before they are
    shuffled, so a payload repeated any number of times reaches its task as a row for each input task.
    """
    named = _named(pages)
    order = F.struct("page_id", "url")
    first = named.filter(F.col("n_bytes") >= revisit_bytes).groupBy("digest").agg(F.max(order).alias("o"), F.max_by("payload", order).alias("payload"), F.first("n_bytes").alias("n_bytes"))
    first = first.select("o.page_id", "o.url", "payload", "digest", "n_bytes", F.lit("1").alias("copy"))
    if revisit_bytes <= 0:
        return first
    # Short payloads are all stored; their rows are told apart where they are read.
    short = named.filter(F.col("n_bytes") < revisit_bytes).withColumn("copy", F.concat(F.lit("s"), F.monotonically_increasing_id().cast("string")))
    return first.unionByName(short)


def revisit_captures(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """``page_id, url, digest, n_bytes, copy, top``: the captures that revisit the stored one, whose page is ``top``. No
    payload is shuffled. Repeated rows are counted, not moved; a digest's pages are dealt over ``SALTS`` tasks."""
    named = _named(pages).filter(F.col("n_bytes") >= revisit_bytes).drop("payload")
    rows = written(named.groupBy("digest", "page_id", "url", "n_bytes").agg(F.count(F.lit(1)).alias("n")))
    tops = rows.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("top"), F.sum("n").alias("all")).filter(F.col("all") > 1).drop("all")
    again = salted_lookup(rows, written(tops), ["digest"], F.struct("page_id", "url"), "inner")
    is_top = F.struct("page_id", "url").eqNullSafe(F.col("top"))
    # The stored capture is copy 1 of its row.
    copies = again.withColumn("least", F.when(is_top, F.lit(2)).otherwise(F.lit(1)).cast("long")).filter(F.col("n") >= F.col("least"))
    copies = copies.withColumn("copy", F.explode(F.sequence(F.col("least"), F.col("n"))))
    # Rows of one page with different URLs need different names.
    copy = F.concat_ws(".", F.col("copy").cast("string"), F.md5(F.coalesce("url", F.lit(""))))
    return copies.select("page_id", "url", "digest", "n_bytes", copy.alias("copy"), F.col("top.page_id").alias("top"))


def _records(captures: DataFrame, revisit: bool) -> DataFrame:
    """A row ``value`` for each record: request, response or revisit, metadata."""
    shown = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    ids = lambda page, copy, kind: F.concat(F.lit("<urn:page:"), page, F.lit(":"), F.col("digest"), F.lit(":"), copy, F.lit(f":{kind}>"))
    capture = ids(shown, F.col("copy"), "capture")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n_bytes").cast("string"), F.lit(CRLF * 2))
    rest = F.regexp_extract("url", r"(?s)://([^?#]*)", 1)
    ask = F.concat(F.lit("GET /"), F.translate(F.regexp_extract(rest, r"(?s)^[^/]*/(.*)$", 1), "\r\n", ""), F.lit(f" HTTP/1.1{CRLF}Host: "), F.translate(F.regexp_extract(rest, "(?s)^[^/]*", 0), "\r\n", ""), F.lit(CRLF * 2))
    uri = _header("WARC-Target-URI", F.col("url"))
    together = _header("WARC-Concurrent-To", capture)
    about = [uri, _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))]
    if revisit:
        target = ids(F.coalesce(F.col("top").cast("string"), F.lit("none")), F.lit("1"), "capture")
        about += [_header("WARC-Refers-To", target), _header("WARC-Profile", F.lit(REVISIT_PROFILE))]
    answer = _record(F.lit("revisit" if revisit else "response"), capture, about, F.lit("application/http; msgtype=response"), http if revisit else F.concat(http, F.col("payload")))
    request = _record(F.lit("request"), ids(shown, F.col("copy"), "request"), [uri, together], F.lit("application/http; msgtype=request"), F.coalesce(ask, F.lit(f"GET / HTTP/1.1{CRLF * 2}")))
    fields = _header("page-id", F.col("page_id").cast("string"))
    metadata = _record(F.lit("metadata"), ids(shown, F.col("copy"), "metadata"), [uri, together], F.lit("application/warc-fields"), fields)
    return captures.select(F.explode(F.array(request, answer, metadata)).alias("value"))


def _write(records: DataFrame, folder: str, capture_bytes: int) -> None:
    n = 3 * max(1, FILE_BYTES // (capture_bytes + HEADER_BYTES))
    records.write.mode("append").option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", n).text(folder)


def write_archives(pages: DataFrame, folder: str, revisit_bytes: int = REVISIT_BYTES) -> None:
    """Writes the captures of ``pages`` (``page_id, url, html``) as gzipped WARC files into ``folder``.

    Files are bounded by bytes: pages are written by size class, so that the number of records in a file bounds its
    bytes. Equal payloads are of one size, but URLs aren't, so a page's class is that of payload and URL together, and
    a revisit's that of its URL, which four records or headers hold.
    """
    payload, url = F.coalesce(F.octet_length("html"), F.lit(0)), 8 * F.coalesce(F.octet_length("url"), F.lit(0))
    most = pages.agg(F.max(payload).alias("p"), F.max(url).alias("u")).first()
    pages = pages.select("page_id", "url", "html")
    least = 0
    for top in (*SIZE_CLASSES, None):
        if least and (most.p or 0) <= least:
            break
        # Copies of a payload are in one class; the longest URL of all bounds what they add.
        size = pages.filter((payload > least) & (payload <= top) if least and top else payload > least if least else payload <= top)
        _write(_records(stored_captures(size, revisit_bytes), False), folder, (top or most.p) + (most.u or 0))
        least = top
    _write(_records(revisit_captures(pages, revisit_bytes), True), folder, most.u or 0)


class _Reader:
    """Bytes of a gzipped archive as they are asked for; what has been read is let go."""

    def __init__(self, data: bytes, step: int = 1 << 20):
        self.data, self.step, self.at = memoryview(data), step, 0
        self.inflate = zlib.decompressobj(31)
        self.held = bytearray()

    def fill(self) -> bool:
        while True:
            if self.inflate.eof:
                tail = self.inflate.unused_data
                if not tail and self.at >= len(self.data):
                    return False
                self.inflate = zlib.decompressobj(31)
                more = self.inflate.decompress(tail) if tail else b""
            elif self.at >= len(self.data):
                return False
            else:
                more = b""
            if not more:
                more = self.inflate.decompress(self.data[self.at : self.at + self.step])
                self.at += self.step
            if more:
                self.held += more
                return True

    def until(self, mark: bytes) -> bytes | None:
        while (i := self.held.find(mark)) < 0:
            if not self.fill():
                return None
        out = bytes(self.held[:i])
        del self.held[: i + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self.fill():
                raise ValueError(f"the archive ends {n - len(self.held)} bytes early")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def _fields(head: bytes) -> dict[str, list[str]]:
    """Values of each header, in order; a header may come several times."""
    out: dict[str, list[str]] = {}
    for line in head.decode("utf-8", "replace").split(CRLF):
        name, mark, value = line.partition(":")
        if mark:
            out.setdefault(name.strip().lower(), []).append(value.strip())
    return out


def parse_archive(data: bytes) -> Iterator[dict]:
    """The records of one archive, in order."""
    reader = _Reader(data)
    while (head := reader.until(CRLF.encode() * 2)) is not None:
        headers = _fields(head.partition(CRLF.encode())[2])
        h = {name: values[-1] for name, values in headers.items()}
        block = reader.take(int(h["content-length"]))
        if reader.take(4) != CRLF.encode() * 2:
            raise ValueError("a record isn't followed by two line ends")
        digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
        out = {"record_id": h["warc-record-id"], "kind": h["warc-type"], "concurrent_to": headers.get("warc-concurrent-to", []), "refers_to": h.get("warc-refers-to"), "target_uri": h.get("warc-target-uri"), "date": h.get("warc-date"), "page_id": None, "http_length": None, "payload_digest": digest, "payload": None}
        if h["warc-type"] in ("response", "revisit"):
            http, _, body = block.partition(CRLF.encode() * 2)
            out["http_length"] = int(_fields(http).get("content-length", [len(body)])[-1])
            out["payload"] = body if h["warc-type"] == "response" else None
        elif h["warc-type"] == "metadata" and (page := _fields(block).get("page-id")):
            out["page_id"] = int(page[-1])
        yield out


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}.get(t, pa.string())) for n, t in (f.split() for f in RECORDS.split(", "))])
    for batch in batches:
        for i in range(batch.num_rows):
            rows, held = [], 0
            for r in parse_archive(batch.column(0)[i].as_py()):
                rows.append(r)
                held += len(r["payload"] or b"")
                if held >= READ_BYTES or len(rows) >= 10_000:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each record of the folder's archives; ``payload`` is null but for responses. Memory: one archive
    file, which ``write_archives`` bounds, and what READ_BYTES allows."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder)
    return files.select("content").mapInArrow(_parse, RECORDS)


def assemble(records: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per capture: ``capture_id, kind, page_id, target_uri, request, response, metadata``.

    The three parts are structs of the records that name the capture in WARC-Concurrent-To, or are it; a part whose
    record is missing is null, and a capture without its response has a null ``kind``. A part's fields are those of one
    record: where several name a capture, the one of least record id counts, of these the one of least fields. A record that
    names several captures is a part of each. Responses and revisits are captures of their own, whatever they name.

    Without ``payloads`` the responses have size and digest only, which are taken before the shuffle.
    """
    is_answer = F.col("kind").isin("response", "revisit")
    named = F.coalesce(F.col("concurrent_to"), F.array().cast("array<string>"))
    of = F.when(is_answer | (F.size(named) == 0), F.array("record_id")).otherwise(F.array_distinct(named))
    measured = records.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("own_digest", base32_sha1(F.col("payload")))
    held = ["payload"] if payloads else []
    parts = {
        "request": (F.col("kind") == "request", F.struct("record_id", "date")),
        "response": (
            is_answer,
            F.struct("record_id", "kind", "date", "target_uri", "refers_to", "http_length", F.col("payload_digest").alias("stated_digest"), "payload_bytes", F.col("own_digest").alias("payload_digest"), *held),
        ),
        "metadata": (F.col("kind") == "metadata", F.struct("record_id", "page_id")),
    }
    keyed = measured.select(F.explode(of).alias("capture_id"), *[F.when(on, part).alias(name) for name, (on, part) in parts.items()])
    nested = keyed.groupBy("capture_id").agg(*[F.min(p).alias(p) for p in parts])
    return nested.select("capture_id", "response.kind", "metadata.page_id", "response.target_uri", *parts)


def op1_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls: a null html is an empty payload, a null URL has no WARC-Target-URI, and captures of null ids are kept.
    Repeated rows (same id, same payload) are captures of their own, of which only the first can be the response. An
    empty table gives an empty result. Columns of ``pages`` but the three used aren't read."""
    with Scratch(spark) as scratch:
        folder = scratch.folder()
        write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
        captures = assemble(read_archives(spark, folder), payloads=False).filter(F.col("kind").isNotNull())
        flat = written(
            captures.select(
                "capture_id", "kind", "page_id", "target_uri", F.col("response.refers_to").alias("target"), F.col("response.payload_bytes").alias("n"), F.col("response.payload_digest").alias("digest")
            )
        )
    revisits = flat.filter("kind = 'revisit'")
    stored = flat.filter("kind = 'response'").select(F.col("capture_id").alias("target"), F.col("page_id").alias("t_page"), F.col("n").alias("t_n"), F.col("digest").alias("t_digest"))
    # A page may have any number of revisits: adaptive execution splits their side.
    resolved = revisits.join(stored, "target")
    out = resolved.select("page_id", F.col("t_n").alias("payload_bytes"), F.col("t_digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("t_page").alias("refers_to"), "target_uri")
    own = flat.filter("kind = 'response'").select("page_id", F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "target_uri")
    return own.unionByName(out)
