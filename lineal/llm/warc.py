"""WARC archives: writing with segmented, chunked records, and reassembly on reading."""

from __future__ import annotations

import gzip

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path

#: Payloads shorter than this are never deduplicated into revisit records.
MIN_REVISIT = 100
#: Content bytes that a record holds at most; longer blocks go on in continuation records.
SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4_096
RECORDS_PER_FILE = 1_000
END = "\r\n\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
_HTTP_CHUNKED = _HTTP + b"Transfer-Encoding: chunked\r\n\r\n"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The payload in HTTP chunked transfer framing."""
    parts = [b"%x\r\n%s\r\n" % (len(c := payload[i : i + size]), c) for i in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunk(body: bytes) -> bytes:
    """Undo chunked framing; extensions after ";" and trailers are skipped, broken framing raises."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if n < 0 or end + 2 + n > len(body):
            raise ValueError("a chunk is longer than the body")
        if n == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n
        if body[at : at + 2] != b"\r\n":
            raise ValueError("a chunk does not end with CRLF")
        at += 2


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block


def records_of(name: str, url: str | None, payload: bytes, digest: str, refers_to: int | None, segment_bytes: int) -> list[bytes]:
    """The record, or the record and its continuations, of one page; name: what follows "urn:page:" in its identifier."""
    base = [("WARC-Record-ID", f"<urn:page:{name}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", len(payload))]
    uri = "".join(c for c in url or "" if c >= " ").strip()
    if uri:
        base.insert(1, ("WARC-Target-URI", uri))
    if refers_to is not None:
        fields = [("WARC-Type", "revisit"), *base, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("Content-Type", "application/http; msgtype=response")]
        return [_record(fields, _HTTP + b"\r\n")]
    block = _HTTP_CHUNKED + chunked(payload)
    fields = [("WARC-Type", "response"), *base, ("Content-Type", "application/http; msgtype=response")]
    if len(block) <= segment_bytes:
        return [_record(fields, block)]
    cuts = range(0, len(block), segment_bytes)
    out = [_record([*fields, ("WARC-Segment-Number", 1)], block[:segment_bytes])]
    for number, at in enumerate(cuts[1:], 2):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:page:{name}:{number}>"), ("WARC-Segment-Origin-ID", f"<urn:page:{name}>"), ("WARC-Segment-Number", number)]
        if number == len(cuts):
            more.append(("WARC-Segment-Total-Length", len(block)))
        out.append(_record(more, block[at : at + segment_bytes]))
    return out


def write_warc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", min_revisit: int = MIN_REVISIT, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write one WARC record per row to gzip files under path; long blocks go on in continuation records.

    Of rows with equal payloads of min_revisit bytes or more, the one with the smallest key is a response,
    the others are revisits of it; smaller payloads are all responses. A null html is an empty payload; a
    null url writes no target field; of rows with equal keys and payloads each gets a record (all of them
    responses where their key is the smallest). Rows with a null key can't be named and raise. The digests'
    first keys are a map-side combined minimum; the join back is one that AQE can split on a hot digest.
    """
    rows = pages.select(F.col(key).cast("long").alias("k"), F.col(url).alias("u"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("p"))
    rows = rows.withColumns({"d": F.sha2("p", 256), "n": F.length("p")})
    firsts = rows.where(F.col("n") >= min_revisit).groupBy(F.col("d").alias("fd")).agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    told = rows.join(firsts, F.col("d") == F.col("fd"), "left").select("k", "u", "p", "d", F.when(~F.col("first").eqNullSafe(F.col("k")), F.col("first")).alias("r"))

    def write(batches):
        place, number = TaskContext.get().partitionId(), 0
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(5)]
            out, size = [], 0
            for k, u, p, d, r in zip(*cols, strict=True):
                number += 1
                for x in records_of(f"{'' if k is None else k}#{place}-{number}", u, p, d, r, segment_bytes):
                    out.append(x)
                    size += len(x)
                if size > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    lines = told.mapInArrow(write, "value binary").select(F.col("value").cast("string").alias("value"))
    # the separator between text rows is the end mark of a WARC record
    lines.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse_warc(data: bytes):
    """(fields with lower-case names, block) of each record of an archive."""
    at = 0
    while at < len(data):
        head_end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:head_end].decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"not a WARC record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start = head_end + 4
        end = start + int(fields["content-length"])
        if end > len(data):
            raise ValueError("a record is cut off")
        yield fields, data[start:end]
        at = end + 4


_PART = "origin string, number int, total long, type string, refers_to string, digest string, length long, block binary"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, record_type, refers_to, digest, length, payload): every whole record, reassembled.

    Archives are read as binary files (each bounded by RECORDS_PER_FILE times SEGMENT_BYTES). Records of
    one segment pass straight on; only segmented ones are grouped by origin identifier, ordered by segment
    number and joined. A missing or repeated segment number, a missing end, or a length other than
    WARC-Segment-Total-Length raises, as does broken chunked framing. A revisit has a null payload; digest
    and length are then those it names. No archive: an empty table.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")

    def split(batches):
        for b in batches:
            for blob in b.column(0).to_pylist():
                rows, size = [], 0
                for f, block in parse_warc(gzip.decompress(blob)):
                    number = f.get("warc-segment-number")
                    total = f.get("warc-segment-total-length")
                    rows.append((f.get("warc-segment-origin-id") or f["warc-record-id"], int(number) if number else None, int(total) if total else None, f["warc-type"], f.get("warc-refers-to"), f.get("warc-payload-digest"), int(f["x-payload-length"]) if "x-payload-length" in f else None, block))
                    size += len(block)
                    if size > 8_000_000:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    parts = files.mapInArrow(split, _PART)
    whole = parts.where("number is null").select("origin", "type", "refers_to", "digest", "length", "block")
    pieces = parts.where("number is not null").groupBy("origin").agg(F.sort_array(F.collect_list("number")).alias("numbers"), F.max_by("total", "number").alias("total"), F.sum(F.length("block")).alias("held"), F.expr("listagg(block) within group (order by number)").alias("whole"), F.max("refers_to").alias("refers_to"), F.max("digest").alias("digest"), F.max("length").alias("length"), F.max_by("type", -F.col("number")).alias("type"))
    right = (F.col("numbers") == F.sequence(F.lit(1), F.size("numbers"))) & (F.coalesce("total", F.lit(-1)) == F.col("held"))
    block = F.when(right, F.col("whole")).otherwise(F.raise_error(F.concat(F.lit("segments missing or of a wrong length: "), F.col("origin"))).cast("binary"))
    joined = pieces.select("origin", "type", "refers_to", "digest", "length", block.alias("block"))

    @F.pandas_udf("binary")
    def payload(blocks, types):
        import pandas as pd

        def one(block, kind):
            if kind == "revisit":
                return None
            head, _, body = block.partition(b"\r\n\r\n")
            return dechunk(body) if b"transfer-encoding: chunked" in head.lower() else body

        return pd.Series([one(b, t) for b, t in zip(blocks, types, strict=True)], dtype=object)

    both = whole.unionByName(joined)
    return both.select(F.col("origin").alias("record_id"), F.col("type").alias("record_type"), "refers_to", F.regexp_replace("digest", "^sha256:", "").alias("digest"), "length", payload("block", "type").alias("payload"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in _PART.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def archive_round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write the pages to an archive in the shared folder, read it back, and return the read records
    with their page's key."""
    path = fresh_path(pages.sparkSession, "warc")
    write_warc(pages, path, key, url, html)
    page = lambda c: F.nullif(F.regexp_extract(c, r"^<urn:page:(-?\d*)(?:#.*)?>$", 1), F.lit("")).cast("long")
    return read_warc(pages.sparkSession, path).select(page(F.col("record_id")).alias(key), "record_type", F.when(F.col("refers_to").isNotNull(), page(F.col("refers_to"))).alias("refers_to"), "digest", "length", "payload")
