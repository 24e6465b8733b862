"""WARC archives: written by Spark as segmented records, read back and reassembled.

Writing: of payloads that are equal and large enough, the row of the smallest id becomes a response record with
the payload, an HTTP message in chunked transfer framing; the others become revisit records that name it.  A
record whose block is larger than ``segment_bytes`` is split into a first record and continuation records.
Archives are written by Spark's text writer, with the record separator of the format, to any file system.

Reading: archives are parsed record by record; continuation records are grouped by the identifier of their origin,
ordered by segment number, checked against the total length, and the chunked framing is decoded.

Defined cases: a null html is an empty payload; payloads of fewer than ``least`` bytes are never revisits; of
repeated rows with equal payload one is the response; rows with a null id are always responses; a null url has no
target URI; an empty table gives no rows; other columns are ignored; a very long html is as many segments as it takes, put
together once, in time and memory in proportion to its own length.  Reading an archive whose record is cut
short, or a message whose framing or digest is wrong, is an error; a message that lacks a segment has ``complete``
false.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import fresh_path, join_each, written

LEAST_BYTES = 100
SEGMENT_BYTES = 32 * 1024
CHUNK_BYTES = 8 * 1024
RECORDS_PER_FILE = 2000
DATE = "2024-01-01T00:00:00Z"
END = b"\r\n\r\n"
_RECORD = "record_id string, kind string, origin_id string, segment int, total_length long, page_id long, refers_to long, digest string, block binary"
_PAGE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, complete boolean"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(payload[a : a + size]), payload[a : a + size]) for a in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """Decode chunked transfer framing: sizes in hex, optional extensions, trailer fields ignored."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("a chunk size is missing")
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(body[at : at + size])
        at += size + 2


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the two line ends after it, which the writer adds."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block


def _name(*parts: object) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5('|'.join(map(str, parts)).encode('utf-8', 'surrogatepass')).digest())}>"


def records_of(page_id, url, payload: bytes | None, digest: str, refers_to, copy: int, size: int, segment_bytes: int) -> list[bytes]:
    own = _name(page_id, digest, url, copy)
    target = None if url is None else quote(url, safe="%/:=&?~#+!$,;'@()*[]")
    common = [("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Page-ID", page_id)]
    kind = [("Content-Type", "application/http; msgtype=response")]
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, ("WARC-Profile", profile), ("X-Refers-To-Page", refers_to), *kind]
        return [_record(fields, f"{head}Content-Length: {size}\r\n\r\n".encode())]
    block = f"{head}Transfer-Encoding: chunked\r\n\r\n".encode() + chunked(payload)
    parts = [block[a : a + segment_bytes] for a in range(0, len(block), segment_bytes)]
    if len(parts) == 1:
        return [_record([("WARC-Type", "response"), ("WARC-Record-ID", own), *common, *kind], block)]
    out = [_record([("WARC-Type", "response"), ("WARC-Record-ID", own), *common, ("WARC-Segment-Number", 1), *kind], parts[0])]
    for n, part in enumerate(parts[1:], 2):
        total = len(block) if n == len(parts) else None
        fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", _name(own, n)), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", total)]
        out.append(_record(fields, part))
    return out


def write(pages: DataFrame, path: str, least: int = LEAST_BYTES, segment_bytes: int = SEGMENT_BYTES) -> None:
    """One record, or a series of segments, for each row of (page_id, url, html), as gzipped archives in ``path``."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.length("payload"))
    # Ids and digests only, combined before the shuffle: many equal payloads or rows are no hot key.
    named, key = rows.where(F.col("page_id").isNotNull()), ["page_id", "digest"]
    ids = written(named.groupBy(*key).agg(F.count("*").alias("rows"), F.min("size").alias("size")), "ids")
    firsts = written(ids.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")), "firsts")
    told = join_each(ids.where(F.col("size") >= least), firsts.drop("n"), ["digest"], firsts).unionByName(ids.where(F.col("size") < least).withColumn("first", F.lit(None).cast("long")))
    told = written(told.where((F.col("rows") > 1) | (F.col("first") != F.col("page_id"))), "told")
    once, more = told.where("rows = 1").select(*key, "first"), told.where("rows > 1").drop("rows")
    refers = F.when(F.col("first") != F.col("page_id"), F.col("first")).alias("refers_to")
    columns = ("page_id", "url", "payload", "digest", "refers_to", "copy", "size")
    zero = F.lit(0).cast("long").alias("copy")
    if more.first() is not None:
        # One of the rows of an id and payload stands for all; the others follow from their number.
        own = rows.drop("size").join(more.select(*key), key, "left_semi")
        same = written(own.groupBy(*key).agg(F.first("payload").alias("payload"), F.min("url").alias("url")).join(more, key), "same")
        counts = written(own.groupBy(*key, "url").agg(F.count("*").alias("n")), "copies")
        small = F.when(F.col("size") < least, F.col("payload")).alias("payload")
        others = join_each(counts, same.select(*key, "first", "size", small, F.col("url").alias("first_url")), key)
        others = others.withColumn("n", F.col("n") - F.col("url").eqNullSafe(F.col("first_url")).cast("long")).where("n > 0")
        others = others.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).withColumn("refers_to", F.col("first"))
        rows, repeated = rows.join(more.select(*key), key, "left_anti"), same.select("page_id", "url", "payload", "digest", refers, zero, "size").unionByName(others.select(*columns))
    else:
        repeated = None
    numbered = rows.join(once, key, "left").select("page_id", "url", "payload", "digest", refers, zero, "size")
    if repeated is not None:
        numbered = numbered.unionByName(repeated)

    def to_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                values = (whole.column(c).slice(at, 500).to_pylist() for c in columns)
                out = [r for row in zip(*values, strict=True) for r in records_of(*row, segment_bytes)]
                yield pa.RecordBatch.from_pydict({"record": pa.array(out, pa.binary())})

    records = numbered.mapInArrow(to_records, "record binary")
    text = records.select(F.col("record").cast("string").alias("value"))
    text.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields with lower-case names, block) of each record."""
    at = 0
    while at < len(archive):
        end = archive.find(END, at)
        if end < 0 or not archive.startswith(b"WARC/", at):
            raise ValueError("not at the start of a record")
        lines = archive[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start = end + len(END)
        stop = start + int(fields["content-length"])
        if archive[stop : stop + 4] != END:
            raise ValueError("a record is cut short")
        yield fields, archive[start:stop]
        at = stop + 4


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the archives in ``path``."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole_number = lambda x: None if x is None else int(x)
        for batch in batches:
            for content in batch.column("content"):
                data = content.as_py()
                rows = []
                for f, block in parse(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    digest = f.get("warc-payload-digest", "").removeprefix("sha256:") or None
                    own = f["warc-record-id"]
                    rows.append((own, f["warc-type"], f.get("warc-segment-origin-id", own), whole_number(f.get("warc-segment-number")), whole_number(f.get("warc-segment-total-length")),
                                 whole_number(f.get("x-page-id")), whole_number(f.get("x-refers-to-page")), digest, block))
                    if len(rows) == 500:
                        yield _batch(rows, _RECORD)
                        rows = []
                if rows:
                    yield _batch(rows, _RECORD)

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    return files.mapInArrow(parsed, _RECORD)


_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[k]) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))


def message(kind: str, block: bytes, digest: str | None) -> tuple[int, str | None, bytes | None]:
    """(payload length, digest, payload) of an HTTP message; the payload of a revisit is elsewhere."""
    head, found, body = block.partition(END)
    if not found:
        raise ValueError("an HTTP message without the end of its head")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}
    if kind == "revisit":
        return int(fields.get("content-length", 0)), digest, None
    payload = unchunked(body) if fields.get("transfer-encoding", "").lower() == "chunked" else body
    own = hashlib.sha256(payload).hexdigest()
    if digest is not None and own != digest:
        raise ValueError("a payload does not have its digest")
    return len(payload), own, payload


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row for each response or revisit, put together from its segments."""
    records = read_records(spark, path)
    first = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c)))
    named = ("kind", "page_id", "refers_to", "digest")
    single = records.where("segment IS NULL").select(*named, F.array("block").alias("blocks"), F.lit(None).cast("long").alias("total"), F.lit(True).alias("complete"))
    pieces = records.where("segment IS NOT NULL").groupBy("origin_id").agg(
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("pieces"), F.max("total_length").alias("total"), *(first(c).alias(c) for c in named)
    )
    numbers = F.col("pieces.segment") == F.sequence(F.lit(1), F.size("pieces"))
    joined = pieces.select(*named, F.col("pieces.block").alias("blocks"), "total", F.coalesce(numbers & F.col("total").isNotNull() & F.col("kind").isNotNull(), F.lit(False)).alias("complete"))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 500):
                rows = []
                for kind, page_id, refers_to, digest, blocks, total, complete in zip(*(whole_batch.column(c).slice(at, 500).to_pylist() for c in (*named, "blocks", "total", "complete")), strict=True):
                    block = b"".join(blocks)
                    complete = complete and (total is None or len(block) == total)
                    size, own, payload = message(kind, block, digest) if complete else (None, digest, None)
                    rows.append((page_id, size, own, kind, refers_to, payload, complete))
                yield _batch(rows, _PAGE)

    return single.unionByName(joined.select(*single.columns)).mapInArrow(decoded, _PAGE)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write archives to the shared folder and read them back."""
    path = fresh_path(pages.sparkSession, "warc")
    write(pages, path, **options)
    return read(pages.sparkSession, path)
