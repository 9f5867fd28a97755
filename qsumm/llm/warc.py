"""WARC archives: segmented writing, reading back, segment reassembly.

Writing.  A page's HTTP response (chunked transfer framing) is one WARC record,
cut into segments when its block is longer than ``SEGMENT_BYTES``: the first is
the ``response``, the others are ``continuation`` records that name it as their
origin, and the last states the total length.  Archives are written by Spark's
own text writer (one row per record, the record separator as line separator,
gzip) to the shared folder; a file closes after a fixed number of records, so
a record's segments may lie in different files.

Reading.  Archives are read as binary files, parsed record by record, and only
the parts of segmented records are shuffled: grouped by origin identifier,
ordered by segment number, checked against the total length and for gaps.  The
block is then decoded from its chunked framing and its digest verified.

Defined results: null html is an empty payload; of equal payloads the rows with
the largest page_id are responses and all others revisit them (rows that tie
for it, such as repeated rows or null ids only, are all responses); a null url
gives no target line; an empty table gives an empty archive and no rows; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qsumm.session import ensure_checkpoint_dir

SEGMENT_BYTES = 8 << 10
CHUNK_BYTES = 4 << 10  # size of a transfer chunk
ARCHIVE_BYTES = 32 << 20  # most bytes of records in an archive, about; bounds a reading task
END = b"\r\n\r\n"
HEAD = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        b"Transfer-Encoding: chunked\r\n\r\n")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing of a payload."""
    out = []
    for i in range(0, len(payload), size):
        part = payload[i:i + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """Payload of a chunked body; raises on broken framing."""
    out, at = [], 0
    while True:
        stop = body.index(b"\r\n", at)
        n = int(body[at:stop].split(b";")[0], 16)
        at = stop + 2
        if n == 0:
            return b"".join(out)
        if body[at + n:at + n + 2] != b"\r\n":
            raise ValueError("broken chunk")
        out.append(body[at:at + n])
        at += n + 2


def header(fields: list[tuple[str, str]]) -> bytes:
    lines = ["WARC/1.1"] + [f"{k}: {v}" for k, v in fields]
    return "\r\n".join(lines).encode() + END


def record_id(page_id, url, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{digest}')}>"


def _clean(url: str) -> str:
    """A url as a header value: white space and control characters escaped."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def with_roles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages with payload, digest, and the page they revisit (``keeper``)."""
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                     F.coalesce(F.encode(F.col(html_col), "UTF-8"), F.lit(b"")).alias("payload"))
    p = p.withColumns({"sha": F.sha1("payload"), "n_bytes": F.length("payload").cast("long")})
    keep = p.groupBy("sha", "n_bytes").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("same"))
    many = keep.where("same > 1").select(F.col("sha").alias("ksha"), F.col("n_bytes").alias("kn"), "keeper")
    # Few payloads occur more than once: only those rows look up their keeper.
    return p.join(many, (F.col("sha") == F.col("ksha")) & (F.col("n_bytes") == F.col("kn")), "left").select(
        "page_id", "url", "payload", F.col("ksha").isNotNull().alias("shared"), "keeper")


def records(pages: DataFrame, segment: int = SEGMENT_BYTES, **cols) -> DataFrame:
    """WARC records (``record``: bytes without the end mark)."""
    def build(batches):
        for batch in batches:
            out = []
            for page, url, payload, shared, keeper in zip(*(c.to_pylist() for c in batch.columns)):
                payload = payload or b""
                digest = digest32(payload)
                rid = record_id(page, url, digest)
                response = not shared or page == keeper
                common = [("WARC-Record-ID", rid), ("WARC-Date", "2024-01-01T00:00:00Z"),
                          ("WARC-Payload-Digest", f"sha1:{digest}")]
                common += [("WARC-Target-URI", _clean(url))] if url is not None else []
                common += [("X-Page-Id", str(page))] if page is not None else []
                http = ("Content-Type", "application/http;msgtype=response")
                if not response:
                    out.append(header([("WARC-Type", "revisit"), *common, ("WARC-Profile", PROFILE),
                                       ("WARC-Refers-To-Page", str(keeper)), http,
                                       ("X-Payload-Length", str(len(payload))),
                                       ("Content-Length", str(len(HEAD)))]) + HEAD)
                    continue
                block = HEAD + chunked(payload)
                if len(block) <= segment:
                    out.append(header([("WARC-Type", "response"), *common, http,
                                       ("Content-Length", str(len(block)))]) + block)
                    continue
                cuts = range(0, len(block), segment)
                for n, at in enumerate(cuts, 1):
                    part = block[at:at + segment]
                    if n == 1:
                        fields = [("WARC-Type", "response"), *common, http]
                    else:
                        own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{rid}|{n}')}>"
                        fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", own),
                                  ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Segment-Origin-ID", rid)]
                        if page is not None:
                            fields.append(("X-Page-Id", str(page)))
                    fields.append(("WARC-Segment-Number", str(n)))
                    if n == len(cuts):
                        fields.append(("WARC-Segment-Total-Length", str(len(block))))
                    out.append(header([*fields, ("Content-Length", str(len(part)))]) + part)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    return with_roles(pages, **cols).mapInArrow(build, "record binary")


def write_archives(pages: DataFrame, path: str | None = None, segment: int = SEGMENT_BYTES,
                   archive_bytes: int = ARCHIVE_BYTES, **cols) -> str:
    """Write the pages as gzipped WARC archives; returns the folder."""
    spark = pages.sparkSession
    if path is None:
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    # A record is at most one segment long, so a file of so many records is bounded.
    (records(pages, segment, **cols).select(F.col("record").cast("string").alias("value"))
     .write.option("lineSep", END.decode()).option("compression", "gzip")
     .option("maxRecordsPerFile", max(1, archive_bytes // segment)).text(path))
    return path


def unzipped(data: bytes, step: int = 1 << 16) -> bytes:
    """All members of a gzip file, one after the other (archives often hold one per
    record); a file that ends inside a member raises."""
    out, at, view = [], 0, memoryview(data)
    while at < len(data):
        member = zlib.decompressobj(31)
        while not member.eof:
            if at >= len(data):
                raise ValueError("archive ends inside a member")
            out.append(member.decompress(view[at:at + step]))
            at += min(step, len(data) - at)
        at -= len(member.unused_data)
    return b"".join(out)


def parse(data: bytes):
    """(fields, block) of every record of one archive."""
    at = 0
    while at < len(data):
        stop = data.index(END, at)
        lines = data[at:stop].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        n = int(fields["Content-Length"])
        at = stop + 4 + n
        yield fields, data[stop + 4:at]
        if data[at:at + 4] != END:
            raise ValueError("record length does not match")
        at += 4


PART = ("origin string, number int, total long, type string, page_id long, digest string, "
        "refers_to long, payload_bytes long, block binary")
PART_NAMES = [f.split(" ")[0] for f in PART.split(", ")]


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives; whole records have number 0."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")

    def split(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                data = unzipped(batch.column(0)[i].as_buffer().to_pybytes())
                held, size = [], 0
                for f, block in parse(data):
                    number = int(f.get("WARC-Segment-Number", 0))
                    page, refers = f.get("X-Page-Id"), f.get("WARC-Refers-To-Page")
                    total, length = f.get("WARC-Segment-Total-Length"), f.get("X-Payload-Length")
                    held.append((f.get("WARC-Segment-Origin-ID", f["WARC-Record-ID"]), number,
                                 int(total) if total else None, f["WARC-Type"], int(page) if page else None,
                                 f.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None,
                                 int(refers) if refers else None, int(length) if length else None, block))
                    size += len(block)
                    if size > 4 << 20:
                        yield _part_batch(held)
                        held, size = [], 0
                if held:
                    yield _part_batch(held)

    return files.mapInArrow(split, PART)


def _part_batch(held: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    types = [kinds[f.split(" ")[1]] for f in PART.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], PART_NAMES)


def reassemble(parts: DataFrame) -> DataFrame:
    """Whole records of all parts: segmented ones are grouped by origin and put
    in order; a record with a gap, no last segment or another total length
    raises.  A repeated page gives equal segments under one origin, ``copies``."""
    whole = parts.where("number = 0").select("type", "page_id", "digest", "refers_to", "payload_bytes", "block",
                                             F.lit(1).alias("copies"))
    # Equal segments of repeated pages are folded before the record is gathered.
    one = (parts.where("number > 0").groupBy("origin", "number")
           .agg(*[F.max(c).alias(c) for c in ("total", "digest")], F.max("page_id").alias("page_id"),
                F.count(F.lit(1)).alias("copies"), F.first("block").alias("block")))
    many = one.groupBy("origin").agg(
        F.lit("response").alias("type"), F.max("page_id").alias("page_id"), F.max("digest").alias("digest"),
        F.max("total").alias("total"), F.max("copies").cast("int").alias("copies"),
        F.sort_array(F.collect_list(F.struct("number", "block"))).alias("segments"))

    def join(batches):
        for batch in batches:
            blocks = []
            segments, totals = batch.column("segments"), batch.column("total").to_pylist()
            for i in range(batch.num_rows):
                got = segments[i].as_py()
                block = b"".join(s["block"] for s in got)
                if [s["number"] for s in got] != list(range(1, len(got) + 1)) or len(block) != totals[i]:
                    raise ValueError("segmented record is not complete")
                blocks.append(block)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column("type"), batch.column("page_id"), batch.column("digest"),
                 pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(blocks, pa.binary()),
                 batch.column("copies")],
                ["type", "page_id", "digest", "refers_to", "payload_bytes", "block", "copies"])

    joined = many.mapInArrow(join, "type string, page_id long, digest string, refers_to long, "
                                   "payload_bytes long, block binary, copies int")
    return whole.unionByName(joined)


def payloads(whole: DataFrame, with_payload: bool = False) -> DataFrame:
    """Decoded records: page_id, payload_bytes, payload_digest, record_type,
    refers_to, and the payload of responses if asked for.  The digest of every
    response is recomputed and must equal its header."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, copies int"
    names = [f.split(" ")[0] for f in schema.split(", ")]
    if with_payload:
        schema, names = schema + ", payload binary", [*names, "payload"]

    def decode(batches):
        for batch in batches:
            rows_ = []
            for r in batch.to_pylist():
                payload, n = None, r["payload_bytes"]
                if r["type"] == "response":
                    head = r["block"].index(END) + 4
                    payload = unchunked(r["block"][head:])
                    n = len(payload)
                    if digest32(payload) != r["digest"]:
                        raise ValueError("payload digest does not match")
                rows_.append((r["page_id"], n, r["digest"], r["type"], r["refers_to"], r["copies"], payload))
            cols = list(zip(*rows_)) or [()] * 7
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)][:len(names)], names)

    out = whole.mapInArrow(decode, schema)
    return out.withColumn("_i", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).drop("_i", "copies")


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Archives to pages (see ``payloads``)."""
    return payloads(reassemble(read_parts(spark, path)), with_payload)
