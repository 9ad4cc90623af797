"""WARC archives: writing records with segments and chunked framing, reading them back, and segment reassembly (operator 7).

Writing. Every page becomes an HTTP response record whose body is chunked; a payload that another page holds too is written once,
by the page with the largest id, and the others become revisit records that refer to it. Blocks longer than a segment are cut:
the first segment keeps the record's type, the rest are continuation records that name its id, their number, and (the last) the
total length. Pages whose payload surely no other page holds (a bitmap of the shared digests tells) are written where they lie; of
shared payloads one copy a digest is shuffled, folded on the map side, and the pages that hold it come without theirs.

Archives are files of one gzip member a record, as archive readers expect. Spark's own text writer writes them, so any file system
that Spark writes will do: its line separator is the zero byte that ends each member (a member ends with the four-byte length of
a record, and records are far smaller than 16 MB, since segments are).

Reading. Archives, gzipped or plain, are read whole (their size is bounded by `archive_records`), records are cut by Content-Length;
header names are of any case, lines without a colon are passed over, and bytes that are no record are put out as a record of type
`unreadable`, after which reading goes on at the next one. Continuation records are grouped by origin, ordered by segment number,
checked against the total length, joined, and their chunked framing decoded. Only records of more than one segment are shuffled.

Defined cases: a null payload counts as empty and has the digest of no bytes; a null url is left out of the record and comes back
null; pages of equal id and equal payload are each written (both response where theirs is the largest id); a null id never
becomes the response where another page holds the payload; a segment that is missing or a length that differs is reported as an
error for that record, in `problem`, and its payload is null; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitweave.llm.common import KeyFilter, materialise, shared_path

END = b"\r\n\r\n"
RECORDS = "record_id string, origin_id string, segment int, total_length long, record_type string, page_id long, url string, refers_to long, digest string, full_bytes long, block binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(body: bytes, size: int) -> bytes:
    """HTTP/1.1 chunked framing."""
    parts = []
    for k in range(0, len(body), size):
        piece = body[k : k + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(framed: bytes) -> bytes:
    """The body of a chunked message; extensions and trailers are passed over, a cut or malformed frame is an error."""
    out, at = [], 0
    while True:
        line = framed.find(b"\r\n", at)
        if line < 0:
            raise ValueError("chunk size is cut off")
        size = int(framed[at:line].split(b";")[0].strip(), 16)
        at = line + 2
        if size == 0:
            return b"".join(out)
        if len(framed) < at + size + 2 or framed[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk is cut off")
        out.append(framed[at : at + size])
        at += size + 2


def _record(kind: str, block: bytes, **headers) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k.replace('_', '-')}: {v}" for k, v in headers.items() if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def page_records(key: str, page_id: int | None, url: str | None, payload: bytes | None, sha: str, size: int, refers_to: int | None, segment_bytes: int, chunk_bytes: int) -> list[bytes]:
    """The records of one page: a revisit, or a response with its continuations."""
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url is not None else None
    raw = {"X_Page_Url": base64.b64encode(url.encode()).decode() if url is not None and uri != url else None}
    sha = base64.b32encode(bytes.fromhex(sha)).decode()
    common = {"WARC_Record_ID": f"<urn:page:{key}>", "WARC_Target_URI": uri, **raw, "X_Page_Id": page_id, "WARC_Payload_Digest": f"sha1:{sha}"}
    if refers_to is not None:
        head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Archived-Length: %d\r\n\r\n" % size
        return [_record("revisit", head, **common, WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", WARC_Refers_To=f"<urn:page-id:{refers_to}>")]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes)
    pieces = [block[k : k + segment_bytes] for k in range(0, len(block), segment_bytes)]
    if len(pieces) == 1:
        return [_record("response", block, **common)]
    out = [_record("response", pieces[0], **common, WARC_Segment_Number=1)]
    for n, piece in enumerate(pieces[1:], 2):
        total = len(block) if n == len(pieces) else None
        out.append(_record("continuation", piece, WARC_Record_ID=f"<urn:page:{key}:{n}>", WARC_Segment_Origin_ID=f"<urn:page:{key}>", WARC_Segment_Number=n, WARC_Segment_Total_Length=total))
    return out


def plan(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload (null for revisits), digest (SHA-1 in hexadecimal), size, refers_to of every page."""
    spark = pages.sparkSession
    base = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumn("digest", F.sha1("payload")).withColumn("size", F.length("payload").cast("long"))
    counted = base.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("copies"))
    shared = materialise(spark, counted.where("copies > 1").select("digest", "first_id"), "shared")
    which = KeyFilter(shared, ["digest"])
    alone = which.surely_not(base).withColumn("refers_to", F.lit(None).cast("long"))
    some = which.maybe(base)
    # one payload a digest, folded before the shuffle; the pages themselves come without it, so that a hot payload is moved once a task
    bodies = some.groupBy("digest").agg(F.first("payload").alias("payload")).join(shared, "digest", "left")
    revisit = ~F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("first_id").isNotNull()
    dealt = some.select("page_id", "url", "digest", "size").join(bodies, "digest").withColumn("refers_to", F.when(revisit, F.col("first_id")))
    columns = ["page_id", "url", "payload", "digest", "size", "refers_to"]
    return alone.select(*columns).unionByName(dealt.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload"))).select(*columns))


def member(record: bytes) -> bytes:
    """A record as a gzip member without its last byte, which is zero."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    packed = packer.compress(record) + packer.flush()
    if len(record) >= 1 << 24:
        raise ValueError("a record of 16 MB or more; take smaller segments")
    return packed[:-1]


def write(pages: DataFrame, path: str, segment_bytes: int = 8192, chunk_bytes: int = 4096, archive_records: int = 5000, least_bytes: int = 0) -> None:
    """Write a record for every page as WARC files under `path`, at most `archive_records` records a file."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(7))):
                out += [member(r + END) for r in page_records(*row, segment_bytes, chunk_bytes)]
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out = []
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    rows = plan(pages, least_bytes).select(F.monotonically_increasing_id().cast("string").alias("key"), "page_id", "url", "payload", "digest", "size", "refers_to")
    rows.mapInArrow(records, "record binary").select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", archive_records).text(path)


def _number(fields: dict, name: str) -> int | None:
    found = re.fullmatch(r"\s*(-?\d{1,18})\s*", fields.get(name, ""))
    return int(found[1]) if found else None


def parse(content: bytes) -> Iterator[dict]:
    """Records of an archive, cut by their Content-Length; bytes between them that are none come as records of type `unreadable`."""
    at, n, lost = 0, len(content), None
    none = dict.fromkeys(("record_id", "origin_id", "segment", "total_length", "page_id", "url", "refers_to", "digest", "full_bytes"))
    while at < n:
        head = content.find(b"\r\n\r\n", at) if content.startswith(b"WARC/", at) else -1
        fields = {}
        if head >= 0:
            for line in content[at:head].decode("utf-8", "replace").split("\r\n")[1:]:
                name, colon, value = line.partition(":")
                if colon:
                    fields[name.strip().lower()] = value.strip()
        size, kind = _number(fields, "content-length"), fields.get("warc-type", "").lower()
        if size is None or size < 0 or not kind or head + 4 + size > n:
            lost = at if lost is None else lost
            at = content.find(b"WARC/", at + 1)
            at = n if at < 0 else at
            continue
        if lost is not None:
            yield {**none, "record_type": "unreadable", "block": content[lost:at]}
            lost = None
        block = content[head + 4 : head + 4 + size]
        at = head + 4 + size
        if content.startswith(END, at):
            at += len(END)
        else:
            while content[at : at + 1] in (b"\r", b"\n"):
                at += 1
        url = fields.get("warc-target-uri")
        if "x-page-url" in fields:
            try:
                url = base64.b64decode(fields["x-page-url"]).decode()
            except ValueError:
                pass
        length = re.search(rb"X-Archived-Length: (\d{1,18})", block) if kind == "revisit" else None
        refers = re.fullmatch(r"<urn:page-id:(-?\d{1,18})>", fields.get("warc-refers-to", ""))
        yield {
            "record_id": fields.get("warc-record-id"), "origin_id": fields.get("warc-segment-origin-id", fields.get("warc-record-id")), "segment": _number(fields, "warc-segment-number"),
            "total_length": _number(fields, "warc-segment-total-length"), "record_type": kind, "page_id": _number(fields, "x-page-id"), "url": url, "refers_to": int(refers[1]) if refers else None,
            "digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, "full_bytes": int(length[1]) if length else None, "block": block,
        }
    if lost is not None:
        yield {**none, "record_type": "unreadable", "block": content[lost:]}


def unpacked(raw: bytes, step: int = 4096) -> bytes:
    """The content of a gzipped archive of any number of members; of one that is cut or broken, what comes before the break.

    A member is fed in slices, the first of them small: what is left of a slice behind a member's end is copied.
    """
    out, at = [], 0
    while raw.startswith(b"\x1f\x8b", at):
        opener, size = zlib.decompressobj(31), step
        try:
            while not opener.eof and at < len(raw):
                out.append(opener.decompress(raw[at : at + size]))
                at = min(len(raw), at + size) - len(opener.unused_data)
                size *= 2
        except zlib.error:
            break
    return b"".join(out)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives under `path`."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(RECORDS))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held = []
                raw = content.as_py()
                for r in parse(unpacked(raw) if raw[:2] == b"\x1f\x8b" else raw):
                    held.append(r)
                    if len(held) == 1000:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(records, RECORDS)


def reassemble(records: DataFrame) -> DataFrame:
    """One row a page, with its whole payload: segments joined in order, lengths checked, chunked framing decoded."""
    head = ["record_type", "page_id", "url", "refers_to", "digest", "full_bytes"]
    whole = records.where(F.col("segment").isNull()).select("block", F.lit(None).cast("string").alias("problem"), *head)
    parts = records.where(F.col("segment").isNotNull()).groupBy("origin_id").agg(
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("pieces"), F.max("total_length").alias("total"),
        *(F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in head),
    )
    joined = parts.withColumn("block", F.aggregate("pieces", F.lit(b""), lambda a, x: F.concat(a, x["block"])))
    problem = F.when(F.col("pieces.segment") != F.sequence(F.lit(1), F.size("pieces")), "segments are missing or repeated").when(
        ~F.length("block").cast("long").eqNullSafe(F.col("total")), "total length differs"
    )
    every = whole.unionByName(joined.withColumn("problem", problem).select("block", "problem", *head))

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ddl = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string, problem string"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                row = {"page_id": r["page_id"], "url": r["url"], "record_type": r["record_type"], "refers_to": r["refers_to"], "payload": None, "payload_bytes": r["full_bytes"], "payload_digest": r["digest"], "problem": r["problem"]}
                if r["record_type"] == "unreadable":
                    row["problem"] = "no record"
                elif r["record_type"] != "revisit" and not r["problem"]:
                    top, _, body = r["block"].partition(b"\r\n\r\n")
                    try:
                        payload = unchunked(body) if b"transfer-encoding: chunked" in top.lower() else body
                        row |= {"payload": payload, "payload_bytes": len(payload), "payload_digest": digest(payload)}
                        if r["digest"] and row["payload_digest"] != r["digest"]:
                            row["problem"] = "payload digest differs"
                    except ValueError as e:
                        row["problem"] = str(e)
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return every.select("block", "problem", *head).mapInArrow(decode, ddl)


def round_trip(spark: SparkSession, pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write every page, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to, problem."""
    path = shared_path(spark, "warc")
    write(pages, path, least_bytes=least_bytes)
    return reassemble(read_records(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")
