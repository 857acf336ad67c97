"""WARC archives: writing with duplicates as revisits and long records in segments, and reading back.

Archives are files of records. A record whose block is longer than a segment becomes a first record
and continuation records, which may lie in other archives; the last one states the total length.
HTTP bodies are sent in chunks. Reading groups continuations by their origin's identifier, orders
them by segment number, verifies the total length and takes the chunks' framing off.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import identified, stage
from millrace.storage import shared_path

END = b"\r\n\r\n"
CHUNK = 8192
PARSED = "record_id string, page_id long, url string, type string, segment int, segmented boolean, origin string, total long, refers string, digest string, block binary"
DATE = "2024-01-01T00:00:00Z"  # archives are a function of their rows


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    """body in chunked transfer framing."""
    return b"".join(b"%x\r\n%b\r\n" % (len(part := body[a : a + size]), part) for a in range(0, len(body), size)) + b"0\r\n\r\n"


def dechunked(data: bytes) -> bytes:
    """The body of data in chunked transfer framing, extensions and trailers ignored; ValueError if it is damaged."""
    out, at = [], 0
    while True:
        line = data.find(b"\r\n", at)
        if line < 0 or not (m := re.fullmatch(rb"\s*([0-9A-Fa-f]+)\s*(;.*)?", data[at:line])):
            raise ValueError("chunked framing: no size")
        size = int(m[1], 16)
        if not size:
            return b"".join(out)
        if data[line + 2 + size : line + 4 + size] != b"\r\n":
            raise ValueError("chunked framing: a chunk isn't whole")
        out.append(data[line + 2 : line + 2 + size])
        at = line + 4 + size


def record(kind: str, record_id: str, block: bytes, **fields: object) -> bytes:
    """A WARC record without the two line ends that follow it; a field's name has _ for -, None leaves it out."""
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": DATE}
    head |= {k.replace("_", "-"): v for k, v in fields.items() if v is not None} | {"Content-Length": len(block)}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of an archive; ValueError if it is damaged."""
    at = 0
    while at < len(data):
        stop = data.find(END, at)
        if stop < 0 or not data.startswith(b"WARC/", at):
            raise ValueError("not a WARC record")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data[at:stop].decode().split("\r\n")[1:])}
        size = int(head["content-length"])
        at = stop + 4 + size
        if data[at : at + 4] != END:
            raise ValueError("a record isn't followed by two line ends")
        yield head, data[stop + 4 : at]
        at += 4


def with_digests(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Adds uid, payload_bytes, payload_digest and, for rows that revisit another, refers_uid and refers_to.

    Of rows with equal payloads of at least `least` bytes, that with the largest page_id (of equal
    ids, the largest url, then the last row; nulls count as least) is the response. Only digests that occur more than once are joined back;
    they are a written table, so the planner broadcasts them only if it sees that they are small.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    url = F.col("url") if "url" in pages.columns else F.lit(None).cast("string").alias("url")
    plain = pages.select("page_id", url, body.alias("html"))
    rows = identified(plain.select("*", F.octet_length("html").cast("long").alias("payload_bytes"), F.sha1("html").alias("payload_digest")))
    last = F.max(F.struct("page_id", "url", "uid")).alias("last")
    again = rows.where(F.col("payload_bytes") >= least).groupBy(F.col("payload_digest").alias("d")).agg(last, F.count("*").alias("n")).where("n > 1")
    again = stage(again.select("d", F.col("last.page_id").alias("to"), F.col("last.uid").alias("to_uid")), "copies")
    joined = rows.join(again, F.col("payload_digest") == F.col("d"), "left")
    other = F.col("to_uid") != F.col("uid")
    return joined.select("page_id", "url", "html", "uid", "payload_bytes", "payload_digest", F.when(other, F.col("to")).alias("refers_to"), F.when(other, F.col("to_uid")).alias("refers_uid"))


def write_archives(pages: DataFrame, path: str, segment: int = 32768, per_file: int = 2048, least: int = 1000) -> None:
    """Writes a record for every row of pages (page_id, url, html) into gzipped archives of at most per_file records in path.

    A null html is an empty payload; a null url or page_id, or a missing column url, leaves its field out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                out: list[bytes] = []
                for r in batch.slice(a, 512).to_pylist():
                    me = f"urn:millrace:{r['uid']}"
                    common = {"WARC_Target_URI": None if r["url"] is None else re.sub(r"[\r\n]", " ", r["url"]), "X_Page_ID": r["page_id"], "WARC_Payload_Digest": f"sha1:{r['payload_digest']}"}
                    if r["refers_uid"] is not None:
                        to = f"<urn:millrace:{r['refers_uid']}>"
                        out.append(record("revisit", me, b"HTTP/1.1 200 OK\r\n\r\n", **common, WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", WARC_Refers_To=to))
                        continue
                    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(r["html"])
                    parts = [block[x : x + segment] for x in range(0, len(block), segment)]
                    if len(parts) == 1:
                        out.append(record("response", me, block, **common))
                        continue
                    out.append(record("response", me, parts[0], **common, WARC_Segment_Number=1))
                    for k, part in enumerate(parts[1:], 2):
                        total = len(block) if k == len(parts) else None
                        out.append(record("continuation", f"{me}:{k}", part, WARC_Segment_Number=k, WARC_Segment_Origin_ID=f"<{me}>", WARC_Segment_Total_Length=total))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    rows = with_digests(pages, least).mapInArrow(run, "value binary")
    # The writer puts a row's bytes out as they are, then the line end: here, what ends a record.
    rows.select(F.col("value").cast("string")).write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives in path, as PARSED; a damaged archive raises ValueError."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = lambda x: x and x.strip("<>")
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        number = lambda x: None if x is None else int(x)
        for batch in batches:
            for data in batch["content"]:
                data = data.as_py()
                while data[:2] == b"\x1f\x8b":  # gzip members
                    member = zlib.decompressobj(31)
                    plain_data = member.decompress(data)
                    rest = member.unused_data
                    out = [
                        (plain(h["warc-record-id"]), number(h.get("x-page-id")), h.get("warc-target-uri"), h["warc-type"], number(h.get("warc-segment-number")) or 1, "warc-segment-number" in h, plain(h.get("warc-segment-origin-id")), number(h.get("warc-segment-total-length")), plain(h.get("warc-refers-to")), (h.get("warc-payload-digest") or "").removeprefix("sha1:") or None, block)
                        for h, block in records(plain_data)
                    ]
                    for a in range(0, len(out), 512):
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[a : a + 512], strict=True), kinds, strict=True)], PARSED.replace(",", "").split()[::2])
                    data = rest

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, PARSED)


def payloads(parsed: DataFrame) -> DataFrame:
    """One row per record that isn't a continuation: page_id, url, type, record_id, refers, digest, payload (null for revisits).

    Only records in segments are shuffled, by their origin; a group is one record. ValueError if
    segments are missing or the total length is wrong.
    """
    names = ["page_id", "url", "type", "record_id", "refers", "digest"]
    first = F.struct(*names)
    own = F.coalesce("origin", "record_id").alias("own")
    in_segments = F.col("origin").isNotNull() | F.col("segmented")
    parts = parsed.where(in_segments).groupBy(own).agg(F.max(F.when(F.col("segment") == 1, first)).alias("first"), F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"), F.max("total").alias("length"))
    joined = parts.select("first.*", F.lit(None).cast("binary").alias("block"), "parts", "length").unionByName(parsed.where(~in_segments).select(*names, "block"), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes | None] = []
            for kind, block, parts, length, me in zip(*(batch[c].to_pylist() for c in ("type", "block", "parts", "length", "record_id")), strict=True):
                if parts is not None:
                    if [x["segment"] for x in parts] != list(range(1, len(parts) + 1)):
                        raise ValueError(f"{me}: segments are missing")
                    block = b"".join(x["block"] for x in parts)
                    if len(block) != length:
                        raise ValueError(f"{me}: {len(block)} bytes, {length} stated")
                head, _, body = block.partition(END)
                out.append(None if kind == "revisit" else dechunked(body) if b"\r\ntransfer-encoding: chunked" in head.lower() else body)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(out, pa.binary())], [*names, "payload"])

    return joined.mapInArrow(run, "page_id long, url string, type string, record_id string, refers string, digest string, payload binary")


def archive_digests(pages: DataFrame, segment: int = 32768, per_file: int = 2048, least: int = 1000) -> DataFrame:
    """Writes pages to archives, reads them back and returns page_id, payload_bytes, payload_digest, record_type and refers_to for each page.

    A response's length and digest are those of its payload as read back, and must equal the digest
    stated in its record; a revisit's length is that of the response it refers to.
    """
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_archives(pages, path, segment, per_file, least)
    found = payloads(read_records(spark, path))
    sha1 = F.sha1("payload")
    digest = F.when(F.col("payload").isNull(), F.col("digest")).when(sha1 == F.col("digest"), sha1).otherwise(F.raise_error(F.concat("record_id", F.lit(": the payload doesn't match its digest"))))
    narrow = stage(found.select("page_id", "record_id", "type", "refers", digest.alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes")), "read-back")
    responses = narrow.where("type = 'response'").select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    to = narrow.where("type = 'response'").select(F.col("record_id").alias("to"), F.col("page_id").alias("refers_to"), "payload_bytes")
    # A revisit is a row of the result even where nothing answers to it, and then the job fails.
    found = narrow.where("type = 'revisit'").drop("payload_bytes").join(to, F.col("refers") == F.col("to"), "left")
    size = F.when(F.col("to").isNotNull(), F.col("payload_bytes")).otherwise(F.raise_error(F.concat("record_id", F.lit(": revisits a record that isn't there"))))
    revisits = found.select("page_id", size.cast("long").alias("payload_bytes"), "payload_digest", F.lit("revisit").alias("record_type"), "refers_to")
    return responses.unionByName(revisits)

