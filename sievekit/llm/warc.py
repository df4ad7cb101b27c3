"""WARC archives: writing page tables, and reading archives by boundary-chain verification.

Reading: each task takes a byte range of a file, finds every place where the record magic stands, and emits
candidate record -> successor offsets (header end + Content-Length + 4). Within a range, chains are followed
backwards at once, so that a candidate points at the first offset that its chain reaches beyond the range.
Pointer jumping over these few offsets, from offset 0 of each file and however few ranges it has, then keeps only reachable ones: a magic
inside a payload starts no chain that the file start reaches, unless a real record is there. Tasks walk the
reachable chain of their range and emit its records.

A null payload is written as an empty one. A page_id that is null is kept as null; it counts as smaller than
any other. Rows that repeat a page_id and its payload are written each, of the same type. An archive whose
chain breaks (cut off, or a wrong length) raises an error that names the file and the offset. Empty tables
give empty archives and no records. Other columns of the input are not read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievekit.llm.common import open_uri, scratch, staged

MAGIC = b"WARC/1.1\r\n"
CRLF = "\r\n"
URN = "urn:sievekit:page:"
#: A record of each group of equal payloads is broadcast up to so many groups (under 100 bytes each); more are joined by a shuffle.
BROADCAST_GROUPS = 100_000
MIN_REVISIT_BYTES = 1000
#: Bytes of a range, and ranges that a task reads one after the other.
BLOCK_BYTES, TASK_RANGES = 4 << 20, 8
DEAD = -1


def payload_of(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def equal_payloads(pages: DataFrame, page_id: str, payload: str, least_bytes: int) -> DataFrame:
    """digest, bytes, keeper (the largest page_id) of payloads of at least least_bytes that several rows have. Only digests are shuffled, pre-aggregated."""
    body = payload_of(F.col(f"`{payload}`"))
    found = pages.select(F.col(f"`{page_id}`").alias("keeper"), F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).cast("long").alias("bytes"))
    return found.where(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(F.max("keeper").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n")


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = MIN_REVISIT_BYTES) -> None:
    """One uncompressed WARC file per partition of pages, through Spark's commit protocol."""
    groups = staged(equal_payloads(pages, page_id, payload, least_bytes))
    if groups.count() <= BROADCAST_GROUPS:
        groups = F.broadcast(groups)
    page, body = F.col("page"), F.col("body")
    rows = pages.select(F.col(f"`{page_id}`").alias("page"), F.col(f"`{url}`").cast("string").alias("target"), payload_of(F.col(f"`{payload}`")).alias("body"))
    rows = rows.withColumns({"digest": F.sha1(body.cast("binary")), "bytes": F.octet_length(body).cast("long")})
    rows = rows.join(groups, ["digest", "bytes"], "left")
    named = F.coalesce(F.concat(F.lit("="), F.url_encode(page.cast("string"))), F.lit("null"))
    revisit = F.col("keeper").isNotNull() & (page.isNull() | (page != F.col("keeper")))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    block = F.when(revisit, http).otherwise(F.concat(http, body))
    target = F.regexp_replace(F.coalesce(F.col("target"), F.lit("about:blank")), r"\s", "%20")
    head = F.concat_ws(
        CRLF, F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit(f"WARC-Record-ID: <{URN}"), named, F.lit(">")), F.lit("WARC-Date: 2024-01-01T00:00:00Z"), F.concat(F.lit("WARC-Target-URI: "), target),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}WARC-Refers-To: <{URN}="), F.url_encode(F.col("keeper").cast("string")), F.lit(">"))),
        F.lit("Content-Type: application/http; msgtype=response"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    rows.select(F.concat(head, F.lit(CRLF * 2), block).alias("value")).write.option("lineSep", CRLF * 2).text(path)


class _Source:
    """A file read through one window that moves forward."""

    def __init__(self, uri: str, length: int):
        self.file, self.length, self.at, self.data = open_uri(uri), length, 0, b""

    def load(self, start: int, end: int) -> None:
        self.file.seek(start)
        self.at, self.data = start, self.file.read(min(end, self.length) - start)

    def bytes(self, start: int, end: int) -> bytes:
        end = min(end, self.length)
        if start < self.at or end > self.at + len(self.data):
            self.load(start, max(end, start + (1 << 16)))
        return self.data[start - self.at : end - self.at]

    def header(self, start: int) -> bytes | None:
        """The header of a record that starts there, with its empty line; None if there is none."""
        size = 1 << 11
        while True:
            piece = self.bytes(start, start + size)
            if not piece.startswith(MAGIC):
                return None
            if (stop := piece.find(b"\r\n\r\n")) >= 0:
                return piece[: stop + 4]
            if len(piece) < size:
                return None
            size *= 4


def _field(header: bytes, name: bytes) -> str | None:
    found = re.search(rb"(?mi)^" + name + rb":[ \t]*([^\r\n]*)", header)
    return found[1].decode("utf-8", "replace").strip() if found else None


def _successor(header: bytes | None, start: int, length: int) -> int:
    if header is None or not (size := _field(header, b"Content-Length") or "").isdigit():
        return DEAD
    after = start + len(header) + int(size) + 4
    return after if after <= length else DEAD


def _candidates(batches):
    """Rows path, length, start, end -> path, off, exit of every magic in the range."""
    import pyarrow as pa

    for batch in batches:
        for r in batch.to_pylist():  # one range is held at a time
            source, start, end = _Source(r["path"], r["length"]), r["start"], r["end"]
            source.load(start, end + (1 << 16))
            block, found, k = source.data, [], source.data.find(MAGIC)
            while 0 <= k < end - start:
                found.append(start + k)
                k = block.find(MAGIC, k + 1)
            follow = [_successor(source.header(at), at, r["length"]) for at in found]
            out: dict[int, int] = {}
            for at, after in zip(reversed(found), reversed(follow)):
                out[at] = after if after >= end or after == DEAD else out.get(after, DEAD)
            yield pa.RecordBatch.from_arrays([pa.array([r["path"]] * len(found), pa.string()), pa.array(found, pa.int64()), pa.array([out[at] for at in found], pa.int64())], names=["path", "off", "exit"])


def _records(batches):
    """Rows path, length, off, end: the records of the chain from off that start before end."""
    import hashlib

    import pyarrow as pa

    names = ["path", "off", "record_type", "record_id", "refers_to", "payload_bytes", "payload_digest"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
    for batch in batches:
        for r in batch.to_pylist():  # one range is held at a time
            rows, source, at = [], _Source(r["path"], r["length"]), r["off"]
            source.load(at, r["end"])
            while at < r["end"]:
                header = source.header(at)
                after = _successor(header, at, r["length"])
                if after == DEAD or source.bytes(after - 4, after) != b"\r\n\r\n":
                    raise ValueError(f"damaged archive: {r['path']} has no whole record at offset {at}")
                body = source.bytes(at + len(header), after - 4)
                http = body.find(b"\r\n\r\n") + 4 if body.startswith(b"HTTP/") else 0
                kind, digest = _field(header, b"WARC-Type"), (_field(header, b"WARC-Payload-Digest") or "").removeprefix("sha1:")
                if kind == "revisit":
                    size = int(_field(body[:http], b"Content-Length") or 0)
                else:
                    size, told, digest = len(body) - http, digest, hashlib.sha1(memoryview(body)[http:]).hexdigest()
                    if told and told != digest:
                        raise ValueError(f"damaged archive: {r['path']}, offset {at}: the payload's digest is {digest}, not {told}")
                rows.append((r["path"], at, kind, _field(header, b"WARC-Record-ID"), _field(header, b"WARC-Refers-To"), size, digest))
                at = after
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], kind) for k, kind in enumerate(kinds)], names=names)


def reachable_offsets(candidates: DataFrame, files: DataFrame, rounds: int) -> DataFrame:
    """path, off that the start of a file reaches in under 2^rounds steps of path, off -> exit. Candidates that no exit names are left out before the first round."""
    entries = candidates.select("path", F.col("exit").alias("off")).where(F.col("exit") > 0).distinct()
    reached = files.select("path", F.lit(0).cast("long").alias("off"))
    jumps = staged(candidates.where("off = 0").unionByName(candidates.join(entries, ["path", "off"], "left_semi").where("off > 0")))
    for _ in range(rounds):
        further = reached.join(jumps, ["path", "off"]).select("path", F.col("exit").alias("off"))
        reached = staged(reached.unionByName(further.where(F.col("off") != DEAD)).distinct())
        beyond = jumps.select("path", F.col("off").alias("exit"), F.col("exit").alias("beyond"))
        jumps = staged(jumps.join(beyond, ["path", "exit"]).select("path", "off", F.col("beyond").alias("exit")))
    return reached


def read_archives(spark, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """path, off, record_type, record_id, refers_to, payload_bytes, payload_digest (lower-case hex SHA-1) of every record of the files in path."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    size = F.lit(block_bytes)
    longest, every = files.agg(F.max("length"), F.sum(F.ceil(F.col("length") / size))).first()
    blocks = math.ceil((longest or 0) / block_bytes)
    ranges = files.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, size.cast("long")))).withColumn("end", F.least(F.col("start") + size, F.col("length")))
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil((every or 0) / TASK_RANGES))
    candidates = staged(ranges.repartition(tasks).mapInArrow(_candidates, "path string, off long, exit long"))
    reached = reachable_offsets(candidates, files, max(1, math.ceil(math.log2(max(1, blocks)))))
    chains = reached.join(files, "path").where("off < length").withColumn("end", F.least((F.floor(F.col("off") / size) + 1) * size, F.col("length")))
    return chains.select("path", "length", "off", "end").repartition(tasks).mapInArrow(_records, "path string, off long, record_type string, record_id string, refers_to string, payload_bytes long, payload_digest string")


def roundtrip(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = MIN_REVISIT_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Writes pages as WARC archives and returns, from reading them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    path = scratch(pages.sparkSession)
    write_archives(pages, path, page_id, url, payload, least_bytes)
    kind = pages.schema[page_id].dataType
    page = lambda c: F.url_decode(F.regexp_extract(F.col(c), f"{URN}=([^>]*)>", 1))
    return read_archives(pages.sparkSession, path, block_bytes).select(
        F.when(~F.col("record_id").endswith(f"{URN}null>"), page("record_id")).cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.when(F.col("refers_to").isNotNull(), page("refers_to")).cast(kind).alias("refers_to")
    )


ORACLE = """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS payload_digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
g AS (SELECT payload_digest, max(page_id) AS keeper FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN g.keeper IS NULL OR g.keeper = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN g.keeper <> p.page_id THEN g.keeper END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND p.payload_bytes >= 1000
"""
