"""Operator 7: WARC archives with an index first, read back by coalesced byte ranges.

Every task writes the records of its rows into archives of a bounded size, one gzip member per record as the standard
recommends, and returns the index (path, offset, length, url, digest) of what it wrote. The index is stored before any
read; reads touch the bytes of selected records only: their ranges are sorted per file, neighbours join into one read,
and records are cut out of it. Html moves between machines only where the digests that repeat outgrow a broadcast.

Archive names are fresh in each attempt of a task, and only finished attempts reach the index: a lost executor leaves
at most files that nothing refers to.

Cases: null html is an empty payload; payloads under 100 bytes are always responses; of equal longer payloads those
with the least page_id are responses (repeated rows: all of them), others revisit it; null page_ids revisit a known
one, and are responses where there is none; null urls leave the header out; no rows give no archives and no rows.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import limit_arrow_batches, materialize, small_batches, work_path

LEAST_PAYLOAD, FILE_BYTES, RANGE_BYTES, GAP_BYTES = 100, 64 << 20, 8 << 20, 64 << 10
LEVEL = 4  # of gzip
SEPARATOR = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
#: Fixed value: what a revisit record says of itself.
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def records(pages: DataFrame) -> DataFrame:
    """(page_id, url, digest, head, body) of every page; a record is head and body. Only repeated digests are stored."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.regexp_replace("url", "[\\x00-\\x20]", "+").alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("long").alias("payload_bytes")
    )
    several = F.count("*") > 1
    first = rows.filter(F.col("payload_bytes") >= LEAST_PAYLOAD).groupBy("digest").agg(F.min("page_id").alias("first"), several.alias("several")).filter("several").drop("several")
    # written out, so that its size is known: Spark broadcasts it below its threshold and moves no html, else it shuffles
    first = materialize(first, "first")
    known = rows.join(first, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    known = known.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("first")))
    body_bytes = F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))

    def line(name: str, value) -> "F.Column":
        return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))

    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(":"), F.col("digest"), F.lit(">"))),
        line("WARC-Profile", F.when(revisit, F.lit(REVISIT))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("X-Page-ID", F.col("page_id")),
        line("X-Payload-Length", F.col("payload_bytes")),
        line("X-Refers-To-Page", F.col("refers_to")),
        line("Content-Length", body_bytes),
        F.lit("\r\n"),
    )
    return known.select("page_id", "url", "digest", head.alias("head"), F.when(revisit, "").otherwise(F.col("html")).alias("body"))


INDEX = "path string, offset long, length long, page_id long, url string, digest string"


def write_archives(rows: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the archives and return their index (path, offset, length, page_id, url, digest), read from Parquet."""
    limit_arrow_batches(rows.sparkSession)
    folder = work_path(rows.sparkSession, "warc")

    def run(batches):
        out, path, at = None, None, 0
        try:
            for batch in (part for whole in batches for part in small_batches(whole)):
                paths, offsets, lengths = [], [], []
                for head, body in zip(batch.column("head"), batch.column("body")):
                    if out is None:
                        path, at = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                        fs, name = file_system(path)
                        fs.create_dir(name.rpartition("/")[0])
                        out = fs.open_output_stream(name, compression=None)
                    member = packed((head.as_py() + body.as_py() + SEPARATOR).encode())
                    out.write(member)
                    paths.append(path)
                    offsets.append(at)
                    lengths.append(len(member))
                    at += len(member)
                    if at >= file_bytes:
                        out.close()
                        out = None
                where = [pa.array(paths, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())]
                yield pa.RecordBatch.from_arrays(where + [batch.column(c) for c in ("page_id", "url", "digest")], ["path", "offset", "length", "page_id", "url", "digest"])
        finally:
            if out is not None:
                out.close()

    return materialize(rows.mapInArrow(run, INDEX), "index")


def packed(record: bytes) -> bytes:
    """One gzip member."""
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path that Spark has written, and the path in it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path)


def read_records(selected: DataFrame, range_bytes: int = RANGE_BYTES, gap: int = GAP_BYTES) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the selected rows of an index."""

    def cut(member: bytes) -> tuple:
        head, _, payload = zlib.decompress(member, 31).removesuffix(SEPARATOR.encode()).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        page, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page")
        if fields["WARC-Type"] == "response":
            size, digest = len(payload), hashlib.sha256(payload).hexdigest()
            if digest != fields["WARC-Payload-Digest"].removeprefix("sha256:"):
                raise ValueError(f"payload of page {page} does not have its digest")
        else:
            size, digest = int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha256:")
        return (None if page is None else int(page), size, digest, fields["WARC-Type"], None if refers is None else int(refers))

    def run(parts):
        for pdf in parts:
            for path, rows in pdf.groupby("path", sort=False):
                fs, name = file_system(path)
                lo, length = rows["offset"].tolist(), rows["length"].tolist()
                with fs.open_input_file(name) as f:
                    at, out = 0, []
                    while at < len(lo):
                        end = at + 1
                        while end < len(lo) and lo[end] - (lo[end - 1] + length[end - 1]) <= gap and lo[end] + length[end] - lo[at] <= range_bytes:
                            end += 1
                        block = f.read_at(lo[end - 1] + length[end - 1] - lo[at], lo[at])
                        out += [cut(block[a - lo[at] : a - lo[at] + n]) for a, n in zip(lo[at:end], length[at:end])]
                        at = end
                    yield pd.DataFrame(out, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]).astype({"page_id": "Int64", "refers_to": "Int64"})

    # by the bytes to be read, which the index's own size does not show
    tasks = max(selected.sparkSession.sparkContext.defaultParallelism, 1 + (selected.agg(F.sum("length")).first()[0] or 0) // FILE_BYTES)
    ranges = selected.withColumn("block", F.floor(F.col("offset") / range_bytes))
    dealt = ranges.repartition(tasks, "path", "block").sortWithinPartitions("path", "offset").select("path", "offset", "length")
    return dealt.mapInPandas(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def report(pages: DataFrame) -> DataFrame:
    """Archive all pages, then read every record back."""
    return read_records(write_archives(records(pages)))


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to FROM f
"""
