"""Operator 3, WARC: archives written and read by Spark tasks.

Writer: each record is a gzip member of its own. Spark's text writer puts the members into files, so the output committer
handles retries and lost executors on any Hadoop file system; the line separator that this writer insists on is an empty
gzip member, which every WARC reader skips.
Reader, splittable: a task gets a byte range of a file, scans it for the gzip magic, validates a candidate by inflating
its start and decoding the WARC header, and owns the records that start inside its range, reading past its end for the last.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from base64 import b32encode
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import KeyFilter, fresh_path, materialize, table

MAGIC = b"\x1f\x8b\x08"
#: An empty gzip member; stands between records in the files.
EMPTY_MEMBER = bytes.fromhex("1f8b0800000000000003" "0300" "00000000" "00000000")
#: Payloads shorter than this are never made revisits.
LEAST_REVISIT = 1000
DATE = "2024-01-01T00:00:00Z"
READ_SCHEMA = "file string, start long, record_id string, record_type string, target_uri string, page_id long, refers_to long, declared_digest string, payload binary"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: bytes | None = None, length: int | None = None) -> bytes:
    """One WARC/1.1 record. A revisit has no payload, only its digest (SHA-1), its length and the page it refers to."""
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:none")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % (len(payload) if length is None else length)
    block = http + (b"" if kind == "revisit" else payload)
    name = "none" if page_id is None else page_id
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{name}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{b32encode(digest or hashlib.sha1(payload).digest()).decode()}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def plan_records(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Per payload of `least` bytes or more that occurs in several rows: payload's digest and length, and the largest page_id, which keeps it."""
    light = pages.select("page_id", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("sha"), F.octet_length(F.coalesce("html", F.lit(""))).alias("len_"))
    return light.where(F.col("len_") >= least).groupBy("sha", "len_").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1 and keeper is not null").drop("n")


def write_warc(pages: DataFrame, path: str, least: int = LEAST_REVISIT) -> None:
    """A record per row of `pages` (page_id, url, html). Equal payloads of `least` bytes or more: rows of the largest
    page_id are response (all of them, if that id repeats; all rows, if no row has an id), the others revisit it. A null
    html is an empty payload; a null url is urn:none; an empty table writes archives without records. Other columns are ignored."""
    html = F.coalesce("html", F.lit(""))
    keyed = pages.select("page_id", "url", html.cast("binary").alias("payload"), F.sha1(html.cast("binary")).alias("sha_p"), F.octet_length(html).alias("len_p"))
    groups = materialize(plan_records(pages, least), "warc-groups")
    repeated = KeyFilter(groups.select("sha"))
    marked = repeated.mark(keyed, "maybe", "sha_p")
    nothing = [F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("int").alias("length")]
    alone = marked.where(~F.col("maybe")).select("page_id", "url", "payload", *nothing)
    # of rows whose payload may repeat only the digest goes to the join, a million copies of a page without their payloads
    joined = marked.where("maybe").drop("payload", "maybe").join(groups, (F.col("sha_p") == F.col("sha")) & (F.col("len_p") == F.col("len_")), "left")
    revisit = ~F.col("page_id").eqNullSafe(F.col("keeper")) & F.col("keeper").isNotNull()
    revisits = joined.where(revisit).select("page_id", "url", F.lit(b"").alias("payload"), F.col("keeper").alias("refers_to"), F.unhex("sha_p").alias("digest"), F.col("len_p").alias("length"))
    # the others' payloads: one row of each group, and rows that the filter lets through by chance
    kept = materialize(joined.where(~revisit).select(F.col("sha_p").alias("sha"), F.col("page_id").alias("id_")).distinct(), "warc-kept")
    whole = KeyFilter(kept).may_hold(marked.where("maybe"), "sha_p", "page_id")
    whole = whole.join(kept, (F.col("sha_p") == F.col("sha")) & F.col("page_id").eqNullSafe(F.col("id_")), "left_semi").select("page_id", "url", "payload", *nothing)
    records = alone.unionByName(whole).unionByName(revisits)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, held = [], 0
            for page_id, url, payload, refers_to, digest, length in zip(*(b.column(n).to_pylist() for n in ("page_id", "url", "payload", "refers_to", "digest", "length"))):
                kind = "response" if refers_to is None else "revisit"
                out.append(gzip_member(record(kind, page_id, url, payload, refers_to, digest, length)))
                held += len(out[-1])
                if held > 8 << 20:
                    yield pa.record_batch([pa.array(out, pa.binary())], ["value"])
                    out, held = [], 0
            yield pa.record_batch([pa.array(out, pa.binary())], ["value"])

    records.mapInArrow(pack, "value binary").select(F.col("value").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(path)


def open_file(path: str):
    """A random-access file of any store that Arrow reaches (local, HDFS, S3, GCS)."""
    uri = re.sub(r"^file:/*", "file:///", re.sub(r"^s3[an]:", "s3:", path))
    store, inner = fs.FileSystem.from_uri(uri)
    return store.open_input_file(inner)


class Window:
    """A file's bytes from `at` on, read as they are needed."""

    def __init__(self, file, at: int, size: int):
        self.file, self.base, self.size, self.buf = file, at, size, bytearray()
        self.file.seek(at)

    def need(self, upto: int) -> None:
        upto = min(upto, self.size)
        while self.base + len(self.buf) < upto:
            got = self.file.read(max(1 << 16, upto - self.base - len(self.buf)))
            if not got:
                break
            self.buf += got

    def drop(self, before: int) -> None:
        if before - self.base > 8 << 20:
            del self.buf[: before - self.base]
            self.base = before

    def find(self, at: int, end: int) -> int:
        self.need(end + len(MAGIC) - 1)
        found = self.buf.find(MAGIC, at - self.base, end + len(MAGIC) - 1 - self.base)
        return -1 if found < 0 else found + self.base

    def inflate(self, at: int) -> tuple[bytes, int] | None:
        """The member that starts at `at` and where it ends; None if no WARC record or empty member starts there."""
        z, out, pos, head = zlib.decompressobj(31), [], at, b""
        try:
            while not z.eof:
                self.need(pos + (1 << 14))
                chunk = bytes(self.buf[pos - self.base : pos - self.base + (1 << 14)])
                if not chunk:
                    return None
                out.append(z.decompress(chunk))
                pos += len(chunk) - len(z.unused_data)
                if len(head) < 7 and (out[-1] or z.eof):
                    head = (head + out[-1])[:7]
                    if not b"WARC/1.".startswith(head):
                        return None
        except zlib.error:
            return None
        return b"".join(out), pos


def parse(data: bytes) -> dict | None:
    """A record's named fields and payload; None if the header isn't one."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    if not sep or not lines[0].startswith("WARC/1.") or not fields.get("content-length", "").isdigit():
        return None
    block = rest[: int(fields["content-length"])]
    if fields.get("content-type", "").startswith("application/http"):
        block = block.partition(b"\r\n\r\n")[2]
    page = lambda x: int(m[1]) if (m := re.fullmatch(r"<urn:x-page:(-?\d+)>", x or "")) else None
    return {
        "record_id": fields.get("warc-record-id"), "record_type": fields.get("warc-type"), "target_uri": fields.get("warc-target-uri"), "page_id": page(fields.get("warc-record-id")),
        "refers_to": page(fields.get("warc-refers-to")), "declared_digest": fields.get("warc-payload-digest"), "payload": block,
    }


def read_range(path: str, start: int, end: int, size: int) -> Iterator[dict]:
    """The records that start in [start, end) of a file."""
    with open_file(path) as file:
        w, at = Window(file, start, size), start
        while at < end and (at := w.find(at, end)) >= 0:
            w.drop(at)
            found = w.inflate(at)
            if found is None:
                at += 1
                continue
            data, stop = found
            if data and (fields := parse(data)):
                yield {"file": path, "start": at} | fields
            at = stop


def read_warc(spark: SparkSession, path: str, split_bytes: int = 16 << 20) -> DataFrame:
    """The records of all gzip WARC files under `path`, read in byte ranges of `split_bytes`."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))).alias("at"))
    n = ranges.count()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
        for pdf in batches:
            for path_, length, at in zip(pdf["path"], pdf["length"], pdf["at"]):
                out, held = [], 0
                for r in read_range(path_, int(at), min(int(at) + split_bytes, int(length)), int(length)):
                    out.append(r)
                    held += len(r["payload"])
                    if held > 4 << 20:
                        yield frame(out, names)
                        out, held = [], 0
                if out:
                    yield frame(out, names)

    return ranges.repartition(max(1, n), "path", "at").mapInPandas(scan, READ_SCHEMA)


def frame(records: list[dict], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(records, columns=names)
    for c in ("page_id", "refers_to"):
        out[c] = out[c].astype("Int64")
    return out


def figures(records: DataFrame) -> DataFrame:
    return records.select("page_id", "record_type", "refers_to", F.length("payload").cast("long").alias("bytes_"), F.sha1("payload").alias("sha_"))


def resolve(light: DataFrame) -> DataFrame:
    """From figures(): page_id, payload_bytes, payload_digest, record_type, refers_to; revisits take the payload's figures from the response they refer to."""
    response = light.where("record_type = 'response'")
    revisit = light.where("record_type = 'revisit'")
    asked = revisit.select(F.col("refers_to").alias("to_")).distinct()
    target = response.join(asked, F.col("page_id") == F.col("to_"), "left_semi").groupBy(F.col("page_id").alias("to_")).agg(F.max("bytes_").alias("b_"), F.max("sha_").alias("s_"))
    solved = revisit.join(target, F.col("refers_to") == F.col("to_"), "left").select("page_id", F.col("b_").alias("payload_bytes"), F.col("s_").alias("payload_digest"), "record_type", "refers_to")
    return response.select("page_id", F.col("bytes_").alias("payload_bytes"), F.col("sha_").alias("payload_digest"), "record_type", "refers_to").unionByName(solved)


def op3_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return resolve(materialize(figures(read_warc(spark, path)), "warc-figures"))


OP3_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS d, max(page_id) OVER (PARTITION BY b) AS keeper FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
FROM q
"""
