"""Deterministic sharded WARC writer, and a reader of its archives."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import file_system
from .common import join_groups, new_folder, stored

#: Bytes of payload in a range of ids, ranges at least, and keys of each range that its edges are taken from.
RANGE_BYTES, LEAST_RANGES, KEYS = 1 << 30, 32, 64
#: Compressed bytes after which a file is closed and the next one begun.
ROLL_BYTES = 256 << 20
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, records long, bytes long, sha256 string, first_id long, last_id long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _member(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """One record as a gzip member of its own, without a time stamp."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + f"Content-Length: {len(block)}\r\n\r\n"
    packed = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packed.compress(head.encode() + block + b"\r\n\r\n") + packed.flush()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit without the payload if ``refers_to`` names another page."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    return _member([
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE),
        ("WARC-Target-URI", target), ("Content-Type", "application/http;msgtype=response"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("WARC-Payload-Digest", f"sha1:{digest}"),
        *([] if refers_to is None else [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("Refers-To-Page-ID", refers_to)]),
        ("Page-ID", page_id), ("Payload-Length", len(payload)),
    ], block)


def _close(fs, out, temporary: str, final: str) -> None:
    out.close()
    fs.move(temporary, final)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def _writer(folder: str, roll: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        fs.create_dir(root)
        attempt = TaskContext.get().taskAttemptId()
        part, number, out, done = None, 0, None, []
        verdict: tuple | None = None

        def finish():
            nonlocal out
            if out:
                done[-1]["sha256"] = hashed.hexdigest()
                _close(fs, out, temporary, f"{root}/{done[-1]['file']}")
                out = None

        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("part", "page_id", "digest", "kind", "url", "html", "newest")), strict=True)
            for p, page_id, digest, kind, url, html, newest in rows:
                if kind == 0:
                    verdict = (page_id, digest, newest)
                    continue
                if p != part or (out and done[-1]["bytes"] >= roll):
                    finish()
                    number = number + 1 if p == part else 0
                    part = p
                if not out:
                    name = f"pages-{part:06d}-{number:04d}.warc.gz"
                    temporary = f"{root}/.{name}.{attempt}.tmp"
                    out, hashed = fs.open_output_stream(temporary), hashlib.sha256()
                    head = _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, name)), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    out.write(head)
                    hashed.update(head)
                    done.append({"file": name, "records": 0, "bytes": len(head), "first_id": page_id})
                refers_to = verdict[2] if verdict and verdict[:2] == (page_id, digest) and verdict[2] != page_id else None
                member = record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers_to)
                out.write(member)
                hashed.update(member)
                done[-1]["records"] += 1
                done[-1]["bytes"] += len(member)
                done[-1]["last_id"] = page_id
        finish()
        if done:
            yield pa.RecordBatch.from_pylist(done, _schema(MANIFEST))

    return run


Key = tuple[bool, int, str]


def edges(keys: DataFrame, parts: int, total: int) -> list[Key]:
    """The first keys of the second range and of those after it, for ranges of near equal bytes.

    ``keys``: a stored table (page_id, digest, size). The edges are quantiles of bytes over
    keys chosen by their hash, some KEYS for each range, and over all keys of half a range's
    bytes or more, however ids are spread; so they are the same in every run. A key of many
    rows may be the first of several ranges. KEYS + 2 rows for each range reach the driver.
    """
    grouped = keys.groupBy("page_id", "digest").agg(F.sum("size").alias("bytes"))
    count, share = keys.count(), 1.0
    if count > parts * KEYS:
        share = parts * KEYS / count
    large = F.col("bytes") >= total / parts / 2
    chosen = F.shiftrightunsigned(F.xxhash64("page_id", "digest"), 11) < int(share * 2**53)
    found = sorted(((r["page_id"] is not None, r["page_id"] or 0, r["digest"]), r["bytes"] * (1 if r["large"] else 1 / share)) for r in grouped.filter(large | chosen).withColumn("large", large).collect())
    out, before, whole = [], 0.0, sum(w for _, w in found)
    for key, weight in found:
        while len(out) < parts - 1 and before + weight > whole * (len(out) + 1) / parts:
            out.append(key)
        before += weight
    return out


def _spans(bounds: list[Key]) -> Column:
    """The first and the last range of a row's key; more than one for a key that is several edges."""

    @F.arrow_udf("array<int>")
    def span(page_id: pa.Array, digest: pa.Array) -> pa.Array:
        keys = [(i is not None, i or 0, d) for i, d in zip(page_id.to_pylist(), digest.to_pylist(), strict=True)]
        return pa.array([(bisect_left(bounds, k), bisect_right(bounds, k)) for k in keys], pa.list_(pa.int32()))

    return span("page_id", "digest")


def write_archives(pages: DataFrame, folder: str | None = None, roll: int = ROLL_BYTES) -> str:
    """Writes a record for every row of pages (page_id, url, html) and returns the folder.

    Of records with equal payloads the one with the largest page_id is the response, the
    others revisit it; rows that repeat that page_id and payload are all responses. Null html
    counts as empty, and a row with a null page_id is a response at the front. Rows go to
    ranges of (page_id, digest) with near equal bytes and are sorted, each range in a task of
    its own, so the files do not depend on tasks; only rows that repeat both page_id and
    payload, more than a range holds, are dealt among their ranges as they come. A file is
    written under a temporary name, moved when whole, and counts once the manifest, a table
    written last, lists it; what attempts that were lost have left is then deleted. Only the
    named columns are read, so others cannot clash; an empty table gives an empty manifest.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    html = F.coalesce(F.col("html"), F.lit(""))
    pages = pages.select("page_id", "url", "html", F.sha1(html.cast("binary")).alias("digest"))
    keys = stored(pages.select("page_id", "digest", (F.octet_length(html) + 64).cast("long").alias("size")), "payloads")
    newest = join_groups(keys.filter("page_id is not null"), "digest", [F.max("page_id").alias("newest")]).filter("group_size > 1 and page_id <> newest")
    verdicts = newest.select("page_id", "digest", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "newest").distinct()
    total = keys.agg(F.sum("size")).first()[0] or 0
    parts = max(LEAST_RANGES, total // RANGE_BYTES)
    span = _spans(edges(keys, parts, total))
    # a page's verdict travels as a row of its own, to each range of its key, and is sorted before the page, so payloads move once
    verdicts = verdicts.withColumn("span", span).withColumn("part", F.explode(F.sequence(F.col("span")[0], F.col("span")[1])))
    rows = pages.select("page_id", "digest", F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("long").alias("newest")).withColumn("span", span)
    turn = F.pmod(F.monotonically_increasing_id(), (F.col("span")[1] - F.col("span")[0] + 1).cast("long"))
    rows = rows.withColumn("part", (F.col("span")[0] + turn).cast("int"))
    rows = verdicts.drop("span").unionByName(rows.drop("span"))
    rows = rows.repartitionById(parts, "part").sortWithinPartitions("part", F.col("page_id").asc_nulls_first(), "digest", "kind", "url")
    files = rows.select("part", "page_id", "digest", "kind", "url", "html", "newest").mapInArrow(_writer(f"{folder}/data", roll), MANIFEST)
    files.write.parquet(f"{folder}/manifest")
    fs, root = file_system(f"{folder}/data")
    for f in fs.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True)):
        if f.base_name.endswith(".tmp"):
            fs.delete_file(f.path)
    return folder


def parse(member: bytes) -> dict | None:
    """Fields of a record whose digests hold; None for warcinfo."""
    head, _, rest = member.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if fields["WARC-Type"] == "warcinfo":
        return None
    payload = block.partition(b"\r\n\r\n")[2]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}" or (fields["WARC-Type"] == "response" and digest != base32_sha1(payload)):
        raise ValueError(f"digest of {fields['WARC-Record-ID']} does not hold")
    number = lambda k: int(fields[k]) if k in fields else None
    return {"page_id": number("Page-ID"), "payload_bytes": number("Payload-Length"), "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number("Refers-To-Page-ID"), "url": fields["WARC-Target-URI"]}


def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """Contents of the gzip members of a stream, one at a time."""
    unpack, held, rest = zlib.decompressobj(31), [], b""
    while data := rest or stream.read(chunk):
        held.append(unpack.decompress(data))
        rest = unpack.unused_data
        if unpack.eof:
            yield b"".join(held)
            unpack, held = zlib.decompressobj(31), []
    if any(held):
        raise ValueError("archive is cut short")


class _Hashed:
    """A stream whose bytes are hashed and counted on the way."""

    def __init__(self, stream):
        self.stream, self.sha256, self.bytes = stream, hashlib.sha256(), 0

    def read(self, n: int) -> bytes:
        data = self.stream.read(n)
        self.sha256.update(data)
        self.bytes += len(data)
        return data


def _reader(folder: str, rows: int = 2000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        for listed in (f for b in batches for f in b.to_pylist()):
            found, records = [], 0
            with fs.open_input_stream(f"{root}/{listed['file']}", compression=None) as stream:
                hashed = _Hashed(stream)
                for m in members(hashed):
                    if fields := parse(m):
                        found.append(fields)
                        records += 1
                    if len(found) >= rows:
                        yield pa.RecordBatch.from_pylist(found, _schema(RECORD))
                        found = []
            if (records, hashed.bytes, hashed.sha256.hexdigest()) != (listed["records"], listed["bytes"], listed["sha256"]):
                raise ValueError(f"{listed['file']} is not the file that the manifest lists")
            if found:
                yield pa.RecordBatch.from_pylist(found, _schema(RECORD))

    return run


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the files in a folder's manifest; the records' digests and the files' are checked on the way."""
    files = spark.read.parquet(f"{folder}/manifest")
    n = max(1, min(files.count(), 10_000))
    return files.select("file", "records", "bytes", "sha256").repartition(n).mapInArrow(_reader(f"{folder}/data"), RECORD)


def archive(pages: DataFrame, folder: str | None = None, roll: int = ROLL_BYTES) -> DataFrame:
    """Writes the archives and returns what they hold, one row per page."""
    return read_archives(pages.sparkSession, write_archives(pages, folder, roll)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB's form of ``archive``: base 32 takes five hex digits as four letters.
ORACLE = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex FROM p),
g AS (
  SELECT *, max(page_id) OVER (PARTITION BY hex) AS newest FROM h)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(hex, 1 + 5 * (k // 4)::INT, 5))::INT >> (15 - 5 * (k % 4)::INT)) & 31), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> newest THEN newest END AS refers_to
FROM g
"""
