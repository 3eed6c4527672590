"""Daily files as published: headers, days, manifests, and the sinks of tables and reports."""

from __future__ import annotations

import csv
import datetime as dt
import gzip
import hashlib
import io
import uuid
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.reconcile import KEY, VALUES, apply_revisions
from .folders import SCHEMES, _at, exists, file_system, scheme, stored

#: The column that a header becomes, by how it starts or what it holds.
STARTS = {"time stamp": "time_stamp", "time zone": "time_zone", "lbmp": "lbmp"}
EQUALS = {"name": "zone", "ptid": "ptid"}
HOLDS = {"losses": "losses", "congestion": "congestion"}
KNOWN = ["time_stamp", "time_zone", "zone", "ptid", "lbmp", "losses", "congestion"]


def known_name(header: str) -> str | None:
    h = header.strip().lower()
    if h in EQUALS:
        return EQUALS[h]
    found = [new for start, new in STARTS.items() if h.startswith(start)] + [new for part, new in HOLDS.items() if part in h]
    return found[0] if found else None


def normalise_headers(rows: DataFrame) -> DataFrame:
    """Known columns under their plain names, in a fixed order; others are left out."""
    names = {new: c for c in reversed(rows.columns) if (new := known_name(c))}
    return rows.select(*[F.col(f"`{names[k]}`").alias(k) for k in KNOWN if k in names])


def day_of(name: str) -> dt.date | None:
    """The day that a CSV file's name begins with, or None for other names."""
    if not name.lower().endswith((".csv", ".csv.gz")) or not name[:8].isdigit():
        return None
    try:
        return dt.datetime.strptime(name[:8], "%Y%m%d").date()
    except ValueError:
        return None


LINES = "file string, member string, file_day date, begin long, line long, " + ", ".join(f"{c} string" for c in KNOWN)
#: Lines of a member that leave a task at a time, and bytes of a file that are read at a time.
PIECE, READ = 8192, 8 << 20


def _opened(path: str):
    """A file opened for random access by the task itself."""
    where, at = file_system(path)
    return where.open_input_file(at)


def openable(path: str) -> bool:
    return scheme(path) in SCHEMES and scheme(path) != "viewfs"


def _member_lines(name: str, raw, start: dt.date, end: dt.date) -> Iterator[pa.RecordBatch]:
    """Lines of an archive's CSV members, streamed: at no time is a member held as a whole. Each header's names are looked up once."""
    with zipfile.ZipFile(raw) as z:
        for path in sorted(z.namelist()):
            member = path.rpartition("/")[2]
            day = day_of(member)
            if day is None or not start <= day <= end:
                continue
            with z.open(path) as packed:
                plain = gzip.GzipFile(fileobj=packed) if member.lower().endswith(".gz") else packed
                yield from _file_lines(name, member, day, plain)


def _file_lines(name: str, member: str, day: dt.date, raw) -> Iterator[pa.RecordBatch]:
    lines = (x for x in csv.reader(io.TextIOWrapper(raw, "utf-8-sig", newline="")) if x)
    at = positions(next(lines, []))
    done = 0
    while rows := list(islice(lines, PIECE)):
        n = len(rows)
        columns = [pa.array([(x[at[c]] or None) if c in at and at[c] < len(x) else None for x in rows], pa.string()) for c in KNOWN]
        yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array([member] * n), pa.array([day] * n, pa.date32()), pa.array([0] * n, pa.int64()), pa.array(range(done, done + n), pa.int64()), *columns], ["file", "member", "file_day", "begin", "line", *KNOWN])
        done += n


def positions(header: list[str]) -> dict[str, int]:
    """Where each known column stands in a header; the first of several headers that mean the same counts."""
    found: dict[str, int] = {}
    for k, h in enumerate(header):
        if (new := known_name(h)) and new not in found:
            found[new] = k
    return found


def daily_lines(raw: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Lines of raw files (path, and content where they are at hand) whose own names, or whose archive members', begin with a day from start to end.

    Every file's header is read by itself; columns are the known ones, as text. Other files
    are left out; empty fields are null. Without content, tasks open the files themselves.
    """
    held = "content" in raw.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            contents = b.column("content") if held else [None] * b.num_rows
            for path, content in zip(b.column("path").to_pylist(), contents, strict=True):
                name = path.rpartition("/")[2]
                with pa.BufferReader(content.as_buffer()) if held else _opened(path) as raw:
                    if name.lower().endswith(".zip"):
                        yield from _member_lines(name, raw, start, end)
                    elif (day := day_of(name)) is not None and start <= day <= end:
                        yield from _file_lines(name, name, day, gzip.GzipFile(fileobj=raw) if name.lower().endswith(".gz") else raw)

    return raw.select("path", *["content"] * held).mapInArrow(run, LINES)


def in_order(lines: DataFrame) -> DataFrame:
    """``seq``, the publication order: by file, member, where a part of the file begins, and line. There is a row for each part to number them."""
    part = ["file", "member", "begin"]
    places = lines.select(*part).distinct().withColumn("place", F.row_number().over(Window.orderBy(*part)).cast("long"))
    return lines.join(places, part).withColumn("seq", F.shiftleft("place", 32) + F.col("line")).drop("place")


def plain_columns(lines: DataFrame) -> DataFrame:
    return lines.select("file_day", "seq", *KNOWN)


def headers(spark: SparkSession, paths: list[str]) -> dict[str, tuple[str, ...]]:
    """The header of each plain or gzipped file: one small read per file, by Hadoop's own file systems, some at a time."""
    java = spark._jvm.java

    def header(path: str) -> tuple[str, ...]:
        where, fs = _at(spark, path)
        raw = fs.open(where)
        try:
            line = java.io.BufferedReader(java.io.InputStreamReader(java.util.zip.GZIPInputStream(raw) if path.lower().endswith(".gz") else raw, "UTF-8")).readLine()
        finally:
            raw.close()
        return tuple(next(csv.reader([(line or "").lstrip("\ufeff")]), []))

    with ThreadPoolExecutor(16) as pool:
        return dict(zip(paths, pool.map(header, paths), strict=True))


def _scanned(spark: SparkSession, header: tuple[str, ...], paths: list[str]) -> DataFrame:
    """Lines of files with the same header by Spark's own CSV scan, which splits large plain files; parts are told apart by where they begin."""
    at, names = positions(list(header)), [f"c{k}" for k in range(len(header))]
    rows = spark.read.schema(", ".join(f"{n} string" for n in names)).option("header", True).csv(paths)
    file = F.col("_metadata.file_name")
    columns = [F.nullif(F.col(names[at[c]]), F.lit("")).alias(c) if c in at else F.lit(None).cast("string").alias(c) for c in KNOWN]
    line = F.monotonically_increasing_id().bitwiseAND((1 << 32) - 1)
    return rows.select(file.alias("file"), file.alias("member"), F.to_date(F.substring(file, 1, 8), "yyyyMMdd").alias("file_day"), F.col("_metadata.file_block_start").alias("begin"), line.alias("line"), *columns)


def raw_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(paths)


def read_daily_files(spark: SparkSession, paths: list[str], start: str, end: str) -> DataFrame:
    """All daily CSV files of a kind, plain, gzipped or in zip archives, as one table: file_day, seq, known columns as text.

    Files are listed and their headers read first; those with the same header are one scan of
    Spark's, archives are streamed member by member. A quoted line end within a field is for
    archives only.
    """
    first, last = dt.date.fromisoformat(start), dt.date.fromisoformat(end)
    listed = sorted(r["path"] for r in raw_files(spark, paths).select("path").collect())
    plain = [p for p in listed if (day := day_of(p.rpartition("/")[2])) is not None and first <= day <= last]
    groups: dict[tuple[str, ...], list[str]] = {}
    for path, header in headers(spark, plain).items():
        if header:
            groups.setdefault(header, []).append(path)
    parts = [_scanned(spark, header, some) for header, some in groups.items()]
    archives = [p for p in listed if p.lower().endswith(".zip")]
    if archives:
        own = [p for p in archives if openable(p)]
        if own:
            parts.append(daily_lines(spark.createDataFrame([(p,) for p in own], "path string").repartition(len(own), "path"), first, last))
        if other := [p for p in archives if not openable(p)]:
            parts.append(daily_lines(raw_files(spark, other), first, last))
    out = parts[0] if parts else spark.createDataFrame([], LINES)
    for more in parts[1:]:
        out = out.unionByName(more)
    return plain_columns(in_order(out))


def read_table(spark: SparkSession, path: str, schema: str, required: bool = True) -> DataFrame:
    """A CSV table with a header; if it is absent, an error, or an empty table where it is optional."""
    if exists(spark, path):
        return spark.read.schema(schema).option("header", True).csv(path)
    if required:
        raise FileNotFoundError(path)
    return spark.createDataFrame([], schema)


def write_days(rows: DataFrame, path: str, day: str = "day") -> None:
    """A table partitioned by day, the landing form of a feed."""
    rows.repartition(day).write.mode("overwrite").partitionBy(day).parquet(path)


def table_manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows, columns) of each table."""
    one = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows", F.array_join(F.array(*[F.lit(c) for c in df.columns]), ",").alias("columns")) for name, df in tables.items()]
    out = one[0]
    for more in one[1:]:
        out = out.unionByName(more)
    return out


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of raw files, named from their partition on; tasks read them in pieces, a file in one task, whatever its size, where they can open it."""
    files = raw_files(spark, [path])
    name = F.regexp_extract("path", r"([^/=]+=[^/]*/)*[^/]+$", 0).alias("file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                digest = hashlib.sha256()
                with _opened(path) as raw:
                    while piece := raw.read(READ):
                        digest.update(piece)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([digest.hexdigest()])], ["path", "sha256"])

    listed = files.select("path", "length", F.lit(uuid.uuid4().hex).alias("read"))  # so that a cached manifest of before is not taken for it
    first = listed.select("path").first()
    if first and not openable(first["path"]):
        return files.withColumn("read", F.lit(uuid.uuid4().hex)).select(name, F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    hashed = listed.select("path", "read").repartition("path").mapInArrow(run, "path string, sha256 string")
    return listed.join(hashed, "path").select(name, F.col("length").alias("bytes"), "sha256")


def read_verified(spark: SparkSession, path: str, manifest: DataFrame, pattern: str = "*.parquet") -> DataFrame:
    """The Parquet table at ``path``, refused if a file is missing, new, or differs from the manifest (file, bytes, sha256) in size or hash."""
    differs = manifest_differences(manifest.select("file", "bytes", "sha256"), file_manifest(spark, f"{path}/{pattern}")).orderBy("file").limit(5).collect()
    if differs:
        raise ValueError(f"{path} is not what its manifest says: " + ", ".join(f"{r['file']} {r['change']}" for r in differs))
    return spark.read.parquet(path)


def merge_days(path: str, revisions: DataFrame, tag: str, day: str = "day", key: list[str] = KEY, values: list[str] = VALUES) -> None:
    """Applies revisions to a table partitioned by day, rewriting the days that they touch and no others.

    Only those days' partitions are read; what becomes of them is stored first and then takes
    their place, so that a merge that is broken off can be done again, to the same end.
    """
    spark = revisions.sparkSession
    held = stored(revisions, f"{tag}-revisions")
    days = [r[day] for r in held.select(day).distinct().collect()]  # partitions, as Spark lists them
    rows = spark.read.parquet(path)
    touched = stored(apply_revisions(rows.filter(F.col(day).isin(days)), held, key, values), f"{tag}-days")
    touched.repartition(day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def snapshot_manifest(spark: SparkSession, tables: dict[str, str], raw: str | None, start: str, end: str, missing: list[str]) -> DataFrame:
    """One row: window, missing; of each table (name to path) rows, columns and sha256; of each raw file bytes and sha256.

    A table's sha256 is that of its files' digests, one after another in order of name.
    """
    counted = table_manifest({name: spark.read.parquet(path) for name, path in tables.items()})
    whole = lambda path: file_manifest(spark, f"{path}/*.parquet").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file", "sha256"))), lambda s: s["sha256"]), "").cast("binary"), 256).alias("sha256"))
    parts = [whole(path).withColumn("name", F.lit(name)) for name, path in tables.items()]
    hashed = parts[0]
    for more in parts[1:]:
        hashed = hashed.unionByName(more)
    listed = counted.join(hashed, "name").agg(F.array_sort(F.collect_list(F.struct("name", "rows", "columns", "sha256"))).alias("tables"))
    files = file_manifest(spark, raw) if raw else spark.createDataFrame([], "file string, bytes long, sha256 string")
    files = files.agg(F.array_sort(F.collect_list(F.struct("file", "bytes", "sha256"))).alias("raw_files"))
    window = F.struct(F.lit(start).cast("date").alias("start"), F.lit(end).cast("date").alias("end"))
    return listed.join(F.broadcast(files)).select(window.alias("window"), "tables", "raw_files", F.lit(missing).cast("array<string>").alias("missing"))  # single rows


def manifest_differences(old: DataFrame, new: DataFrame, key: str = "file") -> DataFrame:
    """Entries that are missing, new, or changed between two manifests."""
    values = [c for c in old.columns if c != key]
    a, b = old.select(key, F.struct(*values).alias("old")), new.select(key, F.struct(*values).alias("new"))
    change = F.when(F.col("new").isNull(), "missing").when(F.col("old").isNull(), "new").when(F.col("old") != F.col("new"), "changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).filter("change is not null")


def write_report(report: DataFrame, path: str) -> None:
    """Nested rows of a gate run as JSON."""
    report.write.mode("overwrite").json(path)


