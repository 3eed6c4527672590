"""The folder that the driver and all executors share, and tables that are stored there once and read more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a local folder where it is unset and all runs on this machine (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-shared-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    """A new folder's path there. It is deleted when the application ends, as what it returned may be read until then."""
    path = f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"
    where, fs = _at(spark, path)
    fs.deleteOnExit(where)
    return path


def delete(spark: SparkSession, path: str) -> None:
    where, fs = _at(spark, path)
    fs.delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _at(spark, path)
    return fs.exists(where)


def _at(spark: SparkSession, path: str) -> tuple:
    """The path and its file system, as Hadoop has them: any scheme that Spark can write to."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


#: Schemes of paths as tasks open them, by the names that pyarrow has for them.
SCHEMES = {"file": "file", "hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "gcs": "gs", "abfs": "abfs", "abfss": "abfss"}


def scheme(path: str) -> str:
    return path.partition(":")[0] if ":" in path.partition("/")[0] else "file"


def for_tasks(path: str) -> str:
    """A path of Hadoop's as pyarrow takes it: other names of the same store are translated, and a local path is made a URI."""
    kind = scheme(path)
    if kind not in SCHEMES:
        raise ValueError(f"tasks cannot open {kind}: paths; known are {', '.join(SCHEMES)}")
    rest = path.partition(":")[2] if ":" in path.partition("/")[0] else path
    return "file:///" + rest.lstrip("/") if kind == "file" else f"{SCHEMES[kind]}:{rest}"


def file_system(path: str) -> tuple:
    """pyarrow's file system of a path, and the path there; for code in tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(for_tasks(path))


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet and read back, so that several readers share one run of its plan."""
    path = new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
