"""Intermediate tables and files in the folder that all executors share."""

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a local folder only in local mode, where there is one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "loomgraph-shared")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def tune(spark: SparkSession) -> None:
    """Arrow batches of bounded size; shuffle files go when their query has ended."""
    for key, value in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", "1000"),
        ("spark.sql.execution.arrow.maxBytesPerBatch", "4m"),
        ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"),
    ):
        spark.conf.set(key, value)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it: lineage ends, nothing is computed twice."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomgraph_path = path
    return out


def _place(df: DataFrame):
    """(file system, path) of a table made by ``stored``."""
    where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._loomgraph_path)
    return where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()), where


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files of a table made by ``stored``."""
    system, where = _place(df)
    return system.getContentSummary(where).getLength()


def drop(*tables: DataFrame) -> None:
    """Delete tables made by ``stored`` that nothing reads any more."""
    for df in tables:
        if hasattr(df, "_loomgraph_path"):
            system, where = _place(df)
            system.delete(where, True)


#: bytes of files that one task reads back
READ_BYTES = 16 << 20


def reading_tasks(files: DataFrame) -> int:
    """Tasks for reading ``files(n_bytes)``: a few rows stand for large files, which Spark can't see and would join in one task."""
    from pyspark.sql import functions as F

    return max(1, -(-int(files.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]) // READ_BYTES))


def filesystem(uri: str):
    """(pyarrow file system, path) of a shared folder, usable on executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def write_file(uri: str, attempt: str, chunks) -> int:
    """Write a file whole or not at all: a retried task replaces its own earlier file."""
    where, path = filesystem(uri)
    where.create_dir(os.path.dirname(path), recursive=True)
    temporary, total = f"{path}.{attempt}.tmp", 0
    with where.open_output_stream(temporary, compression=None) as out:
        for chunk in chunks:
            out.write(chunk)
            total += len(chunk)
    where.move(temporary, path)
    return total


def read_file(uri: str) -> bytes:
    where, path = filesystem(uri)
    with where.open_input_stream(path, compression=None) as src:
        return src.read()
