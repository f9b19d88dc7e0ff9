"""Tables between steps of an iteration, in the folder that the cluster shares."""

import os
import tempfile
import uuid

from pyspark.sql import DataFrame


def shared_folder(spark) -> str:
    """``spark.checkpoint.dir``; a local folder only in local mode, where there is one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "loomgraph-steps")
    return found.rstrip("/")


def arrow(df: DataFrame) -> DataFrame:
    """``df``, from now on given to Python in batches of bounded bytes: long texts, postings or vectors are no 10,000 rows at a time."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    return df


def fresh(spark, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read again: its lineage ends here, and a lost executor costs one step."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def files_state(spark, path: str) -> str:
    """A name of what a folder or file holds just now: its files with their sizes and times."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = system.listStatus(where) if system.exists(where) else []
    return "|".join(sorted(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}" for f in found))
