"""Structured Streaming forms of the event operators."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators.analytics import quantile_sketches, routing_weights, trajectory_key


def audit_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """A folder of JSON-lines audit files as a stream.  Where a bounded queue would drop events, this one lags."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def once(events: DataFrame, stamp: str = "ts", key: str = "id", late: str = "1 day") -> DataFrame:
    """Each id once; ids are remembered as long as events may be late."""
    return events.withWatermark(stamp, late).dropDuplicatesWithinWatermark([key])


def trajectory_counts(events: DataFrame, late: str | None = "1 hour") -> DataFrame:
    """Counts per trajectory and half hour; a half hour is final once the watermark has passed it.

    ``late`` is None for events that have a watermark already.
    """
    keyed = events.withColumn("key", trajectory_key())
    keyed = keyed.withWatermark("ts", late) if late else keyed
    return keyed.groupBy(F.window("ts", "30 minutes").alias("half_hour"), "key").agg(
        F.count("*").alias("events"), F.count_if(F.col("outcome") == "error").alias("errors"), F.max("ts").alias("last_ts")
    )


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Counts per user and session of a gap: an extension, the tumbling key above is the matched behaviour."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("events"))


def running_routing_weights(ratings: DataFrame) -> DataFrame:
    """Routing weights so far: they depend on totals only, so a plain aggregate in update or complete mode."""
    return routing_weights(ratings)


def supersessions(edges: DataFrame) -> DataFrame:
    """(superseded id, by, valid_until) as exclusive edges arrive: the state is the last edge of each source and relation.

    An edge older than the one held is itself superseded at once by its successor.  The state is
    one edge a source and relation, as many as the graph has; a group's arrivals are sorted at once.
    """
    out = "dataset_id string, source_id string, relation string, id string, superseded_by string, valid_until timestamp"

    def step(key, batches: Iterator[pd.DataFrame], state):
        parts = [p[["id", "valid_from"]] for p in batches]
        if state.exists:
            parts.append(pd.DataFrame([state.get], columns=["id", "valid_from"]))
        rows = pd.concat(parts).sort_values(["valid_from", "id"]).reset_index(drop=True)
        state.update((rows["id"].iloc[-1], rows["valid_from"].iloc[-1]))
        after = rows.shift(-1).iloc[:-1]
        found = pd.DataFrame({"id": rows["id"].iloc[:-1], "superseded_by": after["id"], "valid_until": after["valid_from"]})
        yield found.assign(dataset_id=key[0], source_id=key[1], relation=key[2])[["dataset_id", "source_id", "relation", "id", "superseded_by", "valid_until"]]

    return edges.groupBy("dataset_id", "source_id", "relation").applyInPandasWithState(step, out, "id string, valid_from timestamp", "append", "NoTimeout")


def backoff(attempts, base_seconds: int = 30):
    return F.expr(f"make_dt_interval(0, 0, 0, {base_seconds} * power(2, greatest({attempts} - 1, 0)))")


def outbox_step(jobs: DataFrame, results: DataFrame, most: int = 5) -> DataFrame:
    """``jobs(id, status, attempts, due)`` after a batch of ``results(id, ok)``: done, retried later, or dead."""
    rows = jobs.join(results, "id", "left")
    failed = F.col("ok") == F.lit(False)
    attempts = F.when(failed, F.col("attempts") + 1).otherwise(F.col("attempts"))
    status = F.when(F.col("ok"), "done").when(failed & (attempts >= most), "dead").when(failed, "retry").otherwise(F.col("status"))
    due = F.when(failed, F.col("due") + backoff("attempts + 1")).otherwise(F.col("due"))
    return rows.select("id", status.alias("status"), attempts.alias("attempts"), due.alias("due"))


def mirrored(stream: DataFrame, first: str, second: str, checkpoint: str):
    """A query that appends each micro-batch to two folders; a batch that is run again replaces its own files."""

    def write(batch: DataFrame, number: int):
        rows = batch.persist()
        for path in (first, second):
            rows.write.mode("overwrite").parquet(f"{path}/batch={number}")
        rows.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def retained(events: DataFrame, days: int = 90, at=None) -> DataFrame:
    """Events of the last ``days``: what stays when older partitions of a log are dropped."""
    now = F.current_timestamp() if at is None else at
    return events.where(F.col("ts") >= now - F.make_dt_interval(days=F.lit(days)))


def prune(spark: SparkSession, path: str, days: int, today) -> list:
    """Delete the folders day=<date> of a log that are older than ``days``; their names."""
    import datetime as dt

    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path + "/day=*")
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    limit, gone = today - dt.timedelta(days=days), []
    for f in system.globStatus(where) or []:
        name = f.getPath().getName()
        if dt.date.fromisoformat(name.removeprefix("day=")) < limit:
            system.delete(f.getPath(), True)
            gone.append(name)
    return sorted(gone)


def daily_log(stream: DataFrame, path: str, checkpoint: str):
    """A query that adds events to a log of folders by day, which ``prune`` can drop; a batch that is run again replaces its own files."""

    def write(batch: DataFrame, number: int):
        rows = batch.withColumns({"day": F.to_date("ts"), "batch": F.lit(number)})
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


class Progress(StreamingQueryListener):
    """Counts of each stage that ``stage`` observes, the latest batch's and so far."""

    def __init__(self):
        self.last, self.total = {}, {}

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        for name, row in event.progress.observedMetrics.items():
            self.last[name] = row["rows"]
            self.total[name] = self.total.get(name, 0) + row["rows"]

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


def stage(rows: DataFrame, name: str) -> DataFrame:
    """``rows``, counted under a stage's name on their way."""
    return rows.observe(name, F.count(F.lit(1)).alias("rows"))


def sweep(spark: SparkSession, work, every: str = "1 hour", checkpoint: str | None = None):
    """A query that calls ``work(spark)`` once every interval: the janitor."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    out = ticks.writeStream.trigger(processingTime=every).foreachBatch(lambda batch, number: work(batch.sparkSession))
    return (out.option("checkpointLocation", checkpoint) if checkpoint else out).start()


def claim(jobs: DataFrame, now, limit: int) -> DataFrame:
    """The ``limit`` first jobs(id, status, attempts, due, created) that may run: pending or failed, and due; running from now on."""
    ready = jobs.where(F.col("status").isin("pending", "failed") & (F.col("due").isNull() | (F.col("due") <= now)))
    return ready.orderBy("created", "id").limit(limit).withColumns({"status": F.lit("running"), "attempts": F.col("attempts") + 1})


def enqueue(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """``jobs`` with those of ``new`` whose (memory_id, operation, digest) isn't there yet; of equal ones the first id."""
    key = ["memory_id", "operation", "digest"]
    once = new.groupBy(*key).agg(F.min("id").alias("id"))
    fresh = once.join(jobs.select(*key), key, "left_anti")
    return jobs.unionByName(fresh.withColumns({"status": F.lit("pending"), "attempts": F.lit(0)}), allowMissingColumns=True)


def sketched(stream: DataFrame, by: list, value: str, path: str, checkpoint: str):
    """A query that adds each micro-batch's quantile sketches to a folder, whose rows merge for any range; a batch that is run again replaces its own."""

    def write(batch: DataFrame, number: int):
        quantile_sketches(batch, by, value).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
