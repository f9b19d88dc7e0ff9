"""Stateful operators with timers: jobs with leases, back-off and dead letters; edges that supersede each other.

Both run on event time: what a timer waits for is the watermark, so that a stream that is stopped and
started again, or fed the same events again, ends in the same states.  Repeated events change nothing;
events behind the watermark are left out by Spark before they get here.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor

#: a job's states after which nothing follows
FINAL = ("completed", "dead_letter")
JOB = "memory_id string, operation string, digest string"
CHANGE = f"{JOB}, id string, status string, attempts int, at timestamp, next_run_at timestamp"


def use_rocksdb(spark) -> None:
    """The state store that these operators need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def next_status(ok: bool, attempts: int, most: int) -> str:
    return "completed" if ok else "dead_letter" if attempts >= most else "failed"


def delay_ms(attempts: int, base_ms: int) -> int:
    return base_ms * (1 << max(0, attempts - 1))


class Jobs(StatefulProcessor):
    """A job's life by its events: enqueue, claim, ok, error.

    State: id, status, attempts, lease end, next run, the time and kind of the last event.  A claim counts an attempt
    and starts a lease; a lease that ends without an outcome is an error; a failed job is pending again
    when its back-off is over.  A final state is kept for ``keep_ms``, so that repeated events find it, and then forgotten.
    """

    def __init__(self, most: int, base_ms: int, lease_ms: int, keep_ms: int):
        self.most, self.base_ms, self.lease_ms, self.keep_ms = most, base_ms, lease_ms, keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "id string, status string, attempts int, due long, last long")

    def _change(self, key, held, at):
        id_, status, attempts, due, _ = held
        return {"memory_id": key[0], "operation": key[1], "digest": key[2], "id": id_, "status": status, "attempts": attempts, "at": pd.Timestamp(at, unit="ms"), "next_run_at": pd.Timestamp(due, unit="ms") if status == "failed" else pd.NaT}

    def _timer(self, at):
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(int(at))

    def _ended(self, held, ok, at):
        """The state after an attempt has ended; its timer."""
        id_, _, attempts, _, _ = held
        status = next_status(ok, attempts, self.most)
        due = at + (delay_ms(attempts, self.base_ms) if status == "failed" else self.keep_ms)
        self._timer(due)
        return (id_, status, attempts, due, at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows))
        events["ms"] = events["at"].astype("datetime64[ms]").astype("int64")
        order = {"enqueue": 0, "claim": 1, "error": 2, "ok": 3}
        events = events.assign(n=events["kind"].map(order)).sort_values(["ms", "n", "id"]).drop_duplicates(["ms", "kind"])
        held, out = tuple(self.state.get()) if self.state.exists() else None, []
        for kind, id_, at in zip(events["kind"], events["id"], events["ms"]):
            at = int(at)
            if held is not None and held[1] in FINAL:
                break
            if held is not None and held[1] == "failed" and at >= held[3]:  # its back-off is over
                held = (held[0], "pending", held[2], 0, held[4])
            if kind == "enqueue" and held is None:
                held = (id_, "pending", 0, 0, at)
            elif held is None:
                continue  # nothing is known of such a job
            elif kind == "claim" and held[1] == "pending" and at >= held[4]:
                held = (held[0], "running", held[2] + 1, at + self.lease_ms, at)
                self._timer(held[3])
            elif kind in ("ok", "error") and held[1] == "running" and held[4] <= at <= held[3]:
                held = self._ended(held, kind == "ok", at)
            else:
                continue
            out.append(self._change(key, held, at))
        if held is not None:
            self.state.update(held)
        if out:
            yield pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = tuple(self.state.get()) if self.state.exists() else None
        at = int(expiredTimerInfo.getExpiryTimeInMs())
        if held is None:
            return
        if held[1] in FINAL:
            self.state.clear()
            return
        if held[1] == "running":
            held = self._ended(held, False, held[3])
        elif held[1] == "failed" and at >= held[3]:
            held = (held[0], "pending", held[2], 0, held[3])
        else:
            return
        self.state.update(held)
        yield pd.DataFrame([self._change(key, held, at)])


def job_changes(events: DataFrame, most: int = 5, base: str = "30 seconds", lease: str = "5 minutes", keep: str = "7 days", late: str = "1 hour") -> DataFrame:
    """Every change of state of the jobs of ``events(memory_id, operation, digest, id, kind, at)``, a stream."""
    use_rocksdb(events.sparkSession)
    ms = lambda text: int(pd.Timedelta(text).total_seconds() * 1000)
    rows = events.select("memory_id", "operation", "digest", "id", "kind", "at").withWatermark("at", late)
    return rows.groupBy("memory_id", "operation", "digest").transformWithStateInPandas(Jobs(most, ms(base), ms(lease), ms(keep)), CHANGE, "append", "eventTime")


def job_outcomes(events: DataFrame, most: int = 5, base_seconds: int = 30) -> DataFrame:
    """(memory_id, operation, digest, status, attempts, next_run_at) after a batch of ``events(..., kind, at)`` whose attempts each end in ok or error.

    The batch form, without leases: a job is completed by its first ok, dead if ``most`` errors came before it.
    """
    key = ["memory_id", "operation", "digest"]
    ends = events.where("kind in ('ok', 'error')").groupBy(*key, "at").agg(F.max(F.col("kind") == "ok").alias("ok"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy("at"))  # a job's attempts
    ends = ends.withColumn("place", place)
    each = ends.groupBy(*key).agg(F.min(F.when(F.col("ok"), F.col("place"))).alias("first_ok"), F.count("*").alias("n"), F.max("at").alias("last"), F.max(F.when(F.col("place") == most, F.col("at"))).alias("dead_at"))
    known = events.where("kind = 'enqueue'").select(*key).distinct().join(each, key, "left")
    dead = (F.coalesce("n", F.lit(0)) >= most) & (F.coalesce("first_ok", F.lit(most + 1)) > most)
    status = F.when(dead, "dead_letter").when(F.col("first_ok").isNotNull(), "completed").when(F.col("n") > 0, "failed").otherwise("pending")
    attempts = F.when(dead, F.lit(most)).otherwise(F.coalesce("first_ok", "n", F.lit(0))).cast("int")
    out = known.select(*key, status.alias("status"), attempts.alias("attempts"), "last")
    due = F.col("last") + F.make_dt_interval(secs=base_seconds * F.pow(F.lit(2.0), F.col("attempts") - 1))
    return out.select(*key, "status", "attempts", F.when(F.col("status") == "failed", due).alias("next_run_at"))


class Edges(StatefulProcessor):
    """The last edge of a source and relation; forgotten ``keep_ms`` after it began, when no edge that old can come any more."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", "id string, began long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        new["ms"] = new["valid_from"].astype("datetime64[us]").astype("int64")
        found = list(zip(new["ms"].tolist(), new["id"].tolist()))
        if self.state.exists():
            id_, began = self.state.get()
            found.append((began, id_))
        found = sorted(set(found))
        self.state.update((found[-1][1], found[-1][0]))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(found[-1][0] // 1000 + self.keep_ms)
        pairs = [(*key, a[1], b[1], pd.Timestamp(b[0], unit="us")) for a, b in zip(found, found[1:]) if a[1] != b[1]]
        if pairs:
            yield pd.DataFrame(pairs, columns=["dataset_id", "source_id", "relation", "id", "superseded_by", "valid_until"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())


def superseding(edges: DataFrame, keep: str = "365 days", late: str = "1 day") -> DataFrame:
    """(dataset_id, source_id, relation, id, superseded_by, valid_until) as ``edges(..., id, valid_from)`` of exclusive relations arrive."""
    use_rocksdb(edges.sparkSession)
    out = "dataset_id string, source_id string, relation string, id string, superseded_by string, valid_until timestamp"
    rows = edges.select("dataset_id", "source_id", "relation", "id", "valid_from").withWatermark("valid_from", late)
    return rows.groupBy("dataset_id", "source_id", "relation").transformWithStateInPandas(Edges(int(pd.Timedelta(keep).total_seconds() * 1000)), out, "append", "eventTime")
