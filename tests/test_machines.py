"""Job and edge machines: restarts, repeated and late events, leases, back-off, dead letters."""

import datetime as dt
import json

from pyspark.sql import functions as F

from loomgraph.streaming import machines

EVENTS = "memory_id string, operation string, digest string, id string, kind string, at timestamp"
START = dt.datetime(2024, 1, 1)


def event(job, kind, seconds):
    return {"memory_id": job, "operation": "index", "digest": "d", "id": f"id-{job}", "kind": kind, "at": (START + dt.timedelta(seconds=seconds)).isoformat() + "Z"}


def fed(spark, tmp_path, name, schema, make, batches):
    """Rows of a stream that is stopped after each batch of files and started again."""
    source, out = tmp_path / name, tmp_path / f"{name}-out"
    source.mkdir()
    for i, batch in enumerate(batches):
        (source / f"{i}.json").write_text("\n".join(map(json.dumps, batch)))
        q = make(spark.readStream.schema(schema).json(str(source))).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"{name}-ck")).trigger(availableNow=True).start(str(out))
        assert q.awaitTermination(180), q.exception()
        assert q.exception() is None
    return spark.read.parquet(str(out))


def test_jobs(spark, tmp_path):
    first = [event(j, "enqueue", 0) for j in "abcde"] + [event("a", "enqueue", 0), event("a", "claim", 10), event("a", "ok", 20), event("b", "claim", 10), event("b", "error", 20), event("c", "claim", 10), event("x", "ok", 15)]
    later = [event("a", "error", 25), event("b", "claim", 40), event("b", "claim", 60), event("b", "error", 65)]  # b: its back-off of 30 s lasts until 50
    far = [event("e", "claim", 5000)]  # moves the watermark beyond c's lease of 300 s
    after = [event("a", "ok", 20), event("c", "claim", 5010), event("c", "ok", 5020), event("b", "claim", 5030), event("b", "error", 5040), event("d", "ok", 1), event("e", "ok", 5050), event("e", "ok", 5050)]
    end = [event("f", "enqueue", 9000)]
    got = fed(spark, tmp_path, "jobs", EVENTS, lambda s: machines.job_changes(s, most=3, base="30 seconds", lease="300 seconds", late="60 seconds"), [first, later, far, after, end])
    rows = [(r.memory_id, r.status, r.attempts, (r.at - START).total_seconds()) for r in got.orderBy("memory_id", "at", "attempts").collect()]
    of = lambda job: [r[1:] for r in rows if r[0] == job]
    assert of("a") == [("pending", 0, 0), ("running", 1, 10), ("completed", 1, 20)]
    assert [s for s, _, _ in of("b") if s != "pending"] == ["running", "failed", "running", "failed", "running", "dead_letter"]
    assert {("failed", 1, 20.0), ("failed", 2, 65.0), ("dead_letter", 3, 5040.0)} <= set(of("b"))
    assert ("failed", 1, 310.0) in of("c") and ("completed", 2, 5020.0) in of("c")  # its lease ended
    assert of("d") == [("pending", 0, 0)] and [s for s, _, _ in of("e")] == ["pending", "running", "completed"] and of("x") == []
    final = [r for r in rows if r[1] in machines.FINAL]
    assert sorted(r[0] for r in final) == ["a", "b", "c", "e"]  # one outcome each
    due = {(r.memory_id, r.attempts): (r.next_run_at - START).total_seconds() for r in got.where("status = 'failed'").collect()}
    assert due["b", 1] == 50 and due["b", 2] == 125


def test_jobs_end_as_the_batch_says(spark, tmp_path):
    """Attempts that end within their lease and begin after their back-off: the last state is the batch form's."""
    events = []
    for n in range(6):
        at = 0
        events.append(event(f"j{n}", "enqueue", at))
        for k in range(n):
            at += 1000
            events += [event(f"j{n}", "claim", at), event(f"j{n}", "ok" if n % 2 and k == n - 1 else "error", at + 5)]
    split = sorted(events, key=lambda e: e["at"])
    got = fed(spark, tmp_path, "same", EVENTS, lambda s: machines.job_changes(s, most=4, late="1 hour"), [split[:9], split[9:]])
    last = {r.memory_id: (r.s.status, r.s.attempts) for r in got.groupBy("memory_id").agg(F.max_by(F.struct("status", "attempts"), F.struct("at", "attempts", F.col("status") != "running")).alias("s")).collect()}
    batch = machines.job_outcomes(spark.read.schema(EVENTS).json(spark.sparkContext.parallelize([json.dumps(e) for e in events])), most=4)
    assert last == {r.memory_id: (r.status, r.attempts) for r in batch.collect()}


def test_edges(spark, tmp_path):
    edge = lambda i, day, source="s": {"dataset_id": "", "source_id": source, "relation": "r", "id": i, "valid_from": (START + dt.timedelta(days=day)).isoformat() + "Z"}
    schema = "dataset_id string, source_id string, relation string, id string, valid_from timestamp"
    got = fed(spark, tmp_path, "edges", schema, lambda s: machines.superseding(s, keep="30 days", late="2 days"), [[edge("e1", 0), edge("e2", 1), edge("e2", 1)], [edge("e3", 2), edge("e2", 1)], [edge("far", 100, "t")], [edge("e0", 0.5), edge("e4", 101)], [edge("far2", 200, "t")]])
    found = sorted((r.id, r.superseded_by) for r in got.collect())
    assert ("e1", "e2") in found and ("e2", "e3") in found and ("far", "far2") in found
    assert all("e0" not in pair for pair in found)  # behind the watermark
    assert ("e3", "e4") not in found  # the state had ended: 30 days after e3 began
