"""Audit events, trajectories, behaviour, feedback."""

from pyspark.sql import Column, DataFrame, Window, functions as F


def nearest_rank(values: Column, p: float) -> Column:
    """The value at index int((n - 1) * p) of the sorted values: one pass, no window."""
    return F.element_at(F.sort_array(F.collect_list(values)), (F.floor((F.count(values) - 1) * p) + 1).cast("int"))


def audit_summary(events: DataFrame, by: str) -> DataFrame:
    """calls, errors, zero_rate and nearest-rank latencies by ``by``.

    The sorted values are counted per distinct latency first, so that a hot tool's state is
    its distinct values, not its rows.
    """
    each = events.groupBy(by, "latency").agg(
        F.count("*").alias("n"), F.count_if(F.col("outcome") == "error").alias("errors"), F.count_if("zero").alias("zeros")
    )
    total = each.groupBy(by).agg(F.sum("n").alias("calls"), F.sum("errors").alias("errors"), F.sum("zeros").alias("zeros"))
    upto = each.withColumn("upto", F.sum("n").over(Window.partitionBy(by).orderBy("latency"))).join(total.select(by, "calls"), by)
    at = lambda p: F.min(F.when(F.col("upto") > F.floor((F.col("calls") - 1) * p), F.col("latency"))).alias(f"p{int(p * 100)}")
    points = upto.where("latency is not null").groupBy(by).agg(at(0.5), at(0.95), at(0.99))
    return total.join(points, by, "left").select(by, "calls", "errors", F.round(F.col("zeros") / F.col("calls"), 6).alias("zero_rate"), "p50", "p95", "p99")


def half_hour(at: Column) -> Column:
    """The number of the half hour since 1970."""
    return F.floor(F.unix_seconds(at.cast("timestamp")) / 1800).cast("long")


def trajectory_key() -> Column:
    """trace ▸ session ▸ tumbling half hour per client and collection."""
    bucket = half_hour(F.col("ts")).cast("string")
    return (
        F.when(F.col("trace_id") != "", F.concat(F.lit("trace:"), "trace_id"))
        .when(F.col("session_id") != "", F.concat(F.lit("session:"), "session_id"))
        .otherwise(F.concat_ws(":", F.lit("window"), "client", "collection", bucket))
    )


def trajectories(events: DataFrame) -> DataFrame:
    return events.withColumn("key", trajectory_key()).groupBy("key").agg(
        F.count("*").alias("events"), F.count_if(F.col("outcome") == "error").alias("errors"), F.count_if("zero").alias("zeros"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.countDistinct("tool").alias("tools"),
    )


def behaviour(events: DataFrame, consult: str, save: str) -> DataFrame:
    """One row over the traces: how they save, consult, fail and find nothing.

    Saves are informed when a consultation precedes them in the trace; rates are per save, per
    event, per consultation and per trace, 0 where there are none.
    """
    before = Window.partitionBy("key").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    rows = events.withColumn("key", trajectory_key())
    rows = rows.withColumn("consulted", F.coalesce(F.max((F.col("tool") == consult).cast("int")).over(before), F.lit(0)))
    saves, asks = F.col("tool") == save, F.col("tool") == consult
    traces = rows.groupBy("key").agg(
        F.max((F.col("outcome") == "error").cast("int")).alias("err"), F.count("*").alias("n"), F.count_if(saves).alias("saves"), F.count_if(saves & (F.col("consulted") == 1)).alias("informed"),
        F.count_if(F.col("zero")).alias("zeros"), F.count_if(asks).alias("asks"), F.count_if(asks & F.col("zero")).alias("empty"),
    )
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(F.sum(a).cast("double"), F.sum(b)), F.lit(0.0)), 6)
    return traces.agg(
        F.count("*").alias("traces"), F.sum("n").alias("events"), F.round(F.avg("err"), 6).alias("error_rate"), F.sum("saves").alias("saves"), F.sum("informed").alias("informed"),
        rate("informed", "saves").alias("recall_before_save_rate"), rate("zeros", "n").alias("zero_result_rate"), rate("empty", "asks").alias("empty_recall_rate"),
        F.round(F.sum(F.col("saves") + F.col("asks")) / F.count("*"), 6).alias("memory_ops_per_trace"), F.count_if(F.col("saves") > F.col("informed")).alias("blind_traces"),
    )


def routing_weights(ratings: DataFrame, rate: float = 0.1) -> DataFrame:
    """clamp(1 + rate * total * (share of ratings of 4 or more - .5), .5, 1.5) by search_type."""
    s = ratings.groupBy("search_type").agg(F.count("*").alias("total"), F.avg((F.col("rating") >= 4).cast("double")).alias("good"))
    w = F.least(F.greatest(1 + F.lit(rate) * F.col("total") * (F.col("good") - 0.5), F.lit(0.5)), F.lit(1.5))
    return s.select("search_type", "total", F.round(w, 6).alias("weight"))


def top_buckets(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Counts of the n commonest keys, the rest as 'other'."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    best = counts.orderBy(F.desc("n"), key).limit(n).select(F.col(key).alias("_top"))
    named = counts.join(F.broadcast(best), F.col(key) == F.col("_top"), "left")
    return named.groupBy(F.coalesce(F.col("_top").cast("string"), F.lit("other")).alias("bucket")).agg(F.sum("n").alias("n"))


def good_traces(events: DataFrame, consult: str, save: str) -> DataFrame:
    """(key) of traces without errors, that save, consult before each save, save no key twice, and once find something."""
    before = Window.partitionBy("key").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    rows = events.withColumn("key", trajectory_key()).withColumn("_before", F.coalesce(F.max((F.col("tool") == consult).cast("int")).over(before), F.lit(0)))
    repeat = F.col("repeat_save") if "repeat_save" in events.columns else F.lit(False)
    each = rows.groupBy("key").agg(
        F.bool_or(F.col("outcome") == "error").alias("err"), F.bool_or(F.col("tool") == save).alias("saves"), F.bool_or((F.col("tool") == save) & (F.col("_before") == 0)).alias("blind"),
        F.bool_or(repeat).alias("repeats"), F.bool_or((F.col("tool") == consult) & ~F.col("zero")).alias("found"),
    )
    return each.where("saves and found and not err and not blind and not repeats").select("key")


def feedback_stats(ratings: DataFrame) -> DataFrame:
    """(search_type, n, avg_rating, worst): worst is the id of the least rating, the first of equals."""
    worst = F.min_by("id", F.struct("rating", "id")).alias("worst")
    return ratings.groupBy("search_type").agg(F.count("*").alias("n"), F.round(F.avg("rating"), 6).alias("avg_rating"), worst)


def retried(jobs: DataFrame, most: int, seconds: int) -> DataFrame:
    """``jobs(attempts, now)`` that failed: to run again after ``seconds``, doubled with each attempt after the first, or given up after ``most``."""
    wait = F.make_dt_interval(secs=F.lit(seconds).cast("double") * F.pow(F.lit(2.0), F.greatest(F.col("attempts") - 1, F.lit(0))))
    return jobs.withColumns({"status": F.when(F.col("attempts") >= most, "dead_letter").otherwise("failed"), "next_run_at": F.when(F.col("attempts") < most, F.col("now") + wait)})


def repeat_saves(events: DataFrame, key: str) -> DataFrame:
    """Saves ``(id, ts, collection, key)`` with ``repeat``: whether the collection had a save of that key before."""
    first = events.groupBy("collection", key).agg(F.min(F.struct("ts", "id")).alias("_first"))
    return events.join(first, ["collection", key]).withColumn("repeat", F.struct("ts", "id") > F.col("_first")).drop("_first")


def hit_rates(calls: DataFrame, by: str) -> DataFrame:
    """(by, hits, misses, rate) of cache calls (hit); 0 where there are none."""
    return calls.groupBy(by).agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses")).withColumn("rate", F.round(F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("hits") + F.col("misses")), F.lit(0.0)), 6))


#: size of a quantile sketch: the rank error falls with it, below 1 % from 400 on
SKETCH = 800


def quantile_sketches(rows: DataFrame, by: list, value: str, k: int = SKETCH) -> DataFrame:
    """(*by, n, sketch): a mergeable sketch of the values of each key, such as a day and tool; null values are left out."""
    return rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, by: list, ranks, k: int = SKETCH) -> DataFrame:
    """(*by, n, rank, value): quantiles of all ``sketches(*by, n, sketch)`` of a key together; no value is read again."""
    merged = sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))
    pairs = [F.struct(F.lit(float(r)).alias("rank"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(r))).alias("value")) for r in ranks]
    return merged.select(*by, "n", F.explode(F.array(*pairs)).alias("x")).select(*by, "n", "x.rank", "x.value")


def ordered_distinct(rows: DataFrame, by: str, value: str, order: list) -> DataFrame:
    """(by, values): each key's distinct values in the order in which they first come; null and empty ones are left out."""
    first = rows.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(by, value).agg(F.min(F.struct(*order)).alias("_at"))
    return first.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", F.col(value).alias("v")))), lambda x: x["v"]).alias("values"))
