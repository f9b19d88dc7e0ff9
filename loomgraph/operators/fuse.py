"""Fusing and re-ranking ranked lists."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.store import written

RRF_K = 60


def hybrid_rrf(vector: DataFrame, lexical: DataFrame, k: int, vector_weight: float = 1.0, lexical_weight: float = 1.0) -> DataFrame:
    """Reciprocal-rank fusion of two lists (id, score, rank); weights of 0 or less mean 1.

    Ties: lexical score, lexical rank (absent last), vector rank (absent last), id.
    """
    vw, lw = (vector_weight if vector_weight > 0 else 1.0), (lexical_weight if lexical_weight > 0 else 1.0)
    v = vector.select("id", F.col("rank").alias("vr"), F.col("score").alias("vs"))
    x = lexical.select("id", F.col("rank").alias("lr"), F.col("score").alias("ls"))
    share = lambda r, w: F.coalesce(F.lit(w) / (RRF_K + F.col(r)), F.lit(0.0))
    both = v.join(x, "id", "full_outer").withColumn("score", share("vr", vw) + share("lr", lw))
    order = [F.round("score", 12).desc(), F.coalesce("ls", F.lit(0.0)).desc(), F.coalesce("lr", F.lit(1 << 30)), F.coalesce("vr", F.lit(1 << 30)), F.col("id")]
    return both.orderBy(*order).limit(k).select("id", "score", "vr", "lr")


def multi_query_rrf(lists: DataFrame, k: int) -> DataFrame:
    """Sum of 1 / (60 + rank) over ``lists(list, rank, id, score)``, with the best-scored row's score."""
    out = lists.groupBy("id").agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("fused"), F.max("score").alias("score"))
    return out.orderBy(F.round("fused", 12).desc(), "id").limit(k)


def merge_results(lists: DataFrame, k: int) -> DataFrame:
    """As ``multi_query_rrf``, but n > 1 appearances multiply by n / 2; best is the least score."""
    out = lists.groupBy("id").agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("f"), F.count("*").alias("appearances"), F.min("score").alias("best"))
    out = out.withColumn("fused", F.col("f") * F.when(F.col("appearances") > 1, F.col("appearances") * 0.5).otherwise(1.0)).drop("f")
    return out.orderBy(F.round("fused", 12).desc(), "id").limit(k)


def word_set(text: Column) -> Column:
    """Distinct lower-case white-space words without surrounding punctuation."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), "\\s+")
    return F.array_distinct(F.filter(F.transform(words, lambda w: F.btrim(w, F.lit(".,;:!?\"'()[]{}«»—–-"))), lambda w: w != ""))


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """Two empty sets: 0 in deduplication, 1 in shadow comparison."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def jaccard_pairs(results: DataFrame, least: float, by: str) -> DataFrame:
    """(by, a, b, sim) of results (by, id, text) of one list whose word sets' Jaccard exceeds ``least``.

    A list is what one search returned, k rows.  Sizes that can't reach ``least`` are passed
    over; texts without words pair with none.
    """
    sets = written(results.select(by, "id", word_set(F.col("text")).alias("w")).where(F.size("w") > 0), "sets")  # read twice
    a, b = sets.toDF(by, "a", "wa"), sets.toDF(by, "b", "wb")
    close = F.expr(f"size(wa) >= {least} * size(wb) - 1e-9 and size(wb) >= {least} * size(wa) - 1e-9")
    pairs = a.join(b, by).where((F.col("a") < F.col("b")) & close)
    return pairs.select(by, "a", "b", jaccard(F.col("wa"), F.col("wb")).alias("sim")).where(F.col("sim") > least)


def rerank(results: DataFrame, max_gap: float | None = None) -> DataFrame:
    """Orders (id, score, rank, rerank_score): scored ones first; skipped when the scores' spread exceeds ``max_gap``."""
    every = Window.partitionBy(F.lit(1))
    skip = F.lit(False) if max_gap is None else (F.max("score").over(every) - F.min("score").over(every)) > max_gap
    key = F.when(skip, F.lit(None)).otherwise(F.col("rerank_score"))
    return results.withColumn("new_rank", F.row_number().over(every.orderBy(key.desc_nulls_last(), F.col("rank"))).cast("long"))


def unit(score: Column, whole: bool = True) -> Column:
    """A score from 0 to 1: negative ones are 0, those over 1 distances; so is 1 itself unless it is a ``whole`` score."""
    return F.when(score < 0, 0.0).when(score <= 1 if whole else score < 1, score).otherwise(1 / (1 + score))


def confidence(scores: DataFrame) -> DataFrame:
    """top * .6 + gap to the second * .25 + min(n / 10, 1) * .15 of ``scores(score)``, each normalised."""
    best = scores.select(unit(F.col("score")).alias("s")).orderBy(F.desc("s")).limit(2).agg(F.max("s").alias("top"), F.when(F.count("*") > 1, F.max("s") - F.min("s")).otherwise(F.max("s")).alias("gap"))
    return best.crossJoin(scores.agg(F.count("*").alias("n"))).select(
        F.round(F.coalesce("top", F.lit(0.0)) * 0.6 + F.coalesce("gap", F.lit(0.0)) * 0.25 + F.least(F.col("n") / 10, F.lit(1.0)) * 0.15, 6).alias("confidence"), "n"
    )


def combined_confidence(retrieval: Column, routing: Column) -> Column:
    """.7 of what was found and .3 of how sure the route was (.5 where it wasn't routed), from 0 to 1."""
    return F.least(F.greatest(retrieval * 0.7 + F.coalesce(routing, F.lit(0.5)) * 0.3, F.lit(0.0)), F.lit(1.0))


def deduplicated(results: DataFrame, least: float = 0.85, by: str = "qid") -> DataFrame:
    """``results(by, id, text, score, pos)`` of searches without those whose words repeat a kept one's.

    Of two of one list whose word sets' Jaccard exceeds ``least``, the better scored stays, the
    earlier one on a tie; texts without words stay.  Each list, k rows, is gone through in order,
    as a fold over its pairs: whether i falls depends on whether its partners fell before.
    """
    pairs = jaccard_pairs(results.select(by, F.col("pos").alias("id"), "text"), least, by)
    scores = results.select(by, F.col("pos").alias("a"), F.col("score").alias("sa"))
    told = pairs.join(scores, [by, "a"]).join(scores.toDF(by, "b", "sb"), [by, "b"]).groupBy(by).agg(F.sort_array(F.collect_list(F.struct("a", "b", (F.col("sa") >= F.col("sb")).alias("first")))).alias("_pairs"))
    # in the order of (a, b): a pair counts if neither has fallen
    fallen = F.aggregate(
        "_pairs", F.array().cast("array<long>"),
        lambda gone, p: F.when(F.array_contains(gone, p["a"].cast("long")) | F.array_contains(gone, p["b"].cast("long")), gone).otherwise(F.array_append(gone, F.when(p["first"], p["b"]).otherwise(p["a"]).cast("long"))),
    )
    lists = told.select(by, fallen.alias("_gone"))
    return results.join(lists, by, "left").where(~F.coalesce(F.array_contains("_gone", F.col("pos").cast("long")), F.lit(False))).drop("_gone")
