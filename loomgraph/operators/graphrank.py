"""Ranking by the graph: proximity, triplets, contexts under a budget, entities and expansions of a query."""

from pyspark.sql import DataFrame, Window, functions as F

from . import graph, substring
from .relate import distances


def proximity(edges: DataFrame, seeds: DataFrame, decay: float = 0.5, most: int = 50) -> DataFrame:
    """(id, proximity) around ``seeds(id)`` over active edges: 1 for them, ``decay`` at one hop, its square at two.

    The second hop starts from ``most`` nodes of the first.
    """
    start = seeds.select("id").distinct()
    first = graph.neighbours(edges, start.withColumnRenamed("id", "seed")).select("id").distinct()
    second = graph.neighbours(edges, first.orderBy("id").limit(most).withColumnRenamed("id", "seed")).select("id").distinct()
    near = start.withColumn("p", F.lit(1.0)).union(first.withColumn("p", F.lit(decay))).union(second.withColumn("p", F.lit(decay * decay)))
    return near.groupBy("id").agg(F.max("p").alias("proximity"))


def rerank(results: DataFrame, near: DataFrame, alpha: float = 0.6, beta: float = 0.2, gamma: float = 0.2) -> DataFrame:
    """``results(id, entities, score, rerank_score)`` by alpha * score + beta * best proximity of their entities + gamma * rerank_score."""
    best = results.select("id", F.explode_outer("entities").alias("_entity")).join(near.select(F.col("id").alias("_entity"), "proximity"), "_entity", "left").groupBy("id").agg(F.max("proximity").alias("proximity"))
    combined = alpha * F.col("score") + beta * F.coalesce("proximity", F.lit(0.0)) + gamma * F.coalesce("rerank_score", F.lit(0.0))
    return results.join(best, "id").withColumn("combined", combined).orderBy(F.round("combined", 9).desc(), "id")


def triplet_scores(nodes: DataFrame, edges: DataFrame, node_distances: DataFrame, type_distances: DataFrame, k: int = 5, penalty: float = 3.5) -> DataFrame:
    """(id, source_id, target_id, score) of the k edges of least d(source) + d(relation) + d(target).

    ``node_distances(id, distance)`` and ``type_distances(relation, distance)``; what has none gets
    the penalty.  Edges without both nodes are passed over; k of 0 or less means 5.
    """
    near = distances(nodes.select("id").distinct(), node_distances, penalty)
    kinds = type_distances.groupBy("relation").agg(F.min("distance").alias("_t"))
    rows = edges.join(near.toDF("source_id", "_s"), "source_id").join(near.toDF("target_id", "_d"), "target_id").join(kinds, "relation", "left")
    score = F.col("_s") + F.least(F.coalesce("_t", F.lit(penalty)), F.lit(penalty)) + F.col("_d")
    return rows.select("id", "source_id", "target_id", score.alias("score")).orderBy(F.round("score", 9), "id").limit(k if k > 0 else 5)


def aggregated(scored: DataFrame, k: int = 10) -> DataFrame:
    """One row of the k best edges: edges, distinct nodes at their ends."""
    best = scored.orderBy(F.round("score", 9), "id").limit(k)
    return best.select("id", F.explode(F.array("source_id", "target_id")).alias("node")).agg(F.countDistinct("id").alias("edges"), F.countDistinct("node").alias("nodes"))


# fixed values: orders of the providers
ORDERS = {"vsa_first": ("vsa", "sql"), "sql_first": ("sql", "vsa"), "sql_only": ("sql",), "vsa_only": ("vsa",)}


def assembled(items: DataFrame, order: str = "vsa_first", total: int = 20, reserve: int = 10) -> DataFrame:
    """The context lines of ``items(provider, pos, dataset_id, source, relation, target)``, ``total`` at most.

    Providers follow ``order``; a triple counts once, case aside, for the first provider.  Where
    the symbolic provider comes first it gets ``reserve`` lines (0: all), the other the rest.
    """
    providers = ORDERS.get(order, ORDERS["vsa_first"])
    place = F.coalesce(*[F.when(F.col("provider") == p, i) for i, p in enumerate(providers)])
    cap = min(reserve, total) if order == "vsa_first" and reserve > 0 else total
    rows = items.withColumn("_p", place).where("_p is not null")
    key = [F.lower(F.coalesce(c, F.lit(""))).alias(f"_{c}") for c in ("dataset_id", "source", "relation", "target")]
    first = rows.select("*", *key).groupBy("_dataset_id", "_source", "_relation", "_target").agg(F.min(F.struct("_p", "pos", "provider", "source", "relation", "target")).alias("x")).select("x.*")
    few = first.where(F.col("_p") == 0).orderBy("pos").limit(cap)
    if len(providers) > 1:
        few = few.union(first.where(F.col("_p") == 1).orderBy("pos").limit(total))
    return few.orderBy("_p", "pos").limit(total).select("provider", "source", "relation", "target")


def query_entities(nodes: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """(id, name) of nodes whose name contains a word of the query of over two characters."""
    words = nodes.sparkSession.range(1).select(F.explode(F.array_distinct(F.transform(F.split(F.lit(query), r"\s+"), lambda w: F.regexp_replace(F.lower(w), r"^[^\p{L}\p{Nd}]+|[^\p{L}\p{Nd}]+$", "")))).alias("_w"))
    words = words.where("char_length(_w) > 2")
    hits = substring.containing(nodes.select("id", F.col("name").alias("text")), words.select(F.lit(0).alias("qid"), F.col("_w").alias("pattern")))
    return nodes.join(hits.select("id"), "id", "left_semi").select("id", "name").distinct().orderBy("id").limit(limit)


def expansion(nodes: DataFrame, edges: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """(name) that the edges of the query's entities lead to, for a lexical query."""
    hit = query_entities(nodes, query).select(F.col("id").alias("source_id"))
    to = edges.join(F.broadcast(hit), "source_id", "left_semi").select(F.col("target_id").alias("id"))  # ten nodes
    return nodes.join(to.distinct(), "id", "left_semi").select("name").distinct().orderBy("name").limit(limit)


def memify_groups(nodes: DataFrame) -> DataFrame:
    """(kind, key, n): nodes of one name, case and space aside, from two on; of one type from three on."""
    names = nodes.groupBy(F.lower(F.trim("name")).alias("key")).agg(F.count("*").alias("n")).where("n >= 2 and key <> ''")
    kinds = nodes.groupBy(F.col("type").alias("key")).agg(F.count("*").alias("n")).where("n >= 3 and key <> ''")
    return names.select(F.lit("name").alias("kind"), "key", "n").union(kinds.select(F.lit("type").alias("kind"), "key", "n"))


def vsa_rerank(candidates: DataFrame, query: str) -> DataFrame:
    """``candidates(id, similarity, confidence, text)``: plus a quarter at most for the query's words in the text, and .03 for confidence."""
    from .routes import name_tokens

    overlap = F.size(F.array_intersect(name_tokens(F.lit(query)), name_tokens(F.col("text"))))
    score = F.col("similarity") + F.least(F.lit(0.25), 0.12 * overlap) + 0.03 * F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0))
    return candidates.withColumn("score", score).orderBy(F.round("score", 9).desc(), "id")
