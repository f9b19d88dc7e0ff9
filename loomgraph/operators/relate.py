"""Joins between the engine's tables.  An edge's two ends are two equi-joins, never an OR."""

from pyspark.sql import Column, DataFrame, functions as F


def named_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, relation, source, source_type, source_dataset, target, target_type, target_dataset) of edges with both ends."""
    end = lambda s: nodes.select(F.col("id").alias(f"{s}_id"), F.col("name").alias(s), F.col("type").alias(f"{s}_type"), F.col("dataset_id").alias(f"{s}_dataset"))
    return edges.select("id", "relation", "source_id", "target_id").join(end("source"), "source_id").join(end("target"), "target_id").drop("source_id", "target_id")


def graph_rows(nodes: DataFrame, edges: DataFrame, names: Column, allowed=None, skip_relations=("HAPPENED_AT",), skip_types=("TemporalEvent",), limit: int = 50) -> DataFrame:
    """(id, source, relation, target) for sources that meet ``names``, both ends in allowed datasets, by edge id."""
    rows = named_edges(nodes, edges).where(names & ~F.col("relation").isin(*skip_relations) & ~F.col("source_type").isin(*skip_types) & ~F.col("target_type").isin(*skip_types))
    if allowed is not None:
        for c in ("source_dataset", "target_dataset"):
            rows = rows.where((F.coalesce(c, F.lit("")) == "") | F.col(c).isin(*allowed))
    return rows.select("id", "source", "relation", "target").orderBy("id").limit(limit)


def code_rules(nodes: DataFrame, edges: DataFrame, verbs: dict, limit: int = 100) -> DataFrame:
    """(rule) 'source verb target', each triple once; relations without a verb read as they are."""
    verb = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in verbs.items() for x in pair]), F.upper("relation")), F.lower(F.replace("relation", F.lit("_"), F.lit(" "))))
    rows = named_edges(nodes, edges).select("source", "relation", "target").distinct()
    return rows.select(F.concat_ws(" ", "source", verb, "target").alias("rule")).distinct().orderBy("rule").limit(limit)


def events_with_entities(events: DataFrame, edges: DataFrame, nodes: DataFrame, relation: str = "HAPPENED_AT") -> DataFrame:
    """(event, edge, entity): every event, with the entities it happened to, if any."""
    to = edges.where(F.col("relation") == relation).select(F.col("source_id").alias("event"), F.col("id").alias("edge"), F.col("target_id").alias("_to"))
    return events.select(F.col("id").alias("event")).join(to, "event", "left").join(nodes.select(F.col("id").alias("_to"), F.col("name").alias("entity")), "_to", "left").select("event", "edge", "entity")


def taxonomy(domains: DataFrame, collections: DataFrame, documents: DataFrame) -> DataFrame:
    """Domains with their collections with their documents, each optional, in one owner and dataset throughout."""
    key = ["domain_id", "owner_id", "dataset_id"]
    return domains.join(collections, key, "left").join(documents, [*key, "collection_id"], "left")


def edge_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, type, edges): edges at either end of each node; a self loop counts once."""
    ends = edges.select(F.col("source_id").alias("_end"), "id").union(edges.where("source_id <> target_id").select("target_id", "id"))
    counts = ends.groupBy("_end").agg(F.count("*").alias("edges"))  # combined before the shuffle
    return nodes.join(counts, nodes.id == counts._end, "left").select(nodes.id, "type", F.coalesce("edges", F.lit(0)).alias("edges"))


def unmatched(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Rows whose key is nowhere in ``others``."""
    return rows.join(others.select(key).distinct(), key, "left_anti")


def matched(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    return rows.join(others.select(key).distinct(), key, "left_semi")


def reconcile(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """(collection, id, state) of ids(collection, id) on one side only: missing from the vectors, or orphans there.

    Only collections that have rows are looked at.
    """
    key = ["collection", "id"]
    here = vectors.join(rows.select("collection").distinct(), "collection", "left_semi")
    a, b = rows.select(*key).distinct().withColumn("_a", F.lit(1)), here.select(*key).distinct().withColumn("_b", F.lit(1))
    return a.join(b, key, "full_outer").where("_a is null or _b is null").select(*key, F.when(F.col("_b").isNull(), "missing").otherwise("orphan").alias("state"))


def hydrate(ranked: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``rows`` of the ranked ids, in the order of their rank."""
    return ranked.join(rows, key).orderBy("rank", key)


def parents(children: DataFrame, main: DataFrame, k: int) -> DataFrame:
    """The first ``k`` parents, in the order of ``main(id, rank)``, of the best children ``(parent_id, rank)``.

    Of 3k children, ten at least, the first k distinct parents count; those that the main search
    didn't find are left out.
    """
    few = children.orderBy("rank").limit(max(3 * k, 10)).where("coalesce(parent_id, '') <> ''")
    wanted = few.groupBy("parent_id").agg(F.min("rank").alias("_first")).orderBy("_first").limit(k)
    return main.join(wanted.select(F.col("parent_id").alias("id")), "id", "left_semi").orderBy("rank").limit(k)


def distances(items: DataFrame, found: DataFrame, penalty: float) -> DataFrame:
    """``items(id)`` with the least distance found for each, ``penalty`` at most."""
    best = found.groupBy("id").agg(F.min("distance").alias("_d"))
    return items.join(best, "id", "left").withColumn("distance", F.least(F.coalesce("_d", F.lit(penalty)), F.lit(penalty))).drop("_d")


def member_facts(members: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(edge_id, name, relation, target_id): what stands behind the members of symbolic shards, gaps as nulls."""
    n, e = nodes.select(F.col("id").alias("source_id"), "name"), edges.select(F.col("id").alias("edge_id"), "relation", "target_id")
    return members.select("edge_id", "source_id").join(n, "source_id", "left").join(e, "edge_id", "left").select("edge_id", "name", "relation", "target_id")


def internal_edges(edges: DataFrame, members: DataFrame, limit: int = 30) -> DataFrame:
    """Edges with both ends among ``members(id)``, by id."""
    ends = members.select("id").distinct()
    inside = edges.join(ends.toDF("source_id"), "source_id", "left_semi").join(ends.toDF("target_id"), "target_id", "left_semi")
    return inside.orderBy("id").limit(limit)
