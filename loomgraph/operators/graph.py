"""Property-graph operators over nodes(id, ...) and edges(id, source_id, target_id, relation, ...)."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.store import written


def deduplicate_nodes(nodes: DataFrame) -> DataFrame:
    """First by ``pos`` of each id."""
    w = Window.partitionBy("id").orderBy("pos")
    return nodes.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def deduplicate_edges(edges: DataFrame) -> DataFrame:
    """First by ``pos`` of each unseparated source + relation + target (such keys may collide)."""
    w = Window.partitionBy(F.concat("source_id", "relation", "target_id")).orderBy("pos")
    return edges.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def triplets(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, text) 'source -› relation -› target' of edges with both ends and a relation; texts are text, name or description."""
    label = F.coalesce(F.nullif("text", F.lit("")), F.nullif("name", F.lit("")), F.col("description"), F.lit(""))
    n = nodes.select("id", label.alias("label"))
    a, b = n.toDF("source_id", "source_label"), n.toDF("target_id", "target_label")
    rows = edges.where("coalesce(relation, '') <> ''").join(a, "source_id").join(b, "target_id")
    middle = F.coalesce(F.nullif("edge_text", F.lit("")), F.col("relation"))
    return rows.select("id", "source_id", "relation", "target_id", F.concat_ws(" -› ", "source_label", middle, "target_label").alias("text"))


def active(edges: DataFrame, now: Column) -> DataFrame:
    return edges.where(F.col("valid_until").isNull() | (F.col("valid_until") > now))


def visible_at(edges: DataFrame, at: Column | None) -> DataFrame:
    """Edges begun by ``at`` and not over before it, both ends included; None: all."""
    if at is None:
        return edges
    return edges.where((F.col("valid_from").isNull() | (F.col("valid_from") <= at)) & (F.col("valid_until").isNull() | (F.col("valid_until") >= at)))


def entity_at(edges: DataFrame, at: Column) -> DataFrame:
    """As ``visible_at``, but the end is excluded."""
    return edges.where((F.col("valid_from").isNull() | (F.col("valid_from") <= at)) & (F.col("valid_until").isNull() | (F.col("valid_until") > at)))


def endpoints(edges: DataFrame) -> DataFrame:
    """(id, edge): each edge at each of its ends; a self-loop once."""
    return edges.select(F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("id"), F.col("id").alias("edge"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree): an equi-join over both ends rather than a join on either."""
    d = endpoints(edges).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.select("id").join(d, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(endpoints(edges).select("id").distinct(), "id", "left_anti")


def neighbours(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, id) distinct, of ``seeds(seed)``, either direction."""
    out = edges.join(seeds, edges.source_id == seeds.seed).select("seed", F.col("target_id").alias("id"))
    back = edges.join(seeds, edges.target_id == seeds.seed).select("seed", F.col("source_id").alias("id"))
    return out.union(back).distinct()


def subgraph(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ``ids(id)``: two semi-joins."""
    i = ids.select("id").distinct()
    return edges.join(i.toDF("source_id"), "source_id", "left_semi").join(i.toDF("target_id"), "target_id", "left_semi").select(edges.columns)


def both_ways(edges: DataFrame) -> DataFrame:
    e = edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), "relation")
    return e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "relation"))


def n_hop(edges: DataFrame, start: str, hops: int, limit: int = 100) -> DataFrame:
    """(source, relation, target, hop): edges in the direction they are walked from ``start``, breadth first.

    One join per hop with the nodes that are new, written between hops; hops are held to 1..8.
    """
    walk = written(both_ways(edges), "walk")
    spark = edges.sparkSession
    front = spark.range(1).select(F.lit(start).alias("a"))
    seen, out, hops = front, None, min(max(hops, 1), 8)
    for hop in range(1, hops + 1):
        step = walk.join(front, "a").select(F.col("a").alias("source"), "relation", F.col("b").alias("target"), F.lit(hop).cast("long").alias("hop"))
        out = step if out is None else out.union(step)
        if hop == hops:
            break
        front = written(step.select(F.col("target").alias("a")).distinct().join(seen, "a", "left_anti"), "front")
        seen = seen.union(front)
    first = out.groupBy("source", "relation", "target").agg(F.min("hop").alias("hop"))
    return first.orderBy("hop", "source", "relation", "target").limit(limit)


def shortest_path_edges(edges: DataFrame, start: str, end: str, hops: int = 4) -> DataFrame:
    """(source, relation, target) of all shortest paths, as walked: distances from both ends, level by level."""
    hops = 4 if hops <= 0 else min(hops, 8)
    walk = written(both_ways(edges).distinct(), "walk")
    far, near = _levels(walk, start, hops, "from_start"), _levels(walk, end, hops, "to_end")
    best = far.join(near, "id").agg(F.min(F.col("from_start") + F.col("to_end")).alias("d")).where(f"d <= {hops}")
    on = walk.join(far.withColumnRenamed("id", "a"), "a").join(near.withColumnRenamed("id", "b"), "b").crossJoin(best)
    return on.where("from_start + to_end + 1 = d").select(F.col("a").alias("source"), "relation", F.col("b").alias("target")).distinct()


def _levels(walk, start, hops, name):
    front = walk.sparkSession.range(1).select(F.lit(start).alias("id"), F.lit(0).alias(name))
    seen = front
    for level in range(1, hops + 1):
        front = walk.join(front.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        front = written(front.withColumn(name, F.lit(level)), "front")
        seen = seen.union(front)
    return seen


def supersede(edges: DataFrame, exclusive) -> DataFrame:
    """Of an exclusive relation, a later edge of one source (and dataset) ends the one before it.

    valid_until becomes the later edge's valid_from and superseded_by its id.
    """
    w = Window.partitionBy("dataset_id", "source_id", F.lower("relation")).orderBy("valid_from", "id")
    only = F.lower(F.col("relation")).isin([r.lower() for r in exclusive])
    return edges.withColumn("superseded_by", F.when(only, F.lead("id").over(w))).withColumn("valid_until", F.when(only, F.coalesce(F.lead("valid_from").over(w), F.col("valid_until"))).otherwise(F.col("valid_until")))


# fixed values: relations of which a source has one target at a time
EXCLUSIVE = ("assigned_to", "role_is", "status_is", "located_in", "lives_in", "works_at", "owns", "reports_to", "current_state", "is_a")


def upsert_in_time(edges: DataFrame, new: DataFrame, now: Column, exclusive=EXCLUSIVE) -> DataFrame:
    """``edges`` after ``new(..., pos)`` have been written one after another at ``now``, with ``superseded_by``.

    An edge replaces the one of its id.  One of an exclusive relation ends every edge of its source, relation
    and dataset that has no end yet: what was there by the first new one that is another edge, a new one
    by the next.
    """
    kept = edges.withColumn("superseded_by", F.col("superseded_by") if "superseded_by" in edges.columns else F.lit(None).cast("string"))
    ends = kept.select("id", F.col("valid_until").alias("_until"), F.col("superseded_by").alias("_by"), F.lit(True).alias("_old"))
    last = new.groupBy("id").agg(F.max("pos").alias("pos"))
    rows = new.drop("valid_until", "superseded_by").join(last, ["id", "pos"], "left_semi").join(ends, "id", "left")
    rows = rows.withColumn("valid_until", F.col("_until")).withColumn("superseded_by", F.col("_by")).drop("_until", "_by")
    both = kept.join(last.select("id"), "id", "left_anti").withColumns({"pos": F.lit(None).cast("long"), "_old": F.lit(True)}).unionByName(rows.withColumn("pos", F.col("pos").cast("long")))
    key = ["dataset_id", "source_id", "relation"]
    only = F.lower("relation").isin([r.lower() for r in exclusive])
    # the new edges of a key in order: each one's successor, and the first two of all
    fresh = both.where(only & F.col("pos").isNotNull())
    after = fresh.select("id", F.lead("id").over(Window.partitionBy(*key).orderBy("pos", "id")).alias("_next"))
    first = fresh.groupBy(*key).agg(F.min_by("id", F.struct("pos", "id")).alias("_first"))
    found = both.join(after, "id", "left").join(first, key, "left")
    by = F.when(~only, F.lit(None)).when(F.coalesce("_old", F.lit(False)), F.when(F.col("_first") != F.col("id"), F.col("_first")).otherwise(F.col("_next"))).otherwise(F.col("_next"))
    hit = F.col("valid_until").isNull() & by.isNotNull()
    out = found.withColumn("superseded_by", F.when(hit, by).otherwise(F.col("superseded_by"))).withColumn("valid_until", F.when(hit, now).otherwise(F.col("valid_until")))
    return out.select(*kept.columns)


def prune(nodes: DataFrame, edges: DataFrame, now: Column, days: int = 90, drop_orphans: bool = True):
    """(nodes, edges) without edges over for ``days``, and without nodes then unconnected."""
    kept = edges.where(F.col("valid_until").isNull() | (F.col("valid_until") >= now - F.make_dt_interval(F.lit(days))))
    if not drop_orphans:
        return nodes, kept
    return nodes.join(endpoints(kept).select("id").distinct(), "id", "left_semi"), kept


def community_graph(edges: DataFrame) -> DataFrame:
    """(a, b, weight), a < b: undirected, parallel edges summed, self-loops left out; confidence of 0 or less is 1."""
    w = F.when(F.coalesce("confidence", F.lit(0.0)) <= 0, 1.0).otherwise(F.col("confidence"))
    rows = edges.where("source_id <> target_id").select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b"), w.alias("w"))
    return rows.groupBy("a", "b").agg(F.sum("w").alias("weight"))


def modularity(graph: DataFrame, partition: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Modularity of ``partition(id, community)`` over ``graph(a, b, weight)``."""
    p = partition.select("id", "community").hint("merge")  # as many rows as nodes
    ends = graph.join(p.toDF("a", "ca"), "a").join(p.toDF("b", "cb"), "b")
    inside = ends.where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.sum("weight").alias("inner"))
    total = ends.select(F.explode(F.array("ca", "cb")).alias("community"), "weight").groupBy("community").agg(F.sum("weight").alias("tot"))
    m = graph.agg(F.sum("weight").alias("m"))
    each = total.join(inside, "community", "left").crossJoin(m)
    return each.agg(F.sum(F.coalesce("inner", F.lit(0.0)) / F.col("m") - resolution * F.pow(F.col("tot") / (2 * F.col("m")), 2)).alias("modularity"))


def label_moves(graph: DataFrame, rounds: int = 5, start: DataFrame | None = None) -> DataFrame:
    """(id, community) by synchronous moves to the heaviest neighbouring label, for graphs of any size.

    ``start(id, community)`` is where known nodes begin, others alone.
    """
    walk = graph.select("a", "b", "weight").union(graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    labels = walk.select(F.col("a").alias("id")).distinct().withColumn("community", F.col("id"))
    if start is not None:
        labels = labels.join(start.select("id", F.col("community").alias("_c")), "id", "left").select("id", F.coalesce("_c", "community").alias("community"))
    for r in range(rounds):
        votes = walk.join(labels.hint("merge").select(F.col("id").alias("b"), "community"), "b").groupBy("a", "community").agg(F.sum("weight").alias("w"))
        best = votes.groupBy(F.col("a").alias("id")).agg(F.max_by("community", F.struct("w", "community")).alias("new"))
        stay = F.pmod(F.xxhash64("id", F.lit(r)), F.lit(2)) == 0  # half move at a time: no endless swaps
        labels = written(labels.join(best.hint("merge"), "id").select("id", F.when(stay, F.col("community")).otherwise(F.col("new")).alias("community")), "labels")
    return labels


def greedy_dedup(pairs: DataFrame) -> DataFrame:
    """(removed, kept) from pairs (a, b, score), a before b: b goes when a kept earlier one is similar.

    Rounds: a node all of whose earlier neighbours are decided is decided; the kept one with
    the best score is its match.  As many rounds as the longest chain of dependence.
    """
    todo = written(pairs.select("a", "b", "score"), "greedy-pairs")
    nodes = todo.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    state = written(nodes.withColumn("kept", F.lit(None).cast("boolean")), "greedy")
    while True:
        known = todo.join(state.select(F.col("id").alias("a"), F.col("kept").alias("a_kept")), "a")
        verdict = known.groupBy(F.col("b").alias("id")).agg(F.max(F.coalesce("a_kept", F.lit(False))).alias("hit"), F.max(F.col("a_kept").isNull()).alias("open"))
        new = state.join(verdict, "id", "left").select(
            "id", F.coalesce("kept", F.expr("case when hit then false when coalesce(open, false) then null else true end")).alias("kept")
        )
        new = written(new, "greedy")
        left = new.where("kept is null").count()
        state = new
        if not left:
            break
    kept = state.where("kept").select(F.col("id").alias("a"))
    gone = state.where("not kept").select(F.col("id").alias("b"))
    return todo.join(kept, "a", "left_semi").join(gone, "b", "left_semi").groupBy(F.col("b").alias("removed")).agg(F.max_by("a", F.struct("score", -F.col("a"))).alias("kept"))


#: rows of the first round of ``greedy_dedup_vectors``; each later one takes as many as all before it
FIRST = 8192


def greedy_dedup_vectors(vectors: DataFrame, least: float, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """(removed, kept) as ``greedy_dedup`` finds them in all pairs of cosine >= least, in order of id; the pairs are never all made.

    A round takes the next rows by id, drops those that a row kept before is similar to, and compares
    what is left among itself.  So rows are compared with kept ones, and pairs of a round with each other.
    """
    from .vector import best_earlier, exact_pairs

    rows = vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    n, low = rows.agg(F.count("*"), F.min("id")).first()
    shares = [FIRST * 2**k / n for k in range(64) if n and FIRST * 2**k < n]
    ends = [int(x) for x in rows.approxQuantile("id", shares, 0.1 * shares[0])] if shares else []  # any ends will do
    kept, after = None, (low or 0) - 1
    for end in [*sorted(set(ends)), None]:
        part = rows.where(F.col("id") > after) if end is None else rows.where((F.col("id") > after) & (F.col("id") <= end))
        if kept is not None:
            part = part.join(best_earlier(kept, part, least).select(F.col("b").alias("id")), "id", "left_anti")
        part = written(part, "greedy-part")
        gone = greedy_dedup(exact_pairs(part, least, vec_col="v")).select(F.col("removed").alias("id"))
        new = part.join(gone, "id", "left_anti")
        kept = written(new if kept is None else kept.unionByName(new), "greedy-kept")
        after = after if end is None else end
    rest = rows.join(kept.select("id"), "id", "left_anti")
    # what was similar once is so in a product of another shape, whose sums can differ in the last place
    return best_earlier(kept, rest, least - 1e-12).select(F.col("b").alias("removed"), F.col("a").alias("kept"))


def remap_edges(edges: DataFrame, merged: DataFrame) -> DataFrame:
    """Edges whose removed ends are replaced by the kept nodes of ``merged(removed, kept)``; nothing is deduplicated again."""
    a, b = merged.toDF("source_id", "_s"), merged.toDF("target_id", "_t")
    rows = edges.join(a, "source_id", "left").join(b, "target_id", "left")
    fixed = rows.withColumn("source_id", F.coalesce("_s", "source_id")).withColumn("target_id", F.coalesce("_t", "target_id"))
    return fixed.select(edges.columns)


def has_cycle(edges: DataFrame) -> bool:
    """Whether ``edges(a, b)``, b depends on a, hold a cycle: ends without incoming edges are peeled off."""
    left = written(edges.select("a", "b").distinct(), "peel")
    n = left.count()
    while n:
        ready = left.select("a").distinct().join(left.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        left = written(left.join(ready, "a", "left_anti"), "peel")
        m = left.count()
        if m == n:
            return True
        n = m
    return False


def community_lookup(members: DataFrame, asked: DataFrame) -> DataFrame:
    """(node, community, members): the communities of ``asked(node)`` in ``members(community, node)``, with their sizes."""
    sizes = members.groupBy("community").agg(F.count("*").alias("members"))
    return asked.join(members, "node").join(sizes, "community").select("node", "community", "members")


def community_levels(members: DataFrame, least: int = 3) -> DataFrame:
    """(parent, community, member_count) of the communities with ``least`` members or more of ``members(parent, community, node)``."""
    return members.groupBy("parent", "community").agg(F.count("*").alias("member_count")).where(F.col("member_count") >= least)


def n_hop_names(nodes: DataFrame, edges: DataFrame, name: str, hops: int, limit: int = 100) -> DataFrame:
    """(source, relation, target): directed edges within ``hops`` of a name, joined by name, the first by source; a step a frontier of names."""
    named = nodes.select("id", "name")
    a, b = named.toDF("source_id", "source"), named.toDF("target_id", "target")
    walk = written(edges.select("source_id", "relation", "target_id").join(a, "source_id").join(b, "target_id").select("source", "relation", "target").distinct(), "walk")
    at, seen = walk.sparkSession.range(1).select(F.lit(name).alias("source")), None
    for _ in range(min(max(hops, 1), 8)):
        step = walk.join(at, "source", "left_semi")
        seen = step if seen is None else seen.union(step).distinct()
        at = step.select(F.col("target").alias("source")).distinct()
    return seen.orderBy("source", "relation", "target").limit(limit)


def cyclic_plans(steps: DataFrame) -> DataFrame:
    """(plan, cyclic) of ``steps(plan, a, b)``: a plan has a cycle if steps stay when those without a predecessor go, again and again."""
    left = written(steps.select("plan", "a", "b").distinct(), "steps")
    size = left.count()
    while size:
        left = written(left.join(left.select("plan", F.col("b").alias("a")).distinct(), ["plan", "a"], "left_semi"), "steps")
        now = left.count()
        if now == size:
            break
        size = now
    return steps.select("plan").distinct().join(left.select("plan").distinct().withColumn("cyclic", F.lit(True)), "plan", "left").select("plan", F.coalesce("cyclic", F.lit(False)).alias("cyclic"))


def upsert_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with ``new`` in place of those of equal id (source_relation_target where it has none); the earliest valid_from stays."""
    named = new.withColumn("id", F.coalesce(F.nullif("id", F.lit("")), F.concat_ws("_", "source_id", "relation", "target_id")))
    both = edges.withColumn("_seq", F.lit(1)).unionByName(named.withColumn("_seq", F.lit(2)))
    rest = [c for c in edges.columns if c not in ("id", "valid_from")]
    each = both.groupBy("id").agg(F.max_by(F.struct(*rest), "_seq").alias("_r"), F.min("valid_from").alias("valid_from"))
    return each.select("id", *[F.col(f"_r.{c}").alias(c) for c in rest], "valid_from").select(*edges.columns)


def triplet_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes and edges after deduplication, triplets made, edges skipped for a missing end or relation."""
    n, e = deduplicate_nodes(nodes), deduplicate_edges(edges)
    made = triplets(n, e).agg(F.count("*").alias("triplets"))
    return n.agg(F.count("*").alias("nodes")).crossJoin(e.agg(F.count("*").alias("edges"))).crossJoin(made).withColumn("skipped", F.col("edges") - F.col("triplets"))  # one row each
