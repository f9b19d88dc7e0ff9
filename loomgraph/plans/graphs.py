"""Graph queries over the derived property graph."""

from pyspark.sql import Window, functions as F

from ..operators import communities, components as cc
from ..operators import graph, graphrank, strategies, traverse, vector
from ..registry import query
from .base import GRAPH, graph_edges, graph_nodes, table
from .retrieval import COS, vectors

NOW = "TIMESTAMP '1997-06-01'"


def now():
    return F.expr("timestamp_ntz'1997-06-01 00:00:00'")


def G(sql):
    return f"WITH RECURSIVE {GRAPH} {sql}"


@query("graph_read", G("SELECT id, source_id, relation, target_id, valid_from, valid_until FROM edges"))
def graph_read(spark, sf):
    return graph_edges(spark, sf).select("id", "source_id", "relation", "target_id", "valid_from", "valid_until")


@query("graph_nodes_by_type", G("SELECT type, count(*) AS n FROM nodes GROUP BY type"))
def graph_nodes_by_type(spark, sf):
    return graph_nodes(spark, sf).groupBy("type").agg(F.count("*").alias("n"))


@query("graph_neighbours", G(f""", seeds AS (SELECT 'n' || n_nationkey AS seed FROM nation WHERE n_nationkey < 3), act AS (SELECT * FROM edges WHERE valid_until IS NULL OR valid_until > {NOW})
SELECT seed, target_id AS id FROM act JOIN seeds ON source_id = seed UNION SELECT seed, source_id FROM act JOIN seeds ON target_id = seed"""))
def graph_neighbours(spark, sf):
    seeds = spark.range(3).select(F.concat(F.lit("n"), F.col("id")).alias("seed"))
    return graph.neighbours(graph.active(graph_edges(spark, sf), now()), seeds)


@query("graph_subgraph", G(""", ids AS (SELECT id FROM nodes WHERE type IN ('Nation', 'Region')) SELECT id, source_id, target_id, relation FROM edges WHERE source_id IN (SELECT id FROM ids) AND target_id IN (SELECT id FROM ids)"""))
def graph_subgraph(spark, sf):
    ids = graph_nodes(spark, sf).where("type in ('Nation', 'Region')").select("id")
    return graph.subgraph(graph_edges(spark, sf), ids).select("id", "source_id", "target_id", "relation")


@query("edges_as_of", G("SELECT id, source_id, target_id FROM edges WHERE relation = 'PREFERS' AND valid_from <= TIMESTAMP '1995-03-15' AND (valid_until IS NULL OR valid_until >= TIMESTAMP '1995-03-15')"))
def edges_as_of(spark, sf):
    at = F.expr("timestamp_ntz'1995-03-15 00:00:00'")
    return graph.visible_at(graph_edges(spark, sf).where("relation = 'PREFERS'"), at).select("id", "source_id", "target_id")


@query("entity_as_of", G("SELECT e.id, source_id, target_id FROM edges e WHERE (source_id IN (SELECT id FROM nodes WHERE name = 'Customer#000000007') OR target_id IN (SELECT id FROM nodes WHERE name = 'Customer#000000007') OR source_id = 'c7') AND (valid_from IS NULL OR valid_from <= TIMESTAMP '1996-01-01') AND (valid_until IS NULL OR valid_until > TIMESTAMP '1996-01-01')"))
def entity_as_of(spark, sf):
    """An entity's edges at a time, by name or id; the end of validity is excluded."""
    ids = graph_nodes(spark, sf).where("name = 'Customer#000000007' or id = 'c7'").select("id")
    e = graph.entity_at(graph_edges(spark, sf), F.expr("timestamp_ntz'1996-01-01 00:00:00'"))
    sides = e.join(ids, e.source_id == ids.id, "left_semi").union(e.join(ids, e.target_id == ids.id, "left_semi"))
    return sides.select("id", "source_id", "target_id").distinct()


@query("active_edges", G(f"SELECT relation, count(*) AS n FROM edges WHERE valid_until IS NULL OR valid_until > {NOW} GROUP BY relation"))
def active_edges(spark, sf):
    return graph.active(graph_edges(spark, sf), now()).groupBy("relation").agg(F.count("*").alias("n"))


@query("node_degree", G(", ends AS (SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges WHERE target_id <> source_id) SELECT n.id, count(e.id) AS degree FROM nodes n LEFT JOIN ends e ON e.id = n.id GROUP BY n.id"))
def node_degree(spark, sf):
    return graph.degrees(graph_nodes(spark, sf), graph_edges(spark, sf))


@query("orphan_nodes", G("SELECT id FROM nodes n WHERE NOT EXISTS (SELECT * FROM edges e WHERE e.source_id = n.id OR e.target_id = n.id) AND type <> 'X'"))
def orphan_nodes(spark, sf):
    return graph.orphans(graph_nodes(spark, sf), graph_edges(spark, sf)).select("id")


@query("graph_connectivity", G(", ends AS (SELECT source_id AS id FROM edges UNION SELECT target_id FROM edges) SELECT count(*) AS nodes, count(*) FILTER (id NOT IN (SELECT id FROM ends)) AS orphans FROM nodes"))
def graph_connectivity(spark, sf):
    n, e = graph_nodes(spark, sf), graph_edges(spark, sf)
    return n.agg(F.count("*").alias("nodes")).crossJoin(graph.orphans(n, e).agg(F.count("*").alias("orphans")))


@query("triplets", G("SELECT e.id, a.name || ' -› ' || relation || ' -› ' || b.name AS text FROM edges e JOIN nodes a ON a.id = source_id JOIN nodes b ON b.id = target_id"))
def triplets(spark, sf):
    n = graph_nodes(spark, sf).withColumn("text", F.lit("")).withColumn("description", F.lit(""))
    e = graph_edges(spark, sf).withColumn("edge_text", F.lit(""))
    return graph.triplets(n, e).select("id", "text")


@query("graph_dedup", G(""", d AS (SELECT *, 1 AS pos FROM edges UNION ALL SELECT 'x' || id, source_id, target_id, relation, dataset_id, confidence, valid_from, valid_until, 2 FROM edges WHERE relation <> 'PREFERS'),
k AS (SELECT *, row_number() OVER (PARTITION BY source_id || relation || target_id ORDER BY pos, id) AS n FROM d) SELECT id, source_id, target_id FROM k WHERE n = 1"""))
def graph_dedup(spark, sf):
    e = graph_edges(spark, sf)
    again = e.where("relation <> 'PREFERS'").withColumn("id", F.concat(F.lit("x"), "id"))
    both = e.withColumn("pos", F.struct(F.lit(1), F.col("id"))).union(again.withColumn("pos", F.struct(F.lit(2), F.col("id"))))
    return graph.deduplicate_edges(both).select("id", "source_id", "target_id")


@query("graph_upsert", G(""", up AS (SELECT * REPLACE (0.5::DOUBLE AS confidence, TIMESTAMP '2000-01-01' AS valid_from) FROM edges WHERE relation = 'PREFERS' AND hash(id) >= 0 AND source_id LIKE 'c1%'),
al AS (SELECT *, 1 AS seq FROM edges UNION ALL SELECT *, 2 FROM up) SELECT id, arg_max(confidence, seq) AS confidence, min(valid_from) AS valid_from FROM al GROUP BY id"""))
def graph_upsert(spark, sf):
    """Later rows replace earlier ones by id, the first valid_from stays."""
    e = graph_edges(spark, sf)
    new = e.where("relation = 'PREFERS' and source_id like 'c1%'").withColumn("confidence", F.lit(0.5)).withColumn("valid_from", F.expr("timestamp_ntz'2000-01-01 00:00:00'"))
    return graph.upsert_edges(e, new).select("id", "confidence", "valid_from")


@query("process_triplets", G(""", d AS (SELECT DISTINCT source_id, CASE WHEN relation = 'BASED_IN' THEN '' ELSE relation END AS r, target_id FROM edges) SELECT (SELECT count(*) FROM nodes WHERE type <> 'Region') AS nodes, count(*) AS edges,
count(*) FILTER (r <> '' AND source_id NOT LIKE 'r%' AND target_id NOT LIKE 'r%') AS triplets, count(*) FILTER (r = '' OR source_id LIKE 'r%' OR target_id LIKE 'r%') AS skipped FROM d"""))
def process_triplets(spark, sf):
    """Regions are unknown and one relation is empty: such edges are skipped."""
    n = graph_nodes(spark, sf).where("type <> 'Region'").withColumns({"pos": F.lit(1), "text": F.lit(""), "description": F.lit("")})
    e = graph_edges(spark, sf).withColumns({"pos": F.col("id"), "edge_text": F.lit("")}).withColumn("relation", F.expr("if(relation = 'BASED_IN', '', relation)"))
    return graph.triplet_counts(n, e)


@query("incremental_communities")
def incremental_communities(spark, sf):
    """Nations are the known communities; a tenth of the customers are new."""
    g = graph.community_graph(graph_edges(spark, sf))
    known = graph_edges(spark, sf).where("relation in ('LIVES_IN', 'BASED_IN') and source_id not like 'c%7'").select(F.col("source_id").alias("id"), F.col("target_id").alias("community"))
    return communities.incremental(g, known).withColumn("modularity", F.round("modularity", 9))


NHOP = """, walk AS (SELECT source_id AS a, relation, target_id AS b FROM edges UNION SELECT target_id, relation, source_id FROM edges),
lv AS (SELECT 'r0' AS id, 0 AS d UNION SELECT b, d + 1 FROM lv JOIN walk ON a = id WHERE d < 2), dist AS (SELECT id, min(d) AS d FROM lv GROUP BY id)
SELECT a AS source, relation, b AS target, (d + 1)::BIGINT AS hop FROM walk JOIN dist ON a = id WHERE d < 2 ORDER BY hop, source, relation, target LIMIT 100"""


@query("n_hop", G(NHOP))
def n_hop(spark, sf):
    return graph.n_hop(graph_edges(spark, sf), "r0", 2)


@query("n_hop_directed", G(", w AS (SELECT DISTINCT a.name AS s, e.relation AS r, b.name AS t FROM edges e JOIN nodes a ON a.id = e.source_id JOIN nodes b ON b.id = e.target_id), l1 AS (SELECT * FROM w WHERE s = 'Customer#000000001'), l2 AS (SELECT w.* FROM w WHERE s IN (SELECT t FROM l1)), l3 AS (SELECT w.* FROM w WHERE s IN (SELECT t FROM l2)) SELECT s AS source, r AS relation, t AS target FROM l1 UNION SELECT * FROM l2 UNION SELECT * FROM l3"))
def n_hop_directed(spark, sf):
    """A directed walk by names, three hops."""
    return graph.n_hop_names(graph_nodes(spark, sf), graph_edges(spark, sf), "Customer#000000001", 3)


@query("shortest_paths", G(""", walk AS (SELECT source_id AS a, relation, target_id AS b FROM edges UNION SELECT target_id, relation, source_id FROM edges),
f AS (SELECT 'n0' AS id, 0 AS d UNION SELECT b, d + 1 FROM f JOIN walk ON a = id WHERE d < 4), t AS (SELECT 'n5' AS id, 0 AS d UNION SELECT b, d + 1 FROM t JOIN walk ON a = id WHERE d < 4),
fd AS (SELECT id, min(d) AS d FROM f GROUP BY id), td AS (SELECT id, min(d) AS d FROM t GROUP BY id), best AS (SELECT min(fd.d + td.d) AS d FROM fd JOIN td USING (id))
SELECT a AS source, relation, b AS target FROM walk JOIN fd ON fd.id = a JOIN td ON td.id = b, best WHERE fd.d + td.d + 1 = best.d"""))
def shortest_paths(spark, sf):
    return graph.shortest_path_edges(graph_edges(spark, sf), "n0", "n5")


SEEDS = "SELECT 'n' || n_nationkey AS seed FROM nation UNION ALL SELECT 'c' || c_custkey FROM customer WHERE c_custkey % 50 = 7"


def _seeds(spark, sf):
    return table(spark, sf, "nation").selectExpr("concat('n', n_nationkey) as seed").union(table(spark, sf, "customer").where("c_custkey % 50 = 7").selectExpr("concat('c', c_custkey)"))


@query("distances_from_many", G(f""", walk AS MATERIALIZED (SELECT source_id AS a, target_id AS b FROM edges UNION SELECT target_id, source_id FROM edges), s AS ({SEEDS}),
d0 AS MATERIALIZED (SELECT seed, seed AS id FROM s), d1 AS MATERIALIZED (SELECT DISTINCT seed, b AS id FROM d0 JOIN walk ON a = id), d2 AS (SELECT DISTINCT seed, b AS id FROM d1 JOIN walk ON a = id)
SELECT seed, id, min(d)::BIGINT AS distance FROM (SELECT *, 0 AS d FROM d0 UNION ALL SELECT *, 1 FROM d1 UNION ALL SELECT *, 2 FROM d2) GROUP BY ALL"""))
def distances_from_many(spark, sf):
    """All nodes within two steps of every nation and of some customers, 64 starts at a time."""
    return traverse.Walk(graph_edges(spark, sf)).distances(_seeds(spark, sf), 2)


@query("paths_between_many", G(""", walk AS MATERIALIZED (SELECT source_id AS a, relation, target_id AS b FROM edges UNION SELECT target_id, relation, source_id FROM edges), st AS MATERIALIZED (SELECT DISTINCT a, b FROM walk),
pr AS (SELECT 'n' || n_nationkey AS s, 'n' || (n_nationkey * 7 + 3) % 25 AS e FROM nation WHERE n_nationkey < 6), ends AS (SELECT s AS x FROM pr UNION SELECT e FROM pr),
l0 AS MATERIALIZED (SELECT x, x AS id FROM ends), l1 AS MATERIALIZED (SELECT DISTINCT x, b AS id FROM l0 JOIN st ON a = id), l2 AS MATERIALIZED (SELECT DISTINCT x, b AS id FROM l1 JOIN st ON a = id),
l3 AS MATERIALIZED (SELECT DISTINCT x, b AS id FROM l2 JOIN st ON a = id), l4 AS MATERIALIZED (SELECT DISTINCT x, b AS id FROM l3 JOIN st ON a = id),
dist AS MATERIALIZED (SELECT x, id, min(d) AS d FROM (SELECT *, 0 AS d FROM l0 UNION ALL SELECT *, 1 FROM l1 UNION ALL SELECT *, 2 FROM l2 UNION ALL SELECT *, 3 FROM l3 UNION ALL SELECT *, 4 FROM l4) GROUP BY ALL),
len AS (SELECT s, e, d AS n FROM pr JOIN dist ON x = s AND id = e WHERE d > 0)
SELECT DISTINCT s AS start, e AS "end", a AS source, relation, b AS target FROM len JOIN dist f ON f.x = s JOIN walk ON a = f.id JOIN dist t ON t.x = e AND t.id = b WHERE f.d + 1 + t.d = n"""))
def paths_between_many(spark, sf):
    """All shortest paths of several pairs of nations in one search."""
    pairs = table(spark, sf, "nation").where("n_nationkey < 6").selectExpr("concat('n', n_nationkey) as start", "concat('n', (n_nationkey * 7 + 3) % 25) as end")
    return traverse.Walk(graph_edges(spark, sf)).paths(pairs)


@query("supersession", G("SELECT id, lead(id) OVER w AS superseded_by, lead(valid_from) OVER w AS valid_until FROM edges WHERE relation = 'PREFERS' WINDOW w AS (PARTITION BY dataset_id, source_id ORDER BY valid_from, id)"))
def supersession(spark, sf):
    raw = graph_edges(spark, sf).where("relation = 'PREFERS'").withColumn("valid_until", F.lit(None).cast("timestamp_ntz"))
    return graph.supersede(raw, ["prefers"]).select("id", "superseded_by", "valid_until")


@query("upsert_in_time", G(""", m AS (SELECT 'c' || c_custkey AS source_id, c_mktsegment AS dataset_id, c_custkey, c_nationkey FROM customer WHERE c_custkey % 5 = 0),
w AS (SELECT 'm1' || c_custkey AS id, 1 AS pos, source_id, 'n' || (c_nationkey + 1) % 25 AS target_id, dataset_id, CASE WHEN c_custkey % 10 = 0 THEN 'm2' || c_custkey END AS follower FROM m
  UNION ALL SELECT 'm2' || c_custkey, 2, source_id, 'n' || (c_nationkey + 2) % 25, dataset_id, NULL FROM m WHERE c_custkey % 10 = 0)
SELECT e.id, e.target_id, coalesce(e.valid_until, CASE WHEN w.id IS NOT NULL THEN TIMESTAMP '1997-06-01' END) AS valid_until, CASE WHEN e.valid_until IS NULL THEN w.id END AS superseded_by FROM edges e LEFT JOIN w ON w.pos = 1 AND e.relation = 'LIVES_IN' AND w.source_id = e.source_id AND w.dataset_id = e.dataset_id
UNION ALL SELECT id, target_id, CASE WHEN follower IS NOT NULL THEN TIMESTAMP '1997-06-01' END, follower FROM w"""))
def upsert_in_time(spark, sf):
    """Every fifth customer moves to another nation, every tenth twice."""
    moved = table(spark, sf, "customer").where("c_custkey % 5 = 0")
    new = None
    for pos, rows in ((1, moved), (2, moved.where("c_custkey % 10 = 0"))):
        one = rows.selectExpr(f"concat('m{pos}', c_custkey) as id", "concat('c', c_custkey) as source_id", f"concat('n', (c_nationkey + {pos}) % 25) as target_id", "'LIVES_IN' as relation", "c_mktsegment as dataset_id", "1.0D as confidence", "timestamp_ntz'1997-06-01 00:00:00' as valid_from", f"{pos} as pos")
        new = one if new is None else new.union(one)
    return graph.upsert_in_time(graph_edges(spark, sf), new, F.expr("timestamp_ntz'1997-06-01 00:00:00'")).select("id", "target_id", "valid_until", "superseded_by")


@query("prune_graph", G(", kept AS (SELECT * FROM edges WHERE valid_until IS NULL OR valid_until >= TIMESTAMP '1997-06-01' - INTERVAL 90 DAY), ends AS (SELECT source_id AS id FROM kept UNION SELECT target_id FROM kept) SELECT 'edges' AS part, count(*) AS n FROM kept UNION ALL SELECT 'nodes', count(*) FROM nodes WHERE id IN (SELECT id FROM ends)"))
def prune_graph(spark, sf):
    n, e = graph.prune(graph_nodes(spark, sf), graph_edges(spark, sf), now())
    return e.agg(F.lit("edges").alias("part"), F.count("*").alias("n")).union(n.agg(F.lit("nodes").alias("part"), F.count("*").alias("n")))


@query("community_graph", G("SELECT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, sum(CASE WHEN confidence <= 0 THEN 1 ELSE confidence END) AS weight FROM edges WHERE source_id <> target_id GROUP BY ALL"))
def community_graph(spark, sf):
    return graph.community_graph(graph_edges(spark, sf))


@query("modularity", G(""", g AS (SELECT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, sum(confidence) AS w FROM edges GROUP BY ALL), m AS (SELECT sum(w) AS m FROM g),
p AS (SELECT id, type AS c FROM nodes), e AS (SELECT x.c AS ca, y.c AS cb, w FROM g JOIN p x ON x.id = a JOIN p y ON y.id = b),
i AS (SELECT ca AS c, sum(w) AS s FROM e WHERE ca = cb GROUP BY ca), t AS (SELECT c, sum(w) AS s FROM (SELECT ca AS c, w FROM e UNION ALL SELECT cb, w FROM e) GROUP BY c)
SELECT round(sum(coalesce(i.s, 0) / m - pow(t.s / (2 * m), 2)), 6) AS modularity FROM t LEFT JOIN i USING (c), m"""))
def modularity(spark, sf):
    g = graph.community_graph(graph_edges(spark, sf))
    parts = graph_nodes(spark, sf).select("id", F.col("type").alias("community"))
    return graph.modularity(g, parts).select(F.round("modularity", 6).alias("modularity"))


@query("louvain")
def louvain(spark, sf):
    return communities.louvain(graph.community_graph(graph.active(graph_edges(spark, sf), now()))).withColumn("modularity", F.round("modularity", 9))


@query("community_quality")
def community_quality(spark, sf):
    """(method, level, communities, modularity) of both ways to find communities over all active edges."""
    g = graph.community_graph(graph.active(graph_edges(spark, sf), now()))
    found = communities.louvain(g)
    each = found.groupBy("level").agg(F.countDistinct("community").alias("communities"), F.max("modularity").alias("modularity")).withColumn("method", F.lit("louvain"))
    moves = graph.label_moves(g)
    size = moves.agg(F.countDistinct("community").alias("communities")).crossJoin(graph.modularity(g, moves))  # one row each
    rows = each.select("method", "level", "communities", "modularity").union(size.select(F.lit("label_moves"), F.lit(0).cast("long"), "communities", "modularity"))
    return rows.withColumn("modularity", F.round("modularity", 9))


@query("community_store", """WITH p AS (SELECT 'c' || c_custkey AS id, c_nationkey AS n FROM customer UNION ALL SELECT 's' || s_suppkey, s_nationkey FROM supplier), l AS (SELECT id, n_nationkey, n_regionkey FROM p JOIN nation ON n_nationkey = n)
SELECT 0::BIGINT AS level, 'n' || n_nationkey AS community, 'r' || min(n_regionkey) AS parent, count(*) AS member_count FROM l GROUP BY n_nationkey UNION ALL SELECT 1, 'r' || n_regionkey, NULL, count(*) FROM l GROUP BY n_regionkey""")
def community_store(spark, sf):
    """Nations and regions as two levels of communities of their people, in place of the customers' segments."""
    n, c = table(spark, sf, "nation"), table(spark, sf, "customer")
    old = c.selectExpr("concat('c', c_custkey) as id", "0L as level", "c_mktsegment as community")
    people = c.selectExpr("concat('c', c_custkey) as id", "c_nationkey as n").union(table(spark, sf, "supplier").selectExpr("concat('s', s_suppkey)", "s_nationkey"))
    each = people.join(n, F.expr("n_nationkey = n"))
    levels = each.selectExpr("id", "0L as level", "concat('n', n_nationkey) as community").union(each.selectExpr("id", "1L", "concat('r', n_regionkey)"))
    return communities.stored(old).replace(levels).communities()


@query("label_moves")
def label_moves(spark, sf):
    return graph.label_moves(graph.community_graph(graph.active(graph_edges(spark, sf), now())))


@query("similarity_components", f"""WITH RECURSIVE s AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE {COS.format('a.embedding', 'b.embedding')} >= 0.35),
r AS (SELECT a AS id, a AS c FROM s UNION SELECT s.b, r.c FROM r JOIN s ON s.a = r.id) SELECT id, min(c) AS component FROM r GROUP BY id""")
def similarity_components(spark, sf):
    return cc.components(vector.linked(vectors(spark, sf), 0.35))


@query("semantic_dedup")
def semantic_dedup(spark, sf):
    """Greedy: a vector goes when a kept earlier one has a higher cosine than the threshold."""
    return graph.greedy_dedup_vectors(vectors(spark, sf), 0.35)


@query("lsh_dedup", f"""WITH v AS (SELECT vec_id AS id, embedding FROM embeddings UNION ALL SELECT vec_id + 1000000, list_transform(embedding, lambda x: 3 * x) FROM embeddings WHERE vec_id % 10 = 3)
SELECT b.id AS removed, min(a.id) AS kept FROM v a JOIN v b ON a.id < b.id AND {COS.format('a.embedding', 'b.embedding')} >= 0.9 GROUP BY b.id""")
def lsh_dedup(spark, sf):
    """Scaled copies of every tenth vector, found by random hyperplanes, go; the earlier one stays."""
    v = vectors(spark, sf).select("id", "embedding")
    both = v.union(v.where("id % 10 = 3").select(F.col("id") + 1000000, F.transform("embedding", lambda x: x * 3)))
    return graph.greedy_dedup(vector.similar_pairs(both, 0.9))


@query("remap_edges", G(""", m AS (SELECT 'n1' AS removed, 'n0' AS kept) SELECT e.id, coalesce(x.kept, source_id) AS source_id, coalesce(y.kept, target_id) AS target_id FROM edges e LEFT JOIN m x ON x.removed = source_id LEFT JOIN m y ON y.removed = target_id"""))
def remap_edges(spark, sf):
    merged = spark.range(1).select(F.lit("n1").alias("removed"), F.lit("n0").alias("kept"))
    return graph.remap_edges(graph_edges(spark, sf), merged).select("id", "source_id", "target_id")


@query("graph_proximity_rerank", G(f""", seed AS (SELECT 'n0' AS id), act AS (SELECT source_id AS a, target_id AS b FROM edges WHERE valid_until IS NULL OR valid_until > {NOW}), w AS (SELECT a, b FROM act UNION SELECT b, a FROM act),
h1 AS (SELECT DISTINCT b AS id FROM w JOIN seed ON a = id), f AS (SELECT id FROM h1 ORDER BY id LIMIT 50), h2 AS (SELECT DISTINCT b AS id FROM w JOIN f ON a = id),
p AS (SELECT id, max(p) AS p FROM (SELECT id, 1.0 AS p FROM seed UNION ALL SELECT id, 0.5 FROM h1 UNION ALL SELECT id, 0.25 FROM h2) GROUP BY id),
r AS (SELECT 'c' || c_custkey AS id, (c_custkey % 100)::DOUBLE / 4000 AS v FROM customer)
SELECT id, round(0.6 * v + 0.2 * coalesce(p, 0), 6) AS combined FROM r LEFT JOIN p USING (id) ORDER BY round(0.6 * v + 0.2 * coalesce(p, 0), 9) DESC, id LIMIT 20"""))
def graph_proximity_rerank(spark, sf):
    """Customers of rising scores around nation 0."""
    near = graphrank.proximity(graph.active(graph_edges(spark, sf), now()), spark.createDataFrame([("n0",)], "id string"))
    rows = table(spark, sf, "customer").selectExpr("concat('c', c_custkey) as id", "array(concat('c', c_custkey)) as entities", "(c_custkey % 100) / 4000.0D as score", "0.0D as rerank_score")
    return graphrank.rerank(rows, near).limit(20).select("id", F.round("combined", 6).alias("combined"))


@query("context_extension", G(""", ne AS (SELECT e.id, a.name AS source, e.relation, b.name AS target FROM edges e JOIN nodes a ON a.id = e.source_id JOIN nodes b ON b.id = e.target_id),
w AS (SELECT DISTINCT name FROM (SELECT id, name FROM nodes WHERE contains(lower(name), '000000001') ORDER BY id LIMIT 10)), h1 AS (SELECT * FROM ne WHERE source IN (SELECT name FROM w) ORDER BY id LIMIT 30),
t AS (SELECT DISTINCT target FROM h1 WHERE target NOT IN (SELECT source FROM h1) ORDER BY target LIMIT 10), h2 AS (SELECT * FROM ne WHERE source IN (SELECT target FROM t)),
u AS (SELECT *, 1 AS hop FROM h1 UNION ALL SELECT *, 2 FROM h2 WHERE id NOT IN (SELECT id FROM h1)) SELECT id, source, relation, target, hop::INT AS hop FROM u ORDER BY hop, id LIMIT 30"""))
def context_extension(spark, sf):
    """The strategy over the graph of the tables: edges of the named entities, then of their targets."""
    return strategies.get("GRAPH_COMPLETION_CONTEXT_EXTENSION")(spark, {"nodes": graph_nodes(spark, sf), "edges": graph_edges(spark, sf)}, {"query": "of 000000001", "limit": 30})


@query("graph_context_assembly", G(""", cand AS (SELECT 1 AS p, 'vsa' AS provider, * FROM edges WHERE source_id IN ('c1', 'c2', 'c4') UNION ALL SELECT 2, 'sql', * FROM edges WHERE source_id IN ('c2', 'c4', 'c5', 'c7')),
u AS (SELECT DISTINCT ON (dataset_id, source_id, relation, target_id) * FROM cand ORDER BY dataset_id, source_id, relation, target_id, p, id), v AS (SELECT * FROM u WHERE p = 1 ORDER BY id LIMIT 10), q AS (SELECT * FROM u WHERE p = 2 ORDER BY id LIMIT 20)
SELECT provider, source_id AS source, relation, target_id AS target FROM (SELECT * FROM v UNION ALL SELECT * FROM q) ORDER BY p, id LIMIT 20"""))
def graph_context_assembly(spark, sf):
    """The symbolic provider's ten lines first, then the tables', twenty in all, a triple once; case makes no difference."""
    e = graph_edges(spark, sf)
    part = lambda name, ids, f: e.where(F.col("source_id").isin(ids)).select(F.lit(name).alias("provider"), F.col("id").alias("pos"), "dataset_id", F.col("source_id").alias("source"), f("relation").alias("relation"), F.col("target_id").alias("target"))
    found = graphrank.assembled(part("vsa", ["c1", "c2", "c4"], F.col).union(part("sql", ["c2", "c4", "c5", "c7"], F.lower)))
    return found.withColumn("relation", F.upper("relation"))


TRIP = """, dist AS (SELECT 'n' || n_nationkey AS id, n_nationkey * 0.1 AS d FROM nation WHERE n_nationkey < 20), sc AS (SELECT e.id, source_id, target_id, least(coalesce(x.d, 3.5), 3.5) + CASE WHEN relation = 'PREFERS' THEN 3.5 ELSE 0.2 END + least(coalesce(y.d, 3.5), 3.5) AS score
FROM edges e JOIN nodes a ON a.id = source_id JOIN nodes b ON b.id = target_id LEFT JOIN dist x ON x.id = source_id LEFT JOIN dist y ON y.id = target_id)"""


def _scored(spark, sf, k):
    d = table(spark, sf, "nation").where("n_nationkey < 20").selectExpr("concat('n', n_nationkey) as id", "n_nationkey * 0.1D as distance")
    kinds = spark.createDataFrame([("IN_REGION", 0.2), ("LIVES_IN", 0.2), ("BASED_IN", 0.2)], "relation string, distance double")
    return graphrank.triplet_scores(graph_nodes(spark, sf), graph_edges(spark, sf), d, kinds, k)


@query("triplet_topk", G(TRIP + " SELECT id, round(score, 6)::DOUBLE AS score FROM sc ORDER BY round(score, 9), id LIMIT 5"))
def triplet_topk(spark, sf):
    """d(source) + d(relation) + d(target), a missing distance is the penalty; ascending; k of 0 means 5."""
    return _scored(spark, sf, 0).select("id", F.round("score", 6).alias("score"))


@query("aggregate_edges", G(TRIP + ", t AS (SELECT * FROM sc ORDER BY round(score, 9), id LIMIT 10) SELECT count(DISTINCT id) AS edges, count(DISTINCT node) AS nodes FROM (SELECT id, unnest([source_id, target_id]) AS node FROM t)"))
def aggregate_edges(spark, sf):
    return graphrank.aggregated(_scored(spark, sf, 10))


@query("query_entities", G(", w AS (SELECT unnest(['tell', 'nation_1', 'customer#000000001', 'asia']) AS word) SELECT DISTINCT id, name FROM nodes JOIN w ON contains(lower(name), word) ORDER BY id LIMIT 10"))
def query_entities(spark, sf):
    return graphrank.query_entities(graph_nodes(spark, sf), "Tell me of Nation_1, Customer#000000001 (ASIA)?")


@query("query_expansion", G(", hit AS (SELECT id FROM nodes WHERE contains(lower(name), 'nation_3') OR contains(lower(name), 'nation_12') ORDER BY id LIMIT 10) SELECT DISTINCT b.name FROM edges JOIN nodes b ON b.id = target_id WHERE source_id IN (SELECT id FROM hit) ORDER BY b.name LIMIT 5"))
def query_expansion(spark, sf):
    """Names that the named entities' edges lead to, five at most, for a lexical query."""
    return graphrank.expansion(graph_nodes(spark, sf), graph_edges(spark, sf), "nation_3 or nation_12")


@query("memify_groups", G(", n AS (SELECT *, CASE WHEN type = 'Nation' THEN ' Nation ' ELSE name END AS name2 FROM nodes) SELECT 'name' AS kind, trim(lower(name2)) AS key, count(*) AS n FROM n WHERE trim(name2) <> '' GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'type', type, count(*) FROM n WHERE type <> '' GROUP BY type HAVING count(*) > 2"))
def memify_groups(spark, sf):
    """Here all nations share a name."""
    return graphrank.memify_groups(graph_nodes(spark, sf).withColumn("name", F.expr("if(type = 'Nation', ' Nation ', name)")))


@query("dependency_cycle", """WITH RECURSIVE e AS (SELECT n_regionkey AS plan, n_nationkey AS a, (n_nationkey * 7 + n_regionkey) % 25 AS b FROM nation), w AS (SELECT plan, a AS s, b AS t, 1 AS d FROM e UNION SELECT w.plan, w.s, e.b, d + 1 FROM w JOIN e ON e.plan = w.plan AND e.a = w.t WHERE d < 26)
SELECT plan, bool_or(s = t) AS cyclic FROM w GROUP BY plan""")
def dependency_cycle(spark, sf):
    """Each region's nations as the steps of a plan that depend on each other by a rule."""
    steps = table(spark, sf, "nation").selectExpr("n_regionkey as plan", "n_nationkey as a", "(n_nationkey * 7 + n_regionkey) % 25 as b")
    return graph.cyclic_plans(steps)


@query("graph_visual", G("SELECT source_id || '→' || target_id AS label, relation, count(*) AS n FROM edges GROUP BY ALL"))
def graph_visual(spark, sf):
    e = graph_edges(spark, sf)
    return e.groupBy(F.concat_ws("→", "source_id", "target_id").alias("label"), "relation").agg(F.count("*").alias("n"))
