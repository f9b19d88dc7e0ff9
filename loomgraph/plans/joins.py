"""Join-shaped queries over the graph, memories, chunks and workspace tables."""

from pyspark.sql import Window, functions as F

from ..operators import relate as r
from ..registry import query
from .base import CHUNKS, GRAPH, MEMORIES, chunks, graph_edges, graph_nodes, memories, table


def _graph(spark, sf):
    return graph_nodes(spark, sf), graph_edges(spark, sf)


@query("edge_node_join", f"""WITH {GRAPH} SELECT e.id, a.name AS source, e.relation, b.name AS target FROM edges e, nodes a, nodes b WHERE a.id = e.source_id AND b.id = e.target_id
AND a.name LIKE '%1%' AND a.type <> 'Priority' AND b.type <> 'Priority' AND (a.dataset_id = '' OR a.dataset_id = 'MACHINERY') AND (b.dataset_id = '' OR b.dataset_id = 'MACHINERY') ORDER BY e.id LIMIT 50""")
def edge_node_join(spark, sf):
    n, e = _graph(spark, sf)
    return r.graph_rows(n, e, F.contains("source", F.lit("1")), ["MACHINERY"], skip_types=("Priority",))


@query("code_rule_join", f"""WITH {GRAPH} SELECT DISTINCT a.name || CASE e.relation WHEN 'LIVES_IN' THEN ' lives in ' WHEN 'BASED_IN' THEN ' is based in ' WHEN 'IN_REGION' THEN ' in region ' ELSE ' prefers ' END || b.name AS rule
FROM edges e JOIN nodes a ON a.id = e.source_id JOIN nodes b ON b.id = e.target_id ORDER BY rule LIMIT 100""")
def code_rule_join(spark, sf):
    return r.code_rules(*_graph(spark, sf), {"LIVES_IN": "lives in", "BASED_IN": "is based in"})


@query("temporal_event_join", f"""WITH {GRAPH} SELECT n.id AS event, e.id AS edge, b.name AS entity FROM nodes n LEFT JOIN (edges e JOIN nodes b ON b.id = e.target_id) ON e.source_id = n.id AND e.relation = 'IN_REGION'
WHERE n.type IN ('Nation', 'Region')""")
def temporal_event_join(spark, sf):
    """Nations and regions as events: the former happened to a region, the latter to nobody."""
    n, e = _graph(spark, sf)
    return r.events_with_entities(n.where("type in ('Nation', 'Region')"), e, n, "IN_REGION")


@query("dcd_join", """SELECT r_regionkey AS domain_id, n_nationkey AS collection_id, c_custkey AS document_id FROM region LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 6 <> 0) n ON n_regionkey = r_regionkey
LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = c_nationkey % 2) c ON c_nationkey = n_nationkey""")
def dcd_join(spark, sf):
    """Regions, nations, customers as domains, collections, documents; a document of another dataset isn't its collection's."""
    own = lambda d, ds: d.withColumn("owner_id", F.lit("u")).withColumn("dataset_id", F.expr(ds))
    domains = table(spark, sf, "region").selectExpr("r_regionkey as domain_id").select("domain_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("d"))
    n = table(spark, sf, "nation").where("n_nationkey % 6 <> 0").selectExpr("n_regionkey as domain_id", "n_nationkey as collection_id", "int(n_nationkey % 2) as d")
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.expr("c_nationkey = n_nationkey")).selectExpr("n_regionkey as domain_id", "c_nationkey as collection_id", "c_custkey as document_id", "int(c_custkey % 2) as d")
    out = r.taxonomy(own(domains, "concat('ds', d)").drop("d"), own(n, "concat('ds', d)").drop("d"), own(c, "concat('ds', d)").drop("d")).select("domain_id", "collection_id", "document_id")
    # a domain stands once a dataset: without a collection in it, it is a row of nulls, once a domain
    some = out.where("collection_id is not null")
    return some.union(r.unmatched(out.distinct(), some, "domain_id"))


@query("dataset_data_join", "SELECT d.doc_id, d.source, l.quality FROM labels l, documents d WHERE l.doc_id = d.doc_id")
def dataset_data_join(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("doc_id", "source", "quality")


@query("node_edge_count", f"""WITH {GRAPH}, loops AS (SELECT * FROM edges UNION ALL SELECT 'loop', 'n3', 'n3', 'SELF', '', 1.0, NULL, NULL)
SELECT n.id, n.type, (SELECT count(*) FROM loops e WHERE e.source_id = n.id) + (SELECT count(*) FROM loops e WHERE e.target_id = n.id AND e.source_id <> e.target_id) AS edges FROM nodes n""")
def node_edge_count(spark, sf):
    """One self loop is added: it counts once."""
    n, e = _graph(spark, sf)
    loop = spark.createDataFrame([("loop", "n3", "n3")], "id string, source_id string, target_id string")
    return r.edge_counts(n, e.select("id", "source_id", "target_id").union(loop))


@query("orphan_receipts", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def orphan_receipts(spark, sf):
    """Receipts whose task is gone: orders without a large line."""
    return r.unmatched(table(spark, sf, "orders"), table(spark, sf, "lineitem").where("l_quantity > 45").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey").select("o_orderkey")


@query("vector_reconcile", """SELECT source AS collection, doc_id AS id, 'missing' AS state FROM documents WHERE doc_id % 10 = 0 UNION ALL SELECT source, -doc_id - 1, 'orphan' FROM documents WHERE doc_id % 25 = 0""")
def vector_reconcile(spark, sf):
    """Every tenth id has no vector, every twenty-fifth vector another id, and a collection without rows isn't looked at."""
    d = table(spark, sf, "documents").selectExpr("source as collection", "doc_id as id")
    v = d.where("id % 10 <> 0").union(d.where("id % 25 = 0").selectExpr("collection", "-id - 1")).union(d.where("id < 5").selectExpr("'gone'", "id"))
    return r.reconcile(d, v)


@query("rank_hydrate", f"WITH {MEMORIES} SELECT id, key FROM memories WHERE id IN (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20)")
def rank_hydrate(spark, sf):
    """Memories of a ranked list, in its order."""
    best = table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select(F.col("o_orderkey").alias("id"), "o_totalprice")
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "id"))).select("id", "rank")  # twenty rows
    return r.hydrate(ranked, memories(spark, sf), "id").select("id", "key")


@query("parent_chunks", """WITH child AS (SELECT c_nationkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS pos FROM customer), p AS (SELECT c_nationkey FROM child WHERE pos <= 15 AND c_nationkey % 8 <> 0 GROUP BY 1 ORDER BY min(pos) LIMIT 5)
SELECT n_nationkey AS id FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM p) AND n_regionkey <> 4""")
def parent_chunks(spark, sf):
    """Customers as children of nations: 15 children, 5 parents, those of region 4 not in the main search."""
    w = Window.orderBy("a", "b")  # lists of a search, fifteen and at most 25 rows
    c = table(spark, sf, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(15).selectExpr("-c_acctbal as a", "c_custkey as b", "if(c_nationkey % 8 = 0, '', string(c_nationkey)) as parent_id")
    m = table(spark, sf, "nation").where("n_regionkey <> 4").orderBy("n_name").limit(25).selectExpr("n_name as a", "n_nationkey as b", "string(n_nationkey) as id")
    found = r.parents(c.withColumn("rank", F.row_number().over(w)), m.withColumn("rank", F.row_number().over(w)), 5)
    return found.select(F.col("id").cast("int").alias("id"))


@query("distance_mapping", "SELECT n_nationkey AS id, CASE WHEN n_nationkey < 20 AND n_nationkey < 14 THEN n_nationkey / 4 ELSE 3.5 END::DOUBLE AS distance FROM nation")
def distance_mapping(spark, sf):
    """Two distances each, the smaller one counts; the penalty where there is none or it is less."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"))
    found = n.where("id < 20").selectExpr("id", "id / 4.0D as distance")
    return r.distances(n, found.union(found.selectExpr("id", "distance + 1")), 3.5)


@query("dedup_triplet_join", f"WITH {GRAPH} SELECT relation, count(DISTINCT source_id || '|' || target_id) AS n FROM edges WHERE source_id IN (SELECT id FROM nodes) AND target_id IN (SELECT id FROM nodes) GROUP BY relation")
def dedup_triplet_join(spark, sf):
    """Triplets of deduplicated edges, by relation."""
    n, e = _graph(spark, sf)
    once = e.select("source_id", "relation", "target_id", F.concat_ws("|", "source_id", "relation", "target_id").alias("id")).distinct()
    return r.named_edges(n, once).groupBy("relation").agg(F.count("*").alias("n"))


@query("vsa_member_join", f"""WITH {GRAPH} SELECT e.id AS edge_id, n.name, CASE WHEN e.relation <> 'BASED_IN' THEN e.relation END AS relation, CASE WHEN e.relation <> 'BASED_IN' THEN e.target_id END AS target_id
FROM edges e LEFT JOIN nodes n ON n.id = e.source_id WHERE e.valid_until IS NULL AND e.relation <> 'PREFERS'""")
def vsa_member_join(spark, sf):
    """Members of shards whose edge is gone keep their row."""
    n, e = _graph(spark, sf)
    members = e.where("valid_until is null and relation <> 'PREFERS'").select(F.col("id").alias("edge_id"), "source_id")
    return r.member_facts(members, n, e.where("relation <> 'BASED_IN'"))


@query("shares_join", "SELECT n_name, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS shared_with FROM nation")
def shares_join(spark, sf):
    """Datasets with the users they are shared with, if any."""
    shares = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("k"))
    return table(spark, sf, "nation").join(shares, F.expr("n_nationkey = s_nationkey"), "left").select("n_name", F.coalesce("k", F.lit(0)).alias("shared_with"))


@query("tenant_join", "SELECT c_custkey, (SELECT n_name FROM nation WHERE n_nationkey = c_nationkey) AS n_name FROM customer WHERE c_acctbal > 9000")
def tenant_join(spark, sf):
    """Users of a tenant with its name."""
    return table(spark, sf, "customer").where("c_acctbal > 9000").join(table(spark, sf, "nation"), F.expr("c_nationkey = n_nationkey")).select("c_custkey", "n_name")


def _used(spark, sf):
    return table(spark, sf, "lineitem").where("l_quantity > 49").withColumnRenamed("l_partkey", "p_partkey")


@query("data_still_referenced", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def data_still_referenced(spark, sf):
    return r.matched(table(spark, sf, "part"), _used(spark, sf), "p_partkey").select("p_partkey")


@query("data_unreferenced", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def data_unreferenced(spark, sf):
    return r.unmatched(table(spark, sf, "part"), _used(spark, sf), "p_partkey").select("p_partkey")


@query("community_internal_edges", f"WITH {GRAPH} SELECT e.id FROM edges e JOIN nodes a ON a.id = e.source_id JOIN nodes b ON b.id = e.target_id WHERE a.type IN ('Nation', 'Region') AND b.type IN ('Nation', 'Region') ORDER BY e.id LIMIT 30")
def community_internal_edges(spark, sf):
    n, e = _graph(spark, sf)
    return r.internal_edges(e, n.where("type in ('Nation', 'Region')"), 30).select("id")


@query("supplier_part_edges", "SELECT DISTINCT l_suppkey, l_partkey, count(*) OVER (PARTITION BY l_suppkey, l_partkey) AS weight FROM lineitem")
def supplier_part_edges(spark, sf):
    """Parallel edges summed."""
    return table(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("weight"))


@query("chunk_links", f"""WITH {CHUNKS} SELECT id, lag(id) OVER (PARTITION BY collection ORDER BY id) AS prev_id, lead(id) OVER (PARTITION BY collection ORDER BY id) AS next_id FROM chunks""")
def chunk_links(spark, sf):
    """The chunks before and after each of its document."""
    from ..operators import chunk

    return chunk.linked(chunks(spark, sf), "collection", "id").select("id", "prev_id", "next_id")
