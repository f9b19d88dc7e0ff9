"""Tables of a scale folder and the property graph derived from them."""

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, type, dataset_id): regions, nations, customers, suppliers and order priorities."""
    t = lambda n: table(spark, sf_dir, n)
    pick = lambda d, prefix, key, name, kind, ds: d.select(
        F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), F.col(name).alias("name"), F.lit(kind).alias("type"), ds.alias("dataset_id")
    )
    none = F.lit("")
    return (
        pick(t("region"), "r", "r_regionkey", "r_name", "Region", none)
        .union(pick(t("nation"), "n", "n_nationkey", "n_name", "Nation", none))
        .union(pick(t("customer"), "c", "c_custkey", "c_name", "Customer", F.col("c_mktsegment")))
        .union(pick(t("supplier"), "s", "s_suppkey", "s_name", "Supplier", none))
        .union(pick(t("orders").select("o_orderpriority").distinct(), "p", "o_orderpriority", "o_orderpriority", "Priority", none))
    )


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, source_id, target_id, relation, dataset_id, confidence, valid_from, valid_until)."""
    t = lambda n: table(spark, sf_dir, n)
    never = F.lit(None).cast("timestamp_ntz")

    def pick(d, sp, s, tp, g, rel, ds=F.lit(""), start=never, stop=never, key=None):
        source, target = F.concat(F.lit(sp), F.col(s).cast("string")), F.concat(F.lit(tp), F.col(g).cast("string"))
        name = F.concat_ws("|", source, F.lit(rel), target) if key is None else F.concat(F.lit("o"), F.col(key).cast("string"))
        return d.select(name.alias("id"), source.alias("source_id"), target.alias("target_id"), F.lit(rel).alias("relation"), ds.alias("dataset_id"), F.lit(1.0).alias("confidence"), start.alias("valid_from"), stop.alias("valid_until"))

    later = F.lead("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return (
        pick(t("nation"), "n", "n_nationkey", "r", "n_regionkey", "IN_REGION")
        .union(pick(t("customer"), "c", "c_custkey", "n", "c_nationkey", "LIVES_IN", F.col("c_mktsegment")))
        .union(pick(t("supplier"), "s", "s_suppkey", "n", "s_nationkey", "BASED_IN"))
        .union(pick(t("orders").withColumn("stop", later), "c", "o_custkey", "p", "o_orderpriority", "PREFERS", F.lit(""), F.col("o_orderdate"), F.col("stop"), "o_orderkey"))
    )


GRAPH = """
nodes AS (
  SELECT 'r' || r_regionkey AS id, r_name AS name, 'Region' AS type, '' AS dataset_id FROM region
  UNION ALL SELECT 'n' || n_nationkey, n_name, 'Nation', '' FROM nation
  UNION ALL SELECT 'c' || c_custkey, c_name, 'Customer', c_mktsegment FROM customer
  UNION ALL SELECT 's' || s_suppkey, s_name, 'Supplier', '' FROM supplier
  UNION ALL SELECT DISTINCT 'p' || o_orderpriority, o_orderpriority, 'Priority', '' FROM orders),
edges AS (
  SELECT 'n' || n_nationkey || '|IN_REGION|r' || n_regionkey AS id, 'n' || n_nationkey AS source_id, 'r' || n_regionkey AS target_id, 'IN_REGION' AS relation, '' AS dataset_id,
    1.0::DOUBLE AS confidence, NULL::TIMESTAMP AS valid_from, NULL::TIMESTAMP AS valid_until FROM nation
  UNION ALL SELECT 'c' || c_custkey || '|LIVES_IN|n' || c_nationkey, 'c' || c_custkey, 'n' || c_nationkey, 'LIVES_IN', c_mktsegment, 1.0, NULL, NULL FROM customer
  UNION ALL SELECT 's' || s_suppkey || '|BASED_IN|n' || s_nationkey, 's' || s_suppkey, 'n' || s_nationkey, 'BASED_IN', '', 1.0, NULL, NULL FROM supplier
  UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 'p' || o_orderpriority, 'PREFERS', '', 1.0, o_orderdate, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) FROM orders)
"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, score, collection, metadata): search results with JSON metadata, some of it broken."""
    d = table(spark, sf_dir, "documents")
    text = """if(doc_id % 17 = 0, '{broken', concat('{"dataset_id":"', if(doc_id % 5 = 0, '', source), '","project_id":"', if(doc_id % 3 = 0, '', concat('p', doc_id % 3)), '","room":"', lang,
      '","tags":["T', doc_id % 4, '","x', doc_id % 3, '"],"key":"K', doc_id % 10, '","type":"', element_at(array('', 'Function', 'Person'), int(doc_id % 3) + 1), '"', if(doc_id % 7 = 0, ',"text":""', ''), ',"name":"doc ', doc_id, '"}'))"""
    return d.select(F.col("doc_id").alias("id"), ((F.col("n_chars") % 1000) / 1000).alias("score"), F.col("source").alias("collection"), F.expr(text).alias("metadata"))


CHUNKS = """chunks AS (SELECT doc_id AS id, (n_chars % 1000)::DOUBLE / 1000 AS score, source AS collection, CASE WHEN doc_id % 17 = 0 THEN '{broken' ELSE '{"dataset_id":"' || CASE WHEN doc_id % 5 = 0 THEN '' ELSE source END
  || '","project_id":"' || CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'p' || (doc_id % 3) END || '","room":"' || lang || '","tags":["T' || (doc_id % 4) || '","x' || (doc_id % 3) || '"],"key":"K' || (doc_id % 10)
  || '","type":"' || (['', 'Function', 'Person'])[doc_id % 3 + 1] || '"' || CASE WHEN doc_id % 7 = 0 THEN ',"text":""' ELSE '' END || ',"name":"doc ' || doc_id || '"}' END AS metadata FROM documents)"""


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, key, value, owner_id, collection_name, room, hall, superseded_by, is_pinned, pin_priority, updated_at) made of orders."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as id", "concat(if(o_orderkey % 11 = 0, 'API_Key ', 'k'), o_custkey) as key", "concat(o_orderpriority, ' order ', o_orderkey) as value",
        "if(o_custkey % 10 = 0, '', concat('u', o_custkey % 7)) as owner_id", "if(o_orderkey % 3 = 0, '', concat('coll', o_orderkey % 3)) as collection_name", "lower(substring(o_orderpriority, 3)) as room",
        "element_at(array('fact', 'event', 'decision', 'preference', 'advice', 'discovery'), int(o_orderkey % 6) + 1) as hall", "if(o_orderstatus = 'F', concat('x', o_orderkey), '') as superseded_by",
        "o_totalprice > 300000 as is_pinned", "int(o_orderkey % 5) as pin_priority", "o_orderdate as updated_at",
    )


MEMORIES = """memories AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN 'API_Key ' ELSE 'k' END || o_custkey AS key, o_orderpriority || ' order ' || o_orderkey AS value,
  CASE WHEN o_custkey % 10 = 0 THEN '' ELSE 'u' || (o_custkey % 7) END AS owner_id, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'coll' || (o_orderkey % 3) END AS collection_name, lower(substr(o_orderpriority, 3)) AS room,
  (['fact', 'event', 'decision', 'preference', 'advice', 'discovery'])[o_orderkey % 6 + 1] AS hall, CASE WHEN o_orderstatus = 'F' THEN 'x' || o_orderkey ELSE '' END AS superseded_by,
  o_totalprice > 300000 AS is_pinned, (o_orderkey % 5)::INT AS pin_priority, o_orderdate AS updated_at FROM orders)"""


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(generation, path, chunk_id, vector_id, collection, project_id, branch, digest) made of parts; g0 is active, g1 pending deletion."""
    return table(spark, sf_dir, "part").selectExpr(
        "concat('g', p_partkey % 3) as generation", "concat('src/', p_brand, '/f', p_partkey % 13, '.md') as path", "concat('c', p_partkey) as chunk_id", "concat('v', p_partkey) as vector_id",
        "if(p_partkey % 9 = 0, '', concat('coll', p_size)) as collection", "concat('p', p_partkey % 2) as project_id", "if(p_partkey % 4 = 0, 'dev', 'main') as branch", "sha2(p_name, 256) as digest",
    )


MANIFEST = """manifest AS (SELECT 'g' || (p_partkey % 3) AS generation, 'src/' || p_brand || '/f' || (p_partkey % 13) || '.md' AS path, 'c' || p_partkey AS chunk_id, 'v' || p_partkey AS vector_id,
  CASE WHEN p_partkey % 9 = 0 THEN '' ELSE 'coll' || p_size END AS collection, 'p' || (p_partkey % 2) AS project_id, CASE WHEN p_partkey % 4 = 0 THEN 'dev' ELSE 'main' END AS branch, sha256(p_name) AS digest FROM part)"""
