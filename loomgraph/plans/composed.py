"""Strategies and memory, workspace and answer-parsing operators made of the others."""

import datetime as dt

from pyspark.sql import functions as F

from ..operators import answers, graph, graphrank, memory, records, relate, router, routes, strategies, temporal
from ..registry import query
from .base import CHUNKS, GRAPH, MEMORIES, chunks, graph_edges, graph_nodes, memories, table
from .filters import META



def _orders(spark, sf):
    return table(spark, sf, "orders").selectExpr("concat('o', o_orderkey) as id", "o_orderdate as at")


@query("temporal_strategy", """WITH t AS (SELECT 'o' || o_orderkey AS id FROM orders WHERE o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate <= TIMESTAMP '1996-03-08' ORDER BY o_orderdate, 'o' || o_orderkey LIMIT 50),
v AS (SELECT 'o' || vec_id AS id, list_dot_product(embedding::DOUBLE[], list_value(1.0, 1.0)::DOUBLE[]) AS s FROM embeddings WHERE false)
SELECT id, 0 AS provider FROM t""")
def temporal_strategy(spark, sf):
    """The dated events of a week; no vectors are known."""
    tables = {"events": _orders(spark, sf), "vectors": spark.createDataFrame([], "id string, embedding array<float>")}
    return strategies.get("TEMPORAL")(spark, tables, {"query": "first week of March 1996", "embedding": [1.0, 1.0], "from": dt.datetime(1996, 3, 1), "to": dt.datetime(1996, 3, 8), "k": 50})


def _communities(spark, sf):
    """(community, parent, node): nations as level-0 communities of their people, regions above them."""
    e = graph_edges(spark, sf)
    low = e.where("relation in ('LIVES_IN', 'BASED_IN')").select(F.col("target_id").alias("community"), F.col("source_id").alias("node"))
    return low.join(e.where("relation = 'IN_REGION'").select(F.col("source_id").alias("community"), F.col("target_id").alias("parent")), "community")


@query("community_lookup", "SELECT 'c' || c_custkey AS node, 'n' || c_nationkey AS community, (SELECT count(*) FROM customer x WHERE x.c_nationkey = c.c_nationkey) + (SELECT count(*) FROM supplier WHERE s_nationkey = c_nationkey) AS members FROM customer c WHERE c_custkey % 10 = 3")
def community_lookup(spark, sf):
    """The communities of some nodes, with their sizes."""
    asked = table(spark, sf, "customer").where("c_custkey % 10 = 3").selectExpr("concat('c', c_custkey) as node")
    return graph.community_lookup(_communities(spark, sf).select("community", "node"), asked)


@query("community_levels", "SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS community, k AS member_count FROM nation JOIN (SELECT k1 AS nk, count(*) AS k FROM (SELECT c_nationkey AS k1 FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1) ON nk = n_nationkey WHERE k >= 3")
def community_levels(spark, sf):
    """Communities of three members or more below their parents: what gets a summary."""
    return graph.community_levels(_communities(spark, sf), 3)


@query("dcd_boost", """WITH r AS (SELECT n_nationkey AS c, n_regionkey AS d, n_nationkey % 3 / 4 AS conf FROM nation WHERE n_nationkey % 4 = 0), p AS (SELECT s_suppkey AS id, n_regionkey AS d, n_nationkey AS c FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT id, round(coalesce((SELECT max(((r.d = p.d)::INT * 0.1 + (r.c = p.c)::INT * 0.2) * conf) FROM r), 0), 6)::DOUBLE AS boost FROM p""")
def dcd_boost(spark, sf):
    """Suppliers as candidates, every fourth nation as a route."""
    n = table(spark, sf, "nation")
    found = n.where("n_nationkey % 4 = 0").selectExpr("string(n_nationkey) as route", "'' as dataset_id", "string(n_regionkey) as domain_id", "string(n_nationkey) as collection_id", "'' as document_id", "(n_nationkey % 3) / 4.0D as confidence")
    c = table(spark, sf, "supplier").join(n, F.expr("s_nationkey = n_nationkey")).selectExpr("s_suppkey as id", "'' as dataset_id", "string(n_regionkey) as domain_id", "string(n_nationkey) as collection_id", "'' as document_id")
    return routes.route_boosts(c, found).select("id", F.round("boost", 6).alias("boost"))


@query("entity_query", f"""WITH {GRAPH}, ids AS (SELECT id FROM nodes WHERE contains(lower(name), 'customer#00000000') ORDER BY id LIMIT 10)
SELECT id, source_id, relation, target_id FROM edges WHERE (source_id IN (SELECT id FROM ids) OR target_id IN (SELECT id FROM ids)) AND coalesce(valid_from <= TIMESTAMP '1997-06-01', true) AND coalesce(valid_until > TIMESTAMP '1997-06-01', true) ORDER BY id LIMIT 50""")
def entity_query(spark, sf):
    """Edges of the nodes of a name, as of a day."""
    return memory.entity_edges(graph_nodes(spark, sf), graph_edges(spark, sf), "Customer#00000000", F.expr("timestamp_ntz'1997-06-01 00:00:00'")).select("id", "source_id", "relation", "target_id")


@query("workspace_conflicts", """SELECT p_partkey AS path, CASE WHEN p_partkey % 4 = 0 THEN 'unindexed' WHEN p_partkey % 3 = 0 THEN 'missing' ELSE 'dirty' END AS state FROM part
WHERE NOT (p_partkey % 3 = 0 AND p_partkey % 4 = 0) AND (p_partkey % 4 = 0 OR p_partkey % 3 = 0 OR p_partkey % 5 = 0)""")
def workspace_conflicts(spark, sf):
    """Every third file is gone from the disk, every fourth isn't indexed, every fifth has changed."""
    files = table(spark, sf, "part").selectExpr("p_partkey as path", "p_name as digest")
    return memory.file_states(files.where("path % 3 <> 0"), files.where("path % 4 <> 0").withColumn("digest", F.expr("if(path % 5 = 0, 'old', digest)")))


@query("stale_vector_ids", "SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE source <> 'src1')")
def stale_vector_ids(spark, sf):
    """Vectors whose row is gone."""
    live = table(spark, sf, "documents").where("source <> 'src1'").select(F.col("doc_id").alias("vec_id"))
    return relate.unmatched(table(spark, sf, "embeddings"), live, "vec_id").select("vec_id")


@query("link_events_entities", "SELECT 'temporal_' || strftime(o_orderdate, '%Y-%m-%d') AS target, 'c' || o_custkey AS source, count(*) AS n FROM orders GROUP BY ALL")
def link_events_entities(spark, sf):
    """Each customer's orders as dated events: a text's events with the entities of the same text."""
    o = table(spark, sf, "orders")
    dated = o.select(F.col("o_orderkey").alias("doc"), F.to_date("o_orderdate").alias("day"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("raw"))
    nodes, edges = temporal.link_events(dated, o.selectExpr("o_orderkey as doc", "concat('c', o_custkey) as entity"))
    return edges.join(nodes.select(F.col("id").alias("target")), "target", "left_semi").groupBy("source", "target").agg(F.count("*").alias("n"))


@query("memory_upsert", f"WITH {MEMORIES} SELECT key, owner_id, collection_name, max(id) AS id FROM memories GROUP BY ALL")
def memory_upsert(spark, sf):
    """The last write of each key, owner and collection."""
    return records.last_write(memories(spark, sf).select("id", "key", "owner_id", "collection_name", "value"), ["key", "owner_id", "collection_name"], "id").drop("value")


@query("memory_pin", f"WITH {MEMORIES} SELECT id, is_pinned OR id % 100 = 1 AS is_pinned, CASE WHEN id % 100 = 1 THEN 9 ELSE pin_priority END AS pin_priority FROM memories")
def memory_pin(spark, sf):
    """Some memories are pinned at priority 9."""
    m = memories(spark, sf)
    return records.pin(m, m.where("id % 100 = 1").select("id"), 9).select("id", "is_pinned", "pin_priority")


@query("memory_unpin", f"WITH {MEMORIES} SELECT id, is_pinned AND id % 100 <> 1 AS is_pinned, CASE WHEN id % 100 = 1 THEN 0 ELSE pin_priority END AS pin_priority FROM memories")
def memory_unpin(spark, sf):
    m = memories(spark, sf)
    return records.pin(m, m.where("id % 100 = 1").select("id"), None).select("id", "is_pinned", "pin_priority")


@query("consolidation_revert", f"WITH {MEMORIES} SELECT id, CASE WHEN superseded_by = 'x' || id AND o_orderkey % 2 = 0 THEN '' ELSE superseded_by END AS superseded_by FROM memories JOIN orders ON o_orderkey = id")
def consolidation_revert(spark, sf):
    """Runs are undone: what they superseded is live again; here the runs of even numbers."""
    m = memories(spark, sf)
    runs = m.where("superseded_by <> '' and id % 2 = 0").select(F.col("superseded_by").alias("survivor"))
    return records.revert(m, runs).select("id", "superseded_by")


@query("diary", f"WITH {MEMORIES} SELECT id, updated_at FROM memories WHERE owner_id = 'u4' ORDER BY updated_at DESC, id LIMIT 20")
def diary(spark, sf):
    return memory.newest(memories(spark, sf), "u4").select("id", "updated_at")


@query("artifacts_first_wins", "SELECT p_brand, p_name, min(p_partkey) AS p_partkey FROM part GROUP BY ALL")
def artifacts_first_wins(spark, sf):
    return records.last_write(table(spark, sf, "part").select("p_brand", "p_name", "p_partkey"), ["p_brand", "p_name"], -F.col("p_partkey"))


@query("last_interactions", "SELECT conv_id, turn, role FROM conversations ORDER BY conv_id DESC, turn DESC LIMIT 5")
def last_interactions(spark, sf):
    return table(spark, sf, "conversations").orderBy(F.desc("conv_id"), F.desc("turn")).limit(5).select("conv_id", "turn", "role")


@query("natural_language_surface", f"WITH {GRAPH} SELECT n.name, count(*) AS lives FROM nodes n, edges e WHERE e.target_id = n.id AND e.relation = 'LIVES_IN' GROUP BY n.name ORDER BY lives DESC, n.name LIMIT 3")
def natural_language_surface(spark, sf):
    """The graph query surface: a query over the node and edge views, such as a model writes it."""
    tables = {"nodes": graph_nodes(spark, sf), "edges": graph_edges(spark, sf)}
    sql = "SELECT n.name, count(*) AS lives FROM edges e JOIN nodes n ON n.id = e.target_id WHERE e.relation = 'LIVES_IN' GROUP BY n.name ORDER BY lives DESC, n.name LIMIT 3"
    return strategies.get("NATURAL_LANGUAGE")(spark, tables, {"sql": sql})


@query("sub_question_steps", f"""WITH {GRAPH}, q AS (SELECT * FROM (VALUES (1, 'asia nation', ['asia', 'nation']), (2, 'customer#000000007', ['customer', '000000007']), (3, 'nothing known', ['nothing', 'known'])) t(step, question, words)),
m AS (SELECT step, id, name, row_number() OVER (PARTITION BY step ORDER BY id) AS r FROM q JOIN nodes ON len(list_filter(words, lambda w: contains(lower(name), w))) > 0),
e AS (SELECT step, e.id, s.name || ' —[' || relation || ']→ ' || t.name AS edge, row_number() OVER (PARTITION BY step ORDER BY e.id) AS r FROM (SELECT DISTINCT step, name FROM m WHERE r <= 10) x JOIN nodes s ON s.name = x.name JOIN edges e ON e.source_id = s.id JOIN nodes t ON t.id = e.target_id)
SELECT q.step, question, coalesce((SELECT string_agg(edge, '; ' ORDER BY id) FROM e WHERE e.step = q.step AND r <= 50), (SELECT 'Entities found: ' || string_agg(DISTINCT name, ', ' ORDER BY name) FROM m WHERE m.step = q.step AND r <= 10), '(no relevant context found)') AS context FROM q""")
def sub_question_steps(spark, sf):
    """A question's parts, each with the edges that it finds in the whole graph."""
    tables = {"nodes": graph_nodes(spark, sf), "edges": graph_edges(spark, sf)}
    return strategies.get("GRAPH_COMPLETION_COT")(spark, tables, {"query": "", "questions": ["asia nation", "customer#000000007", "nothing known"]})


@query("search_collections", f"""WITH {CHUNKS}, r AS (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY score DESC, id) AS pos FROM chunks)
SELECT collection, id, score FROM r WHERE pos <= 45 AND json_valid(metadata) AND {META.format('room')} = 'en' AND ({META.format('tags[0]')} = 'T2' OR {META.format('tags[1]')} = 'x1') ORDER BY collection, pos LIMIT 15""")
def search_collections(spark, sf):
    """The driver's loop over all collections: thrice as many fetched before a filter by room and tags."""
    return strategies.collected(chunks(spark, sf).withColumn("text", F.lit("")), 15, room="en", tags=["T2", "x1"])


@query("cursor_page", "SELECT o_orderkey, base64(encode('{\"o\":40}')) AS next FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 20")
def cursor_page(spark, sf):
    """A page of twenty after a cursor, and the next cursor."""
    return answers.page(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", answers.cursor(20), 20)


@query("last_page", "SELECT n_nationkey, NULL::VARCHAR AS next FROM nation WHERE n_nationkey >= 20")
def last_page(spark, sf):
    """The last five of 25 rows: no cursor follows."""
    return answers.page(table(spark, sf, "nation").select("n_nationkey"), "n_nationkey", answers.cursor(20), 5)


@query("sanitised_names", "SELECT page_id, regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g') AS name FROM pages")
def sanitised_names(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_replace("url", "[^A-Za-z0-9._-]+", "_").alias("name"))


def _any_of(words, text):
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _sql_route():
    """The signals in DuckDB, without graph queries: a CASE in the order of their scores."""
    low = "lower(t)"
    names = "|".join(n for v in temporal.MONTHS.values() for n in v)
    dated = f"(regexp_matches(t, '\\d{{4}}-\\d{{2}}-\\d{{2}}') OR regexp_matches({low}, '\\d{{1,4}}\\s+({names})|({names})[a-zа-яё]*\\.?(\\s+\\d{{1,4}}|,\\s+\\d{{4}})') OR regexp_matches(t, '\\d{{1,2}}[./]\\d{{1,2}}[./]\\d{{4}}|\\d{{4}}[./]\\d{{1,2}}[./]\\d{{1,2}}') OR regexp_matches(t, '(^|[\\s(,])(1\\d{{3}}|20\\d{{2}}|2100)($|[\\s),.])'))"
    code = f"(regexp_matches(t, '{router.CODE}') OR regexp_matches(t, '{router.SNAKE}') OR len(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: regexp_matches(w, '[a-z][A-Z]') AND strlen(w) >= 4)) > 0)"
    asks = f"(contains(t, '?') OR {' OR '.join(f'starts_with({low}, {w!r})' for w in router.QUESTION)})"
    few = "(len(regexp_split_to_array(t, '\\s+')) <= 3 AND NOT regexp_matches(t, '[^\\p{L}\\p{Nd}_\\s-]'))"
    return f"""CASE WHEN t = '' THEN 'HYBRID' WHEN {dated} THEN 'TEMPORAL' WHEN {_any_of(router.SUMMARY, low)} THEN 'COMMUNITY_GLOBAL' WHEN {code} THEN 'CODING_RULES'
      WHEN {_any_of(router.RELATIONAL, low)} THEN 'COMMUNITY_LOCAL' WHEN {few} THEN 'HYBRID' WHEN {asks} THEN 'RAG_COMPLETION' ELSE 'HYBRID' END"""


@query("route_queries", f"""WITH a AS (SELECT item_id AS id, trim(text) AS t FROM benchmark UNION ALL SELECT 100000 + conv_id * 100 + turn, trim(text) FROM conversations) SELECT id, {_sql_route()} AS strategy FROM a""")
def route_queries(spark, sf):
    """The strategy of each benchmark item and each conversation turn, with every backend but graph queries."""
    asked = table(spark, sf, "benchmark").selectExpr("item_id as id", "trim(text) as text").union(table(spark, sf, "conversations").selectExpr("100000 + conv_id * 100 + turn as id", "trim(text) as text"))
    return router.route(asked, [c for c in router.CAPABILITIES if c != "cypher"]).select("id", "strategy")


@query("token_variants", "SELECT n_nationkey, list_sort(list_distinct(list_filter([lower(n_name), regexp_replace(lower(n_name), '(s|ed|ing)$', '')] || CASE WHEN n_nationkey = 3 THEN ['third', 'x3'] ELSE [] END, lambda x: strlen(x) >= 2))) AS variants FROM nation")
def token_variants(spark, sf):
    """One word has expansions."""
    return table(spark, sf, "nation").select("n_nationkey", F.sort_array(answers.variants(F.col("n_name"), {"nation_3": ["third", "x3"]})).alias("variants"))


@query("vsa_rerank", f"""WITH {GRAPH} SELECT id, round((length(id) % 100) / 100.0 + least(0.25, 0.12 * (contains(lower(target_id), 'n1') AND length(target_id) = 2)::INT + 0.12 * (relation = 'LIVES_IN')::INT * 2) + 0.03, 6)::DOUBLE AS score
FROM edges ORDER BY round(score, 9) DESC, id LIMIT 20""")
def vsa_rerank(spark, sf):
    """Facts for 'who lives in n1': lives and in count as words of a relation."""
    e = graph_edges(spark, sf).select("id", ((F.char_length("id") % 100) / 100.0).alias("similarity"), "confidence", F.concat_ws(" ", "relation", "target_id").alias("text"))
    return graphrank.vsa_rerank(e, "who lives, n1").limit(20).select("id", F.round("score", 6).alias("score"))


@query("answer_entities", "SELECT n_nationkey, 'nation' || n_nationkey AS source, 'IN' AS relation, 'region' || n_regionkey AS target FROM nation")
def answer_entities(spark, sf):
    """Entities and relations in a model's JSON, names resolved to ids."""
    answer = table(spark, sf, "nation").select("n_nationkey", F.concat(
        F.lit('text {"nodes": [{"id": "nation'), "n_nationkey", F.lit('", "name": "A"}, {"id": "region'), "n_regionkey", F.lit('", "name": "B"}], "edges": [{"source": "A", "target": "B", "relation": "IN"}]} text')).alias("t"))
    return answers.entity_edges(answer, "n_nationkey", "t")


@query("memory_delete", "SELECT o_orderkey FROM orders WHERE o_custkey % 10 <> 0")
def memory_delete(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return records.delete(o, o.where("o_custkey % 10 = 0"), "o_orderkey").select("o_orderkey")


@query("search_driver", """WITH v AS (SELECT doc_id AS id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS pos FROM documents WHERE lang = 'en'), f AS (SELECT * FROM v WHERE pos <= 3), o AS (SELECT *, row_number() OVER (ORDER BY source, pos) AS place FROM f)
SELECT id, source FROM o WHERE place <= 10""")
def search_driver(spark, sf):
    """Collections in order, three fetched from each under a metadata filter, the first ten kept."""
    from ..operators.lexical import top_per

    d = table(spark, sf, "documents").where("lang = 'en'").select(F.col("doc_id").alias("id"), "source", "n_chars")
    return top_per(d, "source", [F.desc("n_chars"), F.col("id")], 3).orderBy("source", "rank").limit(10).select("id", "source")


@query("graph_completion_context", f"WITH {GRAPH}, seed AS (SELECT id FROM nodes WHERE type = 'Nation' ORDER BY id LIMIT 5) SELECT DISTINCT e.id, e.source_id, e.relation, e.target_id FROM edges e JOIN seed s ON e.source_id = s.id OR e.target_id = s.id WHERE e.relation IN ('IN_REGION', 'BASED_IN')")
def graph_completion_context(spark, sf):
    """The edges around what a vector search named: two equi-joins, then distinct."""
    e, seed = graph_edges(spark, sf).where("relation in ('IN_REGION', 'BASED_IN')"), graph_nodes(spark, sf).where("type = 'Nation'").select(F.col("id").alias("seed")).orderBy("seed").limit(5)
    both = e.join(seed, e.source_id == seed.seed, "left_semi").union(e.join(seed, e.target_id == seed.seed, "left_semi"))
    return both.select("id", "source_id", "relation", "target_id").distinct()


@query("community_graph_prune_dry_run", f"WITH {GRAPH} SELECT count(*) AS expired FROM edges WHERE valid_until < TIMESTAMP '1997-06-01' - INTERVAL 90 DAY")
def community_graph_prune_dry_run(spark, sf):
    e = graph_edges(spark, sf)
    _, kept = graph.prune(graph_nodes(spark, sf), e, F.expr("timestamp_ntz'1997-06-01 00:00:00'"), drop_orphans=False)
    return e.agg(F.count("*").alias("a")).crossJoin(kept.agg(F.count("*").alias("b"))).select((F.col("a") - F.col("b")).alias("expired"))
