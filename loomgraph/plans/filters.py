"""Predicates: row access, tags, scopes, validity, policies."""

from pyspark.sql import functions as F

from ..operators import analytics, predicates as p
from ..registry import query
from .analytics import AUDIT, KEY, audit
from .base import CHUNKS, MANIFEST, MEMORIES, chunks, manifest, memories, table

META = "CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.{}') END"
DATASET = f"coalesce(nullif({META.format('dataset_id')}, ''), {META.format('project_id')}, '')"


@query("acl_filter", f"WITH {CHUNKS} SELECT id FROM chunks WHERE {DATASET} IN ('', 'src1', 'src2', 'p1')")
def acl_filter(spark, sf):
    """Results without a dataset or in an allowed one; broken metadata has none."""
    allowed = spark.createDataFrame([("src1",), ("src2",), ("p1",)], "dataset string")
    return p.allowed_rows(chunks(spark, sf), allowed, p.dataset_of(F.col("metadata"))).select("id")


@query("acl_empty_http", f"WITH {CHUNKS} SELECT id FROM chunks WHERE false")
def acl_empty_http(spark, sf):
    """An empty list of allowed datasets hides everything."""
    return p.allowed_rows(chunks(spark, sf), spark.createDataFrame([], "dataset string"), p.dataset_of(F.col("metadata")), empty_hides_all=True).select("id")


@query("acl_empty_pipeline", f"WITH {CHUNKS} SELECT id FROM chunks WHERE {DATASET} = ''")
def acl_empty_pipeline(spark, sf):
    """There, an empty list leaves the results without a dataset."""
    return p.allowed_rows(chunks(spark, sf), spark.createDataFrame([], "dataset string"), p.dataset_of(F.col("metadata"))).select("id")


@query("allowed_datasets", """WITH d AS (SELECT DISTINCT source FROM documents) SELECT source AS dataset FROM d WHERE source IN ('src19', 'src2', 'src12')
UNION SELECT source FROM d WHERE source = 'src0' UNION SELECT 'src' || n_nationkey FROM nation WHERE n_regionkey = 2 AND 'src' || n_nationkey IN (SELECT source FROM d)""")
def allowed_datasets(spark, sf):
    """What user u9 owns, what nobody owns, and what region 2 shares with u9."""
    datasets = table(spark, sf, "documents").select(F.col("source").alias("id")).distinct().withColumn(
        "owner_id", F.expr("case when id in ('src19', 'src2', 'src12') then 'u9' when id = 'src0' then null else 'u1' end"))
    shares = table(spark, sf, "nation").selectExpr("concat('src', n_nationkey) as dataset_id", "if(n_regionkey = 2, 'u9', 'u3') as user_id")
    return p.allowed_datasets(datasets, shares, "u9")


@query("tag_filter", f"WITH {CHUNKS} SELECT id FROM chunks WHERE coalesce({META.format('tags[0]')} = 'T1' OR {META.format('key')} = 'K7', false)")
def tag_filter(spark, sf):
    """A tag or the key matches, in any case."""
    return p.tag_filter(chunks(spark, sf), F.col("metadata"), ["t1", "k7"]).select("id")


@query("tag_filter_fallback", "SELECT doc_id AS id FROM documents")
def tag_filter_fallback(spark, sf):
    """Nothing matches: everything is returned."""
    return p.tag_filter(chunks(spark, sf), F.col("metadata"), ["nosuchtag"]).select("id")


@query("room_tag_filter", f"WITH {CHUNKS} SELECT id FROM chunks WHERE json_valid(metadata) AND {META.format('room')} = 'de' AND ({META.format('tags[0]')} = 'T3' OR {META.format('tags[1]')} = 'x0')")
def room_tag_filter(spark, sf):
    """Room and any tag, case counts; broken metadata doesn't match."""
    return chunks(spark, sf).where(p.chunk_matches(F.col("metadata"), "de", ["T3", "x0", "t1"])).select("id")


@query("collection_resolution", "SELECT DISTINCT source AS name FROM documents WHERE lang = 'de'")
def collection_resolution(spark, sf):
    """No collection is named: those of the domain."""
    named = table(spark, sf, "documents").select(F.col("source").alias("name"), F.col("lang").alias("domain")).distinct()
    return p.resolve_collections(named, "", "de").select("name")


@query("memory_scope", f"WITH {MEMORIES} SELECT id FROM memories WHERE owner_id IN ('u3', '') AND collection_name = 'coll1' AND room = 'urgent' AND superseded_by = ''")
def memory_scope(spark, sf):
    return p.memory_scope(memories(spark, sf), "u3", "coll1", "urgent").select("id")


@query("verify_results", f"""WITH {CHUNKS} SELECT count(*) AS total, count(*) FILTER (score >= 0.3 AND json_valid(metadata)) AS kept, count(*) FILTER (score < 0.3) AS dropped_low,
count(*) FILTER (score >= 0.3 AND NOT json_valid(metadata)) AS dropped_bad FROM chunks""")
def verify_results(spark, sf):
    return p.verification_counts(chunks(spark, sf), 0.3)


@query("evidence_ids", f"WITH {CHUNKS} SELECT id FROM chunks ORDER BY score DESC, id LIMIT 8")
def evidence_ids(spark, sf):
    """The first results' ids."""
    return chunks(spark, sf).orderBy(F.desc("score"), "id").limit(8).select("id")


@query("event_range", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts <= TIMESTAMP '2024-01-05'")
def event_range(spark, sf):
    at = lambda t: F.expr(f"timestamp_ntz'{t}'")
    return table(spark, sf, "events").where(p.within(F.col("ts"), at("2024-01-03 00:00:00"), at("2024-01-05 00:00:00"))).select("event_id", "ts")


@query("like_search", f"WITH {MEMORIES} SELECT id FROM memories WHERE contains(lower(key), 'k12') OR regexp_matches(lower(value), 'urgent.*order 1')")
def like_search(spark, sf):
    """A needle in key or value; its % is a wildcard."""
    m = memories(spark, sf)
    return m.where(p.like_any("K12", "key") | p.like_any("urgent%order 1", "value")).select("id")


@query("json_tag_like", f"WITH {CHUNKS} SELECT id FROM chunks WHERE json_valid(metadata) AND {META.format('tags[0]')} = 'T2' AND {META.format('tags[1]')} = 'x1'")
def json_tag_like(spark, sf):
    """All tags, by their quoted text."""
    return chunks(spark, sf).where(p.json_tags_like(F.col("metadata"), ["T2", "x1"])).select("id")


@query("manifest_filter", f"WITH {MANIFEST} SELECT path, chunk_id FROM manifest WHERE generation = 'g0' AND project_id = 'p1'")
def manifest_filter(spark, sf):
    """The active generation's chunks of a project, any branch."""
    return p.manifest_chunks(manifest(spark, sf), "g0", project_id="p1", branch="").select("path", "chunk_id")


@query("audit_page", f"WITH {AUDIT} SELECT id, ts, tool FROM a WHERE tool = 'error' AND client = 'client2' AND ts >= TIMESTAMP '2024-01-02' ORDER BY ts DESC, id LIMIT 50 OFFSET 20")
def audit_page(spark, sf):
    """A limit of 500 is no limit that is allowed: 50."""
    return p.audit_page(audit(spark, sf), F.expr("timestamp_ntz'2024-01-02 00:00:00'"), 500, 20, tool="error", client="client2", collection="").select("id", "ts", "tool")


@query("cypher_policy", "SELECT * FROM (VALUES (1, true, true), (2, false, true), (3, false, true), (4, true, true), (5, false, false), (6, false, false), (7, true, true), (8, false, true), (9, false, false)) AS t(id, read, write)")
def cypher_policy(spark, sf):
    """Texts of the reference's policy, with what reading and what writing access allows."""
    texts = ["MATCH (n) RETURN n", "MATCH (n) DELETE n", "CREATE (n)", "  with 1 as x return x", "CALL dbms.security()", "DROP INDEX x", "optional match (a) return a", "return 1", "   "]
    q = spark.createDataFrame(list(enumerate(texts, 1)), "id int, text string")
    return q.select("id", p.cypher_allowed(F.col("text")).alias("read"), p.cypher_allowed(F.col("text"), write=True).alias("write"))


@query("code_entities", f"WITH {CHUNKS} SELECT id FROM chunks WHERE json_valid(metadata) AND ({META.format('type')} = 'Function' OR ({META.format('type')} = '' AND collection = 'src7'))")
def code_entities(spark, sf):
    """Typed as code, or untyped in a collection named after code, here src7."""
    rows = chunks(spark, sf).where(F.get_json_object("metadata", "$").isNotNull())
    return rows.where(p.code_entity(p.field(F.col("metadata"), "type"), F.expr("if(collection = 'src7', 'my_code', collection)"))).select("id")


@query("embedding_drift", "SELECT 'c' || label AS name, count(*) AS records FROM embeddings WHERE label <> 0 AND label % 3 <> 1 GROUP BY label")
def embedding_drift(spark, sf):
    """Collections of another model; c0 is internal, and every third states no model."""
    c = table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("records")).selectExpr(
        "if(label = 0, '_c0', concat('c', label)) as name", "if(label % 3 = 1, '', 'old-model') as model", "64 as dim", "'' as version", "records")
    return p.drifted(c, "new-model", 64, "v1").select("name", "records")


@query("good_traces", f"""WITH {AUDIT}, k AS (SELECT *, {KEY} AS key FROM a),
f AS (SELECT *, max(CASE WHEN tool = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k)
SELECT key FROM f GROUP BY key HAVING bool_and(outcome <> 'error') AND bool_or(tool = 'purchase') AND bool_and(tool <> 'purchase' OR coalesce(before, 0) = 1) AND bool_or(tool = 'view' AND NOT zero)""")
def good_traces(spark, sf):
    return analytics.good_traces(audit(spark, sf), "view", "purchase")


@query("text_projection", f"WITH {CHUNKS} SELECT id, CASE WHEN id % 17 = 0 OR id % 7 = 0 THEN '' ELSE 'doc ' || id END AS text FROM chunks")
def text_projection(spark, sf):
    """An empty text is a text; broken metadata has neither text nor name."""
    return chunks(spark, sf).select("id", p.text_of(F.col("metadata")).alias("text"))


@query("sensitive_suppression", f"WITH {MEMORIES} SELECT id, key FROM memories WHERE NOT contains(lower(key), 'api_key')")
def sensitive_suppression(spark, sf):
    return memories(spark, sf).where(p.not_sensitive(F.col("key"))).select("id", "key")
