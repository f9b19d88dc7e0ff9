"""Scans, keyed writes, logs, ingest, sync."""

from pyspark.sql import Window, functions as F

from ..operators import hypervector, records, vector
from ..registry import query
from ..sources import readers
from .base import MEMORIES, memories, table
from .retrieval import vectors

@query("collection_scan", "SELECT vec_id AS id, label, len(embedding)::INT AS dim FROM embeddings")
def collection_scan(spark, sf):
    return vectors(spark, sf).select("id", "label", F.size("embedding").alias("dim"))


@query("point_lookup", "SELECT vec_id AS id, label FROM embeddings WHERE vec_id IN (42, 7)")
def point_lookup(spark, sf):
    """Two records by id, and one that isn't there."""
    return records.lookup(vectors(spark, sf), "id", [42, 7, -1]).select("id", "label")


@query("exists_check", "SELECT doc_id AS id, doc_id IN (SELECT vec_id FROM embeddings) AS found FROM documents")
def exists_check(spark, sf):
    return records.exists(table(spark, sf, "documents").select(F.col("doc_id").alias("id")), vectors(spark, sf), "id")


@query("collection_catalog", """SELECT CASE WHEN label = 3 THEN 'renamed' ELSE 'c' || label END AS name, 'd' || (label % 2) AS domain, 64 AS dim, count(*) AS records FROM embeddings WHERE label <> 4 GROUP BY label UNION ALL SELECT 'new', 'd1', 64, 0""")
def collection_catalog(spark, sf):
    """Collections with their records: one is dropped, one renamed, one created."""
    c = table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("records")).selectExpr("concat('c', label) as name", "concat('d', label % 2) as domain", "64 as dim", "records")
    return records.create_collection(records.rename_collection(records.drop_collection(c, "c4"), "c3", "renamed"), "new", "d1", 64)


@query("object_hashes", "SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256, strlen(text) AS bytes FROM documents")
def object_hashes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha1("text").alias("sha1"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"))


@query("sync_export", f"WITH {MEMORIES} SELECT id, key, updated_at FROM memories WHERE updated_at > TIMESTAMP '1998-01-01' AND owner_id = 'u5'")
def sync_export(spark, sf):
    """An owner's memories changed since the last sync."""
    return records.changed_since(memories(spark, sf), "updated_at", F.expr("timestamp_ntz'1998-01-01 00:00:00'"), owner_id="u5").select("id", "key", "updated_at")


@query("vector_upsert", """WITH up AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 3) AS v FROM embeddings WHERE vec_id % 7 = 0)
SELECT e.vec_id AS id, round(coalesce(u.v[1] / sqrt(list_dot_product(u.v, u.v)), e.embedding[1]::DOUBLE), 6) AS first FROM embeddings e LEFT JOIN up u USING (vec_id)""")
def vector_upsert(spark, sf):
    """Replace by id; vectors are normalised, those that aren't finite refused."""
    v = vectors(spark, sf).select("id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    new = v.where("id % 7 = 0").withColumn("embedding", F.transform("embedding", lambda x: x * 3))
    bad = v.where("id = 7").withColumn("embedding", F.transform("embedding", lambda x: F.lit(float("nan"))))
    ok = new.union(bad).where(vector.finite(F.col("embedding"))).withColumn("embedding", vector.normalise(F.col("embedding")))
    return records.upsert(v, ok, "id").select("id", F.round(F.col("embedding")[0], 6).alias("first"))


@query("vector_delete", "SELECT vec_id AS id FROM embeddings WHERE vec_id % 5 <> 0")
def vector_delete(spark, sf):
    v = vectors(spark, sf)
    return records.delete(v, v.where("id % 5 = 0"), "id").select("id")


@query("log_replay", "WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) SELECT user_id, event_id, value FROM l WHERE n = 1 AND event_type <> 'error'")
def log_replay(spark, sf):
    return records.replay(table(spark, sf, "events"), "user_id", "event_id", F.col("event_type") == "error").select("user_id", "event_id", "value")


@query("compact", "WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) SELECT count(*) AS live FROM l WHERE n = 1 AND event_type <> 'error'")
def compact(spark, sf):
    return records.replay(table(spark, sf, "events"), "user_id", "event_id", F.col("event_type") == "error").agg(F.count("*").alias("live"))


@query("sync_import", """WITH al AS (SELECT o_custkey, o_orderkey, o_totalprice, o_orderdate AS stamp, 1 AS side FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_custkey, o_orderkey, o_totalprice, o_orderdate, 0 FROM orders WHERE o_orderkey % 2 = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY stamp DESC, side DESC, o_orderkey DESC) AS n FROM al) SELECT o_custkey, stamp FROM r WHERE n = 1""")
def sync_import(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.col("o_orderdate").alias("stamp"))
    return records.import_newer(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), "o_custkey", "stamp").select("o_custkey", "stamp")


UUID = """substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', ((strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4)::INT + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"""


@query("ingest_dedup", f"""WITH s AS (SELECT doc_id AS pos, sha256(text) AS sha256, sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode(sha256(text) || source)) AS h FROM documents)
SELECT pos, sha256, {UUID} AS id, row_number() OVER (PARTITION BY sha256 ORDER BY pos) > 1 AS already_exists FROM s""")
def ingest_dedup(spark, sf):
    return readers.ingest(table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), F.col("source").alias("owner"), F.col("text").alias("content")))


@query("ingest_links", f"""WITH s AS (SELECT lang, sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode(sha256(text) || source)) AS h FROM documents)
SELECT DISTINCT lang AS dataset_id, {UUID} AS data_id FROM s""")
def ingest_links(spark, sf):
    """The links of all files to datasets, a third of them there before: a file of two datasets is linked to both."""
    items = table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), F.col("source").alias("owner"), F.col("text").alias("content"), "lang")
    found = readers.ingest(items.drop("lang")).join(items.select("pos", F.col("lang").alias("dataset_id")), "pos")
    before = found.where("pos % 3 = 0").select("dataset_id", F.col("id").alias("data_id"))
    return readers.dataset_links(before, found)


@query("detect_format", """WITH n AS (SELECT doc_id, 'f' || doc_id || CASE doc_id % 5 WHEN 0 THEN '.PDF' WHEN 1 THEN '.md' WHEN 2 THEN '.yml' WHEN 3 THEN '.jpeg' ELSE '' END AS name FROM documents)
SELECT doc_id, CASE lower(regexp_extract(name, '\\.([A-Za-z0-9]+)$', 1)) WHEN 'pdf' THEN 'pdf' WHEN 'md' THEN 'md' WHEN 'yml' THEN 'yaml' WHEN 'jpeg' THEN 'image' ELSE 'txt' END AS format FROM n""")
def detect_format(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", F.concat(F.lit("f"), "doc_id", F.expr("element_at(array('.PDF', '.md', '.yml', '.jpeg', ''), cast(doc_id % 5 + 1 as int))")).alias("name"))
    return d.select("doc_id", readers.file_format(F.col("name"), F.col("text").cast("binary")).alias("format"))


def commits(spark, sf):
    """A log made of orders (headers) and their lines (file names), read back as commits."""
    o = table(spark, sf, "orders")
    head = o.select(F.col("o_custkey").alias("repo"), F.struct("o_orderkey", F.lit(0).alias("n")).alias("pos"), F.concat_ws("|", F.lpad(F.col("o_orderkey").cast("string"), 40, "0"), F.concat(F.lit("c"), "o_custkey"), F.col("o_orderdate").cast("string"), F.lit("work")).alias("line"))
    body = table(spark, sf, "lineitem").join(o.select("o_custkey", F.col("o_orderkey").alias("l_orderkey")), "l_orderkey").select(F.col("o_custkey").alias("repo"), F.struct(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("n")).alias("pos"), F.concat(F.lit("file"), "l_partkey").alias("line"))
    return readers.git_commits(head.union(body))


@query("git_log", "SELECT lpad(o_orderkey::VARCHAR, 40, '0') AS sha, 'c' || o_custkey AS author, count(l_linenumber) AS files FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def git_log(spark, sf):
    return commits(spark, sf).select("sha", "author", F.size("files").cast("long").alias("files"))


@query("git_search", "SELECT DISTINCT lpad(o_orderkey::VARCHAR, 40, '0') AS sha, 'c' || o_custkey AS author FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE contains('file' || l_partkey, 'file77') OR contains('c' || o_custkey, 'file77') ORDER BY (SELECT max(x.o_orderdate)::VARCHAR FROM orders x WHERE lpad(x.o_orderkey::VARCHAR, 40, '0') = sha) DESC, sha LIMIT 20")
def git_search(spark, sf):
    """The latest commits that touch a file of a name."""
    return readers.search_commits(commits(spark, sf), "FILE77").select("sha", "author")


@query("git_hot_files", "SELECT 'file' || l_partkey AS file, count(DISTINCT l_orderkey) AS commits, count(DISTINCT o_custkey) AS authors FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1 ORDER BY commits DESC, file LIMIT 10")
def git_hot_files(spark, sf):
    return readers.busiest_files(commits(spark, sf), 10)


@query("directory_listing")
def directory_listing(spark, sf):
    """A table's file, as a listing with a name pattern and no recursion sees it."""
    return readers.files(spark, sf, "nation.parquet", recursive=False).select("name", "length", "sha256", "format")


@query("html_text")
def html_text(spark, sf):
    return readers.page_texts(table(spark, sf, "pages"))


@query("audit_replay", "SELECT event_id AS id, event_type FROM events")
def audit_replay(spark, sf):
    """A log that was written twice, once per id."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), "event_type")
    return e.union(e.where("id % 3 = 0")).dropDuplicates(["id"])


@query("consolidation_plan", """WITH m AS (SELECT doc_id AS id, text, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS n, count(*) OVER (PARTITION BY md5(text)) AS size, min(doc_id) OVER (PARTITION BY md5(text)) AS c, max(doc_id) OVER (PARTITION BY md5(text)) AS s FROM documents)
SELECT DISTINCT c AS cluster, CASE WHEN size > 6 THEN 'skip' ELSE 'merge' END AS action, s AS survivor, size FROM m WHERE size > 1""")
def consolidation_plan(spark, sf):
    """Identical documents as clusters: the newest survives, large clusters are skipped."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("value"), F.col("doc_id").alias("created"), F.md5("text").alias("h"))
    first = d.groupBy("h").agg(F.min("id").alias("component"), F.count("*").alias("n")).where("n > 1")
    clusters = d.join(first, "h").select("id", "component")
    edges = clusters.where("id <> component").select(F.col("component").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("score"))
    return records.consolidation_plan(d.drop("h"), edges, clusters)


@query("memory_supersede", "SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS superseded_by FROM orders")
def memory_supersede(spark, sf):
    w = Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", F.lead("o_orderkey").over(w).alias("superseded_by"))


@query("vsa_shards", "SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber, ((row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey, l_orderkey, l_linenumber)) - 1) // 12 AS shard FROM lineitem")
def vsa_shards(spark, sf):
    facts = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("relation"), F.col("l_partkey").alias("source_id"), F.col("l_orderkey").alias("target_id"), F.col("l_linenumber").alias("id")
    )
    return records.shards(facts).toDF("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "shard")


@query("vsa_superposition", "SELECT label, list(s ORDER BY pos) AS bundle FROM (SELECT label, pos, sum(CASE WHEN x >= 0 THEN 1 ELSE -1 END)::BIGINT AS s FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL) GROUP BY label")
def vsa_superposition(spark, sf):
    v = vectors(spark, sf).select("label", records.sign(F.col("embedding")).alias("v"))
    return records.bundle(v, "label", "v")


@query("vsa_query")
def vsa_query(spark, sf):
    """Which nation does a customer's bundle of facts hold: bound symbols, summed, unbound, compared."""
    c = table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("s"), F.concat(F.lit("n"), "c_nationkey").alias("o"), F.floor(F.col("c_custkey") / 12).alias("shard")).where("shard is not null")
    none = F.array(*[F.lit(0).cast("long")] * hypervector.WORDS)  # no name: every sign is -1
    signs = lambda name: F.when(name.isNull(), none).otherwise(hypervector.symbol(F.concat(name, F.lit("#0"))))  # noqa: E731  256 of them, packed
    facts = c.withColumn("v", hypervector.bind(signs(F.col("s")), signs(F.col("o"))))
    most = facts.groupBy("shard").count().agg(F.max("count")).first()[0] or 1  # twelve, unless keys repeat
    sums = hypervector.bundle(facts, "shard", "v", planes=most.bit_length())
    # the vocabulary is one row: each name's symbol
    names = c.select("o").distinct().select(F.col("o").alias("guess"), signs(F.col("o")).alias("g")).agg(F.sort_array(F.collect_list(F.struct("guess", "g"))).alias("names"))
    asked = c.join(sums, "shard").withColumn("u", signs(F.col("s"))).crossJoin(names)
    likeness = lambda x: hypervector.count_dot(F.col("planes"), F.col("n"), hypervector.bind(F.col("u"), x["g"]), most.bit_length())
    return asked.select("s", "o", F.array_max(F.transform("names", lambda x: F.struct(likeness(x).alias("d"), x["guess"].alias("guess"))))["guess"].alias("answer"))


_SIGN = "(2 * ((('0x' || substr({0}, (16 * (pos // 64) + 16 - (pos % 64) // 4)::INT, 1))::INT >> (pos % 4)::INT) & 1) - 1)"


@query("vsa_recall", f"""WITH p AS (SELECT unnest(range(256)) AS pos), c AS (SELECT 'c' || c_custkey AS s, 'n' || c_nationkey AS o, c_custkey // 12 AS shard FROM customer), pr AS (SELECT sha256('predicate:LIVES_IN') AS hp),
ns AS MATERIALIZED (SELECT o, pos, {_SIGN.format("sha256('entity:' || o)")} AS x FROM (SELECT DISTINCT o FROM c), p), k AS MATERIALIZED (SELECT s, o, shard, pos, {_SIGN.format("sha256('entity:' || s)")} * {_SIGN.format("hp")} AS x FROM c, pr, p),
b AS MATERIALIZED (SELECT k.shard, k.pos, sum(k.x * ns.x) AS n FROM k JOIN ns USING (o, pos) GROUP BY ALL), z AS (SELECT shard, sqrt(sum(n * n)) AS norm FROM b GROUP BY shard),
d AS (SELECT k.s AS subject, ns.o AS answer, sum(b.n * k.x * ns.x) / (any_value(norm) * 16) AS similarity FROM k JOIN b ON b.shard = k.shard AND b.pos = k.pos JOIN z ON z.shard = k.shard JOIN ns ON ns.pos = k.pos GROUP BY ALL)
SELECT subject, answer, round(similarity, 6) AS similarity FROM d QUALIFY row_number() OVER (PARTITION BY subject ORDER BY round(similarity, 9) DESC, answer) = 1""")
def vsa_recall(spark, sf):
    """Where each customer lives, asked of the bundle of twelve customers' facts, by packed signs."""
    c = table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("subject"), F.concat(F.lit("n"), "c_nationkey").alias("o"), F.expr("c_custkey div 12").alias("shard"), F.lit("LIVES_IN").alias("predicate"))
    held = hypervector.bundle(c.withColumn("v", hypervector.fact(F.col("subject"), F.col("predicate"), F.col("o"))), "shard", "v")
    found = hypervector.answers(c.select("shard", "subject", "predicate"), held, c.select("predicate", F.col("o").alias("name")).distinct())
    return found.select("subject", "answer", F.round("similarity", 6).alias("similarity"))


RDF = '<r:RDF xmlns:r="http://r#" xmlns:o="http://o#" xmlns:s="http://s#"><o:Class r:about="http://x#N{0}"><s:label>Nation {0}</s:label><s:subClassOf r:resource="http://x#R"/></o:Class><o:ObjectProperty r:about="http://x/in{0}"/><o:Ontology r:about="http://x"/></r:RDF>'


@query("ontology_terms", "SELECT n_nationkey::VARCHAR AS doc, unnest(['Class', 'ObjectProperty']) AS kind, unnest(['N' || n_nationkey, 'in' || n_nationkey]) AS name, unnest(['Nation ' || n_nationkey, NULL]) AS label, unnest(['http://x#R', NULL]) AS parent FROM nation")
def ontology_terms(spark, sf):
    """A small ontology for each nation."""
    t = table(spark, sf, "nation").select(F.col("n_nationkey").alias("doc_id"), F.replace(F.lit(RDF), F.lit("{0}"), F.col("n_nationkey").cast("string")).alias("text"))
    return readers.ontologies(t).drop("uri")
