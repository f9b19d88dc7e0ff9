"""Ranking and retrieval queries."""

from pyspark.sql import Window, functions as F

from ..operators import fuse, lexical, lexicalindex, records, vector, vectorindex
from ..registry import query
from ..sources.store import files_state, fresh, written
from .base import table

QUERY = "the of thing that entaion"
#: DuckDB twins of the tokenizer and of BM25 over ``q(qid, text)``
TOK = "list_filter(regexp_extract_all(lower(coalesce({}, '')), '[\\p{{L}}\\p{{Nd}}]+'), lambda t: strlen(t) >= 2)"
BM25 = f"""
toks AS (SELECT doc_id AS doc, {TOK.format('text')} AS ts FROM documents),
stats AS (SELECT count(*) AS n_docs, avg(len(ts)) AS avgdl FROM toks),
ex AS (SELECT doc, len(ts) AS dl, unnest(ts) AS term FROM toks),
tf AS (SELECT doc, dl, term, count(*) AS tf FROM ex GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({TOK.format('text')}) AS term FROM q) GROUP BY ALL),
bm AS (SELECT qid, doc, sum(qtf * ln((n_docs - df + 0.5) / (df + 0.5) + 1) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM tf JOIN df USING (term) JOIN qt USING (term) CROSS JOIN stats GROUP BY qid, doc),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc) AS rank FROM bm)"""
COS = "least(1.0, list_dot_product({0}::DOUBLE[], {1}::DOUBLE[]) / sqrt(list_dot_product({0}::DOUBLE[], {0}::DOUBLE[]) * list_dot_product({1}::DOUBLE[], {1}::DOUBLE[])))"


def docs(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "source", "lang")


_INDEXES = {}


def _kept(spark, sf, name, make):
    """What ``make`` builds of a table, once a session and state of its files."""
    key = spark.sparkContext.applicationId, make.__name__, sf, files_state(spark, f"{sf}/{name}.parquet")
    if key not in _INDEXES:
        _INDEXES[key] = make(spark, sf)
    return _INDEXES[key]


def index(spark, sf):
    """The documents' index, built by the first search and kept in the shared folder."""
    return _kept(spark, sf, "documents", _lexical)


def _lexical(spark, sf):
    return lexicalindex.Index.build(docs(spark, sf), fresh(spark, "lexical"))


def vector_index(spark, sf):
    return _kept(spark, sf, "embeddings", _vector)


def _vector(spark, sf):
    return vectorindex.fitted(vectors(spark, sf))


def one(spark, text, qid=0):
    return spark.range(1).select(F.lit(qid).cast("long").alias("qid"), F.lit(text).alias("text"))


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def query_vector(spark, sf, vec_id=0):
    return F.array(*[F.lit(float(x)) for x in vectors(spark, sf).where(F.col("id") == vec_id).first()["embedding"]])


@query("bm25_topk", f"WITH q AS (SELECT 0::BIGINT AS qid, '{QUERY}' AS text), {BM25} SELECT doc, round(score, 6) AS score, rank FROM ranked WHERE rank <= 10")
def bm25_topk(spark, sf):
    return index(spark, sf).search(one(spark, QUERY), 10).select("doc", F.round("score", 6).alias("score"), "rank")


@query("bm25_from_texts", f"WITH q AS (SELECT 0::BIGINT AS qid, '{QUERY}' AS text), {BM25} SELECT doc, round(score, 6) AS score, rank FROM ranked WHERE rank <= 10")
def bm25_from_texts(spark, sf):
    """One search without an index."""
    return lexical.bm25(docs(spark, sf), one(spark, QUERY), 10).select("doc", F.round("score", 6).alias("score"), "rank")


CHANGED = "FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN upper(text) || ' thing' ELSE text END AS text FROM documents WHERE doc_id % 5 <> 2))"


@query("bm25_index_changes", f"WITH q AS (SELECT 0::BIGINT AS qid, '{QUERY}' AS text), {BM25.replace('FROM documents)', CHANGED)} SELECT doc, round(score, 6) AS score, rank FROM ranked WHERE rank <= 10")
def bm25_index_changes(spark, sf):
    """A third of the documents replaced, a fifth removed, then searched."""
    d = docs(spark, sf)
    made = lexicalindex.Index.build(d, fresh(spark, "lexical-changes")).upsert(d.where("id % 3 = 1").withColumn("text", F.concat(F.upper("text"), F.lit(" thing")))).remove(d.where("id % 5 = 2"))
    return lexicalindex.Index(spark, made.path).search(one(spark, QUERY), 10).select("doc", F.round("score", 6).alias("score"), "rank")


@query("bm25_index_merged", f"WITH q AS (SELECT item_id AS qid, text FROM benchmark), {BM25.replace('FROM documents)', CHANGED.replace('upper(text)', 'text'))} SELECT qid, doc, round(score, 6) AS score, rank FROM ranked WHERE rank <= 3")
def bm25_index_merged(spark, sf):
    """Such changes merged into one segment and partly written again, searched by all benchmark items."""
    d = docs(spark, sf)
    change = d.where("id % 3 = 1").withColumn("text", F.concat("text", F.lit(" thing")))
    ix = lexicalindex.built(d.where("id % 4 < 2")).upsert(d.where("id % 4 > 1")).upsert(change).remove(d.where("id % 5 = 2")).merge().upsert(change.where("id % 6 = 4 and id % 5 <> 2"))
    return ix.search(table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text"), 3).withColumn("score", F.round("score", 6))


@query("bm25_blocks_read")
def bm25_blocks_read(spark, sf):
    """What the searches of all benchmark items read of their terms' postings."""
    return index(spark, sf).blocks(table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text"), 5)


@query("bm25_batch", f"WITH q AS (SELECT item_id AS qid, text FROM benchmark), {BM25} SELECT qid, doc, round(score, 6) AS score, rank FROM ranked WHERE rank <= 5")
def bm25_batch(spark, sf):
    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return index(spark, sf).search(queries, 5).withColumn("score", F.round("score", 6))


@query("bm25_postings", f"SELECT doc_id AS doc, term, dl, count(*) AS tf FROM (SELECT doc_id, len(ts)::BIGINT AS dl, unnest(ts) AS term FROM (SELECT doc_id, {TOK.format('text')} AS ts FROM documents)) GROUP BY ALL")
def bm25_postings(spark, sf):
    return lexical.postings(docs(spark, sf)).select("doc", "term", "dl", "tf")


@query("bm25_vocabulary_stats", f"""WITH p AS (SELECT doc_id, unnest({TOK.format('text')}) AS term FROM documents)
SELECT count(DISTINCT doc_id) AS docs, count(DISTINCT term) AS terms, count(*) AS tokens FROM p""")
def bm25_vocabulary_stats(spark, sf):
    p = lexical.postings(docs(spark, sf))
    return p.agg(F.countDistinct("doc").alias("docs"), F.countDistinct("term").alias("terms"), F.sum("tf").alias("tokens"))


@query("cosine_topk", f"SELECT e.vec_id AS id, round({COS.format('e.embedding', 'q.embedding')}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY round({COS.format('e.embedding', 'q.embedding')}, 9) DESC, id LIMIT 10")
def cosine_topk(spark, sf):
    return vector.topk(vectors(spark, sf), query_vector(spark, sf), 10).withColumn("score", F.round("score", 6))


BATCH = f"""WITH s AS (SELECT q.vec_id AS qid, e.vec_id AS id, {COS.format('e.embedding', 'q.embedding')} AS score FROM embeddings e, embeddings q WHERE {{}}),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM s)"""


@query("cosine_topk_batch", BATCH.format("q.vec_id % 100 = 0") + " SELECT qid, id, round(score, 6) AS score, rank FROM r WHERE rank <= 10")
def cosine_topk_batch(spark, sf):
    v = vectors(spark, sf)
    queries = v.where("id % 100 = 0").select(F.col("id").alias("qid"), "embedding")
    return vector.batch_topk(v, queries, 10).withColumn("score", F.round("score", 6))


@query("vector_index_search")
def vector_index_search(spark, sf):
    """Searches that read the nearest cells only, with their recall against all rows and the cells read."""
    v, ix = vectors(spark, sf), vector_index(spark, sf)
    asked = v.where("id % 100 = 0").select(F.col("id").alias("qid"), "embedding")
    true = vector.batch_topk(v, asked, 10).select("qid", "id", F.lit(True).alias("true"))
    found = ix.search(asked, 10).join(true, ["qid", "id"], "left").withColumn("hit", F.coalesce("true", F.lit(False))).drop("true")
    share = F.avg(F.col("hit").cast("double")).over(Window.partitionBy("qid"))  # ten rows each
    return found.select("qid", "id", F.round("score", 6).alias("score"), "rank", "hit", share.alias("recall"), F.lit(ix.probes).alias("cells_read"), F.lit(ix.cells).alias("cells"))


CHANGED_VECTORS = "FROM (SELECT vec_id, CASE WHEN vec_id % 3 = 1 THEN list_reverse(embedding) ELSE embedding END AS embedding FROM embeddings WHERE vec_id % 5 <> 2) e, embeddings q"


@query("vector_index_changes", BATCH.format("q.vec_id % 100 = 0").replace("FROM embeddings e, embeddings q", CHANGED_VECTORS) + " SELECT qid, id, round(score, 6) AS score, rank FROM r WHERE rank <= 5")
def vector_index_changes(spark, sf):
    """A third of the vectors replaced and a fifth removed in segments, merged, one of them written again; then all cells searched."""
    v = vectors(spark, sf)
    ix = vectorindex.fitted(v, cells=16, rounds=2).upsert(v.where("id % 3 = 1").withColumn("embedding", F.reverse("embedding"))).remove(v.where("id % 5 = 2").select("id"))
    ix = ix.merge().upsert(v.where("id % 9 = 4 and id % 5 <> 2").withColumn("embedding", F.reverse("embedding")))
    asked = v.where("id % 100 = 0").select(F.col("id").alias("qid"), "embedding")
    return vectorindex.VectorIndex(spark, ix.path).search(asked, 5, probes=16, depth=100).withColumn("score", F.round("score", 6))


@query("cosine_topk_sharded", BATCH.format("q.vec_id = 3") + """ SELECT id, round(score, 6) AS score, list_reduce([2166136261::BIGINT] || list_transform(string_split(id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda h, c: (xor(h, c) * 16777619) % 4294967296) % 4 AS shard FROM r WHERE rank <= 7""")
def cosine_topk_sharded(spark, sf):
    """The best of each of four shards, then of all."""
    return vector.sharded_topk(vectors(spark, sf), query_vector(spark, sf, 3), 7, 4).withColumn("score", F.round("score", 6))


@query("pending_topk", BATCH.format("q.vec_id = 3").replace("FROM embeddings e, embeddings q", "FROM (SELECT vec_id, CASE WHEN vec_id % 50 = 9 THEN (SELECT embedding FROM embeddings WHERE vec_id = 3) ELSE embedding END AS embedding FROM embeddings) e, embeddings q") + " SELECT id, round(score, 6) AS score FROM r WHERE rank <= 15")
def pending_topk(spark, sf):
    """Rows written but not indexed yet count: every fiftieth vector is replaced by the query's."""
    v = vectors(spark, sf).select("id", "embedding")
    new = v.where("id % 50 = 9").select("id").crossJoin(v.where("id = 3").select("embedding"))  # one row
    return vector.topk(records.upsert(v, new, "id"), query_vector(spark, sf, 3), 15).withColumn("score", F.round("score", 6))


@query("filtered_topk", f"SELECT e.vec_id AS id, round({COS.format('e.embedding', 'q.embedding')}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 1 AND e.label = 3 ORDER BY round({COS.format('e.embedding', 'q.embedding')}, 9) DESC, id LIMIT 5")
def filtered_topk(spark, sf):
    return vector.topk(vectors(spark, sf).where("label = 3"), query_vector(spark, sf, 1), 5).withColumn("score", F.round("score", 6))


@query("dual_search", BATCH.format("q.vec_id = 2") + """, c AS (SELECT *, CASE WHEN label < 5 THEN 'alpha' ELSE 'beta' END AS collection FROM r JOIN embeddings e ON e.vec_id = r.id),
k AS (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY round(score, 9) DESC, id) AS n FROM c)
SELECT collection, id, round(score, 6) AS score FROM k WHERE n <= 5""")
def dual_search(spark, sf):
    """The best of each collection, whose queries have the collection's dimension."""
    v, q, out = vectors(spark, sf), query_vector(spark, sf, 2), None
    for name, part in (("alpha", "label < 5"), ("beta", "label >= 5")):
        found = vector.topk(v.where(part), q, 5).select(F.lit(name).alias("collection"), "id", F.round("score", 6).alias("score"))
        out = found if out is None else out.union(found)
    return out


@query("cross_collection_search", BATCH.format("q.vec_id = 4") + """, k AS (SELECT r.*, label, row_number() OVER (PARTITION BY label ORDER BY round(score, 9) DESC, id) AS n FROM r JOIN embeddings e ON e.vec_id = r.id WHERE label < 5)
SELECT label, id, round(score, 6) AS score, n AS place FROM k WHERE n <= 3""")
def cross_collection_search(spark, sf):
    scored = vectors(spark, sf).where("label < 5").select("label", "id", vector.cosine(F.col("embedding"), query_vector(spark, sf, 4)).alias("score"))
    best = lexical.top_per(scored, "label", [F.round("score", 9).desc(), F.col("id")], 3)
    return best.select("label", "id", F.round("score", 6).alias("score"), F.col("rank").alias("place"))


VEC20 = f"""vec AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM (SELECT e.vec_id AS id, {COS.format('e.embedding', 'x.embedding')} AS score FROM embeddings e, embeddings x WHERE x.vec_id = 0)),
v20 AS (SELECT * FROM vec WHERE rank <= 20), b20 AS (SELECT doc AS id, score, rank FROM ranked WHERE rank <= 20),
fused AS (SELECT coalesce(v.id, b.id) AS id, coalesce({{vw}} / (60 + v.rank), 0) + coalesce({{lw}} / (60 + b.rank), 0) AS score, v.rank AS vr, b.rank AS lr, b.score AS ls FROM v20 v FULL JOIN b20 b ON v.id = b.id)"""
ORDER = "round(score, 12) DESC, coalesce(ls, 0) DESC, coalesce(lr, 1 << 30), coalesce(vr, 1 << 30), id"


def _lists(spark, sf, depth=20):
    v = vector.topk(vectors(spark, sf), query_vector(spark, sf), depth)
    v = v.withColumn("rank", F.row_number().over(Window.orderBy(F.round("score", 9).desc(), "id")).cast("long"))
    x = index(spark, sf).search(one(spark, QUERY), depth).select(F.col("doc").alias("id"), "score", "rank")
    return v, x


def _hybrid_sql(vw, lw, extra="", k=10):
    return f"WITH q AS (SELECT 0::BIGINT AS qid, '{QUERY}' AS text), {BM25}, {VEC20.format(vw=vw, lw=lw)} SELECT id, round(score, 9) AS score, vr, lr FROM (SELECT * FROM fused {extra} ORDER BY {ORDER} LIMIT {k})"


@query("hybrid_rrf", _hybrid_sql("1.0", "1.0"))
def hybrid_rrf(spark, sf):
    return fuse.hybrid_rrf(*_lists(spark, sf), 10).withColumn("score", F.round("score", 9))


@query("hybrid_rrf_weighted", _hybrid_sql("10.0", "1.0"))
def hybrid_rrf_weighted(spark, sf):
    return fuse.hybrid_rrf(*_lists(spark, sf), 10, 10.0, 0.0).withColumn("score", F.round("score", 9))


@query("hybrid_acl", f"WITH q AS (SELECT 0::BIGINT AS qid, '{QUERY}' AS text), {BM25}, {VEC20.format(vw='1.0', lw='1.0')} SELECT f.id, round(score, 9) AS score FROM fused f JOIN documents d ON d.doc_id = f.id WHERE d.source IN ('', 'src1', 'src2', 'src3', 'src5', 'src8') ORDER BY {ORDER.replace('id', 'f.id')} LIMIT 10")
def hybrid_acl(spark, sf):
    """Hybrid strategy: both lists at twice the depth, fused, then the rows that the caller may read."""
    allowed = docs(spark, sf).where(F.col("source").isin("", "src1", "src2", "src3", "src5", "src8")).select("id")
    fused = fuse.hybrid_rrf(*_lists(spark, sf), 40).join(allowed, "id")
    return fused.orderBy(F.round("score", 12).desc(), F.coalesce("lr", F.lit(1 << 30)), F.coalesce("vr", F.lit(1 << 30)), "id").limit(10).select("id", F.round("score", 9).alias("score"))


VARIANTS = [(0, "the of thing"), (1, "that and thing"), (2, "en de la")]
_Q3 = " UNION ALL ".join(f"SELECT {i}::BIGINT AS qid, '{t}' AS text" for i, t in VARIANTS)


def _variants(spark, sf):
    queries = None
    for i, t in VARIANTS:
        queries = one(spark, t, i) if queries is None else queries.union(one(spark, t, i))
    return index(spark, sf).search(queries, 10).select(F.col("qid").alias("list"), F.col("doc").alias("id"), "score", "rank")


@query("multi_query_rrf", f"WITH q AS ({_Q3}), {BM25} SELECT doc AS id, round(sum(1.0 / (60 + rank)), 9) AS fused, round(max(score), 6) AS score FROM ranked WHERE rank <= 10 GROUP BY doc ORDER BY round(sum(1.0 / (60 + rank)), 12) DESC, id LIMIT 10")
def multi_query_rrf(spark, sf):
    return fuse.multi_query_rrf(_variants(spark, sf), 10).select("id", F.round("fused", 9).alias("fused"), F.round("score", 6).alias("score"))


@query("merge_results", f"""WITH q AS ({_Q3}), {BM25}, m AS (SELECT doc AS id, sum(1.0 / (60 + rank)) * CASE WHEN count(*) > 1 THEN count(*) * 0.5 ELSE 1 END AS fused, count(*) AS appearances, min(score) AS best FROM ranked WHERE rank <= 10 GROUP BY doc)
SELECT id, round(fused, 9) AS fused, appearances, round(best, 6) AS best FROM m ORDER BY round(fused, 12) DESC, id LIMIT 10""")
def merge_results(spark, sf):
    return fuse.merge_results(_variants(spark, sf), 10).select("id", F.round("fused", 9).alias("fused"), "appearances", F.round("best", 6).alias("best"))


@query("chunks_strategy", f"WITH q AS ({_Q3}), {BM25} SELECT doc AS id, min(qid) AS first_list, round(arg_min(score, qid), 6) AS score FROM ranked WHERE rank <= 10 GROUP BY doc")
def chunks_strategy(spark, sf):
    """Sub-queries' results in order, an id at its first sight."""
    return _variants(spark, sf).groupBy("id").agg(F.min("list").alias("first_list"), F.round(F.min_by("score", "list"), 6).alias("score"))


@query("lexical_strategy", f"""WITH q AS (SELECT 0::BIGINT AS qid, '{QUERY}' AS text), {BM25}, c AS (SELECT lang, doc, score, row_number() OVER (PARTITION BY lang ORDER BY round(score, 9) DESC, doc) AS place FROM bm JOIN documents d ON d.doc_id = bm.doc)
SELECT lang, doc, round(score, 6) AS score, place FROM c WHERE place <= 5""")
def lexical_strategy(spark, sf):
    """Per-collection best documents; collections stand one after another."""
    scored = index(spark, sf).search(one(spark, QUERY), None).select("doc", "score")
    rows = scored.join(docs(spark, sf).select(F.col("id").alias("doc"), "lang"), "doc")
    best = lexical.top_per(rows, "lang", [F.round("score", 9).desc(), F.col("doc")], 5)
    return best.select("lang", "doc", F.round("score", 6).alias("score"), F.col("rank").alias("place"))


WS = "list_distinct(list_filter(list_transform(regexp_split_to_array(lower(text), '\\s+'), lambda w: trim(w, '.,;:!?\"''()[]{}«»—–-')), lambda w: w <> ''))"


@query("jaccard_pairs", f"""WITH q AS (SELECT item_id AS qid, text FROM benchmark), {BM25}, s AS (SELECT qid, doc AS id, {WS} AS w FROM ranked JOIN documents ON doc_id = doc WHERE rank <= 20),
p AS (SELECT a.qid, a.id AS a, b.id AS b, len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))) AS sim FROM s a JOIN s b ON a.qid = b.qid AND a.id < b.id AND len(a.w) > 0 AND len(b.w) > 0)
SELECT qid, a, b, round(sim, 6) AS sim FROM p WHERE sim > 0.85""")
def jaccard_pairs(spark, sf):
    """Near-equal results of each query, among its twenty best documents."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")
    best = index(spark, sf).search(items, 20).select("qid", F.col("doc").alias("id"))
    found = best.join(docs(spark, sf).select("id", "text"), "id")
    return fuse.jaccard_pairs(found, 0.85, "qid").withColumn("sim", F.round("sim", 6))


@query("similar_vector_pairs", f"SELECT a.vec_id AS a, b.vec_id AS b, round({COS.format('a.embedding', 'b.embedding')}, 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {COS.format('a.embedding', 'b.embedding')} >= 0.4")
def similar_vector_pairs(spark, sf):
    return vector.exact_pairs(vectors(spark, sf), 0.4).withColumn("score", F.round("score", 6))


@query("similar_vector_pairs_lsh")
def similar_vector_pairs_lsh(spark, sf):
    return vector.similar_pairs(vectors(spark, sf), 0.4)


RERANKED = f"""WITH r AS (SELECT id, score, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM (SELECT e.vec_id AS id, {COS.format('e.embedding', 'q.embedding')} AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0) QUALIFY rank <= 20),
x AS (SELECT r.*, CASE WHEN label % 3 = 0 THEN NULL ELSE label * 0.1 END AS rr FROM r JOIN embeddings e ON e.vec_id = r.id)"""


@query("rerank_apply", RERANKED + " SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY rr DESC NULLS LAST, rank) AS new_rank FROM x")
def rerank_apply(spark, sf):
    v, _ = _lists(spark, sf)
    scored = v.join(vectors(spark, sf).select("id", F.expr("if(label % 3 = 0, null, label * 0.1D)").alias("rerank_score")), "id")
    return fuse.rerank(scored).select("id", F.round("score", 6).alias("score"), "new_rank")


@query("search_confidence", RERANKED + """, u AS (SELECT CASE WHEN score < 0 THEN 0 WHEN score <= 1 THEN score ELSE 1 / (1 + score) END AS s FROM x), t AS (SELECT max(s) AS top, (SELECT s FROM u ORDER BY s DESC OFFSET 1 LIMIT 1) AS second FROM u)
SELECT round(top * 0.6 + (top - second) * 0.25 + least((SELECT count(*) FROM u) / 10, 1) * 0.15, 6) AS confidence, (SELECT count(*) FROM u) AS n FROM t""")
def search_confidence(spark, sf):
    return fuse.confidence(_lists(spark, sf)[0])


@query("shadow_compare", f"""{BATCH.format('q.vec_id % 100 = 0')}, a AS (SELECT qid, list(id ORDER BY rank) AS ids FROM r WHERE rank <= 10 GROUP BY qid), b AS (SELECT qid, list(id ORDER BY rank) AS ids FROM r WHERE rank BETWEEN 3 AND 12 GROUP BY qid)
SELECT count(*) AS queries, round(avg(len(list_intersect(a.ids, b.ids))::DOUBLE / len(list_distinct(list_concat(a.ids, b.ids)))), 6) AS jaccard, round(avg((a.ids[1] = b.ids[1])::INT), 6) AS top1 FROM a JOIN b USING (qid)""")
def shadow_compare(spark, sf):
    """Primary against shadow results: Jaccard at k and top-1 stability (two empty lists agree)."""
    v = vectors(spark, sf)
    both = vector.batch_topk(v, v.where("id % 100 = 0").select(F.col("id").alias("qid"), "embedding"), 12)
    ids = lambda low, high: F.transform(F.sort_array(F.collect_list(F.expr(f"if(rank between {low} and {high}, struct(rank, id), null)"))), lambda x: x["id"])
    lists = both.groupBy("qid").agg(ids(1, 10).alias("a"), ids(3, 12).alias("b"))
    return lists.agg(F.count("*").alias("queries"), F.round(F.avg(fuse.jaccard(F.col("a"), F.col("b"), 1.0)), 6).alias("jaccard"), F.round(F.avg((F.col("a")[0] == F.col("b")[0]).cast("int")), 6).alias("top1"))


@query("retrieval_quality", f"""WITH q AS (SELECT item_id AS qid, text FROM benchmark), {BM25}, truth AS (SELECT item_id AS qid, doc_id FROM benchmark JOIN documents d ON contains(d.text, benchmark.text)),
h AS (SELECT t.qid, min(rank) AS r FROM truth t LEFT JOIN ranked k ON k.qid = t.qid AND k.doc = t.doc_id AND rank <= 5 GROUP BY t.qid)
SELECT count(*) AS queries, round(avg((r = 1)::INT * 1.0), 2) AS recall_1, round(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0 END), 2) AS recall_5, round(avg(CASE WHEN r <= 5 THEN 1.0 / r ELSE 0 END), 2) AS mrr FROM (SELECT qid, coalesce(r, 99) AS r FROM h)""")
def retrieval_quality(spark, sf):
    """recall@1, recall@5 and MRR of BM25 on the benchmark items that stand in some document."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")
    d = docs(spark, sf)
    found = index(spark, sf).search(items, 5).select("qid", F.col("doc").alias("id"), "rank")
    # a text that contains an item has all its words but the first and the last whole: the rarest name the documents that are compared
    texts, asked = d.select("id", "text"), items.withColumn("ts", lexical.tokens(F.col("text"))).select("qid", F.col("text").alias("item"), "ts")
    inner = asked.where("size(ts) >= 3").select("qid", F.concat_ws(" ", F.slice("ts", 2, F.size("ts") - 2)).alias("text"))
    named = written(index(spark, sf).holding(inner).withColumnRenamed("doc", "id").join(asked.where("size(ts) >= 3").select("qid", "item"), "qid"), "named")
    truth = named.join(texts, "id").where(F.contains("text", "item")).select("qid", "id")
    short = asked.where("size(ts) < 3 and item is not null").select("qid", "item")
    if not short.isEmpty():
        truth = truth.union(texts.join(short, F.contains("text", "item")).select("qid", "id"))
    best = truth.join(found, ["qid", "id"], "left").groupBy("qid").agg(F.coalesce(F.min("rank"), F.lit(99)).alias("r"))
    return best.agg(
        F.count("*").alias("queries"), F.round(F.avg((F.col("r") == 1).cast("double")), 2).alias("recall_1"),
        F.round(F.avg((F.col("r") <= 5).cast("double")), 2).alias("recall_5"), F.round(F.avg(F.expr("if(r <= 5, 1D / r, 0D)")), 2).alias("mrr"),
    )


@query("summaries_union", "SELECT doc_id AS id, 0.5::DOUBLE AS score FROM documents WHERE text ILIKE '%thing%' AND lang = 'en' ORDER BY doc_id LIMIT 20")
def summaries_union(spark, sf):
    return docs(spark, sf).where(F.col("text").ilike("%thing%") & (F.col("lang") == "en")).orderBy("id").limit(20).select("id", F.lit(0.5).alias("score"))


@query("rag_contexts", f"WITH q AS (SELECT 0::BIGINT AS qid, '{QUERY}' AS text), {BM25}, c AS (SELECT doc, text, row_number() OVER (ORDER BY rank) AS number FROM ranked JOIN documents d ON d.doc_id = ranked.doc WHERE rank <= 30 AND strlen(text) > 20) SELECT number, doc, '[' || number || '] ' || substr(text, 1, 80) AS context FROM c WHERE number <= 10")
def rag_contexts(spark, sf):
    """Numbered contexts of over 20 bytes for an answer: the retrieval half of completion."""
    best = index(spark, sf).search(one(spark, QUERY), 30).join(docs(spark, sf).select(F.col("id").alias("doc"), "text"), "doc").where(F.octet_length("text") > 20)
    numbered = best.withColumn("number", F.row_number().over(Window.orderBy("rank")).cast("long")).where("number <= 10")
    return numbered.select("number", "doc", F.concat(F.lit("["), F.col("number"), F.lit("] "), F.substring("text", 1, 80)).alias("context"))


@query("memory_recall", f"WITH q AS (SELECT 0::BIGINT AS qid, 'zzzz unheard' AS text), {BM25}, hits AS (SELECT doc FROM ranked WHERE rank <= 10) SELECT doc_id AS id FROM documents WHERE source = 'src4' AND text ILIKE '%tion%' AND NOT EXISTS (SELECT * FROM hits) ORDER BY id LIMIT 20")
def memory_recall(spark, sf):
    """Ranked hits inside the scope, else a LIKE search of the scope."""
    scope = docs(spark, sf).where("source = 'src4'")
    hits = index(spark, sf).search(one(spark, "zzzz unheard"), 10).select(F.col("doc").alias("id")).join(scope.select("id"), "id", "left_semi")
    some = hits.agg((F.count("*") > 0).alias("some"))
    fallback = scope.where(F.col("text").ilike("%tion%")).select("id").crossJoin(some).where("not some").select("id").orderBy("id").limit(20)
    return hits.union(fallback)
