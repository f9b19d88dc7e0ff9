"""The search strategies by name.  Each takes (spark, tables, request) and returns a DataFrame.

``tables`` may hold docs(id, text, collection), vectors(id, embedding), events(id, at), nodes and
edges of the graph, summaries(id, text, embedding), communities(id, node, summary).  Embeddings and
answers come from models outside: ``request["embedding"]`` is the query's vector, and what a
completion strategy returns is the numbered context of its answer.
"""

import functools

from pyspark.sql import Window, functions as F

from . import graph, lexical, policy, relate, substring, vector
from .fuse import hybrid_rrf
from .predicates import allowed_rows
from .router import route

STRATEGIES = {}
FALLBACK = "CHUNKS"


def strategy(*names):
    """Register a function under names; a later registration replaces an earlier one."""

    def add(f):
        for n in names:
            STRATEGIES[n] = f
        return f

    return add


def get(name: str):
    """The strategy of a name; CHUNKS for names that nobody registered."""
    return STRATEGIES.get(name, STRATEGIES[FALLBACK])


def search(spark, tables: dict, request: dict):
    """Run ``request``: its query_type, else the routed strategy."""
    name = request.get("query_type")
    if not name:
        one = spark.range(1).select(F.lit(request["query"]).alias("text"))
        name = route(one, request.get("have") or ("bm25", "embedding"), weights=request.get("weights")).first()["strategy"]
    return get(name)(spark, tables, request)


def _k(request):
    return request.get("k", 10)


def _ranked(found):
    return found.withColumn("rank", F.row_number().over(Window.orderBy(F.round("score", 9).desc(), "id")).cast("long"))  # k rows


@strategy("CHUNKS_LEXICAL", "BM25")
def lexical_chunks(spark, tables, request):
    q = spark.range(1).select(F.lit(0).cast("long").alias("qid"), F.lit(request["query"]).alias("text"))
    return lexical.bm25(tables["docs"], q, _k(request)).select(F.col("doc").alias("id"), "score", "rank")


@strategy("CHUNKS")
def chunks(spark, tables, request):
    """The nearest chunks; without an embedding of the query, the lexical ones."""
    if "embedding" not in request:
        return lexical_chunks(spark, tables, request)
    allowed = request.get("allowed")
    rows = tables["vectors"] if allowed is None else allowed_rows(tables["vectors"], allowed, F.col("dataset_id"))
    return _ranked(vector.topk(rows, F.array(*[F.lit(float(x)) for x in request["embedding"]]), _k(request)))


@strategy("HYBRID", "WEIGHTED_HYBRID")
def hybrid(spark, tables, request):
    deep = {**request, "k": 2 * _k(request)}
    return hybrid_rrf(chunks(spark, tables, deep), lexical_chunks(spark, tables, deep), _k(request), request.get("vector_weight", 1.0), request.get("lexical_weight", 1.0))


@strategy("TEMPORAL")
def temporal(spark, tables, request):
    """Events of the range first, by time, then chunks; each id once."""
    k = _k(request)
    dated = tables["events"].where(F.col("at").between(F.lit(request["from"]), F.lit(request["to"]))).orderBy("at", "id").limit(k).select("id", F.lit(0).alias("provider"), F.struct(F.unix_micros(F.col("at").cast("timestamp")).cast("double").alias("a"), F.col("id").alias("b")).alias("place"))
    near = chunks(spark, tables, request).select("id", F.lit(1).alias("provider"), F.struct(F.col("rank").cast("double").alias("a"), F.col("id").alias("b")).alias("place"))
    both = dated.union(near).groupBy("id").agg(F.min(F.struct("provider", "place")).alias("p"))
    return both.orderBy("p").limit(k).select("id", F.col("p.provider").alias("provider"))


@strategy("RAG_COMPLETION")
def rag(spark, tables, request):
    """Up to ten numbered contexts of over 20 bytes, from the max(3k, 20) nearest chunks."""
    found = chunks(spark, tables, {**request, "k": max(3 * _k(request), 20)}).join(tables["docs"].select("id", "text"), "id").where(F.octet_length("text") > 20)
    numbered = found.withColumn("number", F.row_number().over(Window.orderBy("rank")).cast("long")).where("number <= 10")  # few rows
    return numbered.select("number", "id", F.concat(F.lit("["), "number", F.lit("] "), "text").alias("context"))


@strategy("SUMMARIES")
def summaries(spark, tables, request):
    """Nearest summaries, and those that contain the query's text, at a score of .5."""
    s = tables["summaries"]
    like = s.where(F.col("text").ilike(f"%{request['query']}%")).select("id", F.lit(0.5).alias("score"))
    near = chunks(spark, {"vectors": s}, request).select("id", "score") if "embedding" in request else like.where("false")
    return near.union(like).groupBy("id").agg(F.max("score").alias("score")).orderBy(F.round("score", 9).desc(), "id").limit(_k(request))


def _names(spark, tables, request):
    """(name) of the entities nearest to the query, or whose name is a word of it."""
    if "embedding" in request and "entities" in tables:
        return chunks(spark, {"vectors": tables["entities"]}, request).join(tables["nodes"].select("id", "name"), "id").select("name").distinct()
    words = spark.range(1).select(F.explode(lexical.tokens(F.lit(request["query"]))).alias("w")).where("char_length(w) > 2")
    hits = substring.containing(tables["nodes"].select("id", F.col("name").alias("text")), words.select(F.lit(0).alias("qid"), F.col("w").alias("pattern")))
    return tables["nodes"].join(hits.select("id"), "id", "left_semi").select("id", "name").distinct().orderBy("id").limit(10).select("name")


@strategy("GRAPH_COMPLETION", "GRAPH_SUMMARY_COMPLETION")
def graph_completion(spark, tables, request):
    """(id, source, relation, target): edges from the entities that the query names."""
    names = _names(spark, tables, request).withColumnRenamed("name", "source")
    named = relate.named_edges(tables["nodes"], tables["edges"]).join(F.broadcast(names), "source", "left_semi")  # k names
    return named.select("id", "source", "relation", "target").orderBy("id").limit(request.get("limit", 50))


@strategy("GRAPH_COMPLETION_COT")
def by_sub_question(spark, tables, request):
    """(step, question, context): the edges that each of up to five ``questions`` finds, one step a question; without any, the query's own."""
    asked = list(request.get("questions") or [request["query"]])[:5]
    vectors = list(request.get("embeddings") or [])
    out = None
    for step, question in enumerate(asked, 1):
        one = {**request, "query": question}
        one.pop("embedding", None)
        if step <= len(vectors):
            one["embedding"] = vectors[step - 1]
        named = _names(spark, tables, one)
        edges = graph_completion(spark, tables, one).select("id", F.concat("source", F.lit(" —["), "relation", F.lit("]→ "), "target").alias("edge"))
        lines = edges.agg(F.concat_ws("; ", F.transform(F.array_sort(F.collect_list(F.struct("id", "edge"))), lambda x: x["edge"])).alias("found"))  # the limit's edges
        known = named.agg(F.concat_ws(", ", F.array_sort(F.collect_set("name"))).alias("entities"))
        text = F.when(F.col("found") != "", F.col("found")).when(F.col("entities") != "", F.concat(F.lit("Entities found: "), "entities")).otherwise(F.lit("(no relevant context found)"))
        row = lines.crossJoin(known).select(F.lit(step).alias("step"), F.lit(question).alias("question"), text.alias("context"))  # one row each
        out = row if out is None else out.union(row)
    return out


@strategy("GRAPH_COMPLETION_CONTEXT_EXTENSION")
def context_extension(spark, tables, request):
    """The first hop, then edges from up to ten of its new targets, within the limit."""
    limit = request.get("limit", 50)
    first = graph_completion(spark, tables, request)
    new = first.select(F.col("target").alias("source")).distinct().join(first.select("source").distinct(), "source", "left_anti").orderBy("source").limit(10)
    second = relate.named_edges(tables["nodes"], tables["edges"]).join(F.broadcast(new), "source", "left_semi").select("id", "source", "relation", "target")
    both = first.withColumn("hop", F.lit(1)).union(second.withColumn("hop", F.lit(2)))
    return both.groupBy("id", "source", "relation", "target").agg(F.min("hop").alias("hop")).orderBy("hop", "id").limit(limit)


@strategy("TRIPLET_COMPLETION")
def triplets(spark, tables, request):
    """The triplets nearest to the query's vector where they have vectors, else those whose texts hold its words."""
    if "embedding" in request and "triplets" in tables:
        return chunks(spark, {"vectors": tables["triplets"]}, request)
    texts = graph.triplets(tables["nodes"], tables["edges"]).select("id", "text")
    return lexical_chunks(spark, {"docs": texts}, request)


@strategy("NATURAL_LANGUAGE", "CYPHER")
def graph_query(spark, tables, request):
    """One reading query over ``nodes`` and ``edges``, a model's text among them; everything else is refused."""
    return policy.read(spark, request["sql"], nodes=tables["nodes"], edges=tables["edges"])


@strategy("CODE", "CODING_RULES")
def code(spark, tables, request):
    """(rule) sentences of the edges around the entities that the query names."""
    names = _names(spark, tables, request).withColumnRenamed("name", "source")
    ends = tables["nodes"].join(F.broadcast(names.select(F.col("source").alias("name"))), "name", "left_semi").select(F.col("id").alias("source_id"))
    return relate.code_rules(tables["nodes"], tables["edges"].join(ends, "source_id", "left_semi"), request.get("verbs") or {"CALLS": "calls"}, request.get("limit", 100))


@strategy("COMMUNITY_LOCAL")
def community_local(spark, tables, request):
    """(id, summary) of the communities of the entities that the query names."""
    names = _names(spark, tables, request)
    ids = tables["nodes"].join(F.broadcast(names), "name", "left_semi").select(F.col("id").alias("node"))
    return tables["communities"].join(ids, "node", "left_semi").select("id", "summary").distinct().orderBy("id").limit(_k(request))


@strategy("COMMUNITY_GLOBAL")
def community_global(spark, tables, request):
    """The five summaries that match best, by their vectors where they have any."""
    if "embedding" in request and "embedding" in tables["communities"].columns:
        return chunks(spark, {"vectors": tables["communities"].select("id", "embedding").dropDuplicates(["id"])}, {**request, "k": 5})
    texts = tables["communities"].select("id", F.col("summary").alias("text")).distinct()
    return lexical_chunks(spark, {"docs": texts}, {**request, "k": 5})


# fixed values: the kinds of search of each mode, and what stands in for others
MODES = {
    "rag": ("CHUNKS", "HYBRID", "CHUNKS_LEXICAL", "RAG_COMPLETION", "SUMMARIES", "WEIGHTED_HYBRID"),
    "graph": ("GRAPH_COMPLETION", "GRAPH_COMPLETION_COT", "GRAPH_COMPLETION_CONTEXT_EXTENSION", "GRAPH_SUMMARY_COMPLETION", "COMMUNITY_LOCAL", "COMMUNITY_GLOBAL", "CYPHER", "TRIPLET_COMPLETION", "TEMPORAL"),
}
# fixed values: how many times k is fetched before a metadata filter, and the likeness from which results are merged
OVERFETCH, ALIKE = 3, 0.85


def gated(mode: str, kind: str) -> str:
    """The kind of search that runs in a mode: the asked one if the mode has it or the router decides, else the mode's own."""
    if mode not in MODES or kind.upper() in ("", "AUTO") or kind.upper() in MODES[mode]:
        return kind
    return MODES[mode][0]


def collected(found, k, allowed=None, room="", tags=(), merge=False):
    """(collection, id, score): the first k of ``found(collection, id, score, metadata, text)``, collection by collection in order of name.

    Each collection gives its best k, ``OVERFETCH`` times as many before a filter by room or tags; alike
    texts of one collection are merged if asked for, then come the datasets ``allowed`` and the filter.
    """
    from . import fuse, predicates

    fetched = lexical.top_per(found, "collection", [F.round("score", 9).desc(), F.col("id")], k * OVERFETCH if room or tags else k).withColumnRenamed("rank", "pos")
    if merge:
        fetched = fuse.deduplicated(fetched, ALIKE, "collection")
    if allowed is not None:
        fetched = allowed_rows(fetched, allowed, predicates.dataset_of(F.col("metadata")))
    if room or tags:
        fetched = fetched.where(predicates.chunk_matches(F.col("metadata"), room, tags))
    return fetched.orderBy("collection", "pos").limit(k).select("collection", "id", "score")


names = functools.partial(sorted, STRATEGIES)
