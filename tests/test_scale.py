"""Steps whose memory, shuffles or results went wrong on larger or odd tables."""

import duckdb
from pyspark.sql import functions as F

from loomgraph import registry


def put(spark, tmp_path, **tables):
    """A scale folder of its own."""
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_a_score_of_one_is_a_distance_where_the_sql_says_so(spark, tmp_path):
    sf = put(spark, tmp_path, events=spark.range(60001).select(F.col("id").alias("event_id"), (F.col("id") / 100).alias("value")).coalesce(1))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet/*.parquet'")
    mine = registry.queries()["score_normalise"](spark, sf).collect()
    assert sorted(map(tuple, mine)) == sorted(c.sql(registry.oracle_sql()["score_normalise"]).fetchall())


def test_vsa_query_on_packed_signs(spark, tmp_path):
    """The same answers as the sums of unpacked signs, with keys that repeat, nulls and a bundle of more than fifteen facts."""
    from loomgraph.operators import records, vector

    rows = [(k, k * 7 % 25 if k % 11 else None) for k in range(400)] + [(5, n) for n in range(20)] + [(None, 3)]
    sf = put(spark, tmp_path, customer=spark.createDataFrame(rows, "c_custkey long, c_nationkey int"))
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.concat(F.lit("c"), "c_custkey").alias("s"), F.concat(F.lit("n"), "c_nationkey").alias("o"), F.floor(F.col("c_custkey") / 12).alias("shard"))
    sums = records.bundle(c.withColumn("v", records.bind(records.symbol(F.col("s"), 256), records.symbol(F.col("o"), 256))), "shard", "v")
    names = c.select("o").distinct().select(F.col("o").alias("guess"), records.symbol(F.col("o"), 256).alias("g"))
    asked = c.join(sums, "shard").withColumn("u", records.bind(F.col("bundle"), records.symbol(F.col("s"), 256))).crossJoin(names)
    told = asked.groupBy("s", "o").agg(F.max(F.struct(vector.dot(F.col("u"), F.col("g")).alias("d"), "guess"))["guess"].alias("answer")).distinct()
    query = registry.queries()["vsa_query"](spark, sf)
    assert sorted(map(repr, query.distinct().collect())) == sorted(map(repr, told.collect())) and query.count() == 420
    assert "pos" not in query._jdf.queryExecution().optimizedPlan().toString()  # no row a sign


def some_vectors(spark, n=600, dim=8):
    import random

    r = random.Random(4)
    kinds = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(40)]
    made = [(i, [x + r.gauss(0, 0.05) for x in r.choice(kinds)] if i % 3 else [r.gauss(0, 1) for _ in range(dim)]) for i in range(n)]
    made += [(n + i, made[5][1]) for i in range(60)] + [(n + 60, [0.0] * dim), (n + 61, [1.0]), (n + 62, []), (n + 63, None), (7, made[5][1])]
    return spark.createDataFrame(made, "id long, embedding array<float>")


def test_pairs_forests_and_greedy_rounds_agree(spark, monkeypatch):
    from loomgraph.operators import graph, vector
    from loomgraph.operators.components import components

    monkeypatch.setattr(vector, "HELD", 64)
    v = some_vectors(spark)
    a, b = v.toDF("a", "va"), v.toDF("b", "vb")
    true = a.join(b, F.expr("a < b and size(va) = size(vb)")).where(vector.cosine(F.col("va"), F.col("vb")) >= 0.8).select("a", "b", vector.cosine(F.col("va"), F.col("vb")).alias("score")).cache()
    want = {(r.a, r.b) for r in true.collect()}
    for block in (None, 50):
        assert {(r.a, r.b) for r in vector.exact_pairs(v, 0.8, block=block).collect()} == want
        assert sorted(components(vector.linked(v, 0.8, block=block)).collect()) == sorted(components(true).collect())
    unique = v.where("id <> 7")
    told = {r.removed: r.kept for r in graph.greedy_dedup(vector.exact_pairs(unique, 0.8)).collect()}
    monkeypatch.setattr(graph, "FIRST", 70)
    found = {r.removed: r.kept for r in graph.greedy_dedup_vectors(unique, 0.8).collect()}
    assert found.keys() == told.keys() and sum(found[k] != told[k] for k in told) <= 2  # equal scores


def test_buckets_are_products_and_crowded_ones_divided(spark, monkeypatch):
    from loomgraph.operators import vector

    v = some_vectors(spark)
    want = {(r.a, r.b) for r in vector.exact_pairs(v, 0.95).collect()}
    assert {(r.a, r.b) for r in vector.similar_pairs(v, 0.4).collect()} == {(r.a, r.b) for r in vector.exact_pairs(v, 0.4).collect()}  # too many tables
    whole = vector.similar_pairs(v, 0.95, tables=12, bits=6)
    found = sorted((r.a, r.b) for r in whole.collect())
    assert len(found) == len(set(found)) and set(found) <= want and len(found) > 0.95 * len(want)
    assert "Join" not in whole._jdf.queryExecution().optimizedPlan().toString()  # no candidate leaves its task
    monkeypatch.setattr(vector, "CROWDED", 20)
    assert sorted((r.a, r.b) for r in vector.similar_pairs(v, 0.95, tables=12, bits=6).collect()) == found


def test_batched_top_k_holds_strips(spark):
    """600 queries against 10,000 rows are 48 MB of products at once."""
    import tracemalloc
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    from loomgraph.operators import vector

    r = np.random.default_rng(2)
    q, m = r.integers(-3, 4, (600, 6)).astype(float), r.integers(-3, 4, (10_000, 6)).astype(float)  # many equal scores
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000)), pa.array(list(m))], names=["id", "embedding"])
    run = vector._best(SimpleNamespace(value=(list(range(600)), list(q))), 7)
    tracemalloc.start()
    out = list(run([batch.slice(0, 5), batch.slice(5)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
    got = {}
    for b in out:
        for qid, i, s in zip(*(c.to_pylist() for c in b.columns)):
            got.setdefault(qid, set()).add((i, round(s, 9)))
    score = vector._unit(q) @ vector._unit(m).T
    for k in range(600):
        order = np.lexsort((np.arange(10_000), -np.round(score[k], 9)))[:7]
        assert {i for i, _ in got[k]} == set(order.tolist())


def test_python_gets_batches_of_bounded_bytes(spark, monkeypatch):
    from loomgraph.operators import chunk, lexicalindex

    rows = spark.range(0, 3000, 1, 1).selectExpr("id", "id as doc_id", "repeat('word and ', 1000) as text")
    seen = lambda: lambda batches: (b.slice(0, 0) for b in batches if b.nbytes < 6 << 20 or 1 / 0)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    for call in (lambda: chunk.chunks(rows), lambda: chunk.parent_children(rows), lambda: lexicalindex.forward(rows)):
        call()
        assert rows.mapInArrow(seen(), rows.schema).count() == 0
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")


def test_sweeps_broadcast_nothing(spark):
    from loomgraph.operators import communities, graph

    g = spark.range(60).selectExpr("id as a", "id + 1 + id % 3 as b", "1D as weight")
    whole = communities.weighted(g)
    labels = whole.nodes.select("id", (F.col("id") % 7).alias("community"))
    plans = []
    real = communities._written

    def noted(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name)

    try:
        communities._written = noted
        communities._moved(whole, communities.written(labels, "labels"), 1.0, 0, 0, 3)
    finally:
        communities._written = real
    assert not any("Broadcast" in p for p in plans) and any("SortMergeJoin" in p for p in plans)
    assert "Broadcast" not in graph.modularity(g, labels).select("modularity")._jdf.queryExecution().optimizedPlan().toString()


def test_vector_search_ranks_the_best_of_each_part(spark, tmp_path, monkeypatch):
    """What is ranked is the best of a part for each query, not of each block of codes, and rows that are over take no places."""
    from loomgraph.operators import vectorindex

    v = some_vectors(spark).where("id < 660 and id <> 7")
    index = vectorindex.VectorIndex.fit(v, str(tmp_path / "ix"), cells=16, rounds=2).remove(v.where("id % 2 = 1").select("id"))
    asked = v.where("id % 20 = 0").select(F.col("id").alias("qid"), "embedding")
    ranked, real = [], vectorindex.top_per
    monkeypatch.setattr(vectorindex, "top_per", lambda df, *more: ranked.append(df) or real(df, *more))
    few = index.candidates(asked, 2, probes=16, depth=3)
    assert ranked[0].count() <= 6 * asked.count() and few.count() == 6 * asked.count()
    everything = sorted(map(tuple, index.candidates(asked, 100, probes=16, depth=100).collect()))
    assert len(everything) == asked.count() * v.where("id % 2 = 0").count()
    for name, value in (("QUERIES", 7), ("PART", 8 * 50), ("LEAST_ROWS", 20)):  # many blocks and parts
        monkeypatch.setattr(vectorindex, name, value)
    assert sorted(map(tuple, index.candidates(asked, 100, probes=16, depth=100).collect())) == everything
    assert sorted(map(tuple, index.candidates(asked, 2, probes=16, depth=3).collect())) == sorted(map(tuple, few.collect()))


def test_many_long_queries_read_the_documents_once(spark, tmp_path, monkeypatch):
    """No posting of them leaves its task, and the results are those of the blocks, after changes as well."""
    from loomgraph.operators import lexical, lexicalindex
    from test_indexes import texts

    docs = spark.createDataFrame(texts(500), "id long, text string")
    index = lexicalindex.Index.build(docs, str(tmp_path / "ix"))
    items = [(i, t[:200] + " the the") for i, t in texts(40, 9)] + [(90, None), (91, "unheard"), (92, "w3")]
    asked = spark.createDataFrame(items, "qid long, text string")
    new = spark.createDataFrame([(i, t + " w17") for i, t in texts(60, 2) if i % 3 == 0] + [(5000, "the of"), (5001, None)], "id long, text string")
    now = docs.join(new, "id", "left_anti").union(new).where("id <> 4")
    scored = lambda df: sorted(map(tuple, df.selectExpr("qid", "doc", "round(score, 9)", "rank").collect()))
    monkeypatch.setattr(lexicalindex.Index, "_payload", lambda *_: 1 / 0)
    assert scored(index.search(asked, 5)) == scored(lexical.bm25(docs, asked, 5))
    want = scored(lexical.bm25(now, asked, 7, k1=0.9, b=0.4))
    index.upsert(new).remove(spark.createDataFrame([(4,)], "id long"))
    assert scored(index.search(asked, 7, 0.9, 0.4)) == want
    monkeypatch.setattr(lexicalindex, "ASKED", 300)
    monkeypatch.setattr(lexicalindex, "HELD", 100)  # several blocks of queries, few documents at a time
    assert scored(index.search(asked, 7, 0.9, 0.4)) == want


def test_retrieval_quality_of_short_items(spark, tmp_path):
    """Items of a word or none, and parts of words at an item's ends, are in the truth as in the SQL."""
    made = [(0, "one two three four five six"), (1, "two"), (2, "None two three four five sixty"), (3, None), (4, ""), (5, "a b, two three"), (6, "x"), (7, "other words here for length")]
    items = [(0, "one two three four five six"), (1, "two three four"), (2, "two"), (3, ", "), (4, None), (5, "ne two three four fi"), (6, "never seen in any text"), (7, "x")]
    sf = put(spark, tmp_path, documents=spark.createDataFrame([(i, x, "s", "en", 1) for i, x in made], "doc_id long, text string, source string, lang string, n_chars long"), benchmark=spark.createDataFrame(items, "item_id long, text string"))
    c = duckdb.connect()
    for name in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet/*.parquet'")
    mine = registry.queries()["retrieval_quality"](spark, sf).select("queries", "recall_1", "recall_5", "mrr").collect()
    assert list(map(tuple, mine)) == [tuple(map(float, r)) for r in c.sql(registry.oracle_sql()["retrieval_quality"]).fetchall()]


def test_substring_postings_are_lists(spark, tmp_path):
    """A piece's texts of a batch are one row of the postings, whatever letters there are."""
    from loomgraph.operators import substring

    made = [(i, f"abcabc {i % 7}𝄞éß TEXT\n\0end") for i in range(300)] + [(900, None), (901, ""), (902, "ab"), (903, "a𝄞b𝄞")]
    t = spark.createDataFrame(made, "id long, text string").coalesce(1)
    index = substring.SubstringIndex.build(t, str(tmp_path / "s"))
    kept = index._read("postings")
    assert kept.count() < 300
    each = lambda df: sorted(map(tuple, df.collect()))
    assert each(kept.where("piece in ('abc', 'xt\\n', 'bca')").select("piece", F.explode("ids").alias("id")).distinct()) == sorted((p, i) for p in ("abc", "bca", "xt\n") for i in range(300))
    p = spark.createDataFrame([(0, "CABC 3𝄞É"), (1, "\0end"), (2, "𝄞b𝄞"), (3, "b𝄞"), (4, "absent"), (5, ""), (6, "t\n\0")], "qid long, pattern string")
    want = sorted((q, i) for q, x in map(tuple, p.collect()) for i, y in made if x and y and x.lower() in y.lower())
    assert each(index.containing(p)) == want


def test_distances_between_kinds_of_nodes(spark, monkeypatch):
    """As brute force, with nodes alike, loops, ends that are null and nodes of many edges; an end that is null is reached once and not left."""
    import random

    from loomgraph.operators import traverse

    monkeypatch.setattr(traverse, "SHARED", 4)
    monkeypatch.setattr(traverse, "BLOCK", 3)
    r = random.Random(8)
    edges = [(f"c{i}", f"n{i % 3}") for i in range(60)] + [(f"c{i}", f"p{i % 2}") for i in range(40)] + [("n0", "r"), ("n1", "r"), ("n2", None), (None, "p0"), ("c7", None), ("c1", "c1"), ("c4", "c1"), ("c1", "c4"), ("x", "y")]
    edges += [(f"t{r.randrange(9)}", f"t{r.randrange(9)}") for _ in range(12)] + [("t1", "c3")]
    e = spark.createDataFrame([(a, b, "r") for a, b in edges], "source_id string, target_id string, relation string").coalesce(1)
    seeds = [f"c{i}" for i in range(0, 60, 2)] + ["c1", "c7", "n1", "p0", "x", "y", "t1", "t4", "c2", "unknown", None]
    asked = spark.createDataFrame([(s,) for s in seeds], "seed string").coalesce(1)
    for both, hops in ((True, 3), (False, 3)):
        near = {}
        for a, b in edges + [(b, a) for a, b in edges if both]:
            near.setdefault(a, set()).add(b)
        want = {}
        for s in {s for s in seeds if s}:
            front, want[s, s] = {s}, 0
            for d in range(1, hops + 1):
                front = {b for a in front if a for b in near.get(a, ()) if (s, b) not in want}
                want.update({(s, b): d for b in front})
        walk = traverse.Walk(e, both=both, buckets=2)
        got = sorted(map(repr, (tuple(x) for x in walk.distances(asked, hops).collect())))
        assert got == sorted(repr((s, i, d)) for (s, i), d in want.items())
        kinds = walk.kinds()
        assert kinds.select("kind").distinct().count() < kinds.count() / 2
    # no row of a start and a node is shuffled
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = walk.distances(asked, 2)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" in plan and "Exchange" not in plan[: plan.index("explode(seeds")]


def test_distances_of_many_starts_in_longer_blocks(spark, monkeypatch):
    """Blocks of nodes grow with the starts, those of starts shrink; nothing but the explodes makes, joins or compares single rows."""
    from loomgraph.operators import traverse

    for name, value in (("BLOCK", 8), ("EACH", 4), ("BLOCKS", 8), ("ROWS", 256)):
        monkeypatch.setattr(traverse, name, value, raising=False)
    sizes, blocks = [], traverse._blocks
    monkeypatch.setattr(traverse, "_blocks", lambda rows, size: sizes.append(size) or blocks(rows, size))
    e = spark.range(600).selectExpr("concat('c', id) as source_id", "'n' as target_id", "'r' as relation").coalesce(1)
    far = traverse.Walk(e, buckets=2).distances(e.selectExpr("source_id as seed"), 2)
    assert sizes[0] > 8 and sizes[1] < 64 and sizes[0] * sizes[1] <= 256
    plan = far._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("explode(seeds")]
    assert "Generate explode(ids" in above and not any(x in above for x in ("Union", "Filter", "Join"))
    assert sorted(map(tuple, far.groupBy("distance").count().collect())) == [(0, 600), (1, 600), (2, 600 * 599)]
    assert far.distinct().count() == 600 * 601 and far.where("(distance = 0) <> (seed = id)").isEmpty()
