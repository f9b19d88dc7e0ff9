"""The lexical and the vector index: exact results after chains of changes, what a search leaves unread, streams."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import lexical, lexicalindex, vector, vectorindex


def rows(df):
    return sorted(map(tuple, df.collect()))


def scored(df):
    return rows(df.selectExpr("qid", "doc", "round(score, 9)", "rank"))


def texts(n, seed=1):
    """Texts with three words that nearly all have, and rarer ones by a steep law."""
    r = random.Random(seed)
    return [(i, " ".join([*(w for w in ("the", "of", "and") if r.random() < 0.9), *(f"w{int(r.paretovariate(0.6))}" for _ in range(r.randrange(3, 60)))] * r.choice([1, 1, 2]))) for i in range(n)]


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "the of w17"), (2, "w3 w5 w5 and"), (3, "unheard"), (4, "w1 w2 w40 the of and"), (5, "")], "qid long, text string")


def test_lexical_changes(spark, queries, tmp_path):
    docs = spark.createDataFrame(texts(600), "id long, text string")
    made = lexicalindex.Index.build(docs, str(tmp_path / "ix"))
    for k in (1, 5, 50):
        assert scored(made.search(queries, k)) == scored(lexical.bm25(docs, queries, k))
    assert rows(made.search(queries, None).selectExpr("qid", "doc", "round(score, 9)")) == rows(lexical.bm25(docs, queries, None).selectExpr("qid", "doc", "round(score, 9)"))
    new = spark.createDataFrame([(i, t + " w17") for i, t in texts(900, 2) if i % 7 == 0] + [(5000, ""), (5001, None)], "id long, text string")
    made.upsert(new).remove(spark.createDataFrame([(3,), (14,), (77777,), (None,)], "id long")).upsert(new.where("id % 14 = 7"))
    now = docs.join(new, "id", "left_anti").union(new).where("id not in (3, 14)")
    again = lexicalindex.Index(spark, str(tmp_path / "ix"))
    assert again.version == 3 and again.size()[0] == now.count()
    assert scored(again.search(queries, 7)) == scored(lexical.bm25(now, queries, 7))
    assert rows(again.postings().where("term = 'w17'")) == rows(lexical.postings(now).where("term = 'w17'").select("term", "doc", "tf", "dl"))
    merged = again.merge()
    assert merged.segments == [lexicalindex.ERA] and scored(merged.search(queries, 7, 0.9, 0.4)) == scored(lexical.bm25(now, queries, 7, k1=0.9, b=0.4))
    assert scored(merged.remove(now.select("id")).search(queries, 7)) == []


def test_lexical_search_leaves_blocks_unread(spark, queries, tmp_path):
    docs = spark.createDataFrame(texts(6000, 3), "id long, text string")
    made = lexicalindex.Index.build(docs, str(tmp_path / "ix"))
    rare = made.postings().groupBy("term").count().where("count between 4 and 6").orderBy("term").first()[0]
    asked = spark.createDataFrame([(1, f"the of {rare}")], "qid long, text string")
    assert scored(made.search(asked, 3)) == scored(lexical.bm25(docs, asked, 3))
    r = made.blocks(asked, 3).first()
    assert r.blocks > 80 and r.blocks_read < r.blocks / 2 and r.postings_read < r.postings / 2
    # a term that nearly every document has is many rows of bounded size
    heads = made._read("postings").where("term = 'the'")
    assert heads.count() >= 40 and heads.agg(F.max("n")).first()[0] <= lexicalindex.BLOCK
    # the terms asked for reach the scan
    plan = made._of(made._read("postings"), None, ["w17", "the"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term" in plan


def test_lexical_stream(spark, queries, tmp_path):
    (tmp_path / "in").mkdir()
    made = lexicalindex.Index.build(spark.createDataFrame([], "id long, text string"), str(tmp_path / "ix"))
    assert scored(made.search(queries, 3)) == []
    parts = [texts(40, s) for s in (5, 6, 7, 8)]
    for stop in (2, 4):  # stopped and started again
        for i, part in enumerate(parts[:stop]):
            if not (tmp_path / "in" / f"{i}").exists():
                spark.createDataFrame([(x + 20 * i, t) for x, t in part], "id long, text string").coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
        source = spark.readStream.schema("id long, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        made.follow(source, str(tmp_path / "ck"), most=3).processAllAvailable()
        for q in spark.streams.active:
            q.stop()
    last = {x + 20 * i: t for i, part in enumerate(parts) for x, t in part}
    now = spark.createDataFrame(list(last.items()), "id long, text string")
    assert made.refresh().version >= lexicalindex.ERA and made.size()[0] == len(last)
    got, want = made.search(queries, None), lexical.bm25(now, queries, None)
    assert len(rows(got.select("qid", "doc"))) > 40 and abs(got.agg(F.sum("score")).first()[0] / want.agg(F.sum("score")).first()[0] - 1) < 0.5


def clustered(n=4000, dim=24, kinds=40, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((kinds, dim))
    return [(i, (centres[i % kinds] + 0.3 * rng.standard_normal(dim)).tolist()) for i in range(n)]


def test_vector_index(spark, tmp_path):
    table = clustered()
    odd = [(9001, None), (9002, [0.0] * 24), (9003, [1.0] * 3), (9004, [float("nan")] * 24), (None, [1.0] * 24)]
    v = spark.createDataFrame(table + odd, "id long, embedding array<double>")
    index = vectorindex.VectorIndex.fit(v, str(tmp_path / "ix"), cells=64, rounds=4)
    asked = v.where("id % 100 = 0").select(F.col("id").alias("qid"), "embedding")
    good = v.where("id < 9000")
    hits = lambda got, want: len(set(rows(got.select("qid", "id"))) & set(rows(want.select("qid", "id")))) / want.count()
    true = vector.batch_topk(good, asked, 10)
    found = index.search(asked, 10)
    assert hits(found, true) >= 0.95 and index.probes <= 32
    assert rows(found.where("rank = 1").selectExpr("qid", "id")) == [(i, i) for i in range(0, 4000, 100)]
    # one query reads the files of the cells nearest to it
    files = index._read("codes", [0]).select(F.input_file_name().alias("f"), "cell")
    cells = [r.cell for r in index.probed(asked.limit(1)).collect()]
    assert len(cells) == index.probes
    assert files.where(F.col("cell").isin(cells)).select("f").distinct().count() < files.select("f").distinct().count() * 0.6
    plan = index._read("codes", [0]).where(F.col("cell").isin(cells))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan
    # changes are segments: nothing is fitted again
    new = spark.createDataFrame([(i, e) for (i, _), (_, e) in zip(table, clustered(seed=2)) if i % 10 == 3] + [(5000, table[0][1]), (0, None)], "id long, embedding array<double>")
    before = (tmp_path / "ix" / "segments" / "seq=0").stat().st_mtime_ns
    index.upsert(new).remove(spark.createDataFrame([(100,), (3999,)], "id long"))
    now = good.join(new, "id", "left_anti").union(new.where("embedding is not null")).where("id not in (100, 3999)")
    for ix in (vectorindex.VectorIndex(spark, str(tmp_path / "ix")), index.merge()):
        exact = ix.search(asked, 10, probes=64, depth=100)
        assert rows(exact.selectExpr("qid", "id", "round(score, 9)", "rank")) == rows(vector.batch_topk(now, asked, 10).selectExpr("qid", "id", "round(score, 9)", "rank"))
        assert hits(ix.search(asked, 10), vector.batch_topk(now, asked, 10)) >= 0.93
    assert before == (tmp_path / "ix" / "segments" / "seq=0").stat().st_mtime_ns and index._segments() == [1000]


def test_vector_index_of_nothing(spark, tmp_path):
    v = spark.createDataFrame([], "id long, embedding array<double>")
    index = vectorindex.VectorIndex.fit(v, str(tmp_path / "ix"))
    assert index.search(spark.createDataFrame([(1, [1.0])], "qid long, embedding array<double>"), 3).count() == 0
