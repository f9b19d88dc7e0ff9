"""Default targets that can't be met together: moved until raking meets them."""

import collections

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import mixing


def shares(rows, column, weight):
    out = collections.Counter()
    for r in rows:
        out[r[column]] += r.t * (r.probability if weight else 1)
    n = sum(out.values())
    return {k: v / n for k, v in out.items()}


def test_unreachable_default_targets(spark):
    """Every text of source x is German and no other: the root of one share and another power of the same can't both hold."""
    rows = [(i, "w " * (40 if i % 10 else 400), "x" if i % 10 else "y") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.expr("if(source = 'x', 'de', 'en')"))
    with pytest.warns(UserWarning, match="moved by"):
        found = mixing.sample(df).withColumn("t", F.expr(mixing.TOKENS)).collect()
    own, have = shares(found, "m_source", False), shares(found, "m_source", True)
    assert shares(found, "m_lang", True) == pytest.approx({"de": have["x"], "en": have["y"]})
    assert all(min(own[k], 0.5) - 1e-9 <= have[k] <= max(own[k], 0.5) + 1e-9 for k in own)


def test_half_way(spark):
    cells = spark.createDataFrame([("a", "l", "t", 30), ("b", "l", "t", 10)], "m_source string, m_lang string, m_topic string, tokens long")
    targets = spark.createDataFrame([("source", "a", 1.0), ("source", "b", 1.0), ("lang", "l", 2.0), ("topic", "t", 1.0)], "dimension string, value string, share double")
    moved = {(r.dimension, r.value): r.share for r in mixing.moved_targets(cells, targets, 0.5).collect()}
    assert moved == pytest.approx({("source", "a"): 0.625, ("source", "b"): 0.375, ("lang", "l"): 1.0, ("topic", "t"): 1.0})
