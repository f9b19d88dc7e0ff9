"""Communities by parallel moves beside the sequential form, and their tables."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import communities, graph
from loomgraph.plans import base, graphs

from test_operators import KARATE


def sequential(rows):
    """Modularity of the usual form, a node at a time, all levels."""
    names = sorted({x for a, b, _ in rows for x in (a, b)})
    at = {x: i for i, x in enumerate(names)}
    near, loops = [{} for _ in names], [0.0] * len(names)
    for a, b, w in rows:
        near[at[a]][at[b]] = near[at[b]][at[a]] = near[at[a]].get(at[b], 0.0) + w
    m = sum(sum(x.values()) for x in near) / 2
    while True:
        k = [sum(x.values()) + 2 * o for x, o in zip(near, loops)]
        of, total, moved, ever = list(range(len(near))), list(k), True, False
        while moved:
            moved = False
            for i, x in enumerate(near):
                to = {}
                for j, w in x.items():
                    to[of[j]] = to.get(of[j], 0.0) + w
                total[of[i]] -= k[i]
                gain = lambda c: to.get(c, 0.0) / m - total[c] * k[i] / (2 * m * m)  # noqa: E731, B023
                best = max([of[i], *sorted(to)], key=gain)
                if gain(best) > gain(of[i]) + 1e-12:
                    of[i], moved, ever = best, True, True
                total[of[i]] += k[i]
        ids = {c: n for n, c in enumerate(dict.fromkeys(of))}
        new, new_loops = [{} for _ in ids], [0.0] * len(ids)
        for i, x in enumerate(near):
            c = ids[of[i]]
            new_loops[c] += loops[i]
            for j, w in x.items():
                d = ids[of[j]]
                if c == d:
                    new_loops[c] += w / 2
                else:
                    new[c][d] = new[c].get(d, 0.0) + w
        near, loops = new, new_loops
        if not ever:
            return sum(o / m - ((sum(x.values()) + 2 * o) / (2 * m)) ** 2 for x, o in zip(near, loops))


@pytest.fixture(scope="module")
def club(spark):
    pairs = [tuple(f"{int(x):02d}" for x in e.split("-")) for e in KARATE.split()]
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "a string, b string, weight double")


def test_louvain_on_the_club(spark, club):
    out = communities.louvain(club)
    levels = {r.level: r.modularity for r in out.select("level", "modularity").distinct().collect()}
    best = sequential([tuple(r) for r in club.collect()])
    assert levels[0] >= 0.3 and levels[max(levels)] >= max(0.38, 0.95 * best)
    assert sorted(levels.values()) == [levels[k] for k in sorted(levels)]
    top = out.where(F.col("level") == max(levels))
    assert abs(graph.modularity(club, top).first()[0] - levels[max(levels)]) < 1e-9
    of = {r.id: r.community for r in top.collect()}
    assert len(of) == 34 and 2 <= len(set(of.values())) <= 8 and of["01"] != of["34"]
    assert all(c == min(i for i in of if of[i] == c) for c in of.values())
    # each level's communities lie whole in one of the next
    tree = communities.hierarchy(out).collect()
    assert all(r.parent is not None for r in tree if r.level < max(levels)) and sum(r.member_count for r in tree if r.level == 0) == 34
    labels, steps = communities.phase1(communities.weighted(club))
    assert steps == sorted(steps) and abs(communities.quality(communities.weighted(club), labels) - steps[-1]) < 1e-9


def test_louvain_on_the_whole_graph(spark):
    sf = "/root/testdata/sf0.001"
    g = graph.community_graph(graph.active(base.graph_edges(spark, sf), graphs.now()))
    out = communities.louvain(g)
    found = out.agg(F.max("modularity")).first()[0]
    assert found >= 0.95 * sequential([tuple(r) for r in g.collect()])


def test_phase1_keeps_a_known_partition_or_grows_from_it(spark):
    r = random.Random(1)
    cliques = [(f"{c}{i}", f"{c}{j}", 1.0) for c in "xyz" for i in range(8) for j in range(i)] + [("x0", "y0", 1.0), ("y1", "z0", 1.0)]
    new = [("n1", f"x{i}", 1.0) for i in range(3)] + [("n1", "y0", 1.0), ("n2", "z3", 1.0), ("n2", "z4", 1.0)]
    r.shuffle(new)
    edges = spark.createDataFrame(cliques + new, "a string, b string, weight double").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight")
    known = spark.createDataFrame([(f"{c}{i}", c) for c in "xyz" for i in range(8)], "id string, community string")
    out = communities.incremental(edges, known)
    of = {r.id: r.community for r in out.collect()}
    assert {r.level for r in out.select("level").distinct().collect()} == {0}
    assert of["n1"] == of["x5"] and of["n2"] == of["z5"] and len(set(of.values())) == 3
    # moved by modularity, not by the heaviest neighbour alone: a lone hub's friend of a large community stays apart
    few = communities.incremental(edges, known.limit(5))
    assert few.agg(F.max("level")).first()[0] >= 0 and len({r.community for r in few.where("level = 0").collect()}) >= 3
    assert communities.incremental(edges.limit(1), known) is None


def test_store(spark, club, tmp_path):
    out = communities.louvain(club)
    store = communities.Store(spark, str(tmp_path / "c")).replace(spark.createDataFrame([("zz", 0, "zz")], "id string, level long, community string")).replace(out)
    low = store.communities(0)
    assert low.agg(F.sum("member_count")).first()[0] == 34 and store.members().where("id = 'zz'").count() == 0
    asked = spark.createDataFrame([("01",), ("34",), ("none",)], "node string")
    got = {r.node: (r.community, r.members) for r in store.lookup(asked).collect()}
    of = {r.id: r.community for r in out.where("level = 0").collect()}
    assert got == {n: (of[n], sum(c == of[n] for c in of.values())) for n in ("01", "34")}
    texts = spark.createDataFrame([(i, f"text of {i}") for i in of], "id string, text string")
    sums = low.select("level", "community", F.concat(F.lit("about "), "community").alias("summary"))
    parts = {(r.level, r.community): r.parts for r in communities.summary_parts(out, texts, sums).collect()}
    one = of["01"]
    assert parts[0, one] == [f"text of {i}" for i in sorted(of) if of[i] == one]
    if store.communities(1).count():
        tree = {(r.level, r.community): r.parent for r in store.communities().collect()}
        up = tree[0, one]
        assert parts[1, up] == [f"about {c}" for (lv, c), p in sorted(tree.items()) if lv == 0 and p == up]
