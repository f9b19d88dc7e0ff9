"""Communities of a graph: Louvain as joins and sums, phase 1 from a known partition, their hierarchy as tables.

Moves are made in parallel by a share of the nodes at a time (a hash of the node and the sweep
deals them out), each to the neighbouring community that raises the modularity most as things stood
before.  Neighbours that move at once can undo each other's gain, so that a sweep over all
nodes counts only if the modularity has risen; otherwise it is undone and the next one moves
smaller shares.  Between levels the graph is contracted: communities become nodes, what lies inside them loops.
Everything is joins and sums by key over tables that are written between steps: no node's edges, a
hub's included, meet in one task before they are summed.
"""

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from ..sources.store import fresh, written as _written

#: shares in which a sweep moves the nodes at first, at most; sweeps of a level; least gain of a sweep
SHARES, MOST_SHARES, SWEEPS, GAIN = 3, 6, 12, 1e-6


def wide(df: DataFrame) -> DataFrame:
    """A table of as many rows as nodes or communities: joined by merging, never through the driver, however small a sweep leaves it."""
    return df.hint("merge")


def written(df: DataFrame, name: str) -> DataFrame:
    return wide(_written(df, name))


class Graph(NamedTuple):
    """Edges both ways, nodes with their degree (a loop counts twice) and loop, the sum of all weights."""

    walk: DataFrame  # a, b, w
    nodes: DataFrame  # id, k, loop
    m: float


def weighted(edges: DataFrame, loops: DataFrame | None = None) -> Graph:
    """``edges(a, b, weight)``, a <> b and each pair once, and ``loops(id, loop)``."""
    both = edges.select("a", "b", F.col("weight").cast("double").alias("w"))
    walk = written(both.union(both.select("b", "a", "w")), "walk")
    degrees = walk.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("d"))
    if loops is None:
        nodes = degrees.select("id", F.col("d").alias("k"), F.lit(0.0).alias("loop"))
    else:
        nodes = degrees.join(loops, "id", "full").select("id", (F.coalesce("d", F.lit(0.0)) + 2 * F.coalesce("loop", F.lit(0.0))).alias("k"), F.coalesce("loop", F.lit(0.0)).alias("loop"))
    nodes = written(nodes, "nodes")
    return Graph(walk, nodes, (nodes.agg(F.sum("k")).first()[0] or 0.0) / 2)


def quality(graph: Graph, labels: DataFrame, resolution: float = 1.0) -> float:
    """The modularity of ``labels(id, community)``."""
    if not graph.m:
        return 0.0
    ends = graph.walk.join(labels.toDF("a", "ca"), "a").join(labels.toDF("b", "cb"), "b").where("ca = cb")
    inside = ends.groupBy(F.col("ca").alias("community")).agg((F.sum("w") / 2).alias("inner"))
    own = labels.join(graph.nodes, "id").groupBy("community").agg(F.sum("k").alias("tot"), F.sum("loop").alias("loop"))
    each = own.join(wide(inside), "community", "left")
    part = (F.coalesce("inner", F.lit(0.0)) + F.col("loop")) / graph.m - resolution * F.pow(F.col("tot") / (2 * graph.m), 2)
    return each.agg(F.sum(part)).first()[0] or 0.0


def _moved(graph: Graph, labels: DataFrame, resolution: float, seed: int, share: int, shares: int) -> DataFrame:
    """``labels`` after one share of the nodes has moved."""
    turn = lambda c: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(shares)) == share
    mine = labels.where(turn("id")).join(graph.nodes.select("id", "k"), "id")
    totals = labels.join(graph.nodes.select("id", "k"), "id").groupBy("community").agg(F.sum("k").alias("tot"), F.count("*").alias("size"))
    votes = graph.walk.where(turn("a")).join(labels.toDF("b", "community"), "b").select("a", "community", "w")
    votes = votes.union(mine.select("id", "community", F.lit(0.0)))  # staying is always an option
    votes = votes.groupBy("a", "community").agg(F.sum("w").alias("w"))
    own = mine.join(wide(totals).select("community", F.col("size").alias("own_size")), "community").select(F.col("id").alias("a"), F.col("community").alias("own"), "k", "own_size")
    each = votes.join(wide(own), "a").join(wide(totals), "community")
    rest = F.col("tot") - F.when(F.col("community") == F.col("own"), F.col("k")).otherwise(0.0)
    gain = F.col("w") / graph.m - resolution * rest * F.col("k") / (2 * graph.m * graph.m)
    # two lone nodes would only swap: the one goes to the other's smaller name
    fair = (F.col("community") == F.col("own")) | (F.col("own_size") > 1) | (F.col("size") > 1) | (F.col("community") < F.col("own"))
    best = each.where(fair).withColumn("gain", F.round(gain, 14)).groupBy("a").agg(
        F.min_by("community", F.struct(-F.col("gain"), "community")).alias("new"), F.max("gain").alias("most"), F.max(F.when(F.col("community") == F.col("own"), F.col("gain"))).alias("stay")
    )
    goes = best.where("most > stay + 1e-12").select(F.col("a").alias("id"), "new")
    return written(labels.join(wide(goes), "id", "left").select("id", F.coalesce("new", "community").alias("community")), "labels")


def phase1(graph: Graph, start: DataFrame | None = None, resolution: float = 1.0):
    """(labels(id, community), the modularity after each sweep that counted): moves from ``start``, or from every node alone."""
    labels = graph.nodes.select("id", F.col("id").alias("community"))
    if start is not None:
        labels = labels.join(wide(start).select("id", F.col("community").alias("known")), "id", "left").select("id", F.coalesce("known", "community").alias("community"))
    labels = written(labels, "labels")
    steps, shares = [quality(graph, labels, resolution)], SHARES
    for sweep in range(SWEEPS if graph.m else 0):
        after = labels
        for share in range(shares):
            after = _moved(graph, after, resolution, sweep, share, shares)
        q = quality(graph, after, resolution)
        if q < steps[-1] + GAIN:
            if q > steps[-1]:
                labels, steps = after, steps + [q]
            if q >= steps[0] and abs(q - steps[-1]) < GAIN or shares >= MOST_SHARES:
                break
            shares *= 2
            continue
        labels, steps = after, steps + [q]
    # a community is named after its smallest member
    names = labels.groupBy("community").agg(F.min("id").alias("name"))
    return written(labels.join(wide(names), "community").select("id", F.col("name").alias("community")), "labels"), steps


def contracted(graph: Graph, labels: DataFrame) -> Graph:
    """The graph whose nodes are the communities of ``labels``."""
    ends = graph.walk.where("a < b").join(labels.toDF("a", "ca"), "a").join(labels.toDF("b", "cb"), "b")
    pairs = written(ends.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("w").alias("weight")), "contracted")
    inside = pairs.where("a = b").select(F.col("a").alias("id"), F.col("weight").alias("loop"))
    old = labels.join(graph.nodes, "id").groupBy(F.col("community").alias("id")).agg(F.sum("loop").alias("loop"))
    loops = old.union(inside).groupBy("id").agg(F.sum("loop").alias("loop"))
    return weighted(pairs.where("a <> b"), loops)


def louvain(graph: DataFrame, resolution: float = 1.0, levels: int = 10) -> DataFrame:
    """(id, level, community, modularity) of ``graph(a, b, weight)``, a < b: a row a node and level, the level's modularity beside it.

    A community bears the name of its smallest member; the last level is the one that no move improves.
    """
    now, members, out, last = weighted(graph), None, None, None
    for level in range(levels):
        labels, steps = phase1(now, None, resolution)
        if last is not None and steps[-1] <= last + GAIN:
            break
        members = labels if members is None else written(members.select("id", F.col("community").alias("_c")).join(labels.toDF("_c", "community"), "_c").select("id", "community"), "members")
        each = members.select("id", F.lit(level).cast("long").alias("level"), "community", F.lit(steps[-1]).alias("modularity"))
        out, last = each if out is None else out.union(each), steps[-1]
        if len(steps) == 1:
            break
        now = contracted(now, labels)
    return out


def incremental(graph: DataFrame, known: DataFrame, resolution: float = 1.0, most: float = 0.2) -> DataFrame | None:
    """(id, level, community, modularity) after ``graph`` has grown from ``known(id, community)``; None below three nodes.

    With up to a share ``most`` of new nodes: phase 1 from the known partition, one level.  With more, or
    none known: ``louvain``.
    """
    nodes = graph.select(F.col("a").alias("id")).union(graph.select("b")).distinct()
    total, old = nodes.join(known.select("id", "community"), "id", "left").agg(F.count("*"), F.count("community")).first()
    if total < 3:
        return None
    if old == 0 or (total - old) / old > most:
        return louvain(graph, resolution)
    labels, steps = phase1(weighted(graph), known, resolution)
    return labels.select("id", F.lit(0).cast("long").alias("level"), "community", F.lit(steps[-1]).alias("modularity"))


def hierarchy(levels: DataFrame) -> DataFrame:
    """(level, community, parent, member_count) of ``levels(id, level, community)``; the highest have no parent."""
    above = levels.select("id", (F.col("level") - 1).alias("level"), F.col("community").alias("parent"))
    each = levels.select("id", "level", "community").join(above, ["id", "level"], "left")
    return each.groupBy("level", "community").agg(F.min("parent").alias("parent"), F.count("*").alias("member_count"))


def summary_parts(levels: DataFrame, texts: DataFrame, summaries: DataFrame, least: int = 3) -> DataFrame:
    """(level, community, parts): what a summary of each community with ``least`` members is made of, in order of names.

    At level 0 the ``texts(id, text)`` of its members, above that the ``summaries(level, community, summary)`` of its children.
    """
    tree = hierarchy(levels)
    low = levels.where("level = 0").join(texts, "id").select("level", "community", F.col("id").alias("name"), "text")
    child = tree.where("parent is not null").join(summaries, ["level", "community"]).select((F.col("level") + 1).alias("level"), F.col("parent").alias("community"), F.col("community").alias("name"), F.col("summary").alias("text"))
    parts = low.union(child).groupBy("level", "community").agg(F.array_sort(F.collect_list(F.struct("name", "text"))).alias("p"))
    return tree.where(F.col("member_count") >= least).join(parts, ["level", "community"]).select("level", "community", F.transform("p", lambda x: x["text"]).alias("parts"))


class Store:
    """The communities that are in force: a replacement is a new snapshot, and the newest whole one is read."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _newest(self) -> int:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/*/communities/_SUCCESS")  # written last
        found = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(where) or []
        return max((int(f.getPath().getParent().getParent().getName()) for f in found), default=-1)

    def replace(self, levels: DataFrame):
        """``levels(id, level, community)`` in place of all that was there."""
        where = f"{self.path}/{self._newest() + 1}"
        levels.select("id", "level", "community").write.mode("overwrite").parquet(f"{where}/members")
        hierarchy(self.spark.read.parquet(f"{where}/members")).write.mode("overwrite").parquet(f"{where}/communities")
        return self

    def communities(self, level: int | None = None) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/{self._newest()}/communities")
        return rows if level is None else rows.where(F.col("level") == level)

    def members(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self._newest()}/members")

    def lookup(self, asked: DataFrame, level: int = 0) -> DataFrame:
        """(node, community, members) of ``asked(node)`` at a level."""
        own = self.members().where(F.col("level") == level).select(F.col("id").alias("node"), "community")
        return asked.join(own, "node").join(self.communities(level).select("community", F.col("member_count").alias("members")), "community").select("node", "community", "members")


def stored(levels: DataFrame) -> Store:
    """A store in the cluster's shared folder that holds ``levels``."""
    return Store(levels.sparkSession, fresh(levels.sparkSession, "communities")).replace(levels)
