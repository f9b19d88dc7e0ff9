"""Merkle manifest of a dataset: leaves, subroots, the root, and every row's authentication path.

Leaves of a source stand in order of doc_id, in runs of ``RUN`` that become their hash, level
by level; the sources' subroots become the root in the same way.  The leaves of a tree are cut
into aligned blocks of RUN ** ``CLIMB``, one group of a few hundred kilobytes each:

* upwards, a block is hashed to its one node, the blocks' nodes are leaves of the next pass,
  until every tree has one node;
* downwards, a block gets the path above it, one row a block, and emits the successive paths of
  its leaves by fractal traversal: for each tier of levels the existing run, on which the
  current path lies, and the desired one, which grows by one leaf a step and is whole when the
  existing one has been walked.  The path above the block is appended.

Paths of all rows are therefore never shuffled, and no tree, hot or not, meets in one task.

Edge cases: a null value is '-' in its leaf; a null source is a tree of its own, the first one;
null doc_ids come first in their tree, equal ones in order of their leaves, repeated rows are
leaves each; a lone leaf is its own subroot, a lone subroot the root, and a lone row's proof the
hash of nothing; a null doc_id is never tampered with; extra columns are ignored; an empty table gives
an empty result.
"""

import hashlib
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ._store import drop, stored, tune

RUN, CLIMB = 16, 3
BLOCK = RUN**CLIMB
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def tree_of(source):
    """A source's tree: a name that sorts as the sources do, null first."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _leaf(text):
    value = {c: F.col(c).cast("string") for c in FIELDS} | {"text": text}
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in value.values())), 256)


def leaf_digests(docs: DataFrame, tampered=None) -> DataFrame:
    """(doc_id, tree, leaf, tampered) of every row; ``tampered`` says which rows' leaves are recomputed with A-Z lower-cased."""
    rows = docs.select(*FIELDS, (F.lit(False) if tampered is None else tampered).alias("_touched"))
    text = F.col("text").cast("string")
    other = F.when(F.col("_touched"), _leaf(F.translate(text, UPPER, LOWER)))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), tree_of(F.col("source")).alias("tree"), _leaf(text).alias("leaf"), other.alias("tampered"))


def placed(rows: DataFrame, order: list) -> DataFrame:
    """``rows(tree, ...)`` with ``idx``, a row's place in its tree, and ``n``, the tree's size.

    Rows are ranged over all tasks by (tree, order), however large one tree is; a row's place is
    its place in the task plus what the tasks before hold of its tree, a number a task and tree.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.col("tree"), *order, F.col("_tie")]
    ranged = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_tie")
    ranged = stored(ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "merkle-ranged")
    runs = ranged.groupBy("_part", "tree").agg(F.count("*").alias("here"), F.min("_at").alias("_first"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("here").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = stored(runs.select("_part", "tree", (before - F.col("_first")).alias("_shift"), F.sum("here").over(tree).alias("n")), "merkle-runs")
    out = stored(ranged.join(runs, ["_part", "tree"]).withColumn("idx", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift"), "merkle-placed")
    drop(ranged, runs)
    return out


def levels_of(n: int) -> int:
    """Levels that a block of a tree of ``n`` nodes climbs."""
    levels = 0
    while n > 1 and levels < CLIMB:
        n, levels = -(-n // RUN), levels + 1
    return levels


def climbed(nodes: list, levels: int) -> str:
    for _ in range(levels):
        nodes = [digest("".join(nodes[i : i + RUN])) for i in range(0, len(nodes), RUN)]
    return nodes[0]


class _Desired:
    """The next run of a tier, of which one leaf is read a step; partial runs below it are stacked."""

    def __init__(self, tier: int, first: int, n: int):
        self.tier, self.at, self.end, self.n = tier, first, min(first + RUN ** (tier + 1), n), n
        self.stack = [[] for _ in range(tier + 1)]

    def step(self, leaves: list) -> None:
        if self.at >= self.end:
            return
        self.stack[0].append(leaves[self.at])
        self.at += 1
        for level in range(self.tier):  # a run that is full, or the block's last one, becomes its hash
            if not self.stack[level] or (len(self.stack[level]) < RUN and self.at < self.n):
                break
            self.stack[level + 1].append(digest("".join(self.stack[level])))
            self.stack[level] = []


def traversal(leaves: list, levels: int):
    """For each leaf in turn the nodes before and after its own one in its run, a level a pair.

    Held besides the leaves: an existing and a desired run a tier.
    """
    n = len(leaves)
    existing = []
    for tier in range(levels):
        first = _Desired(tier, 0, n)
        while first.at < first.end:
            first.step(leaves)
        existing.append(first.stack[tier])
    desired = [_Desired(tier, RUN ** (tier + 1), n) for tier in range(levels)]
    for i in range(n):
        path = []
        for tier, run in enumerate(existing):
            own = i // RUN**tier % RUN
            path.append(("".join(run[:own]), "".join(run[own + 1 :])))
        yield path
        for tier, nxt in enumerate(desired):
            nxt.step(leaves)
            width = RUN ** (tier + 1)
            if (i + 1) % width == 0:
                existing[tier], desired[tier] = nxt.stack[tier], _Desired(tier, i + 1 + width, n)


def _ordered(table: pa.Table) -> pa.Table:
    return table.sort_by("idx")


def _block_root(table):
    table = _ordered(table)
    n = table.column("n")[0].as_py()
    root = climbed(table.column("digest").to_pylist(), levels_of(n))
    return pa.table({"tree": [table.column("tree")[0].as_py()], "idx": pa.array([table.column("blk")[0].as_py()], pa.int64()), "digest": [root], "n": pa.array([-(-n // BLOCK)], pa.int64())})


def _blocked(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("blk", F.expr(f"idx div {BLOCK}"))


def climbs(nodes: DataFrame) -> list:
    """``nodes(tree, idx, digest, n)`` and the tables of their blocks' nodes above them; the last has one node a tree."""
    levels = [nodes]
    while True:
        up = _blocked(levels[-1].select("tree", "idx", "digest", "n")).groupBy("tree", "blk").applyInArrow(_block_root, "tree string, idx long, digest string, n long")
        levels.append(stored(up, "merkle-nodes"))
        if levels[-1].where("n > 1").isEmpty():
            return levels


def _paths(nodes, upper):
    nodes = _ordered(nodes)
    above = (upper.column("before")[0].as_py(), upper.column("after")[0].as_py())
    before, after = [], []
    for path in traversal(nodes.column("digest").to_pylist(), levels_of(nodes.column("n")[0].as_py())):
        before.append([b for b, _ in path] + above[0])
        after.append([a for _, a in path] + above[1])
    strings = pa.list_(pa.string())
    return pa.table({"tree": nodes.column("tree"), "idx": nodes.column("idx"), "before": pa.array(before, strings), "after": pa.array(after, strings)})


def above_blocks(levels: list, top: DataFrame) -> DataFrame:
    """(tree, idx, before, after): the path above each block of the lowest of ``levels``; ``top(tree, before, after)`` is that above each tree."""
    upper = top.withColumn("idx", F.lit(0).cast("long"))
    for nodes in reversed(levels[1:-1]):
        upper = _descended(nodes, upper)
    return upper


def _descended(nodes: DataFrame, upper: DataFrame) -> DataFrame:
    left = _blocked(nodes.select("tree", "idx", "digest", "n")).groupBy("tree", "blk")
    right = upper.select("tree", F.col("idx").alias("blk"), "before", "after").groupBy("tree", "blk")
    return stored(left.cogroup(right).applyInArrow(_paths, "tree string, idx long, before array<string>, after array<string>"), "merkle-paths")


def _verified(leaves, upper):
    leaves = _ordered(leaves)
    above = list(zip(upper.column("before")[0].as_py(), upper.column("after")[0].as_py()))
    subroot, root = upper.column("subroot")[0].as_py(), upper.column("root")[0].as_py()
    digests, claimed = leaves.column("digest").to_pylist(), leaves.column("tampered").to_pylist()
    proofs, folded = [], []
    for path, own, other in zip(traversal(digests, levels_of(leaves.column("n")[0].as_py())), digests, claimed):
        proof, node = hashlib.sha256(), other or own
        for before, after in path + above:
            proof.update((before + after).encode())
            node = digest(before + node + after)
        proofs.append(proof.hexdigest())
        folded.append(node)
    n = len(digests)
    return pa.table({
        "doc_id": leaves.column("doc_id"), "leaf": leaves.column("digest"), "subroot": pa.array([subroot] * n), "root": pa.array([root] * n),
        "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(folded, pa.string()), "verified": pa.array([f == root for f in folded], pa.bool_()),
    })


def manifest(docs: DataFrame, tampered=None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of ``docs``.

    ``folded_root`` is what the row's leaf, recomputed where ``tampered`` says so, and its
    siblings give; ``verified`` whether that is the root.
    """
    tune(docs.sparkSession)
    leaves = placed(leaf_digests(docs, tampered).withColumnRenamed("leaf", "digest"), [F.col("doc_id").asc_nulls_first(), F.col("digest")])
    levels = climbs(leaves)
    subroots = levels[-1].select(F.lit("").alias("tree"), F.col("tree").alias("source_tree"), "digest")
    sources = placed(subroots, [F.col("source_tree")])
    tops = climbs(sources)
    nothing = F.array().cast("array<string>")
    over = above_blocks(tops, tops[-1].select("tree", nothing.alias("before"), nothing.alias("after")))
    over = _descended(sources, over).join(sources.select("tree", "idx", "source_tree"), ["tree", "idx"])
    over = stored(over.join(tops[-1].select("tree", F.col("digest").alias("root")), "tree").drop("tree", "idx").withColumnRenamed("source_tree", "tree"), "merkle-over")
    blocks = above_blocks(levels, over.select("tree", "before", "after"))
    named = levels[-1].select("tree", F.col("digest").alias("subroot")).join(over.select("tree", "root"), "tree")
    blocks = stored(blocks.join(named, "tree"), "merkle-above")
    drop(*levels[1:], *tops[1:], sources, over)
    left = _blocked(leaves).groupBy("tree", "blk")
    right = blocks.select("tree", F.col("idx").alias("blk"), "before", "after", "subroot", "root").groupBy("tree", "blk")
    return left.cogroup(right).applyInArrow(_verified, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def op12_merkle(spark, sf_dir):
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.coalesce(touched, F.lit(False)))


def _tree_sql(name, levels):
    """Levels of the trees of ``{name}0(tree, i, h, n)`` and their nodes' siblings, as queries."""
    out = []
    for k, what in product(range(levels), ("siblings", "level")):
        if what == "siblings":
            run = f"OVER (PARTITION BY tree, i // {RUN} ORDER BY i ROWS BETWEEN"
            out.append(f"{name}p{k} AS MATERIALIZED (SELECT tree, i, n, coalesce(string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b, coalesce(string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM {name}{k})")
        else:
            out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT tree, i // {RUN} AS i, CASE WHEN min(n) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, (min(n) + {RUN - 1}) // {RUN} AS n FROM {name}{k} GROUP BY tree, i // {RUN})")
    return ",\n".join(out)


def _fold_sql(source, name, levels, out):
    """``source`` with its proof and folded node after the levels of ``name``."""
    steps, last = [], source
    for k in range(levels):
        now = out if k == levels - 1 else f"{out}{k}"
        steps.append(f"{now} AS MATERIALIZED (SELECT x.* EXCLUDE (f, proof), CASE WHEN p.n > 1 THEN sha256(p.b || f || p.a) ELSE f END AS f, CASE WHEN p.n > 1 THEN proof || p.b || p.a ELSE proof END AS proof FROM {last} x JOIN {name}p{k} p ON p.tree = x.{name}_tree AND p.i = x.{name}_i // {RUN**k})")
        last = now
    return ",\n".join(steps)


_FIELD = lambda v: f"coalesce(strlen({v})::VARCHAR || ':' || {v}, '-')"
_LEAF = lambda text: "sha256(" + " || ".join(_FIELD(v) for v in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + ")"
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, _: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::BIGINT)"""
OP12_SQL = f"""
WITH d0 AS (SELECT doc_id, coalesce('=' || source, '') AS t_tree, {_LEAF('text')} AS leaf,
  CASE WHEN {_CRC} % 5 = 0 THEN {_LEAF(f"translate(text, '{UPPER}', '{LOWER}')")} END AS other FROM documents),
d AS MATERIALIZED (SELECT *, coalesce(other, leaf) AS f, '' AS proof, row_number() OVER (PARTITION BY t_tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS t_i FROM d0),
t0 AS MATERIALIZED (SELECT t_tree AS tree, t_i AS i, leaf AS h, count(*) OVER (PARTITION BY t_tree) AS n FROM d),
{_tree_sql('t', 6)},
s0 AS MATERIALIZED (SELECT 0 AS tree, row_number() OVER (ORDER BY tree) - 1 AS i, h, count(*) OVER () AS n, tree AS of FROM t6),
{_tree_sql('s', 4)},
{_fold_sql('d', 't', 6, 'w')},
v AS MATERIALIZED (SELECT w.*, 0 AS s_tree, s0.i AS s_i, s0.h AS subroot FROM w JOIN s0 ON s0.of = w.t_tree),
{_fold_sql('v', 's', 4, 'z')}
SELECT doc_id, leaf, subroot, s4.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = s4.h AS verified FROM z, s4
"""
