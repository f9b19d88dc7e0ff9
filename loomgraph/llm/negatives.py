"""Hard negatives: exact integer inner products behind an orthogonal PCA rotation.

Vectors become integers, floor(scale * x).  The rotation's axes are those of their directions'
second moments over all rows; in them a product is that of the leading components plus a remainder
that residual norms bound (Cauchy-Schwarz), plus slack for rounding.  A task multiplies blocks of
anchors by blocks of rows, the leading components first, drops a pair as soon as its bounds show
that it can't enter a list, and computes the integer product of those that are left.  Lists hold
exact products only, so that the result is that of comparing all pairs.

Two passes: an anchor's positives are its first rows of the same label, over the pairs of blocks
that share a label; its negatives are, a positive each, the first rows of other labels whose
score lies in the band below the positive's.  Blocks hold ``BLOCK`` rows, in order of label; pairs of blocks are
keys of an equi-join, dealt so that a task keeps one anchor block's lists over several row blocks.

Edge cases: rows with a null vec_id, label or vector, or a null or non-finite component, take no
part; shorter vectors are padded with zeros; every row counts for itself, so that a repeated
anchor has its own rows in the result, and its twin as a positive; equal scores stand in order of vec_id; components are
held to 2^62, and scores to the range of a long; extra columns are ignored; an empty table gives an empty result.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ._store import drop, stored, tune

#: rows of a block; row blocks that a task deals with for one anchor block; rows multiplied at a time
BLOCK, SPAN, STRIP = 4096, 4, 256
#: pairs whose components are gathered at a time
CHUNK = 1 << 16
#: shares of the vectors' length that the leading components hold, stage by stage
ENERGY = (0.5, 0.85)
#: rounding of a product in double precision, as a share of the norms' product, with a wide margin
SLACK = 1e-11
LEAST, LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
TOP = 5


def usable(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, q) of the rows that take part; q are their integers."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x"))
    rows = rows.where("vec_id is not null and label is not null and x is not null and not exists(x, v -> v is null or isnan(v) or abs(v) = double('infinity'))")
    held = F.transform("x", lambda v: F.greatest(F.least(F.floor(F.least(F.greatest(v * scale, F.lit(-(2.0**62))), F.lit(2.0**62))), F.lit(1 << 62)), F.lit(-(1 << 62))).cast("long"))
    return rows.select("vec_id", "label", held.alias("q"))


def _matrix(lists, dim):
    """Lists of integers as rows, zero-padded."""
    sizes = np.diff(np.asarray(lists.offsets))
    flat = np.asarray(lists.flatten())
    if (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim), np.int64)
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def _moments(dim):
    def run(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            m = _matrix(batch.column(0), dim).astype(np.float64)
            norms = np.sqrt((m * m).sum(1, keepdims=True))
            m = np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)
            total += m.T @ m
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(list(total), pa.list_(pa.float64()))], names=["axis", "sums"])

    return run


def rotation(rows: DataFrame, dim: int):
    """(axes as columns, leading first; the numbers of leading components of each stage), from all rows' moments."""
    sums = rows.select("q").mapInArrow(_moments(dim), "axis long, sums array<double>")
    each = sums.select("axis", F.posexplode("sums")).groupBy("axis", "pos").agg(F.sum("col").alias("s")).toArrow()  # dim * dim numbers
    moments = np.zeros((dim, dim))
    moments[np.asarray(each.column(0)), np.asarray(each.column(1))] = np.asarray(each.column(2))
    share, axes = np.linalg.eigh(moments)
    share, axes = np.maximum(share[::-1], 0), np.ascontiguousarray(axes[:, ::-1])
    grown = np.cumsum(share) / max(share.sum(), 1e-300)
    return axes, sorted({min(dim, int(np.searchsorted(grown, e)) + 1) for e in ENERGY})


def _packed(with_scores):
    """Rows in blocks: ids, labels, integers (of two bytes where they fit) as bytes."""

    def run(batches):
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 33, [], 0

        def close(table):
            # files are read back in order of their sizes: only here do a block's rows stand in order of label
            table = table.take(pa.array(np.argsort(np.asarray(table.column("label")), kind="stable")))
            q = table.column("q").combine_chunks()
            m = _matrix(q, int(np.diff(np.asarray(q.offsets)).max()))
            m = m.astype("<i2") if not m.size or abs(m).max() < 1 << 15 else m.astype("<i8")
            longs = [np.asarray(table.column(c)).astype("<i8") for c in ("row", "vec_id", "label")]
            goals = [np.asarray(table.column("scores").combine_chunks().flatten()).astype("<i8").tobytes()] if with_scores else []
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([np.unique(longs[2])], pa.list_(pa.int64())), *(pa.array([x.tobytes()], pa.binary()) for x in longs), pa.array([m.dtype.itemsize], pa.int32()), pa.array([m.tobytes()], pa.binary()), *(pa.array([g], pa.binary()) for g in goals)],
                names=[c.split()[0] for c in BLOCKS + [SCORES] * with_scores],
            )

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, BLOCK - size)
                held.append(part)
                size, at = size + part.num_rows, at + part.num_rows
                if size == BLOCK:
                    yield close(pa.Table.from_batches(held))
                    held, size, number = [], 0, number + 1
        if held:
            yield close(pa.Table.from_batches(held))

    return run


BLOCKS, SCORES = ["block long", "has array<bigint>", "row binary", "vec_id binary", "label binary", "width int", "q binary"], "scores binary"


def packed(rows: DataFrame, name: str) -> DataFrame:
    """``rows(row, vec_id, label, q)`` as a table of blocks, each in order of label."""
    extra = "scores" in rows.columns
    return stored(rows.mapInArrow(_packed(extra), ", ".join(BLOCKS + [SCORES] * extra)), name)


class Side:
    """A block: its integers, leading rotated components, and what the others can add after each stage."""

    def __init__(self, row, vec_id, label, width, q, axes, steps):
        self.row, self.id, self.label = (np.frombuffer(x, "<i8") for x in (row, vec_id, label))
        m = np.frombuffer(q, f"<i{width}").reshape(len(self.row), -1)
        self.wide = bool(m.size) and width == 8 and int(max(abs(int(m.max())), abs(int(m.min())))) >= 1 << 20
        self.q = np.zeros((len(m), len(axes)), object if self.wide else np.float64)
        self.q[:, : m.shape[1]] = m
        real = self.q.astype(np.float64)
        self.lead = real @ axes[:, : steps[-1]]
        whole = (real * real).sum(1)
        self.norm = np.sqrt(whole)
        self.rest = [np.sqrt(np.maximum(whole - (self.lead[:, :k] ** 2).sum(1), 0) + SLACK * whole) for k in steps]


def exact(a: Side, i, b: Side, j):
    """Integer products of the pairs (i, j), held to the range of a long."""
    if a.wide or b.wide:
        return np.array([max(LEAST + 1, min(LAST, int(sum(int(x) * int(y) for x, y in zip(a.q[p], b.q[q]))))) for p, q in zip(i, j)], np.int64)
    out = np.empty(len(i), np.int64)
    for at in range(0, len(i), CHUNK):
        s = slice(at, at + CHUNK)
        out[s] = np.einsum("ij,ij->i", a.q[i[s]], b.q[j[s]]).astype(np.int64)  # below 2^53: every sum is exact
    return out


class Lists:
    """The first ``TOP`` of each of many groups by (score descending, id)."""

    def __init__(self, groups):
        self.score, self.id = np.full((groups, TOP), LEAST), np.full((groups, TOP), LAST)

    def last(self):
        return self.score[:, -1]

    def put(self, group, score, ident):
        if not len(group):
            return
        touched, at = np.unique(group, return_inverse=True)
        g = np.concatenate([np.repeat(np.arange(len(touched)), TOP), at])
        s, d = np.concatenate([self.score[touched].ravel(), score]), np.concatenate([self.id[touched].ravel(), ident])
        order = np.lexsort((d, ~s, g))  # ~s falls as s rises, without overflow
        g, s, d = g[order], s[order], d[order]
        place = np.arange(len(g)) - np.searchsorted(g, np.arange(len(touched)))[g]
        keep = place < TOP
        self.score[touched], self.id[touched] = s[keep].reshape(-1, TOP), d[keep].reshape(-1, TOP)

    def rows(self):
        g, k = np.nonzero(self.score > LEAST)
        return g, self.id[g, k], self.score[g, k]


def survivors(a: Side, i0, i1, b: Side, j0, j1, steps, may):
    """Pairs (i, j) of two ranges that ``may(i, low, high)`` doesn't rule out by the bounds of any stage.

    ``may`` gets anchors as a column and bounds as a matrix, or equally long lists of both.
    """
    held = (lambda x: np.clip(x, -(2.0**63), 2.0**63)) if a.wide or b.wide else (lambda x: x)  # as the products are
    slack = SLACK * a.norm[i0:i1].max(initial=0) * b.norm[j0:j1].max(initial=0)
    s = a.lead[i0:i1, : steps[0]] @ b.lead[j0:j1, : steps[0]].T
    rest = np.outer(a.rest[0][i0:i1], b.rest[0][j0:j1]) + slack
    i, j = np.nonzero(may(np.arange(i0, i1)[:, None], held(s - rest), held(s + rest)))
    s, i, j = s[i, j], i + i0, j + j0
    for n, (k, upto) in enumerate(zip(steps, steps[1:]), 1):
        keep = np.zeros(len(i), bool)
        for at in range(0, len(i), CHUNK):
            part = slice(at, at + CHUNK)
            p, q = i[part], j[part]
            s[part] += np.einsum("ij,ij->i", a.lead[p, k:upto], b.lead[q, k:upto])
            rest = a.rest[n][p] * b.rest[n][q] + slack
            keep[part] = may(p, held(s[part] - rest), held(s[part] + rest))
        s, i, j = s[keep], i[keep], j[keep]
    return i, j


def same_label(a: Side, b: Side, lists: Lists, steps):
    """Put rows of ``b`` into the lists of the anchors of ``a`` that have their label; both stand in order of label."""
    for label in np.intersect1d(a.label, b.label):
        i0, i1 = np.searchsorted(a.label, [label, label + 1])
        j0, j1 = np.searchsorted(b.label, [label, label + 1])
        for at in range(j0, j1, STRIP):
            least = lists.last().astype(np.float64)
            i, j = survivors(a, i0, i1, b, at, min(at + STRIP, j1), steps, lambda i, low, high: high >= least[i])
            other = a.row[i] != b.row[j]
            i, j = i[other], j[other]
            lists.put(i, exact(a, i, b, j), b.id[j])


def in_band(a: Side, goals, b: Side, lists: Lists, steps, share):
    """Put rows of ``b`` of other labels into the lists (anchor, positive) in whose band their score lies."""
    down, percent = share
    floor = np.where(goals >= 0, goals * (down / percent), np.inf)  # no score lies in a negative positive's band
    ceiling = goals.astype(np.float64)
    for at in range(0, len(b.row), STRIP):
        held = lists.last().reshape(goals.shape).astype(np.float64)
        least = np.maximum(floor * (1 - 1e-12), held)
        lowest, highest = least.min(1, initial=np.inf), np.where(goals >= 0, ceiling, -np.inf).max(1, initial=-np.inf)

        def may(i, low, high):
            out = (high >= lowest[i]) & (low <= highest[i])
            if out.ndim == 1:
                out &= ((high[:, None] >= least[i]) & (low[:, None] <= ceiling[i])).any(1)
            return out

        i, j = survivors(a, 0, len(a.row), b, at, min(at + STRIP, len(b.row)), steps, may)
        other = a.label[i] != b.label[j]
        i, j = i[other], j[other]
        score = exact(a, i, b, j)
        for k in range(goals.shape[1]):
            goal = goals[i, k]
            if a.wide or b.wide:
                fits = np.array([g >= 0 and down * int(g) <= percent * int(s) <= percent * int(g) for g, s in zip(goal, score)], bool)
            else:
                fits = (goal >= 0) & (down * goal <= percent * score) & (score <= goal)
            lists.put(i[fits] * goals.shape[1] + k, score[fits], b.id[j[fits]])


def _mined(axes, steps, share=None):
    """Blocks joined with anchor blocks to the lists of the anchors; ``share`` for negatives."""

    def run(batches):
        now, a, lists, goals = None, None, None, None

        def close():
            group, ident, score = lists.rows()
            per = goals.shape[1] if share else 1
            return pa.RecordBatch.from_arrays([pa.array(a.row[group // per]), pa.array(group % per, pa.int32()), pa.array(ident), pa.array(score)], names=["anchor", "place", "vec_id", "score"])

        for batch in batches:
            get = lambda c, k: batch.column(batch.schema.get_field_index(c))[k].as_py()  # noqa: E731, B023
            for k in range(batch.num_rows):
                if get("a_block", k) != now:
                    if a is not None:
                        yield close()
                    now, a = get("a_block", k), Side(*(get(f"a_{c}", k) for c in ("row", "vec_id", "label", "width", "q")), axes, steps)
                    goals = np.frombuffer(get("a_scores", k), "<i8").reshape(-1, TOP) if share else None
                    lists = Lists(len(a.row) * (goals.shape[1] if share else 1))
                b = Side(*(get(c, k) for c in ("row", "vec_id", "label", "width", "q")), axes, steps)
                if share:
                    in_band(a, goals, b, lists, steps, share)
                else:
                    same_label(a, b, lists, steps)
        if a is not None:
            yield close()

    return run


def _met(pairs: DataFrame, blocks: DataFrame, anchors: DataFrame, groups: int) -> DataFrame:
    """Row blocks with the anchor blocks that ``pairs(block, a_block)`` gives them, several of the former to one of the latter in a task."""
    pairs = pairs.withColumn("g", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
    named = anchors.drop("has").toDF(*(f"a_{c}" for c in anchors.columns if c != "has"))
    right = named.join(pairs.select("a_block", "g").distinct(), "a_block")
    return blocks.drop("has").join(pairs, "block").join(right, ["a_block", "g"])


def _first(found: DataFrame, *keys) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)


def hard_negatives(vectors: DataFrame, anchor: Column, share=(80, 100), scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of which ``anchor`` holds.

    ``share`` is the band: share[0] * positive score <= share[1] * negative score <= share[1] * positive score.
    """
    spark = vectors.sparkSession
    tune(spark)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("label"), F.col("vec_id"), F.col("tie")]
    rows = usable(vectors, scale).withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("tie")
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "negatives-rows")
    dim = max(1, rows.agg(F.max(F.size("q"))).first()[0] or 1)
    axes, steps = rotation(rows, dim)
    blocks = packed(rows.select("row", "vec_id", "label", "q"), "negatives-blocks")
    own = rows.where(anchor).select("row", "vec_id", "label", "q")
    anchors = packed(own, "negatives-anchors")
    groups = max(1, -(-blocks.count() // SPAN))
    labels = lambda d, name: d.select(F.col("block").alias(name), F.explode("has").alias("label"))
    pairs = labels(blocks, "block").join(labels(anchors, "a_block"), "label").select("block", "a_block").distinct()
    mined = "anchor long, place int, vec_id long, score long"
    found = _met(pairs, blocks, anchors, groups).mapInArrow(_mined(axes, steps), mined)
    positives = stored(_first(found, "anchor").select("anchor", (F.col("rank") - 1).alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")
    # a positive's place in the anchor's list, -1 where there are fewer: no band
    each = positives.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("place", "positive_score"))).alias("by"))
    scores = F.transform(F.array(*(F.lit(k) for k in range(TOP))), lambda k: F.coalesce(F.try_element_at("by", k), F.lit(-1)).cast("long"))
    banded = packed(own.join(each.select(F.col("anchor").alias("row"), scores.alias("scores")), "row").select("row", "vec_id", "label", "q", "scores"), "negatives-banded")
    drop(anchors)
    many = max(1, banded.count())
    dealt = banded.select(F.col("block").alias("a_block"), F.pmod(F.xxhash64("block"), F.lit(many)).cast("int").alias("h"))
    pairs = blocks.select("block", F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias("h")).join(dealt, "h").select("block", "a_block")
    found = _met(pairs, blocks, banded, groups).mapInArrow(_mined(axes, steps, share), mined)
    negatives = _first(found, "anchor", "place").select("anchor", "place", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    names = own.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    out = negatives.join(positives, ["anchor", "place"]).join(names, "anchor")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return hard_negatives(vectors.withColumn("label", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)")), F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH r AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.rid AS a, a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, list_dot_product(a.q, b.q)::BIGINT AS score FROM r a JOIN r b ON a.rid <> b.rid WHERE a.vec_id % 100 = 0),
p AS (SELECT a, anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY a ORDER BY score DESC, id) AS place FROM s WHERE same QUALIFY place <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.a, place ORDER BY score DESC, id)::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5
"""
