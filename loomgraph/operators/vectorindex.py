"""An approximate vector index: coarse cells, residual codes, exact re-ranking; kept as tables.

``fit`` learns centroids by k-means over all rows (a matrix product and one sum of vectors a task
and cell, a round a job) and a codebook of the residuals from a bounded sample.  Vectors live
in segments, partitioned by cell: ``codes`` (blocks of ids and two-dimensional residual codes,
one byte for two components) and ``vectors`` (the full ones).  A search ranks the cells by their
centroids, reads the codes of the ``probes`` nearest ones only, and scores the best of them
again by their full vectors, read from the cells that these lie in.

An upsert or a delete appends a segment and the ids that it ends in older segments; nothing is built again
until ``merge`` writes one segment of the live rows.  A segment without its mark isn't read.
Vectors without length, of another dimension or with null or non-finite parts aren't indexed, as
no search finds them by their angle.
"""

import functools
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.store import arrow, fresh, written
from .lexical import top_per
from .vector import _unit, batch_topk, cosine, finite

#: rows from which the codebook is learnt, and queries that say how many cells a search has to probe
SAMPLE, ASKED = 16_384, 256
#: most cells of an index: its centroids are sent to every task (64 MB at 1024 components)
MOST_CELLS = 8192
#: components that share a code, and codes of such a group
GROUP, CODES = 2, 256
#: rows of a block of codes; queries of a block, components of a part of the rows that meet it (64 MB), least rows of one, queries at a time
BLOCK, QUERIES, PART, LEAST_ROWS, STRIP = 1024, 1024, 1 << 23, 4096, 16
#: how many times k a search scores by full vectors: the first that calibration finds to be enough
DEPTHS = (3, 6, 12, 25, 50, 100)


def _vectors(batch, name, dim):
    """A batch's vectors as unit rows."""
    lists = batch.column(batch.schema.get_field_index(name))
    return _unit(np.asarray(lists.flatten(), np.float64).reshape(len(lists), dim))


def _nearest(vectors, centroids):
    return np.argmax(vectors @ centroids.T, axis=1)


def _partial_sums(shared, dim):
    def run(batches):
        centroids = shared.value
        sums, counts = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for batch in batches:
            v = _vectors(batch, "v", dim)
            cell = _nearest(v, centroids)
            np.add.at(sums, cell, v)
            counts += np.bincount(cell, minlength=len(centroids))
        at = np.flatnonzero(counts)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at]), pa.array(list(sums[at]), pa.list_(pa.float64()))], names=["cell", "n", "sums"])

    return run


def _books(table):
    """The codewords of one group of components, by k-means over a bounded sample of residuals."""
    points = np.stack([np.asarray(table.column("x").combine_chunks()), np.asarray(table.column("y").combine_chunks())], 1)
    words = points[np.linspace(0, len(points) - 1, CODES).astype(int)].copy()
    for _ in range(8):
        at = np.argmin(((points[:, None, :] - words[None]) ** 2).sum(2), axis=1)
        n = np.bincount(at, minlength=CODES)
        for axis in (0, 1):
            words[:, axis] = np.where(n > 0, np.bincount(at, points[:, axis], CODES) / np.maximum(n, 1), words[:, axis])
    return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int64()), "x": pa.array([words[:, 0]], pa.list_(pa.float64())), "y": pa.array([words[:, 1]], pa.list_(pa.float64()))})


def _together(batches):
    """The rows of each (block, part), as one table."""
    held, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("block", "part")])
        starts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0)]))
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            if held and tuple(keys[:, a]) != now:
                yield pa.Table.from_batches(held)
                held = []
            now = tuple(keys[:, a])
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _best_codes(keep, words, dim):
    """The ``keep`` best of a part's rows for each query of a block, by codes, then id."""

    def run(batches):
        for table in _together(batches):
            asked = table.filter(table.column("cells").is_valid())
            rows = table.filter(table.column("code").is_valid()).sort_by("id")  # the first of equal ones come first
            if not asked.num_rows or not rows.num_rows:
                continue
            codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
            part = words[np.arange(words.shape[0]), codes].reshape(len(codes), -1)[:, :dim].T
            of = rows.select(["id", "seq", "cell"]).combine_chunks().to_batches()[0]
            cells, at = np.unique(np.asarray(of.column(2)), return_inverse=True)
            n = min(keep, len(codes))
            for a in range(0, asked.num_rows, STRIP):
                some = asked.slice(a, STRIP).combine_chunks().to_batches()[0]
                near = np.full((some.num_rows, len(cells)), -np.inf)
                for i in range(some.num_rows):
                    own, value = (np.asarray(some.column(some.schema.get_field_index(c))[i].values) for c in ("cells", "nears"))
                    place = np.minimum(np.searchsorted(cells, own), len(cells) - 1)
                    same = cells[place] == own
                    near[i, place[same]] = value[same]
                score = _vectors(some, "q", dim) @ part + near[:, at]
                picked = []
                for s in score:
                    least = np.partition(s, len(s) - n)[len(s) - n]
                    more = np.flatnonzero(s > least)
                    best = np.concatenate([more, np.flatnonzero(s == least)[: n - len(more)]])
                    picked.append(best[s[best] > -np.inf])
                row, took = np.repeat(np.arange(len(picked)), [len(p) for p in picked]), np.concatenate(picked)
                yield pa.RecordBatch.from_arrays(
                    [some.column(some.schema.get_field_index("qid")).take(pa.array(row)), *(c.take(pa.array(took)) for c in of.columns), pa.array(score[row, took])], names=["qid", "id", "seq", "cell", "about"]
                )

    return run


class VectorIndex:
    """``model`` (centroids, codebook, probes), and segments of codes and vectors, under one path."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        meta = json.loads(spark.read.text(f"{self.path}/model/meta").first()[0])
        self.dim, self.cells, self.probes, self.depth, self.kind, self.part = (meta[c] for c in ("dim", "cells", "probes", "depth", "kind", "part"))
        rows = spark.read.parquet(f"{self.path}/model/centroids").toArrow()  # at most MOST_CELLS
        self.centroids = np.array(rows.column("centroid").to_pylist(), np.float64)[np.argsort(np.asarray(rows.column("cell")))]
        rows = spark.read.parquet(f"{self.path}/model/codebook").toArrow()  # half as many rows as components
        order = np.argsort(np.asarray(rows.column("part")))
        self.words = np.stack([np.array(rows.column(c).to_pylist(), np.float64)[order] for c in "xy"], 2) if len(order) else np.zeros((-(-self.dim // GROUP), CODES, GROUP))

    # building

    @classmethod
    def fit(cls, vectors: DataFrame, path: str, id_col: str = "id", vec_col: str = "embedding", cells: int | None = None, rounds: int = 8, recall: float = 0.98):
        """An index of ``vectors`` under ``path``; probes as many as ``recall`` of the true neighbours of sampled rows need."""
        spark = vectors.sparkSession
        dim = vectors.select(F.max(F.size(vec_col))).first()[0] or 1
        rows = written(cls._usable(vectors, id_col, vec_col, dim), "index-rows")
        n = rows.count()
        cells = max(1, min(cells or int(2 * np.sqrt(n)), MOST_CELLS, n or 1))
        first = rows.orderBy(F.xxhash64("id"), "id").limit(cells).toArrow()  # as many as cells
        centroids = _vectors(first.combine_chunks().to_batches()[0], "v", dim) if n else np.zeros((1, dim))
        for _ in range(rounds if n else 0):
            shared = spark.sparkContext.broadcast(centroids)
            part = rows.select("v").mapInArrow(_partial_sums(shared, dim), "cell long, n long, sums array<double>")
            each = part.groupBy("cell").agg(F.sum("n").alias("n"), F.collect_list("sums").alias("s"))  # one vector a task
            each = each.select("cell", F.expr(f"aggregate(s, array_repeat(0D, {dim}), (a, x) -> zip_with(a, x, (p, q) -> p + q))").alias("sum")).toArrow()
            centroids = centroids.copy()
            centroids[np.asarray(each.column(0))] = _unit(np.array(each.column(1).to_pylist(), np.float64).reshape(each.num_rows, dim))
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell long, centroid array<double>").write.parquet(f"{path}/model/centroids")
        cls._codebook(rows, centroids, dim).write.parquet(f"{path}/model/codebook")
        meta = {"dim": dim, "cells": len(centroids), "probes": len(centroids), "depth": DEPTHS[-1], "kind": rows.schema["id"].dataType.simpleString(), "part": vectors.schema[vec_col].dataType.elementType.simpleString()}
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{path}/model/meta")
        index = cls(spark, path)
        index._append(rows, 0)
        if n:
            index.probes, index.depth = index._calibrated(rows, recall)
        spark.createDataFrame([(json.dumps(meta | {"probes": index.probes, "depth": index.depth}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/model/meta")
        return index

    @staticmethod
    def _usable(vectors, id_col, vec_col, dim):
        rows = arrow(vectors).select(F.col(id_col).alias("id"), F.transform(vec_col, lambda x: x.cast("double")).alias("v"))
        return rows.where(F.col("id").isNotNull() & (F.size("v") == dim) & finite(F.col("v")) & ~F.exists("v", lambda x: x.isNull()) & F.exists("v", lambda x: x != 0))

    @staticmethod
    def _codebook(rows, centroids, dim):
        shared = rows.sparkSession.sparkContext.broadcast(centroids)

        def residuals(batches):
            for batch in batches:
                v = _vectors(batch, "v", dim)
                r = v - shared.value[_nearest(v, shared.value)]
                r = np.concatenate([r, np.zeros((len(r), -dim % GROUP))], 1)
                part = np.tile(np.arange(r.shape[1] // GROUP), len(r))
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(r[:, ::2].ravel()), pa.array(r[:, 1::2].ravel())], names=["part", "x", "y"])

        some = rows.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(SAMPLE).repartition(8).select("v")
        return some.mapInArrow(residuals, "part long, x double, y double").groupBy("part").applyInArrow(_books, "part long, x array<double>, y array<double>")

    def _calibrated(self, rows, recall):
        """(probes, depth): cells a search reads, and how many times k it scores again, so that ``recall`` of true neighbours are among them."""
        asked = rows.orderBy(F.xxhash64("id", F.lit(2)), "id").limit(ASKED).select(F.col("id").alias("qid"), F.col("v").alias("embedding"))
        asked = written(asked, "index-asked")
        truth = batch_topk(rows.withColumnRenamed("v", "embedding"), asked, 10)
        found = truth.join(rows.select("id", "v"), "id").join(asked, "qid").select("v", "embedding").toArrow().combine_chunks().to_batches()  # ten rows a query
        if not found:
            return self.cells, DEPTHS[-1]
        v, q = _vectors(found[0], "v", self.dim), _vectors(found[0], "embedding", self.dim)
        near, own = q @ self.centroids.T, np.arange(len(v))
        cell = _nearest(v, self.centroids)
        rank = (near > near[own, cell][:, None]).sum(1)
        probes = int(np.sort(rank)[min(len(rank) - 1, int(np.ceil(recall * len(rank))) - 1)]) + 1
        # the fewest that keep as many of them after ranking by codes
        true = truth.select("qid", "id")
        for depth in DEPTHS:
            if depth == DEPTHS[-1] or true.join(self.candidates(asked, 10, probes, depth), ["qid", "id"], "left_semi").count() >= recall * len(rank) - 1:
                return probes, depth

    def _encode(self, residual):
        """Codes (one byte a group) of residual rows."""
        padded = np.concatenate([residual, np.zeros((len(residual), -self.dim % GROUP))], 1).reshape(len(residual), -1, GROUP)
        out = np.empty(padded.shape[:2], np.uint8)
        for part in range(padded.shape[1]):
            out[:, part] = np.argmin(((padded[:, part, None, :] - self.words[part][None]) ** 2).sum(2), axis=1)
        return out

    def _decode(self, codes):
        return self.words[np.arange(codes.shape[1]), codes].reshape(len(codes), -1)[:, : self.dim]

    # segments

    def _segments(self) -> list[int]:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/segments/*/ended/_SUCCESS")  # written last
        found = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(where) or []
        names = sorted(int(f.getPath().getParent().getParent().getName().removeprefix("seq=")) for f in found)
        merged = [n for n in names if n % 1000 == 0]  # a merge stands for all before it
        return [n for n in names if n >= (merged[-1] if merged else 0)]

    def _append(self, rows: DataFrame, number: int, ended: DataFrame | None = None):
        """Write ``rows(id, v)`` as a segment, and the ids that it ends in the segments before."""
        spark, where = self.spark, f"{self.path}/segments/seq={number}"
        kind = self.kind
        model = spark.sparkContext.broadcast(self.centroids)
        dim = self.dim

        def cells(batches):
            for batch in batches:
                v = _vectors(batch, "v", dim)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_nearest(v, model.value))], names=["id", "v", "cell"])

        placed = rows.select("id", "v").mapInArrow(cells, f"id {kind}, v array<double>, cell long")
        # a crowded cell is many tasks' work: rows are dealt by cell and a few bits of the id
        parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        dealt = placed.repartitionByRange(parts, "cell", F.xxhash64("id")).sortWithinPartitions("cell", "id")
        dealt.select("id", F.transform("v", lambda x: x.cast(self.part)).alias("v"), "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{where}/vectors")
        self._read("vectors", [number]).select("cell", "id", "v").sortWithinPartitions("cell").mapInArrow(self._coded(model, kind), f"cell long, ids array<{kind}>, codes binary").write.mode("overwrite").partitionBy("cell").parquet(f"{where}/codes")
        (ended if ended is not None else rows.select("id").limit(0)).select("id").distinct().write.mode("overwrite").parquet(f"{where}/ended")

    def _coded(self, model, kind):
        encode, dim = self._encode_with(), self.dim

        def run(batches):
            for batch in batches:
                cell = np.asarray(batch.column(0))
                v = _vectors(batch, "v", dim)
                codes = encode(v - model.value[cell])
                edges = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
                for a, b in zip(edges, [*edges[1:], len(cell)]):
                    for at in range(a, b, BLOCK):
                        stop = min(b, at + BLOCK)
                        ids = pa.ListArray.from_arrays(pa.array([0, stop - at], pa.int32()), batch.column(1).slice(at, stop - at))
                        yield pa.RecordBatch.from_arrays([pa.array([cell[at]]), ids, pa.array([codes[at:stop].tobytes()], pa.binary())], names=["cell", "ids", "codes"])

        return run

    def _encode_with(self):
        """``_encode`` as a function of its own, that tasks get without the session."""
        other = object.__new__(VectorIndex)
        other.dim, other.words = self.dim, self.words
        return other._encode

    def _read(self, table: str, segments) -> DataFrame:
        """A table of these segments, with ``seq``; ``cell`` is a folder's name, so that a filter on it chooses files."""
        schema = {"vectors": f"id {self.kind}, v array<{self.part}>, cell long", "codes": f"ids array<{self.kind}>, codes binary, cell long", "ended": f"id {self.kind}"}[table]
        each = [self.spark.read.schema(schema).parquet(f"{self.path}/segments/seq={n}/{table}").withColumn("seq", F.lit(n)) for n in segments]
        return functools.reduce(DataFrame.unionByName, each)

    def _ended(self, segments) -> DataFrame:
        return self._read("ended", segments).groupBy("id").agg(F.max("seq").alias("ended"))

    def _live(self, rows: DataFrame, segments) -> DataFrame:
        """``rows(id, seq)`` of which no later segment ends the id."""
        return rows.join(self._ended(segments), "id", "left").where("ended is null or ended <= seq").drop("ended")

    def _next(self) -> int:
        """The next segment's number; numbers that are left for merges are not taken."""
        last = self._segments()[-1]
        if (last + 1) % 1000 == 0:
            self.merge()
            last = self._segments()[-1]
        return last + 1

    def upsert(self, vectors: DataFrame, id_col: str = "id", vec_col: str = "embedding"):
        """Vectors added, or replaced by id: one more segment.  Vectors that can't be indexed end their id's old one."""
        usable = self._usable(vectors, id_col, vec_col, self.dim)
        self._append(usable, self._next(), vectors.select(F.col(id_col).alias("id")))
        return self

    def remove(self, ids: DataFrame):
        self._append(self.vectors().limit(0), self._next(), ids.select("id"))
        return self

    def vectors(self) -> DataFrame:
        """(id, v) of all live rows."""
        segments = self._segments()
        return self._live(self._read("vectors", segments), segments).select("id", F.transform("v", lambda x: x.cast("double")).alias("v"))

    def merge(self):
        """One segment of the live rows in place of all; the older ones are no longer read."""
        rows = written(self.vectors(), "index-live")
        self._append(rows, (self._segments()[-1] // 1000 + 1) * 1000)
        return self

    # searching

    def _probes(self, queries: DataFrame, probes: int | None = None) -> DataFrame:
        """(qid, q, cells, nears): each of ``queries(qid, embedding)`` with the cells that it reads."""
        n, dim = min(probes or self.probes, self.cells), self.dim
        shared = self.spark.sparkContext.broadcast(self.centroids)
        kind = queries.schema["qid"].dataType.simpleString()

        def run(batches):
            for batch in batches:
                near = _vectors(batch, "q", dim) @ shared.value.T
                cells = np.argpartition(-near, n - 1, axis=1)[:, :n]
                ends = pa.array(np.arange(len(near) + 1, dtype=np.int32) * n)
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.ravel())) for x in (cells, np.take_along_axis(near, cells, 1))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["qid", "q", "cells", "nears"])

        return self._usable(queries, "qid", "embedding", dim).toDF("qid", "q").mapInArrow(run, f"qid {kind}, q array<double>, cells array<long>, nears array<double>")

    def probed(self, queries: DataFrame, probes: int | None = None) -> DataFrame:
        """(qid, q, cell, near): the cells that each of ``queries(qid, embedding)`` reads."""
        each = self._probes(queries, probes).select("qid", "q", F.explode(F.arrays_zip("cells", "nears")).alias("c"))
        return each.select("qid", "q", F.col("c.cells").alias("cell"), F.col("c.nears").alias("near"))

    def _coded_rows(self, segments, wanted) -> DataFrame:
        """(id, seq, cell, code) of the live rows of these cells."""
        kind, width = self.kind, self.words.shape[0]

        def run(batches):
            for batch in batches:
                seq, cell, ids, codes = batch.columns
                n = np.diff(np.asarray(ids.offsets))
                data = b"".join(c.as_py() for c in codes)
                code = pa.Array.from_buffers(pa.binary(), int(n.sum()), [None, pa.py_buffer((np.arange(n.sum() + 1) * width).astype(np.int32).tobytes()), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([ids.flatten(), pa.array(np.repeat(np.asarray(seq), n)), pa.array(np.repeat(np.asarray(cell), n)), code], names=["id", "seq", "cell", "code"])

        blocks = self._read("codes", segments).where(F.col("cell").isin(wanted)).select("seq", "cell", "ids", "codes")
        return self._live(arrow(blocks).mapInArrow(run, f"id {kind}, seq int, cell long, code binary"), segments)

    def candidates(self, queries: DataFrame, k: int, probes: int | None = None, depth: int | None = None) -> DataFrame:
        """(qid, id, seq, cell): the best ``depth`` * k live rows of each query by codes; reads codes of probed cells only.

        Rows that are over are left out first.  Blocks of queries and parts of the rows are dealt to each
        other; a task gives the best of a query and part, not every product of theirs.
        """
        segments, depth = self._segments(), depth or self.depth
        asked = written(self._probes(queries, probes), "index-probes")
        wanted = [r[0] for r in asked.select(F.explode("cells")).distinct().collect()]  # at most MOST_CELLS numbers: the scan's partition filter
        codes = self._coded_rows(segments, wanted)
        n, m = (self._read("codes", segments).where(F.col("cell").isin(wanted)).agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0], asked.count())
        tasks = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        blocks = max(1, -(-m // QUERIES))
        parts = max(1, -(-n // max(1, PART // max(self.dim, 1))), min(-(-tasks // blocks), -(-n // LEAST_ROWS)))
        kind, qkind = self.kind, asked.schema["qid"].dataType.simpleString()
        deal = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
        mine = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        none = lambda *types: [F.lit(None).cast(t).alias(c) for c, t in types]
        left = asked.select(mine("qid", blocks).alias("block"), deal("part", parts), "qid", "q", "cells", "nears", *none(("id", kind), ("seq", "int"), ("cell", "long"), ("code", "binary")))
        right = codes.select(deal("block", blocks), mine("id", parts).alias("part"), *none(("qid", qkind), ("q", "array<double>"), ("cells", "array<long>"), ("nears", "array<double>")), "id", "seq", "cell", "code")
        dealt = arrow(left.unionByName(right)).repartition(min(blocks * parts, 4 * tasks), "block", "part").sortWithinPartitions("block", "part")
        found = dealt.mapInArrow(_best_codes(depth * k, self.words, self.dim), f"qid {qkind}, id {kind}, seq int, cell long, about double")
        return top_per(found, "qid", [F.col("about").desc(), F.col("id")], depth * k).select("qid", "id", "seq", "cell")

    def search(self, queries: DataFrame, k: int, probes: int | None = None, depth: int | None = None) -> DataFrame:
        """(qid, id, score, rank): about the k best by cosine of each of ``queries(qid, embedding)``; scores are exact."""
        some = written(self.candidates(queries, k, probes, depth), "index-candidates")
        vectors = self._read("vectors", self._segments())
        wanted = [r[0] for r in some.select("cell").distinct().collect()]
        vectors = vectors.where(F.col("cell").isin(wanted)).select("id", "seq", F.col("v").alias("w"))
        both = some.select("qid", "id", "seq").join(vectors, ["id", "seq"]).join(self._usable(queries, "qid", "embedding", self.dim).toDF("qid", "q"), "qid")
        return top_per(both.select("qid", "id", cosine(F.col("w"), F.col("q")).alias("score")), "qid", [F.round("score", 9).desc(), F.col("id")], k)


def fitted(vectors: DataFrame, **options) -> VectorIndex:
    """An index in the cluster's shared folder."""
    return VectorIndex.fit(vectors, fresh(vectors.sparkSession, "vector-index"), **options)
