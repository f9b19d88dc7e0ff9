"""Vectors: normalisation, cosine, exact top-k (single, batched), similar pairs."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.store import arrow
from .lexical import top_per


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalise(v: Column, slack: float = 1e-6) -> Column:
    """L2-normalised; a vector within ``slack`` of unit length, or of none, stays as it is."""
    n = norm(v)
    return F.when((n == 0) | (F.abs(n - 1) <= slack), F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / n))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """From -1 to 1; 0 where sizes differ or a vector has no length."""
    value = F.least(F.greatest(F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0)), F.lit(-1.0)), F.lit(1.0))
    return F.when(F.size(a) == F.size(b), value).otherwise(F.lit(0.0))


def finite(v: Column) -> Column:
    """Neither NaN nor infinite anywhere."""
    return ~F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))


def topk(vectors: DataFrame, query: Column, k: int, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """(id, score) of the k best by cosine; exact.  A query of another size has no result."""
    rows = vectors.where(F.size(vec_col) == F.size(query)).select(F.col(id_col).alias("id"), cosine(F.col(vec_col), query).alias("score"))
    return rows.orderBy(F.round("score", 9).desc(), "id").limit(k)


def fnv32a(text: Column) -> Column:
    """The 32-bit FNV-1a hash of a string's bytes."""
    raw = text.cast("binary")
    at = F.sequence(F.lit(1), F.octet_length(raw))
    byte = lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("long")
    step = lambda h, i: (h.bitwiseXOR(byte(i)) * 16777619) % (1 << 32)
    return F.when(F.octet_length(raw) == 0, F.lit(2166136261)).otherwise(F.aggregate(at, F.lit(2166136261).cast("long"), step))


def sharded_topk(vectors: DataFrame, query: Column, k: int, shards: int, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """(id, score, shard): each shard's k best, shards by the hash of the id, then the k best of all."""
    rows = vectors.where(F.size(vec_col) == F.size(query)).select(F.col(id_col).alias("id"), cosine(F.col(vec_col), query).alias("score"), (fnv32a(F.col(id_col).cast("string")) % shards).alias("shard"))
    few = top_per(rows, "shard", [F.round("score", 9).desc(), F.col("id")], k)
    return few.orderBy(F.round("score", 9).desc(), "id").limit(k).select("id", "score", "shard")


def batch_topk(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """(qid, id, score, rank) for each of ``queries(qid, embedding)``: a matrix product per batch.

    The queries are broadcast, 4 MB of them at a time: a stated query set against all rows,
    in blocks.  Each task keeps only its own k best per query, so what is shuffled is
    k rows a query and task.
    """
    spark = vectors.sparkSession
    rows = queries.select("qid", "embedding").toArrow()
    out = None
    dim = len(rows.column(1)[0].as_py()) if rows.num_rows else 1
    step = max(1, (4 << 20) // (8 * dim))
    for at in range(0, max(rows.num_rows, 1), step):
        part = rows.slice(at, step)
        block = spark.sparkContext.broadcast((part.column(0).to_pylist(), [x.as_py() for x in part.column(1)]))
        found = arrow(vectors).select(F.col(id_col).alias("id"), F.col(vec_col).alias("embedding")).mapInArrow(_best(block, k), "qid long, id long, score double")
        out = found if out is None else out.union(found)
    return top_per(out, "qid", [F.round("score", 9).desc(), F.col("id")], k)


def _unit(m):
    n = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


#: rows and queries whose products a task holds at a time
STRIP, ASKED = 2048, 512


def _better(held, ids, i, score, found):
    """Put scores of rows ``found`` into the lists i of ``held`` and ``ids``, whose length stays."""
    touched, at = np.unique(i, return_inverse=True)
    k = held.shape[1]
    g = np.concatenate([np.repeat(np.arange(len(touched)), k), at])
    s, d = np.concatenate([held[touched].ravel(), score]), np.concatenate([ids[touched].ravel(), found])
    order = np.lexsort((d, -np.round(s, 9), g))
    g, s, d = g[order], s[order], d[order]
    keep = np.arange(len(g)) - np.searchsorted(g, np.arange(len(touched)))[g] < k
    held[touched], ids[touched] = s[keep].reshape(-1, k), d[keep].reshape(-1, k)


def _best(block, k):
    def run(batches):
        qids, vectors = block.value
        if not qids:
            return
        q = _unit(np.asarray(vectors, np.float64))
        ids, held = np.full((len(qids), k), np.iinfo(np.int64).max), np.full((len(qids), k), -np.inf)
        width = 64  # the first rows fill the lists, few of the later ones enter them
        for batch in batches:
            lists = batch.column(1)
            same = np.flatnonzero(np.diff(np.asarray(lists.offsets)) == q.shape[1])
            if not len(same):
                continue
            m = _unit(np.asarray(lists.take(pa.array(same)).flatten(), np.float64).reshape(len(same), q.shape[1]))
            names, at = np.asarray(batch.column(0))[same], 0
            while at < len(m):
                part = m[at : at + width].T
                for a in range(0, len(q), ASKED):
                    score = np.clip(q[a : a + ASKED] @ part, -1, 1)
                    i, j = np.nonzero(score >= held[a : a + ASKED, -1:] - 1e-8)  # equal to nine places counts as equal
                    if len(i):
                        _better(held, ids, i + a, score[i, j], names[at + j])
                at, width = at + width, min(2 * width, STRIP)
        i, j = np.nonzero(held > -np.inf)
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(qids)[i]), pa.array(ids[i, j]), pa.array(held[i, j])], names=["qid", "id", "score"])

    return run


#: rows of one bucket of ``similar_pairs``, on average, where rows are unrelated; rows above which a bucket is divided
BUCKET, CROWDED = 2048, 8192
#: components of the rows of a group at most (16 MB), least rows of one, products held at a time
GROUP, LEAST_ROWS, HELD = 1 << 21, 1024, 1 << 20
#: rows that a task deals out at a time
DEALT = 256


def similar_pairs(vectors: DataFrame, least: float, id_col: str = "id", vec_col: str = "embedding", tables: int | None = None, bits: int | None = None, recall: float = 0.95) -> DataFrame:
    """(a, b, score), a < b, score >= least, found by random hyperplanes and confirmed by cosine.

    Used where the table is too large for all pairs; ``exact_pairs`` is the exact form.
    A pair at ``least`` shares a table's key with probability (1 - angle / pi) ** bits;
    there are as many tables as find it with probability ``recall``, 12 at least.  The bits grow with
    the logarithm of the table, so that a bucket of unrelated rows keeps about ``BUCKET`` of them.  A bucket
    is one matrix product: what is shuffled is each row once a table, and the pairs that were confirmed.
    Buckets above ``CROWDED`` rows are divided, each pair of parts being a product of its own.  Where the buckets of all
    tables hold as many pairs as there are (low thresholds need many tables), all pairs are compared: ``exact_pairs``.
    """
    named = vectors.where(F.col(vec_col).isNotNull())
    rows = arrow(named).select(F.col(id_col).alias("id"), _numbers(vectors, vec_col).alias("v"))
    n, given = named.count(), bits is not None or tables is not None
    if bits is None:
        bits = int(np.clip(np.ceil(np.log2(max(n, 1) / BUCKET)), 6, 24))
    if tables is None:
        meet = (1 - np.arccos(np.clip(least, -1, 1)) / np.pi) ** bits
        tables = 12 if meet >= 1 else max(12, int(np.ceil(np.log(1 - recall) / np.log1p(-max(meet, 1e-3)))))
    kind = rows.schema["id"].dataType.simpleString()
    if not given and kind in ("bigint", "int") and tables * n / 2**bits >= n / 2:
        found = exact_pairs(vectors, least, id_col, vec_col)
        return found.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"), "score")
    dim = vectors.select(F.max(F.size(vec_col))).first()[0] or 1
    planes = np.random.default_rng(42).standard_normal((tables, bits, dim))
    crowds = rows.mapInArrow(_crowds(planes), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > CROWDED)
    crowds = {r.key: -(-r.n // CROWDED) for r in crowds.collect()}  # at most tables * n / CROWDED
    of = rows.schema["v"].dataType.simpleString()
    keyed = rows.mapInArrow(_dealt(planes, vectors.sparkSession.sparkContext.broadcast(crowds)), f"key long, low int, high int, own int, id {kind}, v {of}")
    placed = keyed.repartition(max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "key", "low", "high").sortWithinPartitions("key", "low", "high")
    return placed.mapInArrow(_products(least), f"a {kind}, b {kind}, score double").groupBy("a", "b").agg(F.max("score").alias("score"))


def _numbers(vectors, vec_col):
    """The vectors, as floats or doubles."""
    of = vectors.schema[vec_col].dataType.elementType.simpleString()
    return F.col(vec_col) if of in ("float", "double") else F.transform(vec_col, lambda x: x.cast("double"))


def _flat(lists):
    """The components of an array of lists in a row, null ones as NaN."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)


def _keys(lists, planes):
    """A row's key in each table."""
    tables, bits, dim = planes.shape
    sizes = np.diff(np.asarray(lists.offsets))
    m = np.zeros((len(sizes), dim))
    m[np.arange(dim) < sizes[:, None]] = _flat(lists)
    sides = ((m @ planes.reshape(-1, dim).T) >= 0).reshape(-1, tables, bits)
    return (np.arange(tables) << bits) + sides @ (1 << np.arange(bits))


def _crowds(planes):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                keys, n = np.unique(_keys(batch.column(1), planes), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])

    return run


def _dealt(planes, crowds):
    """Each row to its bucket of each table; to all pairs of parts with its own where the bucket is divided."""

    def run(batches):
        place = 0
        for batch in batches:
            for at in range(0, batch.num_rows, DEALT):
                part = batch.slice(at, DEALT)
                keys = _keys(part.column(1), planes)
                row, key = np.repeat(np.arange(len(keys)), keys.shape[1]), keys.ravel().astype(np.int64)
                parts = np.array([crowds.value.get(k, 1) for k in key.tolist()]) if crowds.value else np.ones(len(key), int)
                own = (place + row) % parts  # any part will do
                place += len(keys)
                again = np.repeat(np.arange(len(key)), parts)
                other = np.arange(len(again)) - np.repeat(np.cumsum(parts) - parts, parts)
                row, key, own = row[again], key[again], own[again]
                low, high = np.minimum(own, other), np.maximum(own, other)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), *(pa.array(x.astype(np.int32)) for x in (low, high, own)), part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row))], names=["key", "low", "high", "own", "id", "v"]
                )

    return run


def _grouped(vectors: DataFrame, id_col: str, vec_col: str, block: int | None):
    """(rows(id, v), their number, rows of a group): the fewer groups, the less is shuffled, but there are several tasks a core."""
    rows = arrow(vectors).where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), _numbers(vectors, vec_col).alias("v"))
    n, dim = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    parts = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows, n, block or min(max(LEAST_ROWS, -(-n // int(np.ceil(np.sqrt(4 * parts))))), max(1, GROUP // max(dim or 1, 1)))


def _placed(keyed: DataFrame, keys: int) -> DataFrame:
    parts = max(1, min(keys, 4 * int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return keyed.select("key", "low", "high", "own", "id", "v").repartition(parts, "key", "low", "high").sortWithinPartitions("key", "low", "high")


def _all_groups(vectors, id_col, vec_col, block):
    """Rows dealt to all pairs of groups."""
    rows, n, block = _grouped(vectors, id_col, vec_col, block)
    groups = max(1, -(-n // block))
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))
    every = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return _placed(every.select(F.lit(0).cast("long").alias("key"), F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "id", "v"), groups * (groups + 1) // 2)


def exact_pairs(vectors: DataFrame, least: float, id_col: str = "id", vec_col: str = "embedding", block: int | None = None) -> DataFrame:
    """(a, b, score), a < b, cosine >= least: every row against all rows, as products of groups of rows.

    Rows are dealt into groups by a hash of their id; each pair of groups is one
    key's work, two groups in memory, a strip of their products at a time.  Nothing passes the driver; the work
    grows with the square of the table by definition, what is shuffled with the table times its groups.
    """
    return _all_groups(vectors, id_col, vec_col, block).mapInArrow(_products(least), "a long, b long, score double")


def linked(vectors: DataFrame, least: float, id_col: str = "id", vec_col: str = "embedding", block: int | None = None) -> DataFrame:
    """(a, b): edges with the same components as all of ``exact_pairs``; a task gives one a row at most, not one a pair."""
    return _all_groups(vectors, id_col, vec_col, block).mapInArrow(_forest(least), "a long, b long")


def best_earlier(chosen: DataFrame, vectors: DataFrame, least: float, block: int | None = None) -> DataFrame:
    """(a, b, score): for each of ``vectors(id, v)`` the best by cosine, then id, of ``chosen(id, v)`` with a smaller id, where that is >= least."""
    few, n, size = _grouped(chosen, "id", "v", block)
    rows, m, block = _grouped(vectors, "id", "v", block)
    block = max(size, block)
    tall, wide = max(1, -(-n // block)), max(1, -(-m // block))

    def dealt(rows, own, groups, other):
        each = rows.withColumn("g", F.pmod(F.xxhash64("id"), F.lit(groups))).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(other - 1))))
        key = F.col("o") * wide + F.col("g") if own else F.col("g") * wide + F.col("o")
        return each.select(key.cast("long").alias("key"), F.lit(0).alias("low"), F.lit(1).alias("high"), F.lit(own).alias("own"), "id", "v")

    placed = _placed(dealt(few, 0, tall, wide).unionByName(dealt(rows, 1, wide, tall)), tall * wide)
    found = placed.mapInArrow(_best_of(least), "a long, b long, score double")
    return found.groupBy("b").agg(F.max_by("a", F.struct("score", -F.col("a"))).alias("a"), F.max("score").alias("score")).select("a", "b", "score")


def _tiles(batches):
    """(ids, unit rows, places of the one group, places of the other) of each key, for vectors of one size at a time."""

    def close(held):
        table = pa.Table.from_batches(held)
        own, ids, low, high = (np.asarray(table.column(c)) for c in ("own", "id", "low", "high"))
        lists = table.column("v").combine_chunks()
        sizes = np.diff(np.asarray(lists.offsets))
        for size in np.unique(sizes):  # vectors of one size compare
            same = np.flatnonzero(sizes == size)
            m, side = _unit(_flat(lists.take(pa.array(same))).reshape(len(same), size)), own[same]
            yield ids[same], m, np.flatnonzero(side == low[0]), np.flatnonzero(side == high[0])

    held, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("key", "low", "high")])
        starts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0)]))
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            key = tuple(keys[:, a])
            if key != now and held:
                yield from close(held)
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield from close(held)


def _hits(m, x, y, least):
    """Pairs of places (i of x, j of y) with their cosine, a strip of products at a time."""
    right = m[y].T
    step = max(1, HELD // max(1, len(y)))
    for at in range(0, len(x), step):
        score = np.clip(m[x[at : at + step]] @ right, -1, 1)
        i, j = np.nonzero(score >= least)
        if len(i):
            yield x[at + i], y[j], score[i, j]


def _products(least):
    def run(batches):
        for ids, m, x, y in _tiles(batches):
            once = np.array_equal(x, y)
            for i, j, s in _hits(m, x, y, least):
                a, b = ids[i], ids[j]
                keep = a < b if once else a != b
                a, b, s = a[keep], b[keep], s[keep]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.where(a < b, a, b)), pa.array(np.where(a < b, b, a)), pa.array(s)], names=["a", "b", "score"])

    return run


def _forest(least):
    def run(batches):
        for ids, m, x, y in _tiles(batches):
            root = np.arange(len(ids))
            for i, j, _ in _hits(m, x, y, least):
                keep = ids[i] != ids[j]
                i, j = i[keep], j[keep]
                while True:
                    a, b = root[i], root[j]
                    far = a != b
                    if not far.any():
                        break
                    i, j, a, b = i[far], j[far], a[far], b[far]
                    np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
                    while not np.array_equal(up := root[root], root):
                        root = up
            a, b = ids[root], ids
            keep = a != b
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    return run


def _best_of(least):
    def run(batches):
        for ids, m, x, y in _tiles(batches):
            x = x[np.argsort(ids[x], kind="stable")]  # the first of equal scores has the smallest id
            if not len(x) or not len(y):
                continue
            right, step = m[x].T, max(1, HELD // len(x))
            for at in range(0, len(y), step):
                part = y[at : at + step]
                score = np.clip(m[part] @ right, -1, 1)
                score[~((score >= least) & (ids[x] < ids[part][:, None]))] = -np.inf
                top = np.argmax(score, axis=1)
                s = score[np.arange(len(part)), top]
                keep = s > -np.inf
                if keep.any():
                    yield pa.RecordBatch.from_arrays([pa.array(ids[x[top[keep]]]), pa.array(ids[part[keep]]), pa.array(s[keep])], names=["a", "b", "score"])

    return run
