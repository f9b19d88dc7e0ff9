"""Keyed tables: upserts, deletions, logs, last-writer-wins imports, memories."""

from pyspark.sql import Column, DataFrame, Window, functions as F


def last_write(rows: DataFrame, key, order) -> DataFrame:
    """The last row of each key: one grouped maximum with map-side combining, no sort."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in rows.columns if c not in keys]
    order = [F.col(o) if isinstance(o, str) else o for o in (order if isinstance(order, (list, tuple)) else [order])]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*rows.columns)


def upsert(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``base`` with the rows of ``changes`` in place of those of equal key."""
    return base.join(changes.select(key), key, "left_anti").unionByName(changes)


def delete(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return base.join(keys.select(key).distinct(), key, "left_anti")


def replay(log: DataFrame, key: str, order: str, deleted: Column) -> DataFrame:
    """Live rows of a log: the last operation of each key, without deletions."""
    return last_write(log.withColumn("_d", deleted), key, order).where("not _d").drop("_d")


def import_newer(base: DataFrame, incoming: DataFrame, key, stamp: str) -> DataFrame:
    """Last writer wins by ``stamp``; on a tie what is there stays."""
    both = base.withColumn("_side", F.lit(1)).unionByName(incoming.withColumn("_side", F.lit(0)))
    return last_write(both, key, [stamp, "_side"]).drop("_side")


def consolidation_plan(members: DataFrame, edges: DataFrame, clusters: DataFrame, high: float = 0.97, loss: float = 0.15, most: int = 6) -> DataFrame:
    """(cluster, action, survivor, size) of similar memories.

    ``members(id, value, created)``, ``edges(a, b, score)``, ``clusters(id, component)``.
    All scores at ``high`` or above and no source losing over ``loss`` of its words to the
    newest, which survives: merge; else abstract.  Clusters over ``most`` are skipped.
    """
    words = F.array_distinct(F.filter(F.split(F.lower("value"), "[^\\p{L}\\p{Nd}]+"), lambda w: w != ""))
    m = members.join(clusters, "id").withColumn("words", words)
    new = m.groupBy("component").agg(F.max_by(F.struct("id", "words"), F.struct("created", "id")).alias("s"), F.count("*").alias("size"))
    lost = F.size(F.array_except("words", "s.words")) / F.greatest(F.size("words"), F.lit(1))
    worst = m.join(new, "component").groupBy("component").agg(F.max(lost).alias("lost"))
    low = edges.join(clusters.select(F.col("id").alias("a"), "component"), "a").groupBy("component").agg(F.min("score").alias("low"))
    action = F.when(F.col("size") > most, "skip").when((F.col("low") >= high) & (F.col("lost") <= loss), "merge").otherwise("abstract")
    return new.join(worst, "component").join(low, "component").select(F.col("component").alias("cluster"), action.alias("action"), F.col("s.id").alias("survivor"), "size")


def coverage_guard(source: Column, summary: Column, drop: float = 0.1) -> Column:
    """Whether a summary keeps all numbers, adds none, and drops at most a tenth of the capitalised names."""
    numbers = lambda t: F.array_distinct(F.regexp_extract_all(t, F.lit("\\d+(?:[.,]\\d+)?"), F.lit(0)))
    names = lambda t: F.array_distinct(F.regexp_extract_all(t, F.lit("\\p{Lu}[\\p{L}\\p{Nd}]+"), F.lit(0)))
    same = (F.size(F.array_except(numbers(source), numbers(summary))) == 0) & (F.size(F.array_except(numbers(summary), numbers(source))) == 0)
    return same & (F.size(F.array_except(names(source), names(summary))) <= drop * F.size(names(source)))


def shards(facts: DataFrame, size: int = 12) -> DataFrame:
    """``facts(relation, source_id, target_id, id)`` numbered into shards of ``size`` per relation."""
    w = Window.partitionBy("relation").orderBy("source_id", "target_id", "id")
    return facts.withColumn("shard", F.floor((F.row_number().over(w) - 1) / size).cast("long"))


def symbol(name: Column, dim: int = 64) -> Column:
    """A bipolar vector of a name: the bits of its SHA-256, and of it with a counter beyond 256."""
    digest = F.concat(*[F.sha2(F.concat(name, F.lit(f"#{k}")), 256) for k in range((dim + 255) // 256)])
    nibble = lambda i: F.conv(F.substring(digest, F.floor(i / 4).cast("int") + 1, F.lit(1)), 16, 10).cast("int")
    bit = lambda i: F.floor(nibble(i) / F.pow(F.lit(2), i % 4)).cast("int") % 2
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.when(bit(i) == 1, 1).otherwise(-1))


def bind(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def bundle(rows: DataFrame, by, vec: str) -> DataFrame:
    """Element-wise sums of vectors by group: positions are aggregated, never whole groups."""
    by = [by] if isinstance(by, str) else list(by)
    sums = rows.select(*by, F.posexplode(vec).alias("pos", "x")).groupBy(*by, "pos").agg(F.sum("x").alias("x"))
    return sums.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("bundle"))


def sign(v: Column) -> Column:
    """+1 where the sum is not negative, else -1."""
    return F.transform(v, lambda x: F.when(x >= 0, 1).otherwise(-1))


def pin(memories: DataFrame, ids: DataFrame, priority: int | None) -> DataFrame:
    """``memories`` with those of ``ids(id)`` pinned at a priority, or unpinned at 0 if it is None."""
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    marked = memories.join(hit, "id", "left")
    return marked.withColumns({
        "is_pinned": F.when(F.col("_hit"), F.lit(priority is not None)).otherwise(F.col("is_pinned")), "pin_priority": F.when(F.col("_hit"), F.lit(priority or 0)).otherwise(F.col("pin_priority")),
    }).drop("_hit").select(*memories.columns)


def revert(memories: DataFrame, survivors: DataFrame) -> DataFrame:
    """``memories`` as before a consolidation: those that ``survivors(survivor)`` superseded are live again."""
    undone = survivors.select(F.col("survivor").alias("superseded_by")).distinct().withColumn("_undone", F.lit(True))
    back = memories.join(undone, "superseded_by", "left").withColumn("superseded_by", F.when(F.col("_undone"), F.lit("")).otherwise(F.col("superseded_by")))
    return back.drop("_undone").select(*memories.columns)


def lookup(rows: DataFrame, key: str, ids) -> DataFrame:
    """The rows of some ids; the predicate reaches the scan."""
    return rows.where(F.col(key).isin(*ids))


def exists(asked: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``asked(key)`` with ``found``."""
    return asked.join(rows.select(key).distinct().withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def changed_since(rows: DataFrame, at: str, since: Column, **wanted) -> DataFrame:
    """Rows changed after a time that equal every given field."""
    out = rows.where(F.col(at) > since)
    for column, value in wanted.items():
        out = out.where(F.col(column) == value)
    return out


def _named(catalog: DataFrame, name: str) -> bool:
    return not catalog.where(F.col("name") == name).isEmpty()


def create_collection(catalog: DataFrame, name: str, domain: str, dim: int) -> DataFrame:
    """``catalog(name, domain, dim, records)`` with an empty collection more; one of that name stays as it is."""
    new = catalog.sparkSession.createDataFrame([(name, domain, dim, 0)], "name string, domain string, dim int, records long")
    return catalog.unionByName(new.join(catalog.select("name"), "name", "left_anti"))


def drop_collection(catalog: DataFrame, name: str) -> DataFrame:
    return catalog.where(F.col("name") != name)


def rename_collection(catalog: DataFrame, old: str, new: str) -> DataFrame:
    """Fails where there is no such collection, or one of the new name."""
    if not _named(catalog, old):
        raise ValueError(f"no collection {old}")
    if _named(catalog, new):
        raise ValueError(f"there is a collection {new}")
    return catalog.withColumn("name", F.when(F.col("name") == old, new).otherwise(F.col("name")))
