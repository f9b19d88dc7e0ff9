"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, star edges.

Texts with equal shingle sets are one class before anything is compared.  Each class
has one signature; bands of it are bucket keys.  A bucket of m classes proposes m-1
edges, from one centre to the others, never all pairs.  Candidate edges are confirmed
on full shingle sets.  Later rounds look only at buckets whose members are still in
different components and draw other centres there, while this links many.  The members of
buckets that span components even then, and all short texts, are joined exactly: every pair of them that can reach
the threshold shares one of the first shingles of both.

Edge cases: null or empty texts have the empty set, link with nothing and are their own
component; a null doc_id row stays, unlinked; repeated rows and exact copies are one class;
rows of one doc_id with different texts are linked each by its own text; extra columns are
ignored; an empty table gives an empty result.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._store import drop, stored, tune
from ._text import mix64, shingle_sets, text_slices
from .components import component_stars


def densified_signatures(sets, bins):
    """One-permutation signatures of non-empty hash sets, one row each, no empty bin.

    A hash's top bits choose its bin and the bin keeps its least hash.  An empty bin
    copies the bin that a hash of (bin, attempt), the same for all sets, names first
    among the filled ones.
    """
    n, shift = len(sets), np.uint64(64 - int(bins).bit_length() + 1)
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(n), sizes)
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    sig = np.full(n * bins, empty, np.uint64)
    flat = mix64(flat ^ np.uint64(0xA24BAED4963EE407))
    np.minimum.at(sig, row * bins + (flat >> shift).astype(np.int64), flat)
    sig = sig.reshape(n, bins)
    filled = sig != empty
    todo = ~filled
    attempt = 0
    while todo.any():
        attempt += 1
        if attempt <= 16 * bins:
            source = (mix64(np.arange(bins, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        else:  # each bin in turn: ends for any non-empty set
            source = (np.arange(bins) + attempt) % bins
        can = todo & filled[:, source]
        sig = np.where(can, sig[:, source], sig)
        todo &= ~can
    return sig


def _features(bins, bands, n):
    rows = bins // bands

    def run(batches):
        for batch in batches:
            ids, marks = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "mark"))
            for first, count, data, offs in text_slices(batch, "text"):
                sets = shingle_sets(data, offs, n)
                full = [i for i, s in enumerate(sets) if len(s)]
                low, high = np.zeros(count, np.int64), np.zeros(count, np.int64)
                for i in full:  # 128 bits that name the set
                    s = sets[i]
                    low[i] = np.add.reduce(mix64(s)).view(np.int64)
                    high[i] = np.add.reduce(mix64(s ^ np.uint64(0x5851F42D4C957F2D))).view(np.int64)
                keys = np.zeros((len(full), bands), np.uint64)
                sig = densified_signatures([sets[i] for i in full], bins).reshape(len(full), bands, rows)
                for r in range(rows):
                    keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r])
                keys = mix64(keys + np.arange(bands, dtype=np.uint64))
                offsets = np.zeros(count + 1, np.int32)
                offsets[np.array(full, np.int64) + 1] = bands
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, count).cast(pa.int64()),
                        marks.slice(first, count),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(low),
                        pa.array(high),
                        pa.ListArray.from_arrays(np.cumsum(offsets, dtype=np.int32), pa.array(keys.ravel().view(np.int64))),
                    ],
                    names=["doc_id", "mark", "n_shingles", "d1", "d2", "bands"],
                )

    return run


def _confirm(n, percent):
    def run(batches):
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ta, tb = pa.RecordBatch.from_arrays([batch.column(2)], ["text"]), pa.RecordBatch.from_arrays([batch.column(3)], ["text"])
            keep = np.zeros(len(a), bool)
            # rows of one left text mostly stand together: its set is built once
            change = [i for i in range(len(a)) if i == 0 or a[i] != a[i - 1]]
            left = {}
            for first, _, data, offs in text_slices(ta.take(pa.array(change, pa.int64())), "text"):
                left.update((a[change[i]], s) for i, s in enumerate(shingle_sets(data, offs, n), first))
            for first, count, data, offs in text_slices(tb, "text"):
                for i, s in enumerate(shingle_sets(data, offs, n), first):
                    o = left[a[i]]
                    both = len(np.intersect1d(o, s, assume_unique=True))
                    keep[i] = both > 0 and 100 * both >= percent * (len(o) + len(s) - both)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(keep)], names=["a", "b", "linked"])

    return run


#: counters that tell common shingles from rare ones; only speed depends on them
TALLY = 1 << 20
#: rounds of random centres go on while one finds more than this share of all links so far; only speed depends on it
ROUND = 0.05
#: members of a bucket that stand together in a join
DEAL = 128


def _slots(hashes):
    return (hashes >> np.uint64(44)).astype(np.int64)


def _tally(n):
    def run(batches):
        total = np.zeros(TALLY, np.int64)
        for batch in batches:
            for _, _, data, offs in text_slices(batch, "text"):
                for s in shingle_sets(data, offs, n):
                    np.add.at(total, _slots(s), 1)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["slot", "n"])

    return run


def _prefixes(n, percent, tally):
    """A text's first shingles, rare ones first: all that the first common shingle of a linked pair can be."""

    def run(batches):
        for batch in batches:
            ids, comps = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for first, _, data, offs in text_slices(batch, "text"):
                node, comp, size, at, key = [], [], [], [], []
                for i, s in enumerate(shingle_sets(data, offs, n), first):
                    m = len(s) + (-percent * len(s)) // 100 + 1
                    s2 = s[np.lexsort((s, tally[_slots(s)]))[:m]]
                    node.append(np.full(len(s2), ids[i]))
                    comp.append(np.full(len(s2), comps[i]))
                    size.append(np.full(len(s2), len(s)))
                    at.append(np.arange(len(s2)))
                    key.append(s2.view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c).astype(np.int64)) for c in (key, node, comp, size, at)],
                    names=["shingle", "node", "comp", "size", "at"],
                )

    return run


def _dealt(members: DataFrame) -> DataFrame:
    """``members(key, node, m)`` of buckets of m with ``salt``, so that about DEAL of a bucket share one."""
    return members.withColumn("salt", F.expr(f"int(pmod(xxhash64(node), (m - 1) div {DEAL} + 1))"))


def _salts():
    """A row for each salt of a bucket of ``m``."""
    return F.explode(F.sequence(F.lit(0), F.expr(f"int((m - 1) div {DEAL})"))).alias("salt")


def _named(nodes: DataFrame, stars) -> DataFrame:
    """``nodes(node, ...)`` with ``comp``, their components by ``stars`` (none yet: their own)."""
    if stars is None:
        return nodes.withColumn("comp", F.col("node"))
    return nodes.join(stars.toDF("node", "star"), "node", "left").withColumn("comp", F.coalesce("star", "node")).drop("star")


def _open_members(members: DataFrame) -> DataFrame:
    """(node, comp) of ``members(key, node, comp, m)`` in buckets that span components."""
    open_ = members.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max("m").alias("m")).where("low <> high").select("key", _salts())
    return _dealt(members).join(open_, ["key", "salt"]).select("node", "comp")


def _exact_candidates(nodes: DataFrame, texts: DataFrame, shingle: int, percent: int):
    """(a, b) of ``nodes(node, comp)`` that may link two components; None if there are none.

    In any one order of all shingles, the first that two sets with ``need`` common ones share
    has at least ``need`` shingles from it on in both.  A shingle is a key only where several
    components have it, and its members of the component that has it most meet the others only,
    not each other: a large group of near copies costs its size.
    """
    nodes = stored(nodes.distinct(), "minhash-open")
    if nodes.isEmpty():
        drop(nodes)
        return None
    known = stored(texts.join(nodes, "node").select("node", "comp", "text"), "minhash-known")
    tally = np.zeros(TALLY, np.int32)
    seen = known.select("text").mapInArrow(_tally(shingle), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).where("n > 1").toArrow()  # at most TALLY rows
    tally[np.asarray(seen.column(0))] = np.minimum(np.asarray(seen.column(1)), np.iinfo(np.int32).max)
    firsts = stored(
        known.mapInArrow(_prefixes(shingle, percent, tally), "shingle long, node long, comp long, size long, at long"),
        "minhash-firsts",
    )
    each = firsts.groupBy("shingle", "comp").agg(F.count("*").alias("n")).groupBy("shingle").agg(F.count("*").alias("comps"), F.max_by("comp", F.struct("n", "comp")).alias("main"))
    shared = firsts.join(stored(each.where("comps > 1").select("shingle", "main"), "minhash-shared"), "shingle").withColumn("rest", F.expr("comp <> main"))
    x, y = (shared.select("shingle", *(F.col(c).alias(f"{c}_{side}") for c in ("node", "comp", "size", "at", "rest"))) for side in "xy")
    need = f"{percent} * (size_x + size_y)"
    pairs = (
        x.where("rest_x").join(y, "shingle")
        .where("comp_x <> comp_y and (not rest_y or node_x < node_y)")
        .where(f"100 * least(size_x, size_y) >= {percent} * greatest(size_x, size_y)")
        .where(f"(size_x - at_x) * {100 + percent} >= {need} and (size_y - at_y) * {100 + percent} >= {need}")
        .select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b"))
        .distinct()
    )
    pairs = stored(pairs, "minhash-pairs")
    drop(firsts, nodes, known)
    return pairs


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): near-duplicate components of ``docs(doc_id, text)``; options as of ``marked``."""
    return marked(docs, **options).drop("mark")


def marked(docs: DataFrame, shingle: int = 5, percent: int = 75, bins: int = 128, bands: int = 32) -> DataFrame:
    """``near_duplicates`` with ``mark``, a hash of the text that tells rows of one doc_id apart.

    Documents link when 100 * shared shingles >= percent * all shingles of both.
    With 32 bands of 4 rows a pair at 0.75 shares no bucket with probability 5e-6 if the bins
    are independent.  With few shingles to many bins they aren't, so that all pairs in which a text has at
    most half as many shingles as there are bins are found by the exact join, whatever their bands.
    """
    spark = docs.sparkSession
    tune(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    features = stored(
        docs.mapInArrow(_features(bins, bands, shingle), "doc_id long, mark long, n_shingles long, d1 long, d2 long, bands array<long>"), "minhash-features"
    )
    known = features.where("n_shingles > 0 and doc_id is not null")
    # grouped tables are written before they are joined: between plain reads Spark can split a hot key's rows
    classes = known.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "mark")).alias("least"), F.first("bands").alias("bands"), F.first("n_shingles").alias("size"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "minhash-classes")
    rows = classes.select("node", F.explode("bands").alias("key"))
    crowded = stored(rows.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "minhash-crowded")
    buckets = stored(rows.join(crowded, "key").select("key", "node", "m"), "minhash-buckets")
    # every partner of a set of half as many shingles as bins has at most 100 / percent times as many
    short = stored(classes.where(F.col("size") * 2 * percent <= 100 * bins).select("node"), "minhash-short")
    # texts of the classes that share a bucket with another, and short ones: only these are compared
    nodes = classes.join(buckets.select("node").union(short).distinct(), "node").select("node", "least.doc_id", "least.mark")
    texts = stored(docs.join(nodes, ["doc_id", "mark"]).dropDuplicates(["node"]).select("node", "text"), "minhash-texts")
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("left_text"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("right_text"))
    stars, found, number, exact = None, 0, 0, False
    while True:
        # members of buckets, with their components; a bucket of two is its one pair, compared in round 1
        members = buckets if number == 0 else buckets.where("m > 2")
        if exact:
            pairs = written = _exact_candidates(_named(_open_members(_named(members, stars)).select("node").union(short), stars), texts, shingle, percent)
            if pairs is None:
                break
        else:
            members = _named(members, stars)
            order = F.col("node") if number == 0 else F.xxhash64(F.col("key"), F.col("node"), F.lit(number))
            centres = written = stored(
                members.groupBy("key")
                .agg(F.min_by(F.struct("node", "comp"), order).alias("c"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.max("m").alias("m"))
                .where("low <> high")
                .select("key", _salts(), F.col("c.node").alias("centre"), F.col("c.comp").alias("centre_comp")),
                "minhash-centres",
            )
            # a bucket's members are dealt by DEAL each, and its centre is sent to every deal
            pairs = (
                _dealt(members).join(centres, ["key", "salt"])
                .where("comp <> centre_comp")
                .select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
                .distinct()
            )
        checked = stored(
            pairs.join(right, "b").join(left, "a").select("a", "b", "left_text", "right_text")
            .mapInArrow(_confirm(shingle, percent), "a long, b long, linked boolean"),
            "minhash-checked",
        )
        links = checked.where("linked").select("a", "b")
        new = links.count()
        if new:
            following = component_stars(links if stars is None else links.union(stars.toDF("a", "b")), "minhash-cc")
            if stars is not None:
                drop(stars)
            stars = following
        drop(written, checked)
        number, found = number + 1, found + new
        if exact:
            break
        # a random centre is worth its round while it links many; the exact join ends the others
        exact = number > 1 and new <= ROUND * found or not found
    drop(texts, buckets, crowded, short)
    member = known.join(classes.select("d1", "d2", "node", F.col("least.doc_id").alias("least")), ["d1", "d2"]).select("doc_id", "mark", "n_shingles", "node", "least")
    if stars is None:
        linked = member.withColumn("component_id", F.col("least"))
    else:
        # the smallest doc_id of each component of several classes
        bound = stars.toDF("node", "star")
        bound = bound.union(bound.select(F.col("star").alias("node"), "star").distinct())
        named = classes.select("node", F.col("least.doc_id").alias("least")).join(bound, "node")
        small = stored(named.groupBy("star").agg(F.min("least").alias("component")), "minhash-components")
        linked = member.join(stored(bound.join(small, "star").select("node", "component"), "minhash-labels"), "node", "left").withColumn("component_id", F.coalesce("component", "least"))
    alone = features.where("not (n_shingles > 0 and doc_id is not null)").select("doc_id", "mark", "n_shingles", F.col("doc_id").alias("component_id"))
    out = linked.select("doc_id", "mark", "n_shingles", "component_id").union(alone)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One document of each near-duplicate group, with the columns of ``docs``.

    Repeated rows of one doc_id and text are one document; rows without a doc_id stay.
    """
    keep = marked(docs, **options).where("kept and doc_id is not null").select(F.col("doc_id").alias("_keep"), F.col("mark").alias("_mark")).distinct()
    named = docs.where("doc_id is not null")
    kept = named.join(keep, (named.doc_id.cast("long") == keep._keep) & (F.xxhash64(named.text.cast("string")) == keep._mark), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.where("doc_id is null"))


def op6_minhash(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
