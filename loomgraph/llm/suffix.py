"""Suffix-array dedup: repeated 200-byte strings, one suffix bucket at a time.

The suffixes (window starts) of the corpus are divided into buckets that are ranked apart,
in bounded memory.  A cover sample, a position of each window that depends on the window's
bytes alone (the start of its least hashed 48-byte gram, the leftmost of equals), stands in
for a position of an arithmetic difference cover, which samples ten times as many.  It has
the property by which a difference cover settles long ties.  If the windows at i and j are
equal, their samples stand at one distance o, so that i + o and j + o are both sampled, and
the windows are equal if and only if

    the o bytes before the two samples are equal, and
    the suffixes of the two samples agree in their first 200 - o bytes.

A window's bucket is the gram at its sample, thus equal windows meet in one bucket.  In a
bucket the samples' suffixes, and their preceding bytes read backwards, are sorted once, with
the common prefixes of neighbours.  These are the precomputed ranks: cut at 200 - o and at o
bytes, they name a window by a pair of numbers, however long the tie.  Samples whose gram is
unique in the corpus end before: no window of theirs repeats.

A text that is there twice goes whole; for the others it stands once (texts are equal here by
128 bits of SHA-256, pieces by 128 of BLAKE2).

Memory is bounded by ``HOT`` samples a bucket.  Of larger buckets, equal pieces are counted
before they are dealt out (all windows of a piece that is there twice repeat) and the distinct
ones are divided again, by 16 distances and by the 185 bytes that all windows at those
distances share.  Parts that are larger still are divided to the end, a distance each, where
the windows of a part are equal: these are counted, which needs no rank and no memory.

Edge cases: a null or empty text has no byte; texts shorter than the window only keep; null,
equal or repeated doc_ids are rows of their own, and rows equal in doc_id and text are
copies of each other like any others; matches never cross documents; extra columns are
ignored; an empty table gives no rows.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._store import drop, stored, tune
from ._text import INVERSE, mix64, powers, prefix_hash, text_slices

#: window, gram, window starts scanned at once, samples of a hot bucket, distances of its parts, samples ranked at once
WINDOW, GRAM, BLOCK, HOT, SLOT, BATCH = 200, 48, 1 << 22, 1024, 16, 16384


def cover_samples(data, offs, window=WINDOW, gram=GRAM):
    """(text number, gram hash, sample, first window, last window) of each sample; places count in ``data``.

    A window's sample is its gram of least 40-bit hash, the leftmost of equals.
    """
    wide = window - gram + 1
    out = []
    n = len(data)
    for at in range(0, max(n - window + 1, 0), BLOCK):
        stop = min(n, at + BLOCK + window - 1)
        part = data[at:stop]
        sums = prefix_hash(part)
        m = len(part) - gram + 1
        hashes = mix64((sums[gram:] - sums[:-gram]) * powers(INVERSE, m))
        least = (hashes >> np.uint64(24) << np.uint64(24)) | np.arange(m, dtype=np.uint64)
        width = 1
        while 2 * width <= wide:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < wide:
            least = np.minimum(least[: len(least) - (wide - width)], least[wide - width :])
        starts = np.arange(len(least)) + at
        text = np.searchsorted(offs, starts, side="right") - 1
        whole = starts + window <= offs[text + 1]
        starts, text = starts[whole], text[whole]
        if not len(starts):
            continue
        sample = (least[whole] & np.uint64((1 << 24) - 1)).astype(np.int64)
        new = np.ones(len(starts), bool)
        new[1:] = (sample[1:] != sample[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(starts)) - 1
        out.append((text[first], hashes[sample[first]], sample[first] + at, starts[first], starts[last]))
    if not out:
        return tuple(np.zeros(0, np.uint64 if k == 1 else np.int64) for k in range(5))
    return tuple(np.concatenate(x) for x in zip(*out))


def _samples(window, gram):
    def run(batches):
        for batch in batches:
            keys = batch.column(0)
            for first, _, data, offs in text_slices(batch, "text"):
                text, hashes, sample, lo, hi = cover_samples(data, offs, window, gram)
                base = offs[text]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.view(np.int64)), keys.take(pa.array(first + text)), *[pa.array((x - base).astype(np.int32)) for x in (sample, lo, hi)]],
                    names=["gram", "text_key", "at", "lo", "hi"],
                )

    return run


def _pieces(window):
    def run(batches):
        before = None
        for batch in batches:
            keys = batch.column(0).to_pylist()
            lists = batch.column(2)
            bounds, inner = np.asarray(lists.offsets), lists.values
            gram, count, at, lo, hi = (np.asarray(inner.field(k)).astype(np.int64) for k in range(5))
            rows = []
            for first, number, data, offs in text_slices(batch, "text"):
                raw = data.tobytes()
                for i in range(number):
                    key, begin = keys[first + i], int(offs[i])
                    if key == before:  # a copy: its windows all repeat, and are in the corpus once already
                        continue
                    before, here = key, {}
                    for k in range(int(bounds[first + i]), int(bounds[first + i + 1])):
                        g, c, a, l, h = int(gram[k]), int(count[k]), int(at[k]), int(lo[k]), int(hi[k])
                        piece = raw[begin + l : begin + h + window]
                        digest = hashlib.blake2b(piece + b"%d" % (a - l), digest_size=16).digest() if c > HOT else None
                        if digest in here:
                            here[digest].append(l)
                            continue
                        places = [l]
                        if digest:
                            here[digest] = places
                        rows.append((g, c > HOT, digest, key, places, h - l + 1, a - l, piece))
                    if len(rows) >= 4000:
                        yield _piece_batch(rows)
                        rows = []
            if rows:
                yield _piece_batch(rows)

    return run


def _divide(window):
    """Divides pieces of hot buckets by distance to the sample, and by what all windows at those distances share."""
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    names = ["bucket", "weight", "text_key", "lo", "windows", "before", "piece"]

    def run(batches):
        for batch in batches:
            rows = []
            for gram, weight, key, lo, count, before, piece in zip(*(c.to_pylist() for c in batch.columns)):
                for slot in range((before - count + 1) // SLOT, before // SLOT + 1):
                    x, y = max(0, before - slot * SLOT - SLOT + 1), min(count - 1, before - slot * SLOT)
                    shared = piece[before - slot * SLOT : before - slot * SLOT - SLOT + 1 + window]
                    named = hashlib.blake2b(shared + b"%d %d" % (slot, gram), digest_size=8).digest()
                    rows.append((int.from_bytes(named, "little", signed=True), weight, key, lo + x, y - x + 1, before - x, piece[x : y + window]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names=names)

    return run


def _windows(window):
    """(name, weight, text_key, lo) of each window of pieces."""
    kinds, names = [pa.binary(), pa.int64(), pa.binary(), pa.int32()], ["name", "weight", "text_key", "lo"]

    def run(batches):
        for batch in batches:
            rows = [
                (hashlib.blake2b(piece[i : i + window], digest_size=16).digest(), weight, key, lo + i)
                for weight, key, lo, count, piece in zip(*(c.to_pylist() for c in batch.columns))
                for i in range(count)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names=names)

    return run


def _piece_batch(rows):
    kinds = [pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.binary()]
    names = ["bucket", "hot", "digest", "text_key", "los", "windows", "before", "piece"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _ranked(buckets, strings, depth):
    """(order, common) of strings within buckets: sorted places, and each one's common prefix with the one before it."""
    heads = [b.to_bytes(8, "big", signed=True) for b in buckets]
    order = sorted(range(len(strings)), key=lambda k: heads[k] + strings[k])
    table = np.frombuffer(b"".join(strings[k][:depth].ljust(depth, b"\0") for k in order), np.uint8).reshape(len(order), depth)
    sizes = np.array([min(len(strings[k]), depth) for k in order])
    common = np.zeros(len(order), np.int64)
    if len(order) > 1:
        differ = table[1:] != table[:-1]
        prefix = np.where(differ.any(axis=1), differ.argmax(axis=1), depth)
        same = np.array([buckets[a] == buckets[b] for a, b in zip(order, order[1:])])
        common[1:] = np.where(same, np.minimum(prefix, np.minimum(sizes[1:], sizes[:-1])), -1)
    common[:1] = -1
    return np.array(order), common


def repeated_windows(buckets, weights, windows, before, pieces, window=WINDOW):
    """For each piece, the flags of its windows that begin elsewhere too (whole buckets must be given)."""
    n = len(buckets)
    windows, before, weights = np.asarray(windows), np.asarray(before), np.asarray(weights)
    right, right_common = _ranked(buckets, [p[b : b + window] for p, b in zip(pieces, before.tolist())], window)
    left, left_common = _ranked(buckets, [p[:b][::-1] for p, b in zip(pieces, before.tolist())], window)
    at = np.concatenate([[0], np.cumsum(windows)])
    flags = np.zeros(at[-1], bool)
    right_rank, left_rank = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(int((before - windows + 1).min()), int(before.max()) + 1):
        here = np.flatnonzero((o <= before) & (o > before - windows))
        if not len(here):
            continue
        # neighbours whose common prefix reaches the depth are one class at that depth
        right_rank[right] = np.cumsum(right_common < window - o)
        left_rank[left] = np.cumsum(left_common < o)
        _, inverse = np.unique(left_rank[here] * (n + 1) + right_rank[here], return_inverse=True)
        total = np.bincount(inverse, weights=weights[here])
        flags[at[here] + before[here] - o] = total[inverse] > 1
    return [flags[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def runs(flags):
    """(first, last + 1) of each run of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]])))
    return edge[::2], edge[1::2]


def _rank(window):
    names = ["text_key", "lo", "first", "last"]

    def finish(rows):
        found = repeated_windows([r[0] for r in rows], [r[1] for r in rows], [r[4] for r in rows], [r[5] for r in rows], [r[6] for r in rows], window)
        out = []
        for r, flags in zip(rows, found):
            if r[2] is not None and flags.any():
                a, b = runs(flags)
                out.append((r[2], r[3], a.tolist(), b.tolist()))
        kinds = [pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    def run(batches):
        held = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if len(held) >= BATCH and row[0] != held[-1][0]:
                    yield from finish(held)
                    held = []
                held.append(row)
        if held:
            yield from finish(held)

    return run


def _remove(window):
    def run(batches):
        for batch in batches:
            ids, found, copies = batch.column(0), batch.column(2), batch.column(3).to_pylist()
            for first, count, data, offs in text_slices(batch, "text"):
                rows = []
                for i in range(count):
                    text = data[offs[i] : offs[i + 1]]
                    removed = spans = 0
                    if copies[first + i] and len(text) >= window:
                        removed, spans, text = len(text), 1, text[:0]
                    elif found[first + i].is_valid:
                        edge = np.zeros(len(text) + 1, np.int32)
                        for piece in found[first + i].values.to_pylist():  # one text's at a time
                            los = np.asarray(piece["los"])
                            for a, b in zip(piece["first"], piece["last"]):
                                np.add.at(edge, los + a, 1)
                                np.add.at(edge, los + b - 1 + window, -1)
                        gone = np.cumsum(edge[:-1]) > 0
                        removed, spans = int(gone.sum()), len(runs(gone)[0])
                        text = text[~gone]
                    rows.append((len(data[offs[i] : offs[i + 1]]), removed, spans, hashlib.sha256(text.tobytes()).hexdigest()))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, count), *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                )

    return run


def repeated_pieces(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(text_key, los, first, last): windows lo + first[i] .. lo + last[i] - 1, lo each of ``los``, of a text begin elsewhere too.

    ``docs`` has text_key and text; rows of equal keys are one text here.
    """
    samples = stored(docs.select("text_key", "text").mapInArrow(_samples(window, gram), "gram long, text_key binary, at int, lo int, hi int").distinct(), "suffix-samples")
    # written first, so that the join reads plain tables and Spark can split a hot gram's rows
    counts = stored(samples.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"), "suffix-counts")
    kept = stored(samples.join(counts, "gram").select("text_key", "gram", "n", "at", "lo", "hi"), "suffix-cover")
    drop(samples, counts)
    # a text's samples are a piece of the text: the list is no larger than the row it joins
    lists = stored(kept.groupBy("text_key").agg(F.collect_list(F.struct("gram", "n", "at", "lo", "hi")).alias("samples")), "suffix-lists")
    schema = "bucket long, hot boolean, digest binary, text_key binary, los array<int>, windows int, before int, piece binary"
    pieces = stored(docs.select("text_key", "text").join(lists, "text_key").select("text_key", "text", "samples").mapInArrow(_pieces(window), schema), "suffix-pieces")
    drop(kept)
    columns = ["bucket", "weight", "text_key", "lo", "windows", "before", "piece"]
    cold = pieces.where("not hot").withColumn("weight", F.lit(1).cast("long")).withColumn("lo", F.col("los")[0]).select(*columns)
    # equal pieces of hot buckets are one before they are dealt out; all windows of a piece that is there twice repeat
    hot = pieces.where("hot")
    once = hot.groupBy("bucket", "digest").agg(
        F.sum(F.size("los")).alias("weight"), F.expr("if(sum(size(los)) = 1, min(text_key), null)").alias("text_key"), F.min(F.col("los")[0]).alias("lo"),
        F.first("windows").alias("windows"), F.first("before").alias("before"), F.first("piece").alias("piece"),
    )
    divided = stored(once.select(*columns).mapInArrow(_divide(window), "bucket long, weight long, text_key binary, lo int, windows int, before int, piece binary"), "suffix-divided")
    large = stored(divided.groupBy("bucket").agg(F.count("*").alias("n")).where(f"n > {HOT}").select("bucket"), "suffix-large")
    singles = stored(
        divided.join(large, "bucket").select("weight", "text_key", "lo", "windows", "piece").mapInArrow(_windows(window), "name binary, weight long, text_key binary, lo int"), "suffix-windows"
    )
    same = stored(singles.groupBy("name").agg(F.sum("weight").alias("n")).where("n > 1").select("name"), "suffix-same")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranked = (
        cold.union(divided.join(large, "bucket", "left_anti").select(*columns)).repartition(parts, "bucket").sortWithinPartitions("bucket")
        .mapInArrow(_rank(window), "text_key binary, lo int, first array<int>, last array<int>")
    )
    again = stored(hot.groupBy("bucket", "digest").agg(F.sum(F.size("los")).alias("weight")).where("weight > 1").select("bucket", "digest"), "suffix-again")
    whole = hot.select("bucket", "digest", "text_key", "los", "windows").join(again, ["bucket", "digest"]).select("text_key", "los", F.expr("array(0)").alias("first"), F.expr("array(windows)").alias("last"))
    ends = F.expr("array(0)").alias("first"), F.expr("array(1)").alias("last")
    alike = singles.where("text_key is not null").join(same, "name").groupBy("text_key").agg(F.collect_list("lo").alias("los")).select("text_key", "los", *ends)
    found = stored(ranked.select("text_key", F.array("lo").alias("los"), "first", "last").union(whole).union(alike), "suffix-found")
    drop(pieces, again, divided, large, singles, same)
    return found


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of ``docs(doc_id, text)``."""
    tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("text_key", F.unhex(F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 32)))
    each = repeated_pieces(rows, window, gram).groupBy("text_key").agg(F.collect_list(F.struct("los", "first", "last")).alias("found"))
    copied = rows.groupBy("text_key").agg(F.count("*").alias("n")).where("n > 1").select("text_key", F.lit(True).alias("copied"))
    told = stored(each.join(copied, "text_key", "full_outer"), "suffix-told")
    return rows.join(told, "text_key", "left").select("doc_id", "text", "found", "copied").mapInArrow(
        _remove(window), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


def op2_suffix_dedup(spark, sf_dir):
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
