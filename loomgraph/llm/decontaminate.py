"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Documents are read once.  Word n-grams that may stand in a benchmark item, by a bitmap of
fixed size, mark regions of a document; a region reaches as far as the longest item on both
sides of its marks.  A join on the n-gram names the items.  Seeds are n-grams in at most
one of ``ONE_IN`` documents (and ``RARE`` more) and the rarer half of each item's; each (region, item) with a seed, or
with two common n-grams (an edited passage may stand in very many documents), is aligned: match +2, other word -1, gap -1.  An item leaks into a document whose best local
alignment reaches ``least`` of the item's alignment with itself.

Words are runs of bytes of the lower-cased text without white space or ASCII punctuation.

Edge cases: null or empty texts and items without an n-gram match nothing (an item of fewer
than n words is its own single n-gram of all its words); equal items are all reported;
a null doc_id is reported as null, and ``text_hash`` tells which text it was; repeated rows
are reported once for each doc_id and text; extra columns are ignored; empty tables give no rows.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ._store import drop, stored, tune
from ._text import gram_hashes, span_hashes, text_slices

#: log2 of the bitmap's bits, at least and at most
BITS, MOST_BITS = 22, 27
#: an n-gram is rare in one document of so many, and ``RARE`` more: the share stays as the corpus grows
ONE_IN, RARE = 500, 100


def plain_words(data, offs):
    """(hashes, first_word) of words separated by white space or ASCII punctuation."""
    table = np.ones(256, bool)
    table[:48] = table[58:65] = table[91:97] = table[123:128] = False
    n = len(data)
    ink = np.zeros(n + 1, bool)
    ink[:n] = table[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    left = np.zeros(n, bool)
    left[1:] = ink[: n - 1]
    starts = np.flatnonzero(ink[:n] & (~left | edge[:n]))
    ends = np.flatnonzero(ink[:n] & (~ink[1:] | edge[1:])) + 1
    return span_hashes(np.ascontiguousarray(data), starts, ends, both=False)[0], np.searchsorted(starts, offs)


def _items(n):
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, count, data, offs in text_slices(batch, "text"):
                words, at = plain_words(data, offs)
                rows = []
                for i in range(count):
                    w = words[at[i] : at[i + 1]]
                    grams = gram_hashes(w, n) if len(w) >= n else gram_hashes(w, len(w), salt=1) if len(w) else w
                    rows.append((ids[first + i], (w & np.uint64(0x7FFFFFFF)).astype(np.int64).tolist(), grams.view(np.int64).tolist()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.list_(pa.int64()))],
                    names=["item_id", "item_words", "grams"],
                )

    return run


def _regions(n, bitmap, reach, shorts):
    def run(batches):
        table = np.frombuffer(bitmap.value, np.uint8)
        mask = np.uint64(8 * len(table) - 1)
        for batch in batches:
            ids, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, count, data, offs in text_slices(batch, "text"):
                words, at = plain_words(data, offs)
                out = []
                for size in (n, *shorts):
                    grams = gram_hashes(words, size, salt=int(size != n))
                    slot = (grams & mask).astype(np.int64)
                    hit = np.flatnonzero(table[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
                    doc = np.searchsorted(at, hit, side="right") - 1
                    inside = hit + size <= at[doc + 1]
                    out.append((doc[inside], hit[inside], grams[hit[inside]]))
                doc, hit, gram = (np.concatenate(x) for x in zip(*out))
                if not len(hit):
                    continue
                order = np.argsort(hit, kind="stable")
                doc, hit, gram = doc[order], hit[order], gram[order]
                cut = np.flatnonzero((np.diff(doc) != 0) | (np.diff(hit) > 2 * reach)) + 1
                rows = []
                for a, b in zip(np.concatenate([[0], cut]).tolist(), np.concatenate([cut, [len(hit)]]).tolist()):
                    d = int(doc[a])
                    lo, hi = max(int(at[d]), int(hit[a]) - reach), min(int(at[d + 1]), int(hit[b - 1]) + n + reach)
                    rows.append((ids[first + d], hashes[first + d], lo - int(at[d]), (words[lo:hi] & np.uint64(0x7FFFFFFF)).astype(np.int32), np.unique(gram[a:b]).view(np.int64)))
                flat = lambda k, t: pa.ListArray.from_arrays(np.cumsum([0] + [len(r[k]) for r in rows]).astype(np.int32), pa.array(np.concatenate([r[k] for r in rows]), t))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), flat(3, pa.int32()), flat(4, pa.int64())],
                    names=["doc_id", "text_hash", "start", "words", "grams"],
                )

    return run


def align(items, regions, match=2, other=-1, gap=-1):
    """Smith-Waterman of item k against region k: (best scores, ends in item, ends in region).

    All pairs advance together, an item word at a time; a row's gaps along the region are
    a running maximum.
    """
    count, rows, cols = len(items), max(map(len, items)), max(map(len, regions))
    a, b = np.full((count, rows), -1, np.int64), np.full((count, cols), -2, np.int64)
    for k, (x, y) in enumerate(zip(items, regions)):
        a[k, : len(x)], b[k, : len(y)] = x, y
    slope = -gap * np.arange(cols + 1, dtype=np.int32)
    last = np.zeros((count, cols + 1), np.int32)
    best, row, col = np.zeros(count, np.int32), np.zeros(count, np.int64), np.zeros(count, np.int64)
    for i in range(rows):
        now = np.zeros_like(last)
        step = np.where(a[:, i : i + 1] == b, match, other).astype(np.int32)
        np.maximum(last[:, :-1] + step, last[:, 1:] + gap, out=now[:, 1:])
        np.maximum(now, 0, out=now)
        now = np.maximum.accumulate(now + slope, axis=1) - slope
        end = now.argmax(axis=1)
        top = now[np.arange(count), end]
        better = top > best
        best[better], row[better], col[better] = top[better], i, end[better] - 1
        last = now
    return best, row, col


def _score(least):
    def run(batches):
        for batch in batches:
            ids, hashes, starts, item_ids = (batch.column(k).to_pylist() for k in range(4))
            items, regions = ([np.asarray(x.values) for x in batch.column(k)] for k in (4, 5))
            order = sorted(range(len(ids)), key=lambda k: (len(regions[k]), len(items[k])))
            found = []
            while order:
                size = 1
                while size < len(order) and size < 512 and (size + 1) * len(regions[order[size]]) <= 1 << 20:
                    size += 1
                group, order = order[:size], order[size:]
                x, y = [items[k] for k in group], [regions[k] for k in group]
                best, row, col = align(x, y)
                good = [j for j in range(size) if best[j] >= least * 2 * len(x[j])]
                if good:  # where they begin: the same from the end backwards
                    _, _, back = align([x[j][row[j] :: -1] for j in good], [y[j][col[j] :: -1] for j in good])
                    for j, r in zip(good, back.tolist()):
                        k, e = group[j], int(col[j])
                        found.append((ids[k], hashes[k], item_ids[k], int(best[j]), float(best[j]) / (2 * len(x[j])), starts[k] + e - r, starts[k] + e + 1))
            if found:
                kinds = [pa.int64()] * 4 + [pa.float64()] + [pa.int64()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names=["doc_id", "text_hash", "item_id", "score", "share", "word_start", "word_end"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 3, least: float = 0.5) -> DataFrame:
    """(doc_id, text_hash, item_id, score, share, word_start, word_end) of every leak.

    What is broadcast is a bitmap of 16 bits an n-gram of the benchmark, 2**22 to 2**27 (16 MB);
    a fuller one only lets more regions through to the joins.  The
    joins on n-grams are ordinary ones, whose side Spark may broadcast by its size.
    """
    spark = docs.sparkSession
    tune(spark)
    items = stored(
        benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.lower(F.col("text").cast("string")).alias("text")).dropDuplicates()
        .mapInArrow(_items(n), "item_id long, item_words array<long>, grams array<long>")
        .where("size(grams) > 0").withColumn("item_key", F.monotonically_increasing_id()),
        "benchmark",
    )
    grams = items.select("item_key", F.posexplode("grams").alias("place", "gram"))
    reach, shorts = items.agg(F.max(F.size("item_words")), F.sort_array(F.collect_set(F.expr(f"if(size(item_words) < {n}, size(item_words), null)")))).first()
    width = min(max(BITS, int(grams.count() * 16).bit_length()), MOST_BITS)
    bits = np.zeros(1 << width, bool)
    # a word of 63 marks a row: at most 2**27 / 63 numbers
    marked = grams.select(F.expr(f"(gram & {(1 << width) - 1}L) div 63").alias("word"), F.expr(f"shiftleft(1L, int((gram & {(1 << width) - 1}L) % 63))").alias("mark"))
    for batch in marked.groupBy("word").agg(F.bit_or("mark").alias("marks")).toArrow().to_batches():
        word, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for k in range(63):
            bits[word[(marks >> k) & 1 == 1] * 63 + k] = True
    bitmap = spark.sparkContext.broadcast(np.packbits(bits, bitorder="little").tobytes())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.lower(F.col("text").cast("string")).alias("text"))
    regions = stored(
        rows.mapInArrow(_regions(n, bitmap, int(reach or 0), list(shorts or [])), "doc_id long, text_hash long, start long, words array<int>, grams array<long>")
        .withColumn("region", F.monotonically_increasing_id()),
        "benchmark-regions",
    )
    hits = regions.select("region", "text_hash", "doc_id", F.explode("grams").alias("gram"))
    frequency = hits.groupBy("gram").agg(F.approx_count_distinct(F.struct("doc_id", "text_hash"), 0.02).alias("df"))
    ranked = grams.dropDuplicates(["item_key", "gram"]).join(frequency, "gram", "left").withColumns({
        "rank": F.row_number().over(Window.partitionBy("item_key").orderBy("df", "place")),
        "all": F.count("*").over(Window.partitionBy("item_key")),
    })
    alone = math.floor(n / least) - n + 1  # n-grams of the longest item that one of them alone may give away
    rare = RARE + rows.count() // ONE_IN
    chosen = ranked.select("gram", "item_key", F.expr(f"df <= {rare} or 2 * rank <= all or all <= {alone}").alias("seed"))
    pairs = (
        hits.select("region", "gram").join(chosen, "gram").groupBy("region", "item_key").agg(F.max("seed").alias("seed"), F.count("*").alias("n"))
        .where("seed or n > 1").select("region", "item_key")
    )
    compared = (
        pairs.join(items.select("item_key", "item_id", "item_words"), "item_key")
        .join(regions.select("region", "doc_id", "text_hash", "start", "words"), "region")
        .select("doc_id", "text_hash", "start", "item_id", "item_words", "words")
    )
    schema = "doc_id long, text_hash long, item_id long, score long, share double, word_start long, word_end long"
    found = compared.mapInArrow(_score(least), schema)
    key = ["doc_id", "text_hash", "item_id"]
    best = F.max_by(F.struct("score", "share", "word_start", "word_end"), F.struct("score", -F.col("word_start"))).alias("b")
    return found.groupBy(*key).agg(best).select(*key, "b.*")


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` into which no benchmark item leaks."""
    bad = contaminated(docs, benchmark, **options).select(F.col("doc_id").alias("_bad"), F.col("text_hash").alias("_bad_hash")).distinct()
    return docs.join(bad, docs.doc_id.eqNullSafe(bad._bad) & (F.xxhash64(docs.text) == bad._bad_hash), "left_anti")


def op1_decontaminate(spark, sf_dir):
    found = contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.drop("text_hash")
