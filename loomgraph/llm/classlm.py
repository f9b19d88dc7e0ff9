"""Brown class-based n-gram language model by exchange clustering.

    P(w | v) = P(class(w) | class(v)) * P(w | class(w))

Every word of the training texts has a class.  Head words, those with at least ``HEAD`` of
the tokens and ``LEAST`` occurrences, are assigned by exchange clustering: a word moves to the
class that raises the class-bigram likelihood most, half the words at a time, so that
neighbours don't swap past each other; half a sweep that doesn't raise the likelihood is
undone, and sweeps end when the likelihood hardly rises any more.  A tail word then goes to
the class that raises it most to first order, given the classes around its occurrences.  As
history, every word with ``FREQUENT`` of the tokens stands for its class, exchanged or put there;
the rest are one class.  Each tail word's count is discounted by ``DISCOUNT``; what
that frees is the class of words unseen in training, taken to be as many as the seen ones.
Transitions are smoothed towards the class frequencies.

What reaches every task is bounded whatever the corpus: at most 1 / HEAD words can have HEAD of
all tokens, and 1 / FREQUENT words FREQUENT.  Counts and classes of all other words stay in
tables, which grow with the corpus and are joined.

Tokens are a text's words, A-Z folded, then one end mark, named by 96 bits of two unrelated
hashes.  Edge cases: a null or empty text is its end mark; a null doc_id counts as the empty
text in the split; rows with equal doc_ids are scored each; extra columns are ignored;
without training texts every count is 0; an empty table gives no rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._store import drop, stored, tune
from ._text import distinct_names, text_slices, word_hashes

END, END_CHECK = np.uint64(0x2E5D0C4B1A697887), np.uint64(0x5DEECE66)
FREQUENT, HEAD, LEAST, CLASSES, KAPPA, DISCOUNT = 1e-6, 1e-5, 5, 64, 5.0, 0.5
#: half sweeps end when two in a row add less than this share of the whole rise
RISE = 0.01
#: classes of the end mark, and, as history, of words below FREQUENT, or, as the next word's, of unseen ones
END_CLASS, RARE_CLASS = 0, 1


def token_names(data, offs):
    """(hash, check, first token of each text): words and an end mark after each text; a check has 31 bits."""
    words, checks, _, _, first = word_hashes(data, offs, both=True)
    ends = first[1:]
    return np.insert(words, ends, END), np.insert(checks >> np.uint64(33), ends, END_CHECK), first + np.arange(len(first))


def _signed(x):
    return x.view(np.int64)


class _Tally:
    """Counts of names, merged until they are many."""

    def __init__(self, most=400_000):
        self.most, self.parts, self.size = most, [], 0

    def add(self, first, second, counts=None):
        u, v, _, which = distinct_names(first, second)
        self.parts.append((u, v, np.bincount(which, weights=counts, minlength=len(u)).astype(np.int64)))
        self.size += len(u)
        if self.size > self.most:
            self.merge()
            if self.size > self.most // 2:
                yield from self.flush()

    def merge(self):
        if len(self.parts) > 1:
            first, second, counts = (np.concatenate(x) for x in zip(*self.parts))
            u, v, _, which = distinct_names(first, second)
            self.parts = [(u, v, np.bincount(which, weights=counts, minlength=len(u)).astype(np.int64))]
            self.size = len(u)

    def flush(self):
        self.merge()
        if self.parts:
            u, v, n = self.parts[0]
            yield pa.RecordBatch.from_arrays([pa.array(_signed(u)), pa.array(v.astype(np.int32)), pa.array(n)], names=["key", "check", "n"])
        self.parts, self.size = [], 0


class _KeyTally(_Tally):
    """Counts of 64-bit numbers."""

    def add(self, keys, counts=None):
        yield from super().add(keys.astype(np.uint64), np.zeros(len(keys), np.uint64), counts)

    def flush(self):
        for batch in super().flush():
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], names=["key", "n"])


def _count_words(batches):
    tally = _Tally()
    for batch in batches:
        for _, _, data, offs in text_slices(batch, "text"):
            yield from tally.add(*token_names(data, offs)[:2])
    yield from tally.flush()


def lookup(table, checks, first, second):
    """Place of each name in a table sorted by its distinct first halves, or -1."""
    if not len(table):
        return np.full(len(first), -1, np.int64)
    at = np.minimum(np.searchsorted(table, first), len(table) - 1)
    return np.where((table[at] == first) & (checks[at] == second), at, -1)


def _symbols(tokens, checks, head):
    """Numbers of the tokens: 0 end mark, 1 tail word, others head words by frequency."""
    words, seconds, ranks = head
    at = lookup(words, seconds, tokens, checks)
    found = np.where(at < 0, 1, ranks[at] + 2) if len(words) else np.ones(len(tokens), np.int64)
    return np.where((tokens == END) & (checks == END_CHECK), 0, found)


def _after(symbols):
    """What stands before each token; a text begins after an end."""
    before = np.zeros(len(symbols), np.int64)
    before[1:] = symbols[:-1]
    return before


def _count_pairs(head):
    def run(batches):
        words, tally = head.value, _KeyTally()
        m = len(words[0]) + 2
        for batch in batches:
            for _, _, data, offs in text_slices(batch, "text"):
                tokens, checks, _ = token_names(data, offs)
                sym = _symbols(tokens, checks, words)
                yield from tally.add(_after(sym) * m + sym)
        yield from tally.flush()

    return run


def _contexts(classes):
    """(symbol * 2C + slot, n): slot c < C is a next word of class c, C + c a previous one."""

    def run(batches):
        of, tally = classes.value, _KeyTally()
        m = len(of)
        for batch in batches:
            keys, n = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            a, b = keys // m, keys % m
            yield from tally.add(np.concatenate([a * (2 * CLASSES) + of[b], b * (2 * CLASSES) + CLASSES + of[a]]), np.concatenate([n, n]))
        yield from tally.flush()

    return run


def _class_table(classes):
    def run(batches):
        of, out = classes.value, np.zeros(CLASSES * CLASSES)
        for batch in batches:
            keys, n = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            a, b = keys // len(of), keys % len(of)
            out += np.bincount(of[a] * CLASSES + of[b], weights=n, minlength=CLASSES * CLASSES)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at].astype(np.int64))], names=["key", "n"])

    return run


def _likelihood(table):
    """Class-bigram log likelihood, but for a constant."""
    return _x_log_x(table).sum() - _x_log_x(table.sum(0)).sum() - _x_log_x(table.sum(1)).sum()


def _x_log_x(x):
    return x * np.log(np.maximum(x, 1))


def exchange(right, left, own, table):
    """The best class of each word and its gain, all words judged against the same class table.

    ``right``/``left``: counts of the word's next/previous classes, ``own``: its class now.
    """
    rows, cols = table.sum(1), table.sum(0)
    base = _x_log_x(table)
    ends = _x_log_x(rows) + _x_log_x(cols)
    n_right, n_left = right.sum(1), left.sum(1)
    put = np.zeros((len(own), CLASSES))
    for k in range(len(own)):
        d, c = np.flatnonzero(right[k]), np.flatnonzero(left[k])
        put[k] = (_x_log_x(table[:, d] + right[k, d]) - base[:, d]).sum(1) + (_x_log_x(table[c] + left[k, c, None]) - base[c]).sum(0)
        put[k] -= _x_log_x(rows + n_right[k]) + _x_log_x(cols + n_left[k]) - ends
        a = own[k]
        stay = (base[a, d] - _x_log_x(np.maximum(table[a, d] - right[k, d], 0))).sum() + (base[c, a] - _x_log_x(np.maximum(table[c, a] - left[k, c], 0))).sum()
        put[k, a] = stay - (ends[a] - _x_log_x(np.maximum(rows[a] - n_right[k], 0)) - _x_log_x(np.maximum(cols[a] - n_left[k], 0)))
    put[:, :2] = -np.inf
    best = put.argmax(1)
    return best, put[np.arange(len(own)), best] - put[np.arange(len(own)), own]


def _moves(classes, table, sweep):
    def run(batches):
        of, counts = classes.value, table.value
        for batch in batches:
            symbols = np.asarray(batch.column(0))
            inner = batch.column(1)
            lengths = np.diff(np.asarray(inner.offsets))
            slots, n = (np.asarray(inner.flatten().field(k)) for k in (0, 1))
            vectors = np.zeros((len(symbols), 2 * CLASSES))
            vectors[np.repeat(np.arange(len(symbols)), lengths), slots] = n
            mine = (symbols >= 2) & ((symbols * 2654435761 >> 7) % 2 == sweep % 2)
            best, gain = exchange(vectors[mine, :CLASSES], vectors[mine, CLASSES:], of[symbols[mine]], counts)
            go = gain > 1e-6
            yield pa.RecordBatch.from_arrays([pa.array(symbols[mine][go]), pa.array(best[go])], names=["symbol", "class"])

    return run


def cluster(pairs: DataFrame, size: int):
    """(class of each symbol, class-bigram table) after exchange sweeps over ``pairs(key, n)``."""
    spark = pairs.sparkSession

    def table(of):
        classes = spark.sparkContext.broadcast(of)
        out = np.zeros(CLASSES * CLASSES)
        found = pairs.mapInArrow(_class_table(classes), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()  # C * C rows at most
        out[np.asarray(found.column(0))] = np.asarray(found.column(1))
        return classes, out.reshape(CLASSES, CLASSES)

    of = np.concatenate([[END_CLASS, RARE_CLASS], 2 + np.arange(size) % (CLASSES - 2)]).astype(np.int64)
    classes, counts = table(of)
    begin = now = _likelihood(counts)
    still = half = 0
    while size and still < 2:
        near = pairs.mapInArrow(_contexts(classes), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        near = near.groupBy(F.expr(f"key div {2 * CLASSES}").alias("symbol")).agg(F.collect_list(F.struct(F.expr(f"key % {2 * CLASSES}").alias("slot"), "n")).alias("at"))
        moved = near.mapInArrow(_moves(classes, spark.sparkContext.broadcast(counts), half), "symbol long, class long").toArrow()  # 1 / HEAD rows at most
        trial = of.copy()
        trial[np.asarray(moved.column(0))] = np.asarray(moved.column(1))
        half += 1
        following = table(trial) if moved.num_rows else (classes, counts)
        after = _likelihood(following[1])
        still = 0 if after - now > RISE * (after - begin) else still + 1
        if after > now:
            of, now, (classes, counts) = trial, after, following
    return of, counts


def _tail_contexts(model):
    """(key, around, n) of tail words: the classes before and after an occurrence, packed."""

    def run(batches):
        head, of = model.value
        for batch in batches:
            for _, _, data, offs in text_slices(batch, "text"):
                tokens, checks, _ = token_names(data, offs)
                sym = _symbols(tokens, checks, head)
                cls = of[sym]
                rare = np.flatnonzero(sym == 1)
                around = _after(cls)[rare] * CLASSES + cls[rare + 1]  # an end follows every text
                key, _, where, which = distinct_names(tokens[rare] + around.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), tokens[rare])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_signed(tokens[rare][where])), pa.array(around[where].astype(np.int32)), pa.array(np.bincount(which, minlength=len(key)))], names=["key", "around", "n"]
                )

    return run


def _assign(table):
    """(key, class, 0) of each tail word; at a task's end, (history * C + class, -1, discounted count)."""

    def run(batches):
        counts = table.value
        flat = 0.5
        log = np.log(counts + flat)
        rows, cols = np.log(counts.sum(1) + flat * CLASSES), np.log(counts.sum(0) + flat * CLASSES)
        total = np.zeros((CLASSES, CLASSES))
        for batch in batches:
            keys, lists = batch.column(0), batch.column(1)
            lengths = np.diff(np.asarray(lists.offsets))
            around, n = (np.asarray(lists.flatten().field(k)).astype(np.int64) for k in (0, 1))
            word = np.repeat(np.arange(len(lengths)), lengths)
            left, right = (np.bincount(word * CLASSES + c, weights=n, minlength=len(lengths) * CLASSES).reshape(-1, CLASSES) for c in (around // CLASSES, around % CLASSES))
            size = left.sum(1)
            put = left @ log + right @ log.T - size[:, None] * (rows + cols)
            put[:, :2] = -np.inf
            best = put.argmax(1)
            share = (DISCOUNT / size)[:, None]
            np.add.at(total.T, best, left * (1 - share))
            total[:, RARE_CLASS] += (left * share).sum(0)
            yield pa.RecordBatch.from_arrays([keys, pa.array(best.astype(np.int32)), pa.array(np.zeros(len(best)))], names=["key", "class", "n"])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(len(at), -1, np.int32)), pa.array(total.ravel()[at])], names=["key", "class", "n"])

    return run


def _score(model):
    def run(batches):
        m = model.value
        words, checks, history, chosen, transition, emission = (m[k] for k in ("words", "checks", "history", "chosen", "transition", "emission"))
        shift = m["base_shift"]
        log_counts = np.log10(m["counts"] + 0.5)
        end_base = np.log10(m["ends"] + 0.5) - shift
        for batch in batches:
            meta = [batch.column(k) for k in (1, 2)]
            for first, count, data, offs in text_slices(batch, "text"):
                tokens, seconds, at = token_names(data, offs)
                place, is_end = lookup(words, checks, tokens, seconds), (tokens == END) & (seconds == END_CHECK)
                known = (place >= 0) & ~is_end
                seen = place[known]
                before, into = np.full(len(tokens), RARE_CLASS), np.zeros(len(tokens), np.int64)
                before[is_end], before[known], into[known] = END_CLASS, history[seen], chosen[seen]
                before = _after(before)
                base, emit = np.full(len(tokens), -shift), np.zeros(len(tokens))
                base[known] += log_counts[seen]
                emit[known] = emission[seen]
                base[is_end] = end_base
                score = transition[before, into] + emit
                rest = np.flatnonzero(~known & ~is_end)  # scored by a join
                score[rest] = 0.0
                doc = np.searchsorted(at, rest, side="right") - 1
                # one row for each text, word and history class
                order = np.lexsort((before[rest], seconds[rest], tokens[rest], doc))
                rest, d = rest[order], doc[order]
                w, v, h = tokens[rest], seconds[rest], before[rest]
                new = np.ones(len(w), bool)
                new[1:] = (w[1:] != w[:-1]) | (v[1:] != v[:-1]) | (d[1:] != d[:-1]) | (h[1:] != h[:-1])
                begin = np.flatnonzero(new)
                lists = np.searchsorted(d[begin], np.arange(count + 1)).astype(np.int32)
                sums = lambda x: pa.array(np.add.reduceat(x, at[:-1]) if count else x)
                yield pa.RecordBatch.from_arrays(
                    [
                        meta[0].slice(first, count), meta[1].slice(first, count), pa.array(np.diff(at)), sums((known | (is_end & (m["ends"] > 0))).astype(np.int64)), sums(base), sums(score),
                        pa.ListArray.from_arrays(lists, pa.array(_signed(w[begin]))), pa.ListArray.from_arrays(lists, pa.array(v[begin].astype(np.int32))),
                        pa.ListArray.from_arrays(lists, pa.array(np.diff(np.append(begin, len(w))) * CLASSES + h[begin])),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare", "rare_check", "rare_n"],
                )

    return run


def fit(training: DataFrame) -> dict:
    """The model of ``training(text)``: arrays of bounded size, and ``known(key, check, n, class)``, the table of tail words."""
    spark = training.sparkSession
    send = spark.sparkContext.broadcast
    counts = stored(training.mapInArrow(_count_words, "key long, check int, n long").groupBy("key", "check").agg(F.sum("n").alias("n")), "lm-counts")
    is_end = f"key = {END}L and check = {END_CHECK}"
    total, types, ends = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.expr(f"if({is_end}, n, 0)")), F.lit(0))).first()
    often = max(FREQUENT * total, 2)
    frequent = counts.where((F.col("n") >= often) & F.expr(f"not ({is_end})")).toArrow()  # 1 / FREQUENT rows at most
    words, checks, number = (np.asarray(frequent.column(k)) for k in range(3))
    words = words.view(np.uint64)
    order = np.argsort(words, kind="stable")
    words, checks, number = words[order], checks[order].astype(np.uint64), number[order]
    alone = np.ones(len(words), bool)  # words that share a first half are left to the join
    alone[1:] &= words[1:] != words[:-1]
    alone[:-1] &= words[1:] != words[:-1]
    words, checks, number = words[alone], checks[alone], number[alone]
    big = number >= max(HEAD * total, LEAST)
    order = np.argsort(-number[big], kind="stable")  # classes begin dealt by frequency
    dealt = np.empty(len(order), np.int64)
    dealt[order] = np.arange(len(order))
    head = send((words[big], checks[big], dealt))
    pairs = stored(training.mapInArrow(_count_pairs(head), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "lm-pairs")
    of, table = cluster(pairs, len(dealt))
    drop(pairs)
    # one shuffle, by word: the sums by word and context, and the lists by word, keep it; a tail word is no hot key
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    around = (
        training.mapInArrow(_tail_contexts(send((head.value, of))), "key long, around int, n long").repartition(parts, "key")
        .groupBy("key", "around").agg(F.sum("n").alias("n")).groupBy("key").agg(F.collect_list(F.struct("around", "n")).alias("at"))
    )
    assigned = stored(around.mapInArrow(_assign(send(table)), "key long, class int, n double"), "lm-classes")
    tail = assigned.where("class < 0").groupBy("key").agg(F.sum("n").alias("n")).toArrow()  # C * C rows at most
    table = table.copy()
    table[:, RARE_CLASS] = 0
    table.ravel()[np.asarray(tail.column(0))] += np.asarray(tail.column(1))
    size = table.sum(0)
    prior = (size + 0.5) / (size.sum() + 0.5 * CLASSES)
    transition = np.log10((table + KAPPA * prior) / (table.sum(1, keepdims=True) + KAPPA))
    log_size = np.log10(np.maximum(size, DISCOUNT))
    log_size[RARE_CLASS] = np.log10(types + 1)  # as many unseen words as seen ones
    known = stored(counts.where(f"not ({is_end})").join(assigned.where("class >= 0").select("key", "class"), "key"), "lm-tails")
    drop(counts, assigned)
    # classes of the frequent words that aren't head words: 1 / FREQUENT rows at most
    more = known.where(F.col("n") >= often).select("key", "class").toArrow()
    keys = np.asarray(more.column(0)).view(np.uint64)
    chosen = np.full(len(words), RARE_CLASS)
    chosen[big] = of[2 + dealt]
    if len(words):
        at = np.minimum(np.searchsorted(words, keys), len(words) - 1)
        hit = words[at] == keys
        chosen[at[hit]] = np.asarray(more.column(1))[hit]
    return {
        "words": words, "checks": checks, "counts": number.astype(float), "history": chosen, "chosen": chosen, "transition": transition,
        "emission": np.log10(number - np.where(big, 0, DISCOUNT)) - log_size[chosen], "ends": ends, "base_shift": np.log10(total + 0.5 * (types + 1)),
        "log_size": log_size, "total": total, "types": types, "known": known,
    }


def score_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every text.

    Texts whose crc32(doc_id) mod 5 is 1 are held out, the model learns from the others.
    """
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select(
        F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"),
        (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1).alias("held_out"),
    )
    model = fit(rows.where("not held_out").select("text"))
    known, transition, log_size = model.pop("known"), model["transition"], model["log_size"]
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<long>, rare_check array<int>, rare_n array<long>"
    scored = stored(rows.mapInArrow(_score(spark.sparkContext.broadcast(model)), schema).withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    each = scored.select("row", F.explode(F.arrays_zip("rare", "rare_check", "rare_n")).alias("r")).select(
        "row", F.col("r.rare").alias("key"), F.col("r.rare_check").alias("check"), F.expr(f"int(r.rare_n % {CLASSES})").alias("h"), F.expr(f"r.rare_n div {CLASSES}").alias("m")
    )
    steps = spark.createDataFrame(
        [(h, c, float(transition[h, c] - log_size[c])) for h in range(CLASSES) for c in range(CLASSES)], "h int, class int, step double"
    )  # C * C rows
    told = (
        each.join(known, ["key", "check"], "left").withColumn("class", F.coalesce("class", F.lit(RARE_CLASS))).join(F.broadcast(steps), ["h", "class"])
        .groupBy("row").agg(
            F.sum(F.expr("m * log10(coalesce(n, 0) + 0.5D)")).alias("rare_base"), F.sum(F.expr(f"m * (step + coalesce(log10(n - {DISCOUNT}D), 0D))")).alias("rare_score"),
            F.sum(F.expr("if(n > 0, m, 0)")).alias("rare_known"),
        )
    )
    return (
        scored.drop("rare", "rare_check", "rare_n").join(told, "row", "left")
        .select(
            "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(int(model["total"])).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("rare_score", F.lit(0.0))).alias("score"),
        )
        .withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
    )


def op3_class_lm(spark, sf_dir):
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
