"""Toxicity by a chain of linear classifiers.

Categories are predicted one after another; each model sees the words of the text and the
probabilities of the categories before it.  In training those are out-of-fold predictions,
so that a later model learns how far to trust the earlier ones.  A model is a logistic
regression on word presence weighted by the words' log-odds (both learned inside the fold).

Training takes at most ``sample`` labelled documents, those with the least hash of doc_id;
everything is scored.  Edge cases: null or empty texts get the models' priors; labels that
are null are left out of their category; a category with one class only gives that class's
rate to all; repeated rows are scored alike; a doc_id with several texts has each scored,
and in training stands for one of them, whichever order they come in; extra columns are ignored;
without labelled documents every probability is 0.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._store import tune
from ._text import text_slices
from .decontaminate import plain_words

BITS = 18
#: category -> SQL for its label; the order is the chain's
CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}
SAMPLE, FOLDS, KEEP, STEPS = 8000, 3, 20000, 80


def buckets(data, offs):
    """(document number, word bucket): each document's distinct hashed words."""
    words, at = plain_words(data, offs)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(at)).astype(np.uint64)
    both = np.unique((doc << np.uint64(BITS)) | (words >> np.uint64(64 - BITS)))
    return (both >> np.uint64(BITS)).astype(np.int64), (both & np.uint64((1 << BITS) - 1)).astype(np.int64)


def _bucket_lists(batches):
    for batch in batches:
        for first, count, data, offs in text_slices(batch, "text"):
            doc, word = buckets(data, offs)
            at = np.searchsorted(doc, np.arange(count + 1)).astype(np.int32)
            rest = [batch.column(k).slice(first, count) for k in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*rest, pa.ListArray.from_arrays(at, pa.array(word.astype(np.int32)))], names=[*batch.schema.names[1:], "words"])


class Linear:
    """Logistic regression on weighted word presence and a few dense columns."""

    def __init__(self, words, dense, bias):
        self.words, self.dense, self.bias = words, dense, bias

    @classmethod
    def fit(cls, rows, lengths, dense, y, steps=STEPS, penalty=1.0):
        """``rows``: all documents' word buckets in a row, ``lengths`` of each."""
        n, doc = len(y), np.repeat(np.arange(len(y)), lengths)
        rate = (y.sum() + 0.5) / (n + 1)
        if n == 0 or y.min() == y.max():
            return cls(np.zeros(1 << BITS, np.float32), np.zeros(dense.shape[1]), float(np.log(rate / (1 - rate))))
        yes, no = np.bincount(rows, weights=y[doc], minlength=1 << BITS), np.bincount(rows, weights=1 - y[doc], minlength=1 << BITS)
        odds = np.log((yes + 0.5) / (y.sum() + 1)) - np.log((no + 0.5) / (n - y.sum() + 1))
        odds[yes + no < 4] = 0
        strength = np.abs(odds) * np.sqrt(yes + no)
        floor = np.partition(strength, -KEEP)[-KEEP]
        odds[strength <= max(floor, 0)] = 0
        used = odds[rows] != 0
        rows, doc = rows[used], doc[used]
        x, at = odds[rows], np.searchsorted(doc, np.arange(n + 1))
        w, d, b = np.full(1 << BITS, 0.1), np.zeros(dense.shape[1]), float(np.log(rate / (1 - rate)))
        moment = [np.zeros_like(w), np.zeros_like(d), 0.0]
        square = [np.zeros_like(w), np.zeros_like(d), 0.0]
        sums = np.zeros(len(x) + 1)
        for t in range(1, steps + 1):
            np.cumsum(x * w[rows], out=sums[1:])
            z = sums[at[1:]] - sums[at[:-1]] + dense @ d + b
            miss = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
            slopes = (np.bincount(rows, weights=x * miss[doc], minlength=1 << BITS) + penalty * w * (odds != 0), dense.T @ miss + penalty * d, miss.sum())
            step = []
            for k, g in enumerate(slopes):
                moment[k] = 0.9 * moment[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                step.append(0.05 * (moment[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.99**t)) + 1e-8))
            w, d, b = w - step[0], d - step[1], b - step[2]
        return cls((w * odds).astype(np.float32), d, float(b))

    def predict(self, doc, word, count, dense):
        z = np.bincount(doc, weights=self.words[word], minlength=count) + dense @ self.dense + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit_chain(rows, lengths, labels, ids, folds=FOLDS):
    """[(model, threshold)] of the chain; ``labels``: a float column per category, NaN where unknown.

    A threshold is the one with the best F1 on the out-of-fold predictions, and at least 0.5.
    """
    n = len(lengths)
    at = np.concatenate([[0], np.cumsum(lengths)])
    fold = np.array([(int(i) * 2654435761 % (1 << 32)) * folds >> 32 for i in ids], np.int64) if n else np.zeros(0, np.int64)
    take = lambda m: (np.concatenate([rows[at[i] : at[i + 1]] for i in np.flatnonzero(m)] or [rows[:0]]), lengths[m])
    dense, chain = np.zeros((n, 0)), []
    for y in labels.T:
        known, held = ~np.isnan(y), np.zeros(n)
        for f in range(folds):
            train, test = known & (fold != f), fold == f
            model = Linear.fit(*take(train), dense[train], y[train])
            word, size = take(test)
            held[test] = model.predict(np.repeat(np.arange(len(size)), size), word, len(size), dense[test])
        model = Linear.fit(*take(known), dense[known], y[known])
        order = np.argsort(-held[known], kind="stable")
        hits, p = np.cumsum(y[known][order]), held[known][order]
        f1 = 2 * hits / (np.arange(1, len(hits) + 1) + max(hits[-1], 1)) if len(hits) else np.zeros(0)
        chain.append((model, max(0.5, float(p[f1.argmax()])) if len(f1) else 0.5))
        dense = np.column_stack([dense, logit(held)])
    return chain


def _score(chain):
    def run(batches):
        models = chain.value
        for batch in batches:
            ids = batch.column(1)
            for first, count, data, offs in text_slices(batch, "text"):
                doc, word = buckets(data, offs)
                dense, columns = np.zeros((count, 0)), []
                for words, weights, bias, least in models:
                    p = Linear(words, weights, bias).predict(doc, word, count, dense)
                    columns += [pa.array(np.round(p, 6)), pa.array(p >= least)]
                    dense = np.column_stack([dense, logit(p)])
                yield pa.RecordBatch.from_arrays([ids.slice(first, count).cast(pa.int64()), *columns], names=["doc_id"] + [f"c{k}" for k in range(len(columns))])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, categories=None, sample: int = SAMPLE) -> DataFrame:
    """doc_id, and for each category p_<name> and <name>, for every document."""
    categories = categories or CATEGORIES
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(*[F.max(F.expr(f"double({e})")).alias(c) for c, e in categories.items()])
    some = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # a bounded table: it may be broadcast
    schema = "doc_id long, " + ", ".join(f"{c} double" for c in categories) + ", words array<int>"
    # a doc_id with several texts learns from the one whose words are least
    found = rows.join(F.broadcast(some), "doc_id").select("text", "doc_id", *categories).mapInArrow(_bucket_lists, schema)
    train = found.groupBy("doc_id").agg(*[F.first(c).alias(c) for c in categories], F.min("words").alias("words")).toArrow()
    words = train.column("words").combine_chunks()
    lengths = np.array([len(x) for x in words], np.int64)
    flat = np.asarray(words.values if not isinstance(words, pa.ChunkedArray) else words.combine_chunks().values).astype(np.int64)
    order = np.argsort(np.asarray(train.column("doc_id")), kind="stable")
    at = np.concatenate([[0], np.cumsum(lengths)])
    flat = np.concatenate([flat[at[i] : at[i + 1]] for i in order] or [flat[:0]])
    marked = np.column_stack([train.column(c).to_numpy() for c in categories]) if len(order) else np.zeros((0, len(categories)))
    if len(order):
        chain = fit_chain(flat, lengths[order], marked[order].astype(float), np.asarray(train.column("doc_id"))[order])
    else:
        chain = [(Linear(np.zeros(1 << BITS, np.float32), np.zeros(k), -30.0), 0.5) for k in range(len(categories))]
    models = spark.sparkContext.broadcast([(m.words, m.dense, m.bias, t) for m, t in chain])  # 2**18 weights a category
    names = [x for c in categories for x in (f"p_{c}", c)]
    found = rows.mapInArrow(_score(models), "doc_id long, " + ", ".join(f"c{k} {'boolean' if k % 2 else 'double'}" for k in range(len(names))))
    return found.toDF("doc_id", *names)


def op8_toxicity(spark, sf_dir):
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
