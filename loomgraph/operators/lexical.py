"""Lexical retrieval: tokenizer, postings and BM25."""

from pyspark.sql import Column, DataFrame, functions as F

K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and decimal digits of two bytes at least, in order."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[\\p{L}\\p{Nd}]+"), F.lit(0))
    return F.filter(found, lambda t: F.octet_length(t) >= 2)


def postings(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(term, doc, tf) and the document's length dl."""
    rows = docs.select(F.col(id_col).alias("doc"), tokens(F.col(text_col)).alias("ts"))
    terms = rows.select("doc", F.size("ts").cast("long").alias("dl"), F.explode("ts").alias("term"))
    return terms.groupBy("doc", "term", "dl").agg(F.count("*").alias("tf"))


def _wanted(queries: DataFrame) -> DataFrame:
    """(qid, term, qtf): a term that a query repeats counts as often."""
    return queries.select("qid", F.explode(tokens(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))


def scores(tf: DataFrame, wanted: DataFrame, size: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(qid, doc, score) of ``tf(term, doc, tf, dl)``, the whole postings of ``wanted(qid, term, qtf)``; ``size(n_docs, avgdl)`` is one row.

    k1 < 0 and b outside 0..1 mean the defaults.
    """
    k1, b = (k1 if k1 >= 0 else K1), (b if 0 <= b <= 1 else B)
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.expr(f"ln((n_docs - df + 0.5) / (df + 0.5) + 1) * (tf * ({k1} + 1)) / (tf + {k1} * (1 - {b} + {b} * dl / avgdl))")
    return tf.join(df, "term").crossJoin(size).join(wanted, "term").groupBy("qid", "doc").agg(F.sum(weight * F.col("qtf")).alias("score"))


def best(scored: DataFrame, k: int | None) -> DataFrame:
    """The k best documents of each query with their rank; None: all, without a rank."""
    return scored if k is None else top_per(scored, "qid", [F.round("score", 9).desc(), F.col("doc")], k)


def bm25(docs: DataFrame, queries: DataFrame, k: int | None, id_col: str = "id", text_col: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """(qid, doc, score, rank): the best k documents of each of ``queries(qid, text)``, from the texts.

    Only the queries' terms leave the scan: the counts are aggregated before anything is
    shuffled.  For more than one search of the same documents, see ``lexicalindex.Index``.
    """
    wanted = _wanted(queries)
    rows = docs.select(F.col(id_col).alias("doc"), tokens(F.col(text_col)).alias("ts")).withColumn("dl", F.size("ts").cast("long"))
    size = rows.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    hits = rows.select("doc", "dl", F.explode("ts").alias("term")).join(wanted.select("term").distinct(), "term", "left_semi")
    tf = hits.groupBy("doc", "dl", "term").agg(F.count("*").alias("tf"))
    return best(scores(tf, wanted, size, k1, b), k)


def top_per(df: DataFrame, key, order, k: int) -> DataFrame:
    """The first k rows of each key in ``order``, with their ``rank``."""
    from pyspark.sql import Window

    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long")).where(F.col("rank") <= k)
