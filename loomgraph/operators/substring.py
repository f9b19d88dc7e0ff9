"""Substring search by three-letter pieces: postings of pieces, the rarest of a pattern's joined, then checked.

A text that contains a pattern contains each of the pattern's pieces.  The rarest ``RARE`` of them are
equi-joined with the texts' pieces and the texts that have all of them are compared.  Patterns of
fewer letters have no piece and are compared with every text.  Case is not told apart.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.store import arrow, fresh, written
from .lexical import top_per

#: letters of a piece; pieces of a pattern that are looked up; most pieces that are given to a scan as literals
PIECE, RARE, LITERALS = 3, 4, 1000
#: tasks that share a common piece's postings
SHARES = 16


def pieces(text: Column) -> Column:
    """The distinct pieces of a lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"(?s)(?=(.{{{PIECE}}}))"), F.lit(1)))  # a look ahead from each letter: one pass


def _grouped(batches):
    """(piece, ids) of a batch of lower-cased texts (id, text): a piece's rows together, each once."""
    for batch in batches:
        texts = [t.decode("utf-8", "replace") for t in batch.column(1).cast(pa.binary()).to_pylist()]
        starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        letters = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        if not len(letters):
            continue
        alphabet = np.flatnonzero(np.bincount(letters))
        number = np.zeros(alphabet[-1] + 1, np.int64)
        number[alphabet] = np.arange(len(alphabet))
        letters, size = number[letters], len(alphabet)
        step = max(1, (2**63 - 1) // size**PIECE)  # rows whose pieces are numbers of 63 bits: nearly always all
        for at in range(0, len(texts), step):
            ends = starts[at : at + step + 1]
            own, n = letters[ends[0] : ends[-1]], len(ends) - 1
            if len(own) < PIECE:
                continue
            row = np.repeat(np.arange(n), np.diff(ends))
            code = np.zeros(len(own) - PIECE + 1, np.int64)
            for i in range(PIECE):
                code = code * size + own[i : len(code) + i]
            keys = np.sort((code * n + row[: len(code)])[row[: len(code)] == row[PIECE - 1 :]])  # none over a text's end
            code, row = np.divmod(keys[np.diff(keys, prepend=-1) > 0], n)
            new = np.flatnonzero(np.diff(code, prepend=-1))
            pieces = code[new]
            spelt = alphabet[np.stack([pieces // size**i % size for i in reversed(range(PIECE))], 1)].astype("<u4").tobytes().decode("utf-32-le")
            names = pa.array([spelt[i : i + PIECE] for i in range(0, len(spelt), PIECE)], pa.string())
            lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(code)).astype(np.int32)), batch.column(0).take(pa.array(at + row)))
            yield pa.RecordBatch.from_arrays([names, lists], names=["piece", "ids"])


def grouped(texts: DataFrame) -> DataFrame:
    """(piece, ids): the rows of lower-cased ``texts(id, text)`` that hold each piece, a batch's in one list."""
    rows = arrow(texts).select("id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_grouped, f"piece string, ids array<{texts.schema['id'].dataType.simpleString()}>")


def _wanted(patterns: DataFrame) -> DataFrame:
    return patterns.where("pattern is not null and pattern <> ''").select("qid", F.lower("pattern").alias("pattern"))


def _few(wanted: DataFrame, counts: DataFrame | None) -> DataFrame:
    """(qid, pattern, piece, looked_up): the pieces of each pattern that are looked up, rarest first where ``counts(piece, n)`` are known."""
    if counts is None:
        each = wanted.select("qid", "pattern", F.explode(pieces(F.col("pattern"))).alias("piece"))
        few = top_per(each, ["qid", "pattern"], [F.xxhash64("piece")], RARE)
    else:
        named = wanted.select(F.col("pattern").alias("id"), F.col("pattern").alias("text")).distinct()
        each = wanted.join(grouped(named).select("piece", F.explode("ids").alias("pattern")), "pattern")
        few = top_per(each.join(counts, "piece", "left"), ["qid", "pattern"], [F.coalesce("n", F.lit(0)), F.col("piece")], RARE)
    sizes = few.groupBy("qid", "pattern").agg(F.count("*").alias("looked_up"))
    return few.select("qid", "pattern", "piece").join(sizes, ["qid", "pattern"])


def _found(postings: DataFrame, few: DataFrame, texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Of lower-cased ``texts``."""
    hits = postings.join(few, "piece").groupBy("qid", "pattern", "id").agg(F.count("*").alias("n"), F.first("looked_up").alias("looked_up")).where("n >= looked_up")  # rows of one id count together; the check decides
    checked = hits.select("qid", "pattern", "id").join(texts, "id").where(F.contains("text", "pattern")).select("qid", "id")
    short = wanted.where(F.char_length("pattern") < PIECE)
    if short.isEmpty():
        return checked.distinct()
    return checked.union(texts.join(short, F.contains("text", "pattern")).select("qid", "id")).distinct()


def containing(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(qid, id): the rows of ``texts(id, text)`` that contain each of ``patterns(qid, pattern)``, without an index.

    For short texts, such as names: only pieces that some pattern has leave the scan.
    """
    wanted = _wanted(patterns)
    rows = texts.select("id", F.explode(pieces(F.col("text"))).alias("piece"))
    return _found(rows, _few(wanted, None), texts.select("id", F.lower("text").alias("text")), wanted)


class SubstringIndex:
    """Postings of pieces, dealt by piece and a few shares of it so that a common piece is many files' rows, beside the lower-cased texts."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, texts: DataFrame, path: str):
        spark, path = texts.sparkSession, path.rstrip("/")
        parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        texts.select("id", F.lower("text").alias("text")).repartitionByRange(parts, "id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{path}/texts")
        kept = spark.read.parquet(f"{path}/texts")
        share = F.pmod(F.xxhash64(F.element_at("ids", 1)), F.lit(SHARES))
        grouped(kept).repartition(parts, "piece", share).sortWithinPartitions("piece").write.mode("overwrite").parquet(f"{path}/postings")
        spark.read.parquet(f"{path}/postings").groupBy("piece").agg(F.sum(F.size("ids")).alias("n")).write.mode("overwrite").parquet(f"{path}/counts")
        return cls(spark, path)

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def containing(self, patterns: DataFrame) -> DataFrame:
        """(qid, id) of the texts that contain each of ``patterns(qid, pattern)``."""
        wanted = _wanted(patterns)
        few, postings = written(_few(wanted, self._read("counts")), "substring-pieces"), self._read("postings")
        names = [r[0] for r in few.select("piece").distinct().limit(LITERALS + 1).collect()]
        rows = postings.where(F.col("piece").isin(names)) if len(names) <= LITERALS else postings.join(few.select("piece").distinct(), "piece", "left_semi")
        return _found(rows.select("piece", F.explode("ids").alias("id")), few, self._read("texts"), wanted)


def built(texts: DataFrame) -> SubstringIndex:
    return SubstringIndex.build(texts, fresh(texts.sparkSession, "substrings"))
