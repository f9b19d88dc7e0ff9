"""Fuzzy joins of names by edit distance, as equi-joins of segments.

Names of n letters match others with at most d edits, d by the cutoff and the lengths.  A name cut into
d + 1 segments shares at least one of them whole with every match, at a place that at most d edits
have moved: segments, by length and number, are keys, and the matches' letters at those places
are the keys of the other side.  Only names that share a key are compared.
"""

from pyspark.sql import DataFrame, functions as F


def _edits(length: str, cutoff: float) -> str:
    """Most edits between a name of ``length`` letters and any match."""
    return f"int(floor({1 - cutoff}D * floor({length} / {cutoff}D + 1e-9) + 1e-9))"


def _segments(name: str, cutoff: float):
    """The keys of a name: its segments."""
    n = f"char_length({name})"
    d = _edits(n, cutoff)
    cut = lambda i: f"int({i} * {n} div ({d} + 1))"
    return F.expr(f"transform(sequence(0, {d}), i -> concat_ws('|', {n}, i, substring({name}, {cut('i')} + 1, {cut('(i + 1)')} - {cut('i')})))")


def _places(name: str, cutoff: float):
    """The keys under which a name's matches may have cut themselves."""
    n = f"char_length({name})"
    d = _edits("m", cutoff)
    cut = lambda i: f"int({i} * m div ({d} + 1))"
    size = f"({cut('(i + 1)')} - {cut('i')})"
    low, high = f"greatest(0, {cut('i')} - {d})", f"least({n} - {size}, {cut('i')} + {d})"
    at = f"if({high} >= {low}, transform(sequence({low}, greatest({low}, {high})), p -> concat_ws('|', m, i, substring({name}, p + 1, {size}))), array())"
    lengths = f"sequence(greatest(1, int(ceil({cutoff}D * {n} - 1e-9))), greatest(1, int(floor({n} / {cutoff}D + 1e-9))))"
    return F.array_distinct(F.expr(f"flatten(transform({lengths}, m -> flatten(transform(sequence(0, {d}), i -> {at}))))"))


def similar_names(left: DataFrame, right: DataFrame, cutoff: float = 0.8) -> DataFrame:
    """(a, b, similarity) of ``left(a, name)`` and ``right(b, name)``: 1 - edits / the longer name's letters, at least ``cutoff``.

    Case is not told apart; empty and null names match nothing.  Equal names are joined once and
    stand for all their rows.
    """
    if not 0.5 <= cutoff <= 1:
        raise ValueError("the cutoff must lie between one half and one")
    x = left.select("a", F.lower("name").alias("x")).where("x <> ''")
    y = right.select("b", F.lower("name").alias("y")).where("y <> ''")
    xs, ys = x.select("x").distinct(), y.select("y").distinct()
    keyed = xs.select("x", F.explode(_places("x", cutoff)).alias("key")).join(ys.select("y", F.explode(_segments("y", cutoff)).alias("key")), "key")
    longest = F.greatest(F.char_length("x"), F.char_length("y"))
    pairs = keyed.select("x", "y").distinct().withColumn("similarity", 1 - F.levenshtein("x", "y") / longest).where(F.col("similarity") >= cutoff - 1e-9)
    return pairs.join(x, "x").join(y, "y").select("a", "b", "similarity")


def closest(names: DataFrame, vocabulary: DataFrame, cutoff: float = 0.8) -> DataFrame:
    """(a, b, similarity): for each of ``names(a, name)`` the nearest of ``vocabulary(b, name)``, the smallest b of equally near ones."""
    each = similar_names(names, vocabulary, cutoff)
    return each.groupBy("a").agg(F.min_by(F.struct("b", "similarity"), F.struct(-F.round("similarity", 9), "b")).alias("best")).select("a", "best.b", "best.similarity")
