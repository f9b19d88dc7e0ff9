"""Bipolar hypervectors, 64 signs a long: a set bit is +1.

Binding is the complement of xor, similarity a count of bits.  A bundle holds the number of +1 at
each position as bit planes (the k-th has the number's k-th bit), to which a vector is added like a
carry: a shard of up to 2 ** planes - 1 vectors is a few arrays of longs, whatever the dimension.  A name's
signs are the bits of its SHA-256, with a counter beyond 256.
"""

import functools

from pyspark.sql import Column, DataFrame, functions as F

#: longs of a vector of 256 signs; planes of a bundle of up to 15
WORDS, PLANES = 4, 4


def symbol(name: Column, words: int = WORDS) -> Column:
    digest = F.concat(*[F.sha2(name if k == 0 else F.concat(name, F.lit(f"#{k}")), 256) for k in range((words + 3) // 4)])
    half = lambda i, at: F.conv(F.substring(digest, 16 * i + at, 8), 16, 10).cast("long")
    return F.array(*[F.shiftleft(half(i, 1), 32).bitwiseOR(half(i, 9)) for i in range(words)])


def bind(a: Column, b: Column) -> Column:
    """The product of the signs; its own inverse."""
    return F.zip_with(a, b, lambda x, y: F.bitwise_not(x.bitwiseXOR(y)))


def _bits(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda n, x: n + F.bit_count(x))


def similarity(a: Column, b: Column) -> Column:
    """From -1 to 1: agreeing signs less the others, as a share."""
    return 1 - 2 * _bits(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))) / (64 * F.size(a))


def bundle(rows: DataFrame, by, vec: str, words: int = WORDS, planes: int = PLANES) -> DataFrame:
    """(*by, n, planes): each group's vectors counted; groups hold at most 2 ** planes - 1, as shards do."""
    by = [by] if isinstance(by, str) else list(by)
    none = F.array(*[F.array(*[F.lit(0).cast("long") for _ in range(words)]) for _ in range(planes)])

    def add(held, v):
        out, carry = [], v
        for k in range(planes):
            out.append(F.zip_with(held[k], carry, lambda x, y: x.bitwiseXOR(y)))
            carry = F.zip_with(held[k], carry, lambda x, y: x.bitwiseAND(y))
        return F.array(*out)

    each = rows.groupBy(*by).agg(F.count("*").alias("n"), F.collect_list(vec).alias("_vs"))
    full = F.assert_true(F.col("n") < (1 << planes), F.lit("a bundle holds more vectors than its planes can count"))
    return each.select(*by, "n", F.when(full.isNull(), F.aggregate("_vs", none, add)).alias("planes"))


def count_dot(planes: Column, n: Column, candidate: Column, count: int = PLANES, words: int = WORDS) -> Column:
    """The product of a bundle's sums and a vector, a whole number."""
    plus = functools.reduce(lambda a, b: a + b, [(1 << k) * F.bit_count(planes[k][w].bitwiseAND(candidate[w])) for k in range(count) for w in range(words)])
    whole = functools.reduce(lambda a, b: a + b, [(1 << k) * F.bit_count(planes[k][w]) for k in range(count) for w in range(words)])
    ones = functools.reduce(lambda a, b: a + b, [F.bit_count(candidate[w]) for w in range(words)])
    return 2 * (2 * plus - whole) - n * (2 * ones - 64 * words)


def count_similarity(planes: Column, n: Column, candidate: Column, count: int = PLANES) -> Column:
    """The cosine of a bundle's sums and a vector; 0 where the sums are all 0."""
    size = 64 * F.size(candidate)
    both = lambda a, b: _bits(F.zip_with(a, b, lambda x, y: x.bitwiseAND(y)))
    plus = functools.reduce(lambda a, b: a + b, [(1 << k) * both(planes[k], candidate) for k in range(count)])
    whole = functools.reduce(lambda a, b: a + b, [(1 << k) * _bits(planes[k]) for k in range(count)])
    squares = functools.reduce(lambda a, b: a + b, [(1 << (j + k)) * both(planes[j], planes[k]) for j in range(count) for k in range(count)])
    dot = 2 * (2 * plus - whole) - n * (2 * _bits(candidate) - size)
    norm = 4 * squares - 4 * n * whole + n * n * size
    return F.when(norm > 0, dot / (F.sqrt(norm.cast("double")) * F.sqrt(size.cast("double")))).otherwise(F.lit(0.0))


def fact(subject: Column, predicate: Column, target: Column, words: int = WORDS) -> Column:
    """subject, predicate and target bound."""
    return bind(key(subject, predicate, words), symbol(F.concat(F.lit("entity:"), target), words))


def key(subject: Column, predicate: Column, words: int = WORDS) -> Column:
    """What a shard is asked with: bound to a candidate, it is compared with the bundle."""
    return bind(symbol(F.concat(F.lit("entity:"), subject), words), symbol(F.concat(F.lit("predicate:"), predicate), words))


def answers(asked: DataFrame, bundles: DataFrame, names: DataFrame, k: int = 1, words: int = WORDS, planes: int = PLANES) -> DataFrame:
    """(subject, predicate, answer, similarity, rank): the k best of ``names(predicate, name)`` for each of ``asked(shard, subject, predicate)``."""
    from .lexical import top_per

    held = bundles.select("shard", "n", "planes")
    coded = names.select("predicate", F.col("name").alias("answer"), symbol(F.concat(F.lit("entity:"), "name"), words).alias("g"))
    rows = asked.join(held, "shard").withColumn("key", key(F.col("subject"), F.col("predicate"), words)).join(coded, "predicate")
    scored = rows.select("subject", "predicate", "answer", count_similarity(F.col("planes"), F.col("n"), bind(F.col("key"), F.col("g")), planes).alias("similarity"))
    return top_per(scored, ["subject", "predicate"], [F.round("similarity", 9).desc(), F.col("answer")], k)
