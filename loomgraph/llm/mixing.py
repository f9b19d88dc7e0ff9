"""Mixing sources to target weights by iterative proportional fitting (DataFrame functions only).

Tokens are counted per cell (source, language, topic).  Raking multiplies the cells' factors
until the weighted tokens meet the target share of every source, language and topic.  A
document is kept with its cell's factor over the largest one as its probability, decided by a
hash of its doc_id: the tokens kept have the target shares in expectation, however far these
are from the corpus's own.

Stated targets that raking can't meet raise an error.  Default targets are the own shares to a
power, no value's more than ``BOOST`` times its own share; where empty cells keep them from
being met together, they are moved towards the own shares, which every corpus meets, by the first of
the ``STEPS`` that raking does meet, and a warning names it.  The weights returned have always converged.

Edge cases: null source, language or topic is the value ''; a null or empty text has no
tokens and gets its cell's probability; a value without a target keeps its own share of the
tokens; targets of values that don't occur are left out, and the rest scaled to one;
rows that share a doc_id are kept or dropped alike; extra columns are kept by ``sample``;
empty tables give empty results.
"""

import warnings

from pyspark.sql import Column, DataFrame, functions as F

from ._store import drop, stored, tune

DIMENSIONS = ("source", "lang", "topic")
_T = "coalesce(cast(text as string), '')"
_WS = "' \\t\\n\\u000B\\u000C\\r'"
#: SQL of a document's words
TOKENS = f"if(btrim({_T}, {_WS}) = '', 0L, bigint(size(split(btrim({_T}, {_WS}), '[\\\\x20\\\\x09-\\\\x0D]+'))))"
#: SQL of a document's topic where it has no column of that kind: its form, and the length of prose (``tokens`` are its words)
FORM = f"""case when 20 * (length({_T}) - length(translate({_T}, '|#*$%&<>', ''))) > length({_T}) then 'symbols'
  when 10 * (length({_T}) - length(translate({_T}, '0123456789', ''))) > length({_T}) then 'numbers'
  when 3 * (length({_T}) - length(translate({_T}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > length({_T}) then 'capitals'
  when tokens < 100 then 'note' when tokens < 1000 then 'article' else 'book' end"""
#: exponents that make a dimension's own shares its default targets: below 1 they flatten, above 1 (topics: less of the rare forms) they sharpen; and their limit
FLATTEN, BOOST = {"source": 0.5, "lang": 0.7, "topic": 1.1}, 8.0
#: raking ends at this relative miss of every share, and fails when five rounds don't take a tenth off it
TOLERANCE, ROUNDS = 1e-9, 200
#: how far default targets that can't be met move towards the own shares
STEPS = (0.0, 0.125, 0.25, 0.5, 0.75, 1.0)


def cell_keys(topic: str = FORM) -> dict:
    return {
        "m_source": F.coalesce(F.col("source").cast("string"), F.lit("")),
        "m_lang": F.coalesce(F.col("lang").cast("string"), F.lit("")),
        "m_topic": F.coalesce(F.expr(topic).cast("string"), F.lit("")),
    }


def flattened_targets(cells: DataFrame, exponents=None, boost: float = BOOST) -> DataFrame:
    """(dimension, value, share): each dimension's own shares to the power of its exponent, scaled to one, at most ``boost`` times the own ones."""
    out = None
    total = cells.agg(F.sum("tokens").cast("double").alias("all"))
    for d, power in (exponents or FLATTEN).items():
        one = cells.groupBy(F.col(f"m_{d}").alias("value")).agg(F.sum("tokens").alias("t")).where("t > 0").crossJoin(total).selectExpr("value", "t / all as own")
        whole = one.agg(F.sum(F.pow("own", F.lit(power))).alias("z"))
        one = one.crossJoin(whole).selectExpr(f"'{d}' as dimension", "value", f"least(pow(own, {power}D) / z, {boost}D * own) as share")
        out = one if out is None else out.union(one)
    return out


def moved_targets(cells: DataFrame, targets: DataFrame, step: float) -> DataFrame:
    """``targets`` moved by a share ``step`` of the way to the own shares of their values."""
    total = cells.agg(F.sum("tokens").cast("double").alias("all"))
    own = None
    for d in DIMENSIONS:
        one = cells.groupBy(F.col(f"m_{d}").alias("value")).agg(F.sum("tokens").alias("t")).crossJoin(total).selectExpr(f"'{d}' as dimension", "value", "t / all as own")  # one total
        own = one if own is None else own.union(one)
    sums = targets.groupBy("dimension").agg(F.sum("share").alias("z"))
    each = targets.join(sums, "dimension").join(own, ["dimension", "value"])
    return each.selectExpr("dimension", "value", f"{1 - step}D * share / z + {step}D * own as share")


def _goals(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """``cells`` with the tokens that each of its values shall have, goal_<dimension>."""
    for d in DIMENSIONS:
        want = targets.where(F.col("dimension") == d).groupBy(F.col("value").alias(f"m_{d}")).agg(F.max("share").alias("want"))
        own = cells.groupBy(f"m_{d}").agg(F.sum("tokens").alias("own")).join(want, f"m_{d}", "left")
        own = stored(own.withColumn("want", F.expr("if(own > 0, want, null)")), "margin")
        # values with targets share the tokens that they have together
        both = own.agg(F.sum("want").alias("ws"), F.sum(F.expr("if(want is null, null, own)")).alias("os"))
        goal = stored(own.crossJoin(both).select(f"m_{d}", F.expr("coalesce(want / nullif(ws, 0) * os, double(own))").alias(f"goal_{d}")), "goal")
        cells = cells.join(goal, f"m_{d}")
    return cells


class Unreachable(ValueError):
    """Targets that no weights of the cells meet together."""


def rake(cells: DataFrame, targets: DataFrame, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> DataFrame:
    """``cells(m_source, m_lang, m_topic, tokens)`` with their raked ``factor``.

    A round is, for each dimension, a sum by its values and a join with it (sums are combined
    before they are shuffled, so that a value with a third of the cells is no one task's work);
    it is one query, whose result is written, and whose largest miss of a share decides about
    the next.  Shares that don't approach their targets, or haven't met them after ``rounds``, are
    an error: ``Unreachable``.
    """
    now, misses = stored(_goals(cells, targets).withColumn("factor", F.lit(1.0)), "rake"), []
    while len(misses) < rounds and not (len(misses) > 10 and misses[-1] > 0.9 * misses[-6]):
        step = now.withColumn("miss", F.lit(0.0))
        for d in DIMENSIONS:
            have = step.groupBy(f"m_{d}").agg(F.sum(F.expr("tokens * factor")).alias("have"))
            step = step.join(have, f"m_{d}").withColumns({
                "factor": F.expr(f"if(have > 0, factor * goal_{d} / have, factor)"), "miss": F.expr(f"greatest(miss, if(goal_{d} > 0, abs(have / goal_{d} - 1), 0D))"),
            }).drop("have")
        following = stored(step, "rake")
        drop(now)
        now = following
        misses.append(now.agg(F.max("miss")).first()[0] or 0.0)
        if misses[-1] < tolerance:
            break
    else:
        drop(now)
        raise Unreachable(f"the targets can't be met together: after {len(misses)} rounds a share is missed by {misses[-1] if misses else 1:.2g} of itself")
    return now.select(*(f"m_{d}" for d in DIMENSIONS), "tokens", "factor")


def probabilities(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """(m_source, m_lang, m_topic, probability): each cell's factor over the largest of the cells with tokens."""
    raked = rake(cells, targets)
    top = raked.agg(F.max(F.expr("if(tokens > 0, factor, 0)")).alias("top"))
    return raked.crossJoin(top).select(*(f"m_{d}" for d in DIMENSIONS), F.expr("if(top > 0, least(1D, factor / top), 1D)").alias("probability"))


def uniform(seed: int) -> Column:
    """A number in [0, 1) that depends on doc_id and the seed alone."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def chances(keyed: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """The probability of each cell of ``keyed(m_source, m_lang, m_topic, tokens)``."""
    cells = stored(keyed.groupBy(*(f"m_{d}" for d in DIMENSIONS)).agg(F.sum("tokens").alias("tokens")), "cells")
    # the cells are far fewer than the documents: Spark broadcasts them by their written size
    if targets is not None:
        return stored(probabilities(cells, targets), "chances")
    wanted = stored(flattened_targets(cells), "targets")
    for step in STEPS:
        try:
            found = stored(probabilities(cells, moved_targets(cells, wanted, step) if step else wanted), "chances")
        except Unreachable as problem:
            told = problem
            continue
        if step:
            warnings.warn(f"default targets moved by {step} towards the own shares: {told}")
        return found
    raise told


def sample(docs: DataFrame, targets: DataFrame | None = None, topic: str = FORM, seed: int = 1) -> DataFrame:
    """``docs`` with m_source, m_lang, m_topic, probability and ``kept``, in place of columns of these names.

    ``topic`` is SQL over the columns of ``docs``, such as the name of its topic column.
    """
    tune(docs.sparkSession)
    keyed = docs.drop("probability", "kept", "tokens").withColumn("tokens", F.expr(TOKENS)).withColumns(cell_keys(topic))
    found = chances(keyed, targets)
    return keyed.drop("tokens").join(found, [f"m_{d}" for d in DIMENSIONS], "left").withColumn("kept", uniform(seed) < F.col("probability"))


def sampled(docs: DataFrame, targets: DataFrame | None = None, topic: str = FORM, seed: int = 1) -> DataFrame:
    """The sampled rows of ``docs``, with their own columns only, whatever these are called."""
    tune(docs.sparkSession)
    rows = docs.select("source", "lang", "text", "doc_id", F.struct(*(docs[c] for c in docs.columns)).alias("_row"))
    return sample(rows, targets, topic, seed).where("kept").select("_row.*")


def op4_mixing(spark, sf_dir):
    tune(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("tokens", F.expr(TOKENS))
    measured = stored(docs.select("doc_id", "tokens", *(c.alias(k) for k, c in cell_keys().items())), "mixing")
    rows = measured.join(chances(measured), [f"m_{d}" for d in DIMENSIONS], "left")
    return rows.select(
        "doc_id", *(F.col(f"m_{d}").alias(d) for d in DIMENSIONS), F.col("tokens").alias("n_tokens"), F.round("probability", 6).alias("probability"),
        (uniform(1) < F.col("probability")).alias("kept"),
    )


def _round_sql(rounds):
    """The raking of ``rounds`` rounds as nested queries, a line each."""
    out, last = [], "r0"
    for i in range(rounds):
        for d in DIMENSIONS:
            name = f"r{i}{d}"
            out.append(f"{name} AS MATERIALIZED (SELECT * EXCLUDE (f, have), CASE WHEN have > 0 THEN f * goal_{d} / have ELSE f END AS f FROM (SELECT *, sum(tokens * f) OVER (PARTITION BY {d}) AS have FROM {last}))")
            last = name
    return ",\n".join(out), last


_ROUNDS, _LAST = _round_sql(30)
_MANY = lambda chars: f"(length(t) - length(regexp_replace(t, '[{chars}]', '', 'g')))"
OP4_SQL = rf"""
WITH d0 AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS t,
  len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS n_tokens FROM documents),
d AS (SELECT doc_id, source, lang, n_tokens,
  CASE WHEN 20 * {_MANY('|#*$%&<>')} > length(t) THEN 'symbols' WHEN 10 * {_MANY('0-9')} > length(t) THEN 'numbers'
       WHEN 3 * {_MANY('A-Z')} > length(t) THEN 'capitals' WHEN n_tokens < 100 THEN 'note' WHEN n_tokens < 1000 THEN 'article' ELSE 'book' END AS topic FROM d0),
c AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY ALL),
n AS (SELECT sum(tokens) AS n FROM c),
ps AS (SELECT source, o, o / n AS own, pow(o / n, 0.5) / sum(pow(o / n, 0.5)) OVER () AS flat FROM (SELECT source, sum(tokens) AS o FROM c GROUP BY 1), n WHERE o > 0),
pl AS (SELECT lang, o, o / n AS own, pow(o / n, 0.7) / sum(pow(o / n, 0.7)) OVER () AS flat FROM (SELECT lang, sum(tokens) AS o FROM c GROUP BY 1), n WHERE o > 0),
pt AS (SELECT topic, o, o / n AS own, pow(o / n, 1.1) / sum(pow(o / n, 1.1)) OVER () AS flat FROM (SELECT topic, sum(tokens) AS o FROM c GROUP BY 1), n WHERE o > 0),
gs AS (SELECT source, least(flat, 8 * own) / sum(least(flat, 8 * own)) OVER () * sum(o) OVER () AS goal_source FROM ps),
gl AS (SELECT lang, least(flat, 8 * own) / sum(least(flat, 8 * own)) OVER () * sum(o) OVER () AS goal_lang FROM pl),
gt AS (SELECT topic, least(flat, 8 * own) / sum(least(flat, 8 * own)) OVER () * sum(o) OVER () AS goal_topic FROM pt),
r0 AS (SELECT source, lang, topic, tokens, coalesce(goal_source, 0) AS goal_source, coalesce(goal_lang, 0) AS goal_lang, coalesce(goal_topic, 0) AS goal_topic, 1.0::DOUBLE AS f
  FROM c LEFT JOIN gs USING (source) LEFT JOIN gl USING (lang) LEFT JOIN gt USING (topic)),
{_ROUNDS},
top AS (SELECT max(CASE WHEN tokens > 0 THEN f ELSE 0 END) AS top FROM {_LAST}),
p AS (SELECT source, lang, topic, CASE WHEN top > 0 THEN least(1.0, f / top) ELSE 1.0 END AS probability FROM {_LAST}, top)
SELECT doc_id, source, lang, topic, n_tokens, round(probability, 6) AS probability,
  ('0x' || substr(md5('1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT / 281474976710656.0 < probability AS kept FROM d JOIN p USING (source, lang, topic)
"""
