"""Quality rules with risk-controlled cutoffs (DataFrame and SQL functions only).

Each rule measures one ratio; a document whose ratio exceeds the rule's cutoff goes.  A level
is a cutoff for every rule; the levels are fixed beforehand and go from lenient to strict.
They are tested in this order on the labelled good documents of each stratum: a level passes
when the exact binomial tail P(Bin(n, alpha) <= k) is at most delta / strata, k of the n good
documents exceeding any of its cutoffs.  Testing stops at the first failure (a fixed sequence
needs no further correction) and the strata are corrected by Bonferroni: with probability
1 - delta, no stratum falsely loses more than alpha of its good documents to its level.  A
stratum with fewer than ln(delta / strata) / ln(1 - alpha) good labels (173 for four strata)
can't pass any level and keeps everything that the base rule keeps.

Edge cases: a null text has no words and fails the base rule; a null stratum is the
stratum ''; labels that are null or of unknown documents are ignored; a document with
several labels is good when all are; repeated rows are judged alike; extra columns are
kept by ``apply_rules`` and ignored elsewhere; empty tables give empty results.
"""

from pyspark.sql import DataFrame, functions as F

from ._store import stored, tune

SPACE = "[\\\\x20\\\\x09-\\\\x0D]"
#: rule -> (ratio, its cutoff at each level)
RULES = {
    "symbols": ("n_symbols / n_words", (2.0, 1.0, 0.75, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05, 0.05, 0.04, 0.03, 0.02, 0.02)),
    "repeats": ("n_repeat_words / n_words", (0.49, 0.48, 0.47, 0.46, 0.45, 0.44, 0.42, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05, 0.02)),
    "lines": ("n_dup_lines / n_words", (0.3, 0.25, 0.2, 0.18, 0.16, 0.14, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01, 0.005)),
    "long_words": ("word_chars / n_words", (40.0, 30.0, 25.0, 20.0, 18.0, 16.0, 14.0, 13.0, 12.0, 11.0, 10.0, 9.0, 8.0, 7.0, 6.0, 5.5)),
}
LEVELS = 16
ALPHA, DELTA = 0.025, 0.05

# let-bindings are one-element arrays: Catalyst would otherwise copy the expression to each use
_WORDS = f"if(btrim({{t}}, ' \\t\\n\\u000B\\u000C\\r') = '', array(), split(btrim({{t}}, ' \\t\\n\\u000B\\u000C\\r'), '{SPACE}+'))"
_SAME = "shiftright(s[k], b) = shiftright(s[k {d} 1], b) AND w[int(s[k] & m)] = w[int(s[k {d} 1] & m)] AND w[int(s[k] & m) + 1] = w[int(s[k {d} 1] & m) + 1] AND w[int(s[k] & m) + 2] = w[int(s[k {d} 1] & m) + 2]"
_REPEATS = f"""
if(size(w) < 4, 0L, element_at(transform(array(length(bin(size(w)))), b -> element_at(transform(array(shiftleft(1L, b) - 1), m ->
  element_at(transform(array(sort_array(transform(sequence(0, size(w) - 3),
    i -> shiftleft(shiftrightunsigned(xxhash64(w[i], w[i + 1], w[i + 2]), b + 1), b) | i))), s ->
      size(array_distinct(flatten(transform(
        filter(sequence(0, size(s) - 1), k -> if(k > 0, {_SAME.format(d='-')}, false) OR if(k < size(s) - 1, {_SAME.format(d='+')}, false)),
        k -> array((s[k] & m), (s[k] & m) + 1, (s[k] & m) + 2)))))
  ), 1)), 1)), 1))"""


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    The repeated three-word windows are found by sorting (window hash, position) packed in
    one long and comparing neighbours' words themselves, all inside the row.
    """
    t = f"coalesce(cast({text} as string), '')"
    lines = f"filter(split({t}, '\\n'), x -> btrim(x, ' \\t\\n\\u000B\\u000C\\r') <> '')"
    found = f"""element_at(transform(array({_WORDS.format(t=t)}), w -> named_struct(
        'n_words', bigint(size(w)), 'n_repeat_words', bigint({_REPEATS}))), 1)"""
    return (
        docs.withColumn("__w", F.expr(found))
        .withColumn("__l", F.expr(f"element_at(transform(array({lines}), x -> bigint(size(x) - size(array_distinct(x)))), 1)"))
        .withColumn("n_words", F.col("__w.n_words"))
        .withColumn("word_chars", F.expr(f"bigint(length(translate({t}, ' \\t\\n\\u000B\\u000C\\r', '')))"))
        .withColumn("n_symbols", F.expr(f"bigint(length({t}) - length(translate({t}, '#*$%&|<>', '')))"))
        .withColumn("n_dup_lines", F.col("__l"))
        .withColumn("n_repeat_words", F.col("__w.n_repeat_words"))
        .withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))
        .drop("__w", "__l")
    )


def _ln_gamma(x: str) -> str:
    """Stirling's series at x + 8, brought back by the recurrence; exact to 1e-13 for x >= 1."""
    z = f"({x} + 8)"
    back = " * ".join(f"({x} + {i})" for i in range(8))
    return f"(({z} - 0.5D) * ln({z}) - {z} + 0.9189385332046727D + 1 / (12D * {z}) - 1 / (360D * {z} * {z} * {z}) + 1 / (1260D * pow({z}, 5)) - ln({back}))"


def binomial_tail(k: str, n: str, p: float) -> str:
    """SQL for P(Bin(n, p) <= k): the last term by logarithms, earlier ones by their ratios, downwards."""
    n, k = f"double({n})", f"double({k})"
    last = f"exp({_ln_gamma(f'({n} + 1)')} - {_ln_gamma(f'({k} + 1)')} - {_ln_gamma(f'({n} - {k} + 1)')} + {k} * ln({p}D) + ({n} - {k}) * ln({1 - p}D))"
    odds = (1 - p) / p
    return f"""if({k} >= {n}, 1D, {last} * aggregate(sequence(0L, bigint({k})), named_struct('term', 1D, 'total', 0D),
        (a, i) -> named_struct('term', a.term * ({k} - i) / ({n} - {k} + i + 1) * {odds}D, 'total', a.total + a.term), a -> a.total))"""


def exceeds(level: int) -> str:
    """SQL: whether a document exceeds a cutoff of this level."""
    return "(" + " OR ".join(f"coalesce({ratio} > {grid[level]}D, false)" for ratio, grid in RULES.values()) + ")"


def cutoffs(features: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, stratum: str = "lang") -> DataFrame:
    """(stratum, n_good, level, rule columns): each stratum's strictest passing level and its cutoffs; null where none passes."""
    good = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    held = features.where("not base_failed").join(good, "doc_id", "left_semi").withColumn("stratum", F.expr(f"coalesce(cast(`{stratum}` as string), '')"))
    each = held.groupBy("stratum").agg(F.count("*").alias("n"), *[F.sum(F.expr(f"bigint({exceeds(i)})")).alias(f"k_{i}") for i in range(LEVELS)])
    each = each.crossJoin(held.agg(F.countDistinct("stratum").alias("strata")))  # one row
    tests = ", ".join(f"{binomial_tail(f'k_{i}', 'n', alpha)} <= {delta}D / strata" for i in range(LEVELS))
    # the longest run of passes from the lenient end
    level = F.expr(f"nullif(aggregate(array({tests}), named_struct('go', true, 'n', 0), (a, ok) -> named_struct('go', a.go AND ok, 'n', a.n + int(a.go AND ok)), a -> a.n), 0) - 1")
    told = each.select("stratum", F.col("n").alias("n_good"), level.alias("level"))
    return told.select("*", *[F.expr(f"get(array({', '.join(f'{c}D' for c in grid)}), level)").alias(f"cut_{rule}") for rule, (_, grid) in RULES.items()])


def judged(features: DataFrame, cuts: DataFrame, stratum: str = "lang") -> DataFrame:
    """``features`` with ``n_good``, ``level`` and ``kept``: false where the base rule failed or a cutoff is exceeded.

    ``cuts`` has a row per stratum; written beforehand, it is broadcast by its size or joined.
    """
    over = " OR ".join(f"coalesce({ratio} > cut_{rule}, false)" for rule, (ratio, _) in RULES.items())
    rows = features.withColumn("stratum", F.expr(f"coalesce(cast(`{stratum}` as string), '')")).join(cuts, "stratum", "left")
    rows = rows.withColumn("n_good", F.coalesce("n_good", F.lit(0)))
    return rows.withColumn("kept", F.expr(f"if(base_failed, false, not ({over}))")).drop("stratum", *[f"cut_{rule}" for rule in RULES])


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, stratum: str = "lang") -> DataFrame:
    """One row per document with its measurements, its stratum's good labels and level, ``base_failed`` and ``kept``."""
    tune(docs.sparkSession)
    rows = docs.select("doc_id", stratum, F.xxhash64("text").alias("text_hash"), "text")
    features = stored(measured(rows).drop("text"), "quality")
    return judged(features, stored(cutoffs(features, labels, alpha, delta, stratum), "cutoffs"), stratum)


def keep_good(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns only, whatever these are called."""
    tune(docs.sparkSession)
    rows = measured(docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row")), "_row.text")
    rows = stored(rows.withColumn("lang", F.col("_row.lang")).withColumn("doc_id", F.col("_row.doc_id")), "quality-rows")
    # the cutoffs read the measurements alone, the filter everything
    return judged(rows, stored(cutoffs(rows.drop("_row"), labels, alpha, delta), "cutoffs")).where("kept").select("_row.*")


def op9_quality(spark, sf_dir):
    found = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_good", "level")


_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_GRID = ", ".join("(" + ", ".join(map(str, (i, *(grid[i] for _, grid in RULES.values())))) + ")" for i in range(LEVELS))
OP9_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
        list_filter(string_split(t, chr(10)), lambda x: trim(x, {_SPACES}) <> '') AS l FROM d),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: {{'i': i, 'g': [w[i], w[i+1], w[i+2]]}})) AS s FROM w WHERE len(w) >= 3),
r AS (SELECT doc_id, s.i AS i, count(*) OVER (PARTITION BY doc_id, s.g) AS m FROM g),
p AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM r, (VALUES (0), (1), (2)) AS o(j) WHERE m > 1 GROUP BY doc_id),
f AS (SELECT doc_id, lang, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        coalesce(p.n, 0)::BIGINT AS n_repeat_words, len(w) < 50 OR 100 * coalesce(p.n, 0) > 50 * len(w) AS base_failed
      FROM w LEFT JOIN p USING (doc_id)),
grid AS (SELECT * FROM (VALUES {_GRID}) AS g(i, c_symbols, c_repeats, c_lines, c_chars)),
good AS (SELECT f.* FROM f JOIN (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1) USING (doc_id) WHERE NOT base_failed),
tested AS (SELECT lang, i, count(*) AS n, count(*) FILTER (n_symbols::DOUBLE / n_words > c_symbols OR n_repeat_words::DOUBLE / n_words > c_repeats
    OR n_dup_lines::DOUBLE / n_words > c_lines OR word_chars::DOUBLE / n_words > c_chars) AS k FROM good, grid GROUP BY ALL),
tail AS (SELECT *, list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({ALPHA}) + (n - j) * ln(1 - {ALPHA})))) AS p,
        (SELECT count(DISTINCT lang) FROM good) AS strata FROM tested),
ok AS (SELECT *, bool_and(p <= {DELTA} / strata) OVER (PARTITION BY lang ORDER BY i) AS pass FROM tail),
cuts AS (SELECT lang, max(n) AS n_good, max(i) FILTER (pass) AS level FROM ok GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(n_good, 0)::BIGINT AS n_good, level::INTEGER AS level,
  NOT base_failed AND coalesce(NOT (n_symbols::DOUBLE / n_words > c_symbols OR n_repeat_words::DOUBLE / n_words > c_repeats
    OR n_dup_lines::DOUBLE / n_words > c_lines OR word_chars::DOUBLE / n_words > c_chars), true) AS kept
FROM f LEFT JOIN cuts USING (lang) LEFT JOIN grid ON i = level
"""
