"""Routes through the domain ▸ collection ▸ document taxonomy, and predicates ranked for a query."""

from pyspark.sql import Column, DataFrame, functions as F

from . import lexical

# fixed values: level -> (boost of a name or alias in the query, boost of each of its words in it, weight in a candidate's boost)
LEVELS = {"domain": (4.0, 0.5, 0.10), "collection": (3.0, 0.4, 0.20), "document": (5.0, 0.6, 0.35)}
DESCRIPTION = (1.0, 0.2)
# fixed values: weights of predicate synonyms
EXACT, MANUAL, GENERATED, FEEDBACK, SUBSTRING = 100, 80, 50, 30, 20


def plain(text: Column) -> Column:
    """Lower case, punctuation of names as single spaces."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[_\-.,:;/\s]+", " "))


def words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, " "), lambda w: F.octet_length(w) >= 2))


def _boost(query: Column, value: Column, whole: float, each: float) -> Column:
    v = plain(value)
    return F.when(v == "", 0.0).otherwise(F.when(F.contains(query, v), whole).otherwise(0.0) + each * F.size(F.array_intersect(words(v), words(query))))


def route_scores(rows: DataFrame, query: str, with_bm25: bool = True) -> DataFrame:
    """``rows`` of the taxonomy with score and confidence, those above zero, best first.

    For each level there may be ``<level>`` (its name), ``<level>_description`` and
    ``<level>_aliases`` (a JSON array).  A name or alias that stands in the query, and each of
    its words that does, adds; so does BM25 of the whole row's text.
    """
    q = plain(F.lit(query))
    score, parts = F.lit(0.0), []
    for level, (whole, each, _) in LEVELS.items():
        if level not in rows.columns:
            continue
        score = score + _boost(q, F.col(level), whole, each)
        parts.append(F.coalesce(level, F.lit("")))
        if f"{level}_description" in rows.columns:
            score = score + _boost(q, F.col(f"{level}_description"), *DESCRIPTION)
            parts.append(F.coalesce(f"{level}_description", F.lit("")))
        if f"{level}_aliases" in rows.columns:
            aliases = F.coalesce(F.from_json(f"{level}_aliases", "array<string>"), F.array().cast("array<string>"))
            score = score + F.aggregate(aliases, F.lit(0.0), lambda a, x: a + _boost(q, x, whole, each))
            parts.append(F.array_join(aliases, " "))
    scored = rows.withColumn("score", score)
    if with_bm25:
        texts = rows.select(F.struct(*rows.columns).alias("id"), F.concat_ws(" ", *parts).alias("text"))
        asked = rows.sparkSession.range(1).select(F.lit(0).alias("qid"), F.lit(query).alias("text"))
        found = lexical.bm25(texts, asked, None).select(F.col("doc").alias("_row"), F.col("score").alias("_bm25"))
        scored = scored.withColumn("_row", F.struct(*rows.columns)).join(found, "_row", "left").withColumn("score", F.col("score") + F.coalesce("_bm25", F.lit(0.0))).drop("_row", "_bm25")
    scored = scored.where("score > 0").withColumn("confidence", F.least(F.col("score") / 10, F.lit(1.0)))
    return scored.orderBy(F.round("score", 9).desc(), *([f"{k}_id" for k in LEVELS if f"{k}_id" in rows.columns] or [F.lit(1)]))


def route_boosts(candidates: DataFrame, routes: DataFrame) -> DataFrame:
    """``candidates(id, dataset_id, domain_id, collection_id, document_id)`` with ``boost``: the best of their routes, times its confidence.

    A route and a candidate of different datasets don't meet.  Routes are joined on each level's
    id; what a pair has from several levels is summed.
    """
    each = None
    for level, (_, _, weight) in LEVELS.items():
        key = f"{level}_id"
        side = routes.where(F.coalesce(key, F.lit("")) != "").select(F.col(key), F.col("route"), F.col("dataset_id").alias("_ds"), "confidence")
        hit = candidates.select("id", "dataset_id", key).join(side, key).where("dataset_id = '' or _ds = '' or dataset_id = _ds").select("id", "route", (F.lit(weight) * F.col("confidence")).alias("boost"))
        each = hit if each is None else each.union(hit)
    best = each.groupBy("id", "route").agg(F.sum("boost").alias("boost")).groupBy("id").agg(F.max("boost").alias("boost"))
    return candidates.join(best, "id", "left").withColumn("boost", F.coalesce("boost", F.lit(0.0)))


def name_tokens(text: Column) -> Column:
    """Distinct words of two bytes or more, with their forms without s, ed or ing."""
    found = F.filter(F.split(F.lower(text), r"[^\p{L}\p{Nd}]+"), lambda w: F.octet_length(w) >= 2)
    forms = F.flatten(F.transform(found, lambda w: F.array(w, F.regexp_replace(w, "s$", ""), F.regexp_replace(w, "ed$", ""), F.regexp_replace(w, "ing$", ""))))
    return F.array_distinct(F.filter(forms, lambda w: F.octet_length(w) >= 2))


def rank_predicates(predicates: DataFrame, synonyms: DataFrame, query: str) -> DataFrame:
    """``predicates(predicate)`` with their score for a query, best first.

    The predicate's own words count EXACT and, as generated synonyms, GENERATED; those of
    ``synonyms(predicate, synonym, weight)`` their weight; parts of words, both of four bytes or more, SUBSTRING.
    """
    asked = name_tokens(F.lit(query))
    close = lambda w: F.size(F.filter(asked, lambda t: (F.octet_length(w) >= 4) & (F.octet_length(t) >= 4) & (F.contains(w, t) | F.contains(t, w))))
    value = lambda w, n: F.when(F.array_contains(asked, w), n).otherwise(0) + F.lit(SUBSTRING) * close(w)
    own = predicates.select("predicate", F.explode(name_tokens(F.col("predicate"))).alias("word"))
    terms = own.select("predicate", "word", F.lit(EXACT).alias("weight")).union(own.select("predicate", "word", F.lit(GENERATED).alias("weight")))
    terms = terms.union(synonyms.select("predicate", F.lower(F.btrim("synonym")).alias("word"), F.when(F.col("weight") > 0, F.col("weight")).otherwise(GENERATED).alias("weight")))
    scores = terms.where("word <> ''").select("predicate", value(F.col("word"), F.col("weight")).alias("s")).groupBy("predicate").agg(F.sum("s").alias("score"))
    return predicates.join(scores, "predicate", "left").select("predicate", F.coalesce("score", F.lit(0)).cast("long").alias("score")).orderBy(F.desc("score"), "predicate")
