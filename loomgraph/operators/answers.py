"""Paging cursors, word variants, and structure in a model's answers."""

import base64
import json

from pyspark.sql import Column, DataFrame, functions as F

LIMIT = 1000


def cursor(offset: int) -> str:
    return base64.b64encode(json.dumps({"o": offset}, separators=(",", ":")).encode()).decode()


def page(rows: DataFrame, order, after: str | None, limit: int) -> DataFrame:
    """``limit`` rows (a thousand at most) after a cursor, with the ``next`` cursor; null on the last page, which a row more than the limit tells."""
    offset = json.loads(base64.b64decode(after))["o"] if after else 0
    limit = min(max(limit, 1), LIMIT)
    few = rows.orderBy(order).offset(offset).limit(limit + 1)
    more = few.agg((F.count("*") > limit).alias("_more"))  # one row
    return few.orderBy(order).limit(limit).crossJoin(more).withColumn("next", F.when(F.col("_more"), F.lit(cursor(offset + limit)))).drop("_more")


def variants(word: Column, expansions: dict | None = None) -> Column:
    """The lower-case word, its stem without s, ed or ing, and what ``expansions`` adds to either, of two bytes or more."""
    low = F.lower(word)
    forms = F.array(low, F.regexp_replace(low, "(s|ed|ing)$", ""))
    if expansions:
        more = F.create_map(*[x for k, v in expansions.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
        forms = F.concat(forms, F.flatten(F.transform(forms, lambda f: F.coalesce(F.try_element_at(more, f), F.array().cast("array<string>")))))
    return F.array_distinct(F.filter(forms, lambda x: F.octet_length(x) >= 2))


def entity_edges(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, source, relation, target): the edges of each answer's JSON object, ends resolved by name to id.

    The object is what stands between the first { and the last }; an answer without one has no edges.
    """
    kind = "nodes array<struct<id string, name string>>, edges array<struct<source string, target string, relation string>>"
    parsed = rows.select(key, F.from_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1), kind).alias("j"))
    ids = F.map_from_entries(F.transform("j.nodes", lambda n: F.struct(n["name"], n["id"])))
    edges = parsed.where("j.nodes is not null and j.edges is not null").select(key, ids.alias("ids"), F.explode("j.edges").alias("e"))
    end = lambda c: F.coalesce(F.try_element_at("ids", F.col(c)), F.col(c))
    return edges.select(key, end("e.source").alias("source"), F.col("e.relation").alias("relation"), end("e.target").alias("target"))


def markdown(fields: dict, level: int = 2) -> str:
    """A structured extraction as Markdown: nested objects are sections, lists are bullets."""
    out = []
    for name, value in fields.items():
        if isinstance(value, dict):
            out += [f"{'#' * level} {name}", "", markdown(value, level + 1)]
        elif isinstance(value, list):
            out += [f"{'#' * level} {name}", "", *[f"- {x}" for x in value], ""]
        elif value not in (None, ""):
            out += [f"**{name}:** {value}", ""]
    return "\n".join(out).rstrip() + "\n"


def markdown_texts(rows: DataFrame, key: str, field: str) -> DataFrame:
    """(key, text): JSON objects as Markdown; what is no object is ''."""
    import pyarrow as pa

    def one(text):
        try:
            found = json.loads(text or "")
        except ValueError:
            return ""
        return markdown(found) if isinstance(found, dict) else ""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([one(t) for t in batch.column(1).to_pylist()], pa.string())], names=[key, "text"])

    return rows.select(key, field).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, text string")
