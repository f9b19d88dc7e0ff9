"""What a query written by somebody else, or by a model, may do: read the tables it is given, nothing else."""

import re

from pyspark.sql import DataFrame, SparkSession

#: operators of Spark's own plans of which a reading query is made
READING = {
    "Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Limit", "Offset", "Distinct", "UnresolvedHaving", "Join", "SubqueryAlias", "UnresolvedSubqueryColumnAliases", "Union", "Intersect", "Except",
    "UnresolvedWith", "UnresolvedRelation", "OneRowRelation", "Generate", "WithWindowDefinition", "UnresolvedInlineTable", "LateralJoin", "ResolvedInlineTable", "UnresolvedOrdinal",
}
#: functions that call code by its name or read what a table isn't
CALLS = r"(?i)\b(reflect|java_method|try_reflect|read_files|input_file_name|current_user|session_user)\s*\("


class Refused(ValueError):
    """A query that isn't allowed to run."""


def _nodes(plan):
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i))


def checked(spark: SparkSession, text: str, names) -> str:
    """``text`` if it is one query that reads only ``names``; else ``Refused``.

    The text is parsed by Spark and not run: its plan must consist of reading operators, and every
    relation in it, those of subqueries too, must be a name given or one that the query defines.
    """
    text = (text or "").strip()
    if not re.match(r"(?i)(select|with)\b", text) or "{" in text or "}" in text or re.search(CALLS, text):
        raise Refused("only a SELECT over the given tables is allowed")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as problem:
        raise Refused("the query can't be read") from problem
    for node in _nodes(plan):
        if node.getClass().getSimpleName() not in READING:
            raise Refused(f"{node.getClass().getSimpleName()} is not allowed")
    shown = plan.toString()
    own = {n.strip().lower() for group in re.findall(r"CTE \[([^\]]*)\]", shown) for n in group.split(",")}
    for relation in re.findall(r"UnresolvedRelation \[([^\]]*)\]", shown):
        if relation.lower() not in own | {n.lower() for n in names}:
            raise Refused(f"{relation} is not one of the given tables")
    if re.search(r"UnresolvedTableValuedFunction|RelationTimeTravel|InsertInto|Command", shown):
        raise Refused("only given tables can be read")
    return text


def read(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    """The rows of a checked query over ``tables``; no view of the session is made or replaced."""
    text = checked(spark, text, tables)
    given = ", ".join(f"{name} AS (SELECT * FROM {{{name}}})" for name in tables)
    start = re.match(r"(?i)with(\s+recursive)?\b", text)
    return spark.sql(f"{start.group(0)} {given}, {text[start.end():]}" if start else f"WITH {given} {text}", **tables)
