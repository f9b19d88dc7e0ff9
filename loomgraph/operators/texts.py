"""Text functions: classification, tables, titles, embedded JSON, code entities, keys."""

from pyspark.sql import Column, DataFrame, Window, functions as F

# fixed values: patterns that mark code
CODE_PATTERNS = (r"\bfunc \w+\(", r"\bdef \w+\(", r"\bclass \w+", r"\bimport \w+", r"\breturn\b", r"[{};]\s*$")


def classify(text: Column) -> Column:
    """'csv' (three lines or more of equally many commas, two at least), else 'code' (two patterns in the first 1000 characters), else 'text'."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    commas = F.transform(lines, lambda x: F.char_length(x) - F.char_length(F.replace(x, F.lit(","), F.lit(""))))
    csv = (F.size(lines) >= 3) & (F.array_min(commas) == F.array_max(commas)) & (F.array_min(commas) >= 2)
    marks = sum((F.substring(text, 1, 1000).rlike("(?m)" + p).cast("int") for p in CODE_PATTERNS), F.lit(0))
    return F.when(csv, "csv").when(marks >= 2, "code").otherwise("text")


CLASSIFY_SQL = r"""WITH l AS (SELECT doc_id, text, list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), lambda x: length(x) - length(replace(x, ',', ''))) AS c FROM documents)
SELECT doc_id, CASE WHEN len(c) >= 3 AND list_min(c) = list_max(c) AND list_min(c) >= 2 THEN 'csv' WHEN """ + " + ".join(f"regexp_matches(substr(text, 1, 1000), '(?m){p}')::INT" for p in CODE_PATTERNS) + r""" >= 2 THEN 'code' ELSE 'text' END AS kind FROM l"""


def table_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, rows, score): lines of 2 to 8 fields with a number; two rows or more score .4 + .1 * (rows - 2), .85 at most."""
    numeric = lambda x: (F.size(F.split(F.trim(x), "\\s{2,}|\\t|\\|")) >= 2) & (F.size(F.split(F.trim(x), "\\s{2,}|\\t|\\|")) <= 8) & x.rlike("[0-9]")
    rows = docs.select("doc_id", F.size(F.filter(F.split("text", "\n"), numeric)).cast("long").alias("rows"))
    return rows.select("doc_id", "rows", F.when(F.col("rows") >= 2, F.round(F.least(0.4 + 0.1 * (F.col("rows") - 2), F.lit(0.85)), 6)).otherwise(0.0).alias("score"))


TABLE_SQL = r"""WITH l AS (SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: len(regexp_split_to_array(trim(x), '\s{2,}|\t|\|')) BETWEEN 2 AND 8 AND regexp_matches(x, '[0-9]')))::BIGINT AS rows FROM documents)
SELECT doc_id, rows, CASE WHEN rows >= 2 THEN round(least(0.4::DOUBLE + 0.1::DOUBLE * (rows - 2), 0.85), 6) ELSE 0.0::DOUBLE END AS score FROM l"""


def json_array(text: Column) -> Column:
    """The array of strings between the first [ and the last ] of an answer; null where it is none."""
    return F.from_json(F.regexp_extract(text, r"(?s)(\[.*\])", 1), "array<string>")


def titles(docs: DataFrame, id_col: str, text_col: str = "text", words: int = 7) -> DataFrame:
    """(id, title): texts of up to seven words as they are; else the first seven, and of texts of over 30 words the three commonest of over three bytes."""
    split = F.filter(F.split(text_col, r"\s+"), lambda w: w != "")
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"), split.alias("_w"))
    counts = rows.where(F.size("_w") > 30).select(id_col, F.explode(F.transform("_w", F.lower)).alias("_x")).where(F.octet_length("_x") > 3).groupBy(id_col, "_x").agg(F.count("*").alias("_n"))
    best = counts.groupBy(id_col).agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("_n")).alias("n"), F.col("_x").alias("x")))), 1, 3).alias("_top"))  # a text's own words
    short = F.concat(F.array_join(F.slice("_w", 1, words), " "), F.coalesce(F.concat(F.lit(" ["), F.array_join(F.transform("_top", lambda t: t["x"]), ", "), F.lit("]")), F.lit("")))
    return rows.join(best, id_col, "left").select(id_col, F.when(F.size("_w") <= words, F.col("_text")).otherwise(short).alias("title"))


def local_name(uri: Column) -> Column:
    """What follows the last #, else the last slash, else all."""
    return F.when(F.contains(uri, F.lit("#")), F.substring_index(uri, "#", -1)).otherwise(F.substring_index(uri, "/", -1))


def memory_digest(key: Column, value: Column) -> Column:
    """SHA-256 of key, a zero byte, value."""
    return F.sha2(F.concat(key.cast("binary"), F.unhex(F.lit("00")), value.cast("binary")), 256)


def embed_context(document: Column, section: Column, text: Column) -> Column:
    return F.concat(F.lit("Document: "), document, F.lit("\nSection: "), section, F.lit("\n\n"), text)


def cache_key(model: Column, prompt: Column, system: Column, temperature: Column) -> Column:
    return F.sha2(F.format_string("%s|%s|%s|%.4f", model, prompt, system, temperature), 256)


def embed_key(text: Column) -> Column:
    """The name of a text in a cache of vectors: half of its SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 32)


#: language -> [(kind, pattern of a line, its group that is the name, its group that is what it extends or belongs to)]
LANGUAGES = {
    "python": [
        ("import", r"^\s*(?:from\s+\S+\s+)?import\s+([\w.]+)", 1, None), ("class", r"^\s*class\s+(\w+)(?:\(([^)]*)\))?", 1, 2),
        ("method", r"^\s+(?:async\s+)?def\s+(\w+)", 1, None), ("function", r"^(?:async\s+)?def\s+(\w+)", 1, None),
    ],
    "go": [
        ("import", r'^(?:import\s+|\s+)(?:\w+\s+)?"([^"]+)"\s*$', 1, None), ("class", r"^type\s+(\w+)\s+struct\b", 1, None), ("interface", r"^type\s+(\w+)\s+interface\b", 1, None),
        ("method", r"^func\s+\(\s*\w*\s*\*?(\w+)\s*\)\s*(\w+)\s*\(", 2, 1), ("function", r"^func\s+(\w+)\s*\(", 1, None),
    ],
}


def code_entities(docs: DataFrame, language: str = "python") -> DataFrame:
    """(doc_id, pos, kind, name, detail) line by line: detail is a class's bases, or the type a Go method belongs to."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    found = F.coalesce(*[
        F.when(F.col("line").rlike(p), F.struct(F.lit(kind).alias("kind"), F.regexp_extract("line", p, name).alias("name"), (F.regexp_extract("line", p, of) if of else F.lit("")).alias("detail")))
        for kind, p, name, of in LANGUAGES[language]
    ])
    return lines.withColumn("e", found).where("e is not null").select("doc_id", "pos", "e.*")


def code_edges(docs: DataFrame, language: str = "python") -> DataFrame:
    """(doc_id, source, relation, target), each once: the text IMPORTS, a class EXTENDS its bases, a function or method CALLS another of its text."""
    found = code_entities(docs, language)
    file = F.concat(F.lit("file:"), F.col("doc_id").cast("string"))
    imports = found.where("kind = 'import'").select("doc_id", file.alias("source"), F.lit("IMPORTS").alias("relation"), F.col("name").alias("target"))
    bases = found.where("kind = 'class' and detail <> ''").select("doc_id", F.col("name").alias("source"), F.lit("EXTENDS").alias("relation"), F.explode(F.split("detail", r"\s*,\s*")).alias("target"))
    bodies = found.where("kind in ('function', 'method')").select("doc_id", "pos", "name")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).join(bodies, ["doc_id", "pos"], "left")
    inside = lines.withColumn("source", F.last("name", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("pos"))).where("name is null and source is not null")
    called = inside.select("doc_id", "source", F.explode(F.regexp_extract_all("line", F.lit(r"(\w+)\("), F.lit(1))).alias("target")).distinct()
    calls = called.join(bodies.select("doc_id", F.col("name").alias("target")).distinct(), ["doc_id", "target"]).select("doc_id", "source", F.lit("CALLS").alias("relation"), "target")
    return imports.union(bases).union(calls).where("target <> ''").distinct()
