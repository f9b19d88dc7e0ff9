"""Row predicates: access, tags, scopes, policies, validity."""

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: parts of keys whose values stay out of cross-collection results
SENSITIVE = ("api_key", "apikey", "password", "passwd", "secret", "token", "credential", "private_key")
# fixed values: the graph query policy
READ_PREFIXES = ("MATCH ", "OPTIONAL MATCH ", "WITH ", "CALL ", "UNWIND ")
ADMIN_WORDS = (" DROP ", " DATABASE ", " CONSTRAINT ", " INDEX ", " DBMS ", " DBMS.", " TERMINATE ", " LOAD CSV ")
WRITE_WORDS = ("CREATE ", "MERGE ", "DELETE ", "DETACH ", "SET ", "REMOVE ", "FOREACH ")
# fixed values: entity types that are code
CODE_TYPES = ("function", "class", "module", "method", "import")


def field(metadata: Column, name: str) -> Column:
    """A field of JSON metadata; null where it is missing or the JSON is broken."""
    return F.get_json_object(metadata, f"$.{name}")


def dataset_of(metadata: Column) -> Column:
    """dataset_id, else project_id, else ''."""
    return F.coalesce(F.nullif(field(metadata, "dataset_id"), F.lit("")), field(metadata, "project_id"), F.lit(""))


def _any(rows: DataFrame, name: str) -> DataFrame:
    """One row: whether ``rows`` has any."""
    return rows.limit(1).agg((F.count("*") > 0).alias(name))


def allowed_rows(rows: DataFrame, allowed: DataFrame | None, dataset: Column, empty_hides_all: bool = False) -> DataFrame:
    """Rows without a dataset or with one of ``allowed(dataset)``; None: all rows.

    An empty table of allowed datasets leaves the rows without one, or none if ``empty_hides_all``.
    """
    if allowed is None:
        return rows
    known = allowed.select(F.col("dataset").alias("_allowed")).distinct()
    kept = rows.withColumn("_dataset", dataset).join(known, F.col("_dataset") == F.col("_allowed"), "left").where("_dataset = '' or _allowed is not null")
    if empty_hides_all:
        kept = kept.crossJoin(_any(known, "_some")).where("_some").drop("_some")  # one row
    return kept.drop("_dataset", "_allowed")


def allowed_datasets(datasets: DataFrame, shares: DataFrame, user: str, superuser: bool = False) -> DataFrame | None:
    """(dataset) that ``user`` owns, nobody owns, or is shared with ``user``; None for a superuser."""
    if superuser:
        return None
    mine = shares.where(F.col("user_id") == user).select(F.col("dataset_id").alias("_shared")).distinct()
    seen = datasets.join(mine, datasets.id == mine._shared, "left").where((F.col("owner_id") == user) | (F.coalesce("owner_id", F.lit("")) == "") | F.col("_shared").isNotNull())
    return seen.select(F.col("id").alias("dataset")).distinct()


def tag_filter(rows: DataFrame, metadata: Column, wanted) -> DataFrame:
    """Rows with a wanted tag, or a wanted key, in any case; all rows where none has or nothing is wanted."""
    if not wanted:
        return rows
    want = F.array(*[F.lit(w.lower()) for w in wanted])
    tags = F.from_json(field(metadata, "tags"), "array<string>")
    hit = F.coalesce(F.exists(tags, lambda t: F.array_contains(want, F.lower(t))), F.lit(False)) | F.coalesce(F.array_contains(want, F.lower(field(metadata, "key"))), F.lit(False))
    marked = rows.withColumn("_hit", hit)
    return marked.crossJoin(_any(marked.where("_hit"), "_some")).where("_hit or not _some").drop("_hit", "_some")  # one row


def chunk_matches(metadata: Column, room: str = "", tags=()) -> Column:
    """Whether a chunk is in the room and has any of the tags, case counts; broken JSON matches no filter."""
    out = F.lit(True)
    if room:
        out = out & (field(metadata, "room") == room)
    if tags:
        out = out & F.arrays_overlap(F.from_json(field(metadata, "tags"), "array<string>"), F.array(*map(F.lit, tags)))
    return F.coalesce(out, F.lit(False))


def json_tags_like(tags: Column, wanted) -> Column:
    """Every wanted tag stands quoted in the JSON text."""
    out = F.lit(True)
    for t in wanted:
        out = out & tags.like(f'%"{t}"%')
    return out


def resolve_collections(collections: DataFrame, explicit: str = "", domain: str = "") -> DataFrame:
    """``collections(name, domain)``: the named one, else the domain's, else all."""
    return collections.where(F.col("name") == explicit) if explicit else collections.where(F.col("domain") == domain) if domain else collections


def memory_scope(memories: DataFrame, owner: str, collection: str = "", room: str = "", hall: str = "", superseded: bool = False) -> DataFrame:
    """Memories that ``owner`` or nobody owns, in the named scopes; live ones unless ``superseded``."""
    out = memories.where((F.col("owner_id") == owner) | (F.col("owner_id") == ""))
    for column, value in (("collection_name", collection), ("room", room), ("hall", hall)):
        out = out.where(F.col(column) == value) if value else out
    return out if superseded else out.where("superseded_by = ''")


def verification(rows: DataFrame, least: float = 0.0, check: bool = True) -> DataFrame:
    """``rows(score, metadata)`` with ``verdict``: low_score, bad_metadata or kept."""
    low = (F.col("score") < least) if least > 0 else F.lit(False)
    bad = F.get_json_object("metadata", "$").isNull() if check else F.lit(False)
    return rows.withColumn("verdict", F.when(low, "low_score").when(bad, "bad_metadata").otherwise("kept"))


def verification_counts(rows: DataFrame, least: float = 0.0, check: bool = True) -> DataFrame:
    """One row: total, kept, dropped_low, dropped_bad."""
    of = lambda v: F.count_if(F.col("verdict") == v)
    return verification(rows, least, check).agg(F.count("*").alias("total"), of("kept").alias("kept"), of("low_score").alias("dropped_low"), of("bad_metadata").alias("dropped_bad"))


def within(at: Column, begin: Column, end: Column) -> Column:
    """Both ends included."""
    return at.between(begin, end)


def like_any(needle: str, *columns: str) -> Column:
    """Any column contains the needle, case aside; % and _ in it are wildcards."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.col(c).ilike(f"%{needle}%"), F.lit(False))
    return out


def manifest_chunks(chunks: DataFrame, active: str | None = None, **wanted) -> DataFrame:
    """Chunks of a manifest that equal every given field ('' matches all); of generation ``active`` only, if given."""
    out = chunks if active is None else chunks.where(F.col("generation") == active)
    for column, value in wanted.items():
        out = out.where(F.col(column) == value) if value else out
    return out.orderBy("generation", "path", "chunk_id", "vector_id")


def audit_page(events: DataFrame, since: Column, limit: int = 50, offset: int = 0, **wanted) -> DataFrame:
    """Events since a time that equal every given field, newest first; a limit outside 1..100 means 50."""
    out = events.where(F.col("ts") >= since)
    for column, value in wanted.items():
        out = out.where(F.col(column) == value) if value else out
    return out.orderBy(F.desc("ts"), "id").offset(offset).limit(limit if 0 < limit <= 100 else 50)


def cypher_allowed(text: Column, write: bool = False) -> Column:
    """Whether a graph query may run: no administration, and unless ``write`` only reading."""
    trimmed = F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))
    upper = F.upper(trimmed)
    has = lambda t, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(t, w))
    ok = (trimmed != "") & ~has(F.concat(F.lit(" "), upper, F.lit(" ")), ADMIN_WORDS)
    if not write:
        ok = ok & F.exists(F.array(*map(F.lit, READ_PREFIXES)), lambda p: F.startswith(upper, p)) & ~has(upper, WRITE_WORDS)
    return F.coalesce(ok, F.lit(False))


def code_entity(kind: Column, collection: Column) -> Column:
    """Code by its type; without a type, by a collection named after code."""
    untyped = F.coalesce(kind, F.lit("")) == ""
    return F.when(untyped, F.lower(collection).rlike("code|function|class")).otherwise(F.lower(kind).isin(*CODE_TYPES))


def drifted(collections: DataFrame, model: str, dim: int, version: str = "") -> DataFrame:
    """Collections ``(name, model, dim, version, records)`` whose stated model, dimension or version isn't the current one.

    Names that begin with _ and empty collections are passed over; what isn't stated doesn't differ.
    """
    other = ((F.col("model") != "") & (F.col("model") != model)) | ((F.col("dim") > 0) & (F.col("dim") != dim))
    if version:
        other = other | ((F.col("version") != "") & (F.col("version") != version))
    return collections.where(~F.startswith("name", F.lit("_")) & (F.col("records") > 0) & other)


def text_of(metadata: Column) -> Column:
    """``text`` where there is one, even an empty one, else ``name``, else ''."""
    return F.coalesce(field(metadata, "text"), field(metadata, "name"), F.lit(""))


def not_sensitive(key: Column) -> Column:
    return ~F.lower(key).rlike("|".join(SENSITIVE))
