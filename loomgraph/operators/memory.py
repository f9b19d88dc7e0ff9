"""Memories, wake-up, workspaces, tasks: what an agent's session reads."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from .predicates import memory_scope


def pinned(memories: DataFrame, owner: str, collection: str = "", limit: int = 50) -> DataFrame:
    """Live pinned memories of a scope, by priority, the newest first."""
    return memory_scope(memories, owner, collection).where("is_pinned").orderBy(F.desc("pin_priority"), F.desc("updated_at"), "id").limit(limit)


def busiest(nodes: DataFrame, edges: DataFrame, dataset: str, now: Column, n: int) -> DataFrame:
    """(name, type, edges): the nodes of a dataset with most active edges; no dataset, no nodes."""
    from .graph import active
    from .relate import edge_counts

    mine = nodes.where((F.col("dataset_id") == dataset) & F.lit(dataset != ""))
    counts = edge_counts(mine, active(edges, now)).join(mine.select("id", "name"), "id")
    return counts.orderBy(F.desc("edges"), "id").limit(n).where("name <> ''").select("name", "type", "edges")


def sessions(rows: DataFrame, session: str, at: str, kind: str, limit: int) -> DataFrame:
    """(session, n, last_at, type) of each session, the latest first."""
    each = rows.groupBy(F.col(session).alias("session")).agg(F.count("*").alias("n"), F.max(at).alias("last_at"), F.max(kind).alias("type"))
    return each.orderBy(F.desc("last_at"), "session").limit(limit)


def staleness(memories: DataFrame) -> DataFrame:
    """(room, oldest, n) of live memories."""
    return memories.where("superseded_by = ''").groupBy("room").agg(F.min("updated_at").alias("oldest"), F.count("*").alias("n"))


def sync_state(rows: DataFrame, at: str, owner: str) -> DataFrame:
    """One row: rows, the newest time, distinct owners."""
    return rows.agg(F.count("*").alias("n"), F.max(at).alias("newest"), F.countDistinct(owner).alias("owners"))


def coverage(rows: DataFrame, key: str, id_col: str, **indexes: DataFrame) -> DataFrame:
    """Rows by ``key``, and how many of their ids each index (id) has."""
    out = rows.select(key, F.col(id_col).alias("id"))
    for name, index in indexes.items():
        out = out.join(index.select("id").distinct().withColumn(name, F.lit(1)), "id", "left")
    return out.groupBy(key).agg(F.count("*").alias("items"), *[F.count(name).alias(name) for name in indexes])


def predicates(edges: DataFrame, shards: DataFrame, dataset: str = "") -> DataFrame:
    """(predicate) of active edges and of shards(predicate, dataset_id), each once."""
    scoped = lambda d: d.where(F.col("dataset_id") == dataset) if dataset else d
    a = scoped(edges).where("valid_until is null").select(F.col("relation").alias("predicate"))
    return a.union(scoped(shards).select("predicate")).where("predicate <> ''").distinct()


def density(actions: DataFrame, memories: DataFrame) -> DataFrame:
    """(action, density): bytes of the survivor over those of all that it stands for; 0 where these have none.

    ``actions(action, survivor, id)`` names each member once, the survivor among them.
    """
    sizes = memories.select("id", F.octet_length("value").alias("size"))
    each = actions.join(sizes, "id").groupBy("action").agg(F.sum(F.expr("if(id = survivor, size, 0)")).alias("kept"), F.sum("size").alias("total"))
    return each.select("action", F.when(F.col("total") > 0, F.round(F.col("kept") / F.col("total"), 6)).otherwise(0.0).alias("density"))


def validation(criteria: DataFrame, receipts: DataFrame, revision: str) -> DataFrame:
    """(criterion, state): found, else stale, failed, or missing.

    A receipt(criterion, status, type, exit_code, revision) counts when it passed, its command
    ended with 0, and it is of the current revision; one of another revision is stale.
    """
    bad = (F.col("status") != "pass") | ((F.col("type") == "command") & (F.coalesce("exit_code", F.lit(0)) != 0))
    old = ~bad & (F.col("revision") != "") & (F.col("revision") != revision) & F.lit(revision != "")
    each = receipts.groupBy("criterion").agg(F.bool_or(~bad & ~old).alias("ok"), F.bool_or(old).alias("old"), F.bool_or(bad).alias("bad"))
    state = F.when(F.col("ok"), "found").when(F.col("old"), "stale").when(F.col("bad"), "failed").otherwise("missing")
    return criteria.join(each, "criterion", "left").select("criterion", state.alias("state"))


def last_turns(turns: DataFrame, by: str, order: str, n: int = 5) -> DataFrame:
    """The last ``n`` turns of each conversation, replayed oldest first: ``place`` 1 is the oldest."""
    w = Window.partitionBy(by)
    back = turns.withColumn("_back", F.row_number().over(w.orderBy(F.desc(order)))).where(F.col("_back") <= n)
    return back.withColumn("place", F.row_number().over(w.orderBy(order)).cast("long")).drop("_back")


def within_budget(rows: DataFrame, cost: str, order: str, budget: int, chunk: int) -> DataFrame:
    """The rows, in ``order`` (an integer column), whose running cost stays within ``budget``.

    Sums by ranges of ``chunk`` numbers are run up first, so that no window holds all rows; only the ranges are.
    """
    part = F.floor(F.col(order) / chunk).alias("_part")
    parts = rows.groupBy(part).agg(F.sum(cost).alias("_sum"))
    before = F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") <= budget).select("_part", "_before")
    inside = F.sum(cost).over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_part", part).join(starts, "_part").withColumn("_used", F.col("_before") + inside).where(F.col("_used") <= budget).drop("_part", "_before", "_used")


def gc_plan(chunks: DataFrame, pending: DataFrame, active: str) -> DataFrame:
    """(collection, plan, vectors) for generations(generation) to be deleted: a collection that no other uses is dropped, else its vectors are deleted.

    Chunks without a collection are deleted by vector.  The active generation can't go.
    """
    if not pending.where(F.col("generation") == active).isEmpty():
        raise ValueError(f"the active generation {active} can't be deleted")
    gone = chunks.join(pending.select("generation").distinct().withColumn("_gone", F.lit(True)), "generation", "left").withColumn("_gone", F.coalesce("_gone", F.lit(False)))
    each = gone.groupBy("collection").agg(F.bool_or("_gone").alias("hit"), F.bool_or(~F.col("_gone")).alias("used"), F.count_if("_gone").alias("vectors")).where("hit")
    return each.select("collection", F.expr("case when collection = '' then 'vectors' when used then 'shared' else 'exclusive' end").alias("plan"), "vectors")


def file_states(disk: DataFrame, index: DataFrame) -> DataFrame:
    """(path, state) of files(path, digest): unindexed, missing from the disk, or dirty."""
    both = disk.select("path", F.col("digest").alias("_d")).join(index.select("path", F.col("digest").alias("_i")), "path", "full_outer")
    state = F.when(F.col("_i").isNull(), "unindexed").when(F.col("_d").isNull(), "missing").when(F.col("_d") != F.col("_i"), "dirty")
    return both.select("path", state.alias("state")).where("state is not null")


def newest(memories: DataFrame, owner: str, n: int = 20) -> DataFrame:
    """An owner's memories, the newest first."""
    return memories.where(F.col("owner_id") == owner).orderBy(F.desc("updated_at"), "id").limit(n)


def entity_edges(nodes: DataFrame, edges: DataFrame, name: str, at: Column | None = None, limit: int = 50) -> DataFrame:
    """Edges at either end of the (ten at most) nodes whose name contains ``name``, valid at a time."""
    from .graph import entity_at

    ids = nodes.where(F.contains(F.lower("name"), F.lit(name.lower()))).orderBy("id").limit(10).select(F.col("id").alias("_id"))
    hit = edges.join(F.broadcast(ids), edges.source_id == F.col("_id"), "left_semi").union(edges.join(F.broadcast(ids), edges.target_id == F.col("_id"), "left_semi")).distinct()  # ten ids
    return (hit if at is None else entity_at(hit, at)).orderBy("id").limit(limit)


def page(memories: DataFrame, limit: int, offset: int) -> DataFrame:
    """A page of memories, the newest first; a limit outside 1..100 means 50."""
    return memories.orderBy(F.desc("updated_at"), "id").offset(offset).limit(limit if 0 < limit <= 100 else 50)


def reviews(memories: DataFrame, before: Column, halls) -> DataFrame:
    """(room, stale, other_halls, n) of live memories: those not updated since a time, those of a hall that isn't among ``halls``."""
    live = memories.where("superseded_by = ''")
    return live.groupBy("room").agg(F.count_if(F.col("updated_at") < before).alias("stale"), F.count_if(~F.col("hall").isin(*halls)).alias("other_halls"), F.count("*").alias("n"))


def promotable(steps: DataFrame, blockers: DataFrame) -> DataFrame:
    """(task) all of whose ``steps(task, passed)`` passed, without ``blockers(task)``."""
    done = steps.groupBy("task").agg(F.bool_and("passed").alias("_all")).where("_all")
    return done.join(blockers.select("task").distinct(), "task", "left_anti").select("task")


def migration(records: DataFrame, embedded: DataFrame) -> DataFrame:
    """(collection, todo, done, ready) of records(collection, id) and those that the new encoder has seen; ready to cut over when nothing is left."""
    seen = embedded.select("collection", "id").distinct().withColumn("_done", F.lit(1))
    each = records.join(seen, ["collection", "id"], "left").groupBy("collection").agg(F.count_if(F.col("_done").isNull()).alias("todo"), F.count("_done").alias("done"))
    return each.withColumn("ready", F.col("todo") == 0)


def workspace_search(chunks: DataFrame, active: str, needle: str, limit: int = 20, **wanted) -> DataFrame:
    """Chunks of the active generation that equal the given fields and whose path holds the needle, case aside."""
    from .predicates import manifest_chunks

    found = manifest_chunks(chunks, active, **wanted).where(F.contains(F.lower("path"), F.lit(needle.lower())))
    return found.orderBy("path", "chunk_id").limit(limit)


def glob(path: Column, pattern: str) -> Column:
    """Whether a path matches a glob: * and ? within a folder, ** across folders."""
    import re

    parts = re.split(r"(\*\*|\*|\?)", pattern)
    rule = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
    return path.rlike("^" + "".join(rule.get(x) or re.sub(r"([^\w/ -])", r"\\\1", x) for x in parts) + "$")


def search_turns(turns: DataFrame, needle: str, role: str = "", limit: int = 20) -> DataFrame:
    """The latest turns(conv_id, turn, role, text) that contain the needle, case aside, of a role if given."""
    from .predicates import like_any

    found = turns.where(like_any(needle, "text"))
    found = found.where(F.col("role") == role) if role else found
    return found.orderBy(F.desc("conv_id"), F.desc("turn")).limit(limit)


# fixed values: what a category of findings asks to change, how by default, and the risk by severity
TARGETS = {"missed_recall": "project_agents", "blind_save": "project_agents", "duplicate_save": "memory_policy", "wrong_room_hall": "memory_policy", "noisy_memory": "memory_policy", "scaffold_recommendation": "project_agents"}
CHANGES = {
    "missed_recall": "Clarify consult-before-write rules in the project memory scaffold.", "blind_save": "Clarify consult-before-write rules in the project memory scaffold.", "duplicate_save": "Clarify duplicate-check and update-vs-new-memory policy.",
    "wrong_room_hall": "Clarify project room taxonomy and allowed hall vocabulary.", "noisy_memory": "Clarify do-not-save rules and wake_up pin discipline.", "": "Review and refine the project memory scaffold.",
}
RISKS = {"high": "High behavior impact; requires careful human review before applying.", "low": "Low risk; wording-only scaffold change.", "": "Medium risk; may change agent memory behavior."}


def proposals(findings: DataFrame) -> DataFrame:
    """(digest, target, collection, summary, current_problem, proposed_change, risk, status, source_run_id, finding_ids, created_at, updated_at).

    Of ``findings(id, run_id, collection, category, severity, summary, evidence, recommendation, at)``: those whose category
    asks for a change, one proposal a digest, the first finding's run and risk, and all their ids in order.  Texts are cut at 500,
    1000 and 1200 characters.
    """
    named = lambda table, c, rest=None: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in table.items() if k for x in (k, v)]), c), F.lit(rest))
    cut = lambda c, n: F.substring(F.btrim(c, F.lit(" \t\n\r\x0b\x0c")), 1, n)
    given = lambda c, other: F.when(F.btrim(F.coalesce(c, F.lit("")), F.lit(" \t\n\r\x0b\x0c")) != "", c).otherwise(other)
    rows = findings.withColumn("target", named(TARGETS, F.col("category"))).where("target is not null")
    rows = rows.select(
        "target", F.coalesce("collection", F.lit("")).alias("collection"), cut(given(F.col("summary"), F.concat(F.lit("Improve memory scaffold for "), "category")), 500).alias("summary"),
        cut(F.coalesce("evidence", F.lit("")), 1000).alias("current_problem"), cut(given(F.col("recommendation"), named(CHANGES, F.col("category"), CHANGES[""])), 1200).alias("proposed_change"),
        named(RISKS, F.lower("severity"), RISKS[""]).alias("risk"), F.col("run_id").alias("source_run_id"), F.trim("id").alias("id"), "at",
    )
    key = ["target", "collection", "summary", "current_problem", "proposed_change"]
    rows = rows.withColumn("digest", F.sha2(F.concat_ws("\x00", *key), 256))
    once = rows.groupBy("digest", "id").agg(F.min(F.struct("at", "source_run_id", "risk")).alias("first"), F.max("at").alias("last"), *(F.first(c).alias(c) for c in key))
    each = once.groupBy("digest", *key).agg(F.array_sort(F.collect_list(F.struct(F.col("first.at").alias("at"), "id", F.col("first.source_run_id").alias("run"), F.col("first.risk").alias("risk")))).alias("f"), F.max("last").alias("updated_at"))
    return each.select("digest", *key, F.col("f")[0]["risk"].alias("risk"), F.lit("open").alias("status"), F.col("f")[0]["run"].alias("source_run_id"), F.filter(F.transform("f", lambda x: x["id"]), lambda i: i != "").alias("finding_ids"), F.col("f")[0]["at"].alias("created_at"), "updated_at")
