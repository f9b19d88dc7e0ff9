"""Aggregates over events, sessions, feedback, memories."""

from pyspark.sql import functions as F

from ..operators import analytics, memory, records, routes
from ..operators.predicates import memory_scope
from ..registry import query
from ..streaming import machines
from .base import GRAPH, MANIFEST, MEMORIES, graph_edges, graph_nodes, manifest, memories, table


def audit(spark, sf):
    """Events as audit rows: tool, outcome, latency and the ids that group them."""
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), "ts", F.expr("if(user_id % 3 = 0, concat('t', user_id), '')").alias("trace_id"), F.expr("if(user_id % 3 = 1, concat('s', user_id), '')").alias("session_id"),
        F.expr("concat('client', user_id % 4)").alias("client"), F.expr("concat('coll', user_id % 2)").alias("collection"), F.col("event_type").alias("tool"),
        F.expr("if(event_type = 'error', 'error', 'ok')").alias("outcome"), F.col("value").alias("latency"), F.expr("value < 5").alias("zero"),
    )


AUDIT = """a AS (SELECT event_id AS id, ts, CASE WHEN user_id % 3 = 0 THEN 't' || user_id ELSE '' END AS trace_id, CASE WHEN user_id % 3 = 1 THEN 's' || user_id ELSE '' END AS session_id, 'client' || (user_id % 4) AS client,
  'coll' || (user_id % 2) AS collection, event_type AS tool, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS outcome, value AS latency, value < 5 AS zero FROM events)"""
KEY = "CASE WHEN trace_id <> '' THEN 'trace:' || trace_id WHEN session_id <> '' THEN 'session:' || session_id ELSE 'window:' || client || ':' || collection || ':' || floor(epoch(ts) / 1800)::BIGINT END"


def _pct(p):
    return f"list_sort(list(latency))[floor((count(*) - 1) * {p})::BIGINT + 1]"


@query("audit_summary", f"WITH {AUDIT} SELECT tool, count(*) AS calls, count(*) FILTER (outcome = 'error') AS errors, round(avg(zero::INT), 6) AS zero_rate, {_pct(0.5)} AS p50, {_pct(0.95)} AS p95, {_pct(0.99)} AS p99 FROM a GROUP BY tool")
def audit_summary(spark, sf):
    return analytics.audit_summary(audit(spark, sf), "tool")


@query("trajectories", f"""WITH {AUDIT}, k AS (SELECT *, {KEY} AS key FROM a) SELECT key, count(*) AS events, count(*) FILTER (outcome = 'error') AS errors, count(*) FILTER (zero) AS zeros,
min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT tool) AS tools FROM k GROUP BY key""")
def trajectories(spark, sf):
    return analytics.trajectories(audit(spark, sf))


@query("behaviour_summary", f"""WITH {AUDIT}, k AS (SELECT *, {KEY} AS key FROM a), f AS (SELECT *, coalesce(max((tool = 'view')::INT) OVER (PARTITION BY key ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS consulted FROM k),
t AS (SELECT key, max((outcome = 'error')::INT) AS err, count(*) AS n, count(*) FILTER (tool = 'purchase') AS saves, count(*) FILTER (tool = 'purchase' AND consulted = 1) AS informed, count(*) FILTER (zero) AS zeros,
  count(*) FILTER (tool = 'view') AS asks, count(*) FILTER (tool = 'view' AND zero) AS empty FROM f GROUP BY key)
SELECT count(*) AS traces, sum(n)::BIGINT AS events, round(avg(err), 6) AS error_rate, sum(saves)::BIGINT AS saves, sum(informed)::BIGINT AS informed, round(sum(informed) / sum(saves), 6) AS recall_before_save_rate, round(sum(zeros) / sum(n), 6) AS zero_result_rate,
  round(sum(empty) / sum(asks), 6) AS empty_recall_rate, round((sum(saves) + sum(asks)) / count(*), 6) AS memory_ops_per_trace, count(*) FILTER (saves > informed) AS blind_traces FROM t""")
def behaviour_summary(spark, sf):
    return analytics.behaviour(audit(spark, sf), "view", "purchase")


@query("routing_weights", """WITH f AS (SELECT event_type AS search_type, (event_id % 5 + 1) AS rating FROM events), s AS (SELECT search_type, count(*) AS total, avg((rating >= 4)::INT) AS rate FROM f GROUP BY search_type)
SELECT search_type, total, round(least(greatest(1 + 0.1 * total * (rate - 0.5), 0.5), 1.5), 6) AS weight FROM s""")
def routing_weights(spark, sf):
    rated = table(spark, sf, "events").select(F.col("event_type").alias("search_type"), (F.col("event_id") % 5 + 1).alias("rating"))
    return analytics.routing_weights(rated)


@query("user_buckets", "WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, user_id) AS pos FROM c) SELECT CASE WHEN pos <= 10 THEN user_id::VARCHAR ELSE 'other' END AS bucket, sum(n)::BIGINT AS n FROM r GROUP BY 1")
def user_buckets(spark, sf):
    return analytics.top_buckets(table(spark, sf, "events"), "user_id", 10)


def rated(spark, sf):
    return table(spark, sf, "events").selectExpr("event_id as id", "event_type as search_type", "event_id % 5 + 1 as rating")


@query("feedback_stats", "SELECT event_type AS search_type, count(*) AS n, round(avg(event_id % 5 + 1), 6) AS avg_rating, arg_min(event_id, (event_id % 5, event_id)) AS worst FROM events GROUP BY event_type")
def feedback_stats(spark, sf):
    return analytics.feedback_stats(rated(spark, sf))


@query("feedback_worst", "SELECT event_id AS id, event_id % 5 + 1 AS rating FROM events WHERE event_type = 'click' ORDER BY 2, 1 LIMIT 5")
def feedback_worst(spark, sf):
    return rated(spark, sf).where("search_type = 'click'").orderBy("rating", "id").limit(5).select("id", "rating")


@query("implicit_feedback", "SELECT event_type AS signal, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def implicit_feedback(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("signal")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("sessions", "SELECT user_id AS session, count(*) AS n, max(ts) AS last_at, max(event_type) AS type FROM events GROUP BY user_id ORDER BY max(ts) DESC, user_id LIMIT 100")
def sessions(spark, sf):
    return memory.sessions(table(spark, sf, "events"), "user_id", "ts", "event_type", 100)


@query("memory_staleness", f"WITH {MEMORIES} SELECT room, min(updated_at) AS oldest, count(*) AS n FROM memories WHERE superseded_by = '' GROUP BY room")
def memory_staleness(spark, sf):
    return memory.staleness(memories(spark, sf))


@query("wakeup_pinned", f"WITH {MEMORIES} SELECT id, key, pin_priority FROM memories WHERE is_pinned AND owner_id IN ('u2', '') AND superseded_by = '' AND collection_name = 'coll2' ORDER BY pin_priority DESC, updated_at DESC, id LIMIT 50")
def wakeup_pinned(spark, sf):
    return memory.pinned(memories(spark, sf), "u2", "coll2").select("id", "key", "pin_priority")


@query("wakeup_entities", f"""WITH {GRAPH} SELECT name, type, (SELECT count(*) FROM edges e WHERE (e.source_id = n.id OR e.target_id = n.id) AND (e.valid_until IS NULL OR e.valid_until > TIMESTAMP '1997-06-01')) AS edges
FROM nodes n WHERE dataset_id = 'MACHINERY' ORDER BY edges DESC, id LIMIT 10""")
def wakeup_entities(spark, sf):
    return memory.busiest(graph_nodes(spark, sf), graph_edges(spark, sf), "MACHINERY", F.expr("timestamp_ntz'1997-06-01 00:00:00'"), 10)


@query("sync_manifest", f"WITH {MEMORIES} SELECT count(*) AS n, max(updated_at) AS newest, count(DISTINCT owner_id) AS owners FROM memories")
def sync_manifest(spark, sf):
    return memory.sync_state(memories(spark, sf), "updated_at", "owner_id")


@query("vsa_stats", f"""WITH {GRAPH}, m AS (SELECT *, (row_number() OVER (PARTITION BY relation ORDER BY source_id, target_id, id) - 1) // 12 AS shard FROM edges WHERE valid_until IS NULL)
SELECT relation, count(DISTINCT shard) AS shards, count(*) AS members, count(DISTINCT source_id) AS sources FROM m GROUP BY relation""")
def vsa_stats(spark, sf):
    s = records.shards(graph_edges(spark, sf).where("valid_until is null"))
    return s.groupBy("relation").agg(F.countDistinct("shard").alias("shards"), F.count("*").alias("members"), F.countDistinct("source_id").alias("sources"))


@query("ordered_dedup", """WITH f AS (SELECT user_id, event_type, min(ts) AS ts, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL)
SELECT user_id, list(event_type ORDER BY ts, event_id) AS "values" FROM f GROUP BY user_id""")
def ordered_dedup(spark, sf):
    """What each user did, each kind once, in order of its first time."""
    return analytics.ordered_distinct(table(spark, sf, "events"), "user_id", "event_type", ["ts", "event_id"])


@query("sketched_quantiles", """WITH e AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, n, r AS rank, max(value) FILTER (i = greatest(1, ceil(n * r)::BIGINT)) AS exact, true AS within FROM e, (VALUES (0.05::DOUBLE), (0.5), (0.95)) q(r) GROUP BY event_type, n, r""")
def sketched_quantiles(spark, sf):
    """Quantiles of each kind's values from one sketch a day, beside the exact ones: within 1 % of the rank."""
    e = table(spark, sf, "events").where("value is not null")
    daily = analytics.quantile_sketches(e.withColumn("day", F.to_date("ts")), ["event_type", "day"], "value")
    found = analytics.sketch_quantiles(daily, ["event_type"], [0.05, 0.5, 0.95])
    place = e.select("event_type", F.col("value").alias("v")).join(found, "event_type").groupBy("event_type", "n", "rank").agg(F.avg((F.col("v") <= F.col("value")).cast("double")).alias("at"))
    exact = e.groupBy("event_type").agg(F.expr("array(percentile_disc(0.05D) within group (order by value), percentile_disc(0.5D) within group (order by value), percentile_disc(0.95D) within group (order by value))").alias("x"))
    each = exact.select("event_type", F.posexplode("x").alias("i", "exact")).withColumn("rank", F.expr("element_at(array(0.05D, 0.5D, 0.95D), i + 1)"))
    return place.join(each, ["event_type", "rank"]).select("event_type", "n", "rank", "exact", (F.abs(F.col("at") - F.col("rank")) < 0.01).alias("within"))


@query("job_outcomes", """WITH e AS (SELECT user_id::VARCHAR AS memory_id, 'index' AS operation, strftime(ts, '%Y-%m-%d') AS digest, event_type, ts FROM events),
b AS (SELECT memory_id, operation, digest, ts, bool_or(event_type = 'purchase') AS ok FROM e WHERE event_type IN ('purchase', 'error') GROUP BY ALL),
a AS (SELECT *, row_number() OVER (PARTITION BY memory_id, digest ORDER BY ts) AS place FROM b),
j AS (SELECT memory_id, digest, min(place) FILTER (ok) AS first_ok, count(*) AS n, max(ts) AS last FROM a GROUP BY ALL),
k AS (SELECT DISTINCT memory_id, operation, digest FROM e WHERE event_type IN ('view', 'signup'))
SELECT memory_id, operation, digest, CASE WHEN coalesce(n, 0) >= 2 AND coalesce(first_ok, 3) > 2 THEN 'dead_letter' WHEN first_ok IS NOT NULL THEN 'completed' WHEN n > 0 THEN 'failed' ELSE 'pending' END AS status,
  CASE WHEN coalesce(n, 0) >= 2 AND coalesce(first_ok, 3) > 2 THEN 2 ELSE coalesce(first_ok, n, 0) END::INT AS attempts,
  CASE WHEN n < 2 AND first_ok IS NULL THEN last + INTERVAL 30 SECOND END AS next_run_at FROM k LEFT JOIN j USING (memory_id, digest)""")
def job_outcomes(spark, sf):
    """Each user's jobs of a day: views and sign-ups ask for one, purchases and errors end its attempts, two at most."""
    kind = F.expr("case event_type when 'purchase' then 'ok' when 'error' then 'error' when 'click' then 'claim' else 'enqueue' end")
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("memory_id"), F.lit("index").alias("operation"), F.date_format("ts", "yyyy-MM-dd").alias("digest"), kind.alias("kind"), F.col("ts").alias("at"))
    return machines.job_outcomes(e, most=2)


@query("outbox_counts", "SELECT CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'completed' ELSE 'failed' END AS status, count(*) AS jobs FROM orders GROUP BY 1")
def outbox_counts(spark, sf):
    jobs = table(spark, sf, "orders").select(F.expr("case o_orderstatus when 'O' then 'pending' when 'F' then 'completed' else 'failed' end").alias("status"))
    return jobs.groupBy("status").agg(F.count("*").alias("jobs"))


@query("coverage_by_collection", """SELECT source, count(*) AS items, count(*) FILTER (doc_id IN (SELECT vec_id FROM embeddings)) AS vectors, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS labelled FROM documents GROUP BY source""")
def coverage_by_collection(spark, sf):
    v, m = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id")), table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return memory.coverage(table(spark, sf, "documents"), "source", "doc_id", vectors=v, labelled=m)


@query("dataset_counts", "SELECT s.source AS dataset, (SELECT count(*) FROM documents d WHERE d.source = s.source AND lang = 'en') AS items FROM (SELECT DISTINCT source FROM documents) s")
def dataset_counts(spark, sf):
    """Datasets with their English items, those without any too."""
    d = table(spark, sf, "documents")
    n = d.where("lang = 'en'").groupBy(F.col("source").alias("dataset")).agg(F.count("*").alias("n"))
    return d.select(F.col("source").alias("dataset")).distinct().join(n, "dataset", "left").select("dataset", F.coalesce("n", F.lit(0)).alias("items"))


@query("predicate_list", f"WITH {GRAPH} SELECT DISTINCT relation AS predicate FROM edges WHERE valid_until IS NULL UNION SELECT DISTINCT upper(type) FROM nodes WHERE type <> ''")
def predicate_list(spark, sf):
    shards = graph_nodes(spark, sf).select(F.upper("type").alias("predicate"), "dataset_id")
    return memory.predicates(graph_edges(spark, sf), shards)


@query("char_density", """WITH m AS (SELECT doc_id, strlen(text) AS size, md5(text) AS h FROM documents), c AS (SELECT h, min(doc_id) AS action, max(doc_id) AS survivor FROM m GROUP BY h HAVING count(*) > 1)
SELECT action, round(any_value(CASE WHEN doc_id = survivor THEN size END)::DOUBLE / sum(size), 6) AS density FROM m JOIN c USING (h) GROUP BY action HAVING sum(size) > 0""")
def char_density(spark, sf):
    """Merges of equal documents: the survivor's bytes over all."""
    d = table(spark, sf, "documents").selectExpr("doc_id as id", "text as value", "md5(text) as h")
    groups = d.groupBy("h").agg(F.min("id").alias("action"), F.max("id").alias("survivor"), F.count("*").alias("n")).where("n > 1")
    return memory.density(d.join(groups, "h").select("action", "survivor", "id"), d)


@query("task_validation", """WITH r AS (SELECT l_orderkey AS criterion, l_returnflag = 'R' OR (l_linenumber = 1 AND l_quantity > 40) AS bad, l_linestatus = 'F' AS old FROM lineitem)
SELECT o_orderkey AS criterion, CASE WHEN o_orderkey IN (SELECT criterion FROM r WHERE NOT bad AND NOT old) THEN 'found' WHEN o_orderkey IN (SELECT criterion FROM r WHERE NOT bad AND old) THEN 'stale'
WHEN o_orderkey IN (SELECT criterion FROM r WHERE bad) THEN 'failed' ELSE 'missing' END AS state FROM orders""")
def task_validation(spark, sf):
    """Orders as criteria, their lines as receipts: returned ones fail, first lines are commands, status F is an older revision."""
    receipts = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey as criterion", "if(l_returnflag = 'R', 'fail', 'pass') as status", "if(l_linenumber = 1, 'command', 'note') as type", "if(l_quantity > 40, 1, 0) as exit_code", "if(l_linestatus = 'F', 'r1', 'r2') as revision")
    return memory.validation(table(spark, sf, "orders").select(F.col("o_orderkey").alias("criterion")), receipts, "r2")


@query("project_context", f"""WITH {MEMORIES}, m AS (SELECT 'memory' AS kind, id FROM memories WHERE owner_id = 'u1' ORDER BY updated_at DESC, id LIMIT 20), c AS (SELECT 'chat' AS kind, conv_id * 1000 + turn AS id FROM conversations ORDER BY conv_id DESC, turn DESC LIMIT 5)
SELECT * FROM m UNION ALL SELECT * FROM c""")
def project_context(spark, sf):
    """An owner's newest memories and the last chat turns."""
    chat = table(spark, sf, "conversations").orderBy(F.desc("conv_id"), F.desc("turn")).limit(5).selectExpr("'chat' as kind", "conv_id * 1000 + turn as id")
    return memory.newest(memories(spark, sf), "u1").select(F.lit("memory").alias("kind"), "id").union(chat)


@query("chat_history", "WITH r AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) SELECT conv_id, turn, role, p - greatest(n - 5, 0) AS place FROM r WHERE p > n - 5")
def chat_history(spark, sf):
    """The last five turns of each conversation, replayed oldest first."""
    return memory.last_turns(table(spark, sf, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role", "place")


@query("token_budget", "SELECT doc_id FROM documents d WHERE (SELECT sum(n_chars) FROM documents x WHERE x.doc_id <= d.doc_id) <= 50000")
def token_budget(spark, sf):
    """Documents, in order, while their characters fit."""
    return memory.within_budget(table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 50_000, 1000).select("doc_id")


@query("gc_plan", f"""WITH {MANIFEST} SELECT collection, CASE WHEN collection = '' THEN 'vectors' WHEN collection IN (SELECT collection FROM manifest WHERE generation <> 'g1') THEN 'shared' ELSE 'exclusive' END AS plan, count(*) AS vectors
FROM manifest WHERE generation = 'g1' GROUP BY 1, 2""")
def gc_plan(spark, sf):
    return memory.gc_plan(manifest(spark, sf), spark.createDataFrame([("g1",)], "generation string"), "g0")


DCD = "tell me about asia: nation 1 and nation 12, please"


@query("dcd_routes", """WITH t AS (SELECT n_regionkey AS domain_id, n_nationkey AS collection_id, lower(r_name) AS d, replace(lower(n_name), '_', ' ') AS c, r_name || ' ' || n_name AS text FROM nation JOIN region ON r_regionkey = n_regionkey),
s AS (SELECT domain_id, collection_id, CASE WHEN d = 'asia' THEN 4.5 ELSE 0 END + CASE WHEN contains('tell me about asia nation 1 and nation 12 please', c) THEN 3 ELSE 0 END
  + 0.4 * len(list_filter(list_distinct(string_split(c, ' ')), lambda w: strlen(w) >= 2 AND list_contains(['tell', 'me', 'about', 'asia', 'nation', 'and', '12', 'please'], w))) AS score FROM t)
SELECT domain_id, collection_id, round(score, 6)::DOUBLE AS score, round(least(score / 10, 1), 6)::DOUBLE AS confidence FROM s WHERE score > 0""")
def dcd_routes(spark, sf):
    """Regions and nations as domains and collections, by names and words alone."""
    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), F.expr("n_regionkey = r_regionkey")).selectExpr("n_regionkey as domain_id", "n_nationkey as collection_id", "r_name as domain", "n_name as collection")
    return routes.route_scores(rows, DCD, with_bm25=False).select("domain_id", "collection_id", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"))


@query("predicate_ranking", """-- words in the query, exact and generated, and pairs of words one of which holds the other, for both
SELECT * FROM (VALUES ('LIVES_IN', (3 * (100 + 50) + 2 * 4 * 20)::BIGINT), ('IN_REGION', 2 * (100 + 50) + 2 * 2 * 20), ('BASED_IN', 100 + 50), ('PREFERS', 0)) AS t(predicate, score)""")
def predicate_ranking(spark, sf):
    """'who lives in regions' asks for who, lives, live, in, regions, region."""
    names = graph_edges(spark, sf).select(F.col("relation").alias("predicate")).distinct()
    synonyms = spark.createDataFrame([("LIVES_IN", "resides", routes.MANUAL), ("IN_REGION", "area", routes.FEEDBACK)], "predicate string, synonym string, weight int")
    return routes.rank_predicates(names, synonyms, "who lives in regions")


@query("repeat_saves", "SELECT event_id AS id, count(*) OVER (PARTITION BY user_id % 2, floor(value) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS repeat FROM events WHERE event_type = 'purchase'")
def repeat_saves(spark, sf):
    """Purchases as saves, their whole value as the key."""
    e = table(spark, sf, "events").where("event_type = 'purchase'").selectExpr("event_id as id", "ts", "user_id % 2 as collection", "floor(value) as key")
    return analytics.repeat_saves(e, "key").select("id", "repeat")


@query("cache_hit_rates", "SELECT event_type AS model, count(*) FILTER (value > 30) AS hits, count(*) FILTER (value <= 30) AS misses, round(avg((value > 30)::INT), 6) AS rate FROM events GROUP BY 1")
def cache_hit_rates(spark, sf):
    return analytics.hit_rates(table(spark, sf, "events").selectExpr("event_type as model", "value > 30 as hit"), "model")


@query("session_context", f"""WITH {MEMORIES}, p AS (SELECT 'pinned' AS kind, id FROM memories WHERE is_pinned AND owner_id IN ('u1', '') AND superseded_by = '' ORDER BY pin_priority DESC, updated_at DESC, id LIMIT 10),
m AS (SELECT 'recent' AS kind, id FROM memories WHERE owner_id = 'u1' ORDER BY updated_at DESC, id LIMIT 10), t AS (SELECT 'turn' AS kind, conv_id * 1000 + turn AS id FROM conversations WHERE conv_id = 3 ORDER BY turn DESC LIMIT 5) SELECT * FROM p UNION ALL SELECT * FROM m UNION ALL SELECT * FROM t""")
def session_context(spark, sf):
    """What a session begins with: pinned memories, the newest ones, and the conversation's last turns."""
    turns = memory.last_turns(table(spark, sf, "conversations").where("conv_id = 3"), "conv_id", "turn").selectExpr("'turn' as kind", "conv_id * 1000 + turn as id")
    m = memories(spark, sf)
    kind = lambda d, k: d.select(F.lit(k).alias("kind"), "id")
    return kind(memory.pinned(m, "u1", limit=10), "pinned").union(kind(memory.newest(m, "u1", 10), "recent")).union(turns)


@query("list_memories", f"WITH {MEMORIES} SELECT id, key, room, hall FROM memories WHERE owner_id IN ('u2', '') AND hall = 'fact' AND superseded_by = '' ORDER BY updated_at DESC, id LIMIT 20 OFFSET 20")
def list_memories(spark, sf):
    """A page of a scope's live memories of one kind."""
    return memory.page(memory_scope(memories(spark, sf), "u2", hall="fact"), 20, 20).select("id", "key", "room", "hall")


@query("memory_reviews", f"WITH {MEMORIES} SELECT room, count(*) FILTER (updated_at < TIMESTAMP '1995-01-01') AS stale, count(*) FILTER (hall NOT IN ('fact', 'event')) AS other_halls, count(*) AS n FROM memories WHERE superseded_by = '' GROUP BY room")
def memory_reviews(spark, sf):
    """What of each room should be looked at: old memories, and halls out of the vocabulary given."""
    return memory.reviews(memories(spark, sf), F.expr("timestamp_ntz'1995-01-01 00:00:00'"), ("fact", "event"))


KINDS = ["missed_recall", "blind_save", "duplicate_save", "wrong_room_hall", "noisy_memory", "scaffold_recommendation", "praise"]


@query("scaffold_proposals", f"""WITH f AS (SELECT 'f' || o_orderkey AS id, 'run' || o_custkey % 11 AS run_id, 'k' || o_custkey % 5 AS collection, ({KINDS})[o_orderkey % 7 + 1] AS category, (['HIGH', 'low', 'medium'])[o_orderkey % 3 + 1] AS severity,
  CASE WHEN o_orderkey % 2 = 0 THEN ' ' ELSE o_orderpriority END AS summary, o_orderstatus AS evidence, CASE WHEN o_orderkey % 3 = 0 THEN 'Say when.' ELSE '' END AS recommendation, o_orderdate AS ts FROM orders),
p AS (SELECT CASE WHEN category IN ('missed_recall', 'blind_save', 'scaffold_recommendation') THEN 'project_agents' ELSE 'memory_policy' END AS target, collection, CASE WHEN trim(summary) = '' THEN 'Improve memory scaffold for ' || category ELSE summary END AS summary,
  evidence AS current_problem, CASE WHEN recommendation <> '' THEN recommendation WHEN category IN ('missed_recall', 'blind_save') THEN 'Clarify consult-before-write rules in the project memory scaffold.' WHEN category = 'duplicate_save' THEN 'Clarify duplicate-check and update-vs-new-memory policy.'
    WHEN category = 'wrong_room_hall' THEN 'Clarify project room taxonomy and allowed hall vocabulary.' WHEN category = 'noisy_memory' THEN 'Clarify do-not-save rules and wake_up pin discipline.' ELSE 'Review and refine the project memory scaffold.' END AS proposed_change,
  CASE lower(severity) WHEN 'high' THEN 'High behavior impact; requires careful human review before applying.' WHEN 'low' THEN 'Low risk; wording-only scaffold change.' ELSE 'Medium risk; may change agent memory behavior.' END AS risk, run_id, id, ts FROM f WHERE category <> 'praise')
SELECT sha256(target || chr(0) || collection || chr(0) || summary || chr(0) || current_problem || chr(0) || proposed_change) AS digest, target, collection, summary, current_problem, proposed_change, arg_min(risk, (ts, id)) AS risk, 'open' AS status,
  arg_min(run_id, (ts, id)) AS source_run_id, list(id ORDER BY ts, id) AS finding_ids, min(ts) AS created_at, max(ts) AS updated_at FROM p GROUP BY ALL""")
def scaffold_proposals(spark, sf):
    """Proposals to change the scaffold, by digest, of findings made of orders."""
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    found = table(spark, sf, "orders").selectExpr(
        "concat('f', o_orderkey) as id", "concat('run', o_custkey % 11) as run_id", "concat('k', o_custkey % 5) as collection", f"element_at(array({kinds}), int(o_orderkey % 7) + 1) as category", "element_at(array('HIGH', 'low', 'medium'), int(o_orderkey % 3) + 1) as severity",
        "if(o_orderkey % 2 = 0, ' ', o_orderpriority) as summary", "o_orderstatus as evidence", "if(o_orderkey % 3 = 0, 'Say when.', '') as recommendation", "o_orderdate as at",
    )
    return memory.proposals(found)


@query("task_promotion", "SELECT DISTINCT l_orderkey AS task FROM lineitem GROUP BY l_orderkey HAVING bool_and(l_linestatus = 'O') AND count(*) FILTER (l_returnflag = 'R') = 0")
def task_promotion(spark, sf):
    """Tasks all of whose steps passed and that nothing blocks: open lines, none returned."""
    lines = table(spark, sf, "lineitem")
    return memory.promotable(lines.selectExpr("l_orderkey as task", "l_linestatus = 'O' as passed"), lines.where("l_returnflag = 'R'").selectExpr("l_orderkey as task")).select("task")


@query("reembed_plan", "SELECT 'c' || label AS collection, count(*) FILTER (vec_id % 3 <> 0) AS todo, count(*) FILTER (vec_id % 3 = 0) AS done, count(*) FILTER (vec_id % 3 <> 0) = 0 AS ready FROM embeddings GROUP BY label")
def reembed_plan(spark, sf):
    """Collections on their way to a new encoder: every third record is there."""
    v = table(spark, sf, "embeddings").selectExpr("concat('c', label) as collection", "vec_id as id")
    return memory.migration(v, v.where("id % 3 = 0"))


@query("workspace_search", f"""WITH {MANIFEST} SELECT chunk_id, path FROM manifest WHERE generation = 'g0' AND branch = 'main' AND contains(path, 'f1') ORDER BY path, chunk_id LIMIT 20""")
def workspace_search(spark, sf):
    """Active chunks of a branch whose path holds a word."""
    return memory.workspace_search(manifest(spark, sf), "g0", "f1", branch="main").select("chunk_id", "path")


@query("artifact_filter", f"WITH {MANIFEST} SELECT path, count(*) AS chunks FROM manifest WHERE generation = 'g0' AND regexp_matches(path, '^src/Brand#1[^/]*/f[^/]*\\.md$') GROUP BY path")
def artifact_filter(spark, sf):
    """Paths by a glob."""
    m = manifest(spark, sf).where("generation = 'g0'")
    return m.where(memory.glob(F.col("path"), "src/Brand#1*/f*.md")).groupBy("path").agg(F.count("*").alias("chunks"))


@query("search_chats", "SELECT conv_id, turn, role FROM conversations WHERE contains(lower(text), 'tion') AND role = 'user' ORDER BY conv_id DESC, turn DESC LIMIT 20")
def search_chats(spark, sf):
    """The latest turns of one role that hold a needle."""
    return memory.search_turns(table(spark, sf, "conversations"), "TION", "user", 20).select("conv_id", "turn", "role")
