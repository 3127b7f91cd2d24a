"""Queries over keyed state, in batch and as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from plansift.functions.geo import coordinate
from plansift.operators import state
from plansift.plans.base import joined, query, table
from plansift.sources.shared import shared_base
from plansift.streaming import sessions


def _folder(spark) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_base(spark)}/stream-{uuid.uuid4().hex}"


@query("""
    WITH g AS (SELECT *, CASE WHEN epoch(date_trunc('second', ts)) - epoch(date_trunc('second', lag(ts) OVER w)) > 86400 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    p AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS part FROM g),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r, max(part) OVER (PARTITION BY user_id) AS top FROM p)
    SELECT user_id, array_to_string(list(event_id ORDER BY ts, event_id), ',') AS history, max(ts) AS last FROM r WHERE r <= 10 AND part = top GROUP BY user_id""")
def session_last10(spark, d):
    return state.last_turns(table(spark, d, "events"), "user_id", "ts", "event_id", ttl=state.SESSION_TTL).withColumn("history", joined("history"))


@query()
def session_state_stream(spark, d):
    """The same histories by a stateful stream over the events file."""
    own = _streaming(spark)
    schema = table(spark, d, "events").schema
    stream = own.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(_stream_path(d, "events"))
    rows = sessions.drained(sessions.last_turns(stream, "user_id", "ts", "event_id"), _folder(spark), "update")
    newest = Window.partitionBy("key").orderBy(F.desc("batch"))
    rows = rows.withColumn("r", F.row_number().over(newest)).filter("r = 1 and size(history) > 0")
    return rows.select(F.col("key").alias("user_id"), joined("history"), "last")


def _streaming(spark):
    """A session of its own for a stateful stream, so that the caller's settings stay as they are."""
    own = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.checkpoint.dir"):
        if (value := spark.conf.get(name, None)) is not None:
            try:
                own.conf.set(name, value)
            except AnalysisException:  # a static setting, which all sessions share
                pass
    own.conf.set("spark.sql.streaming.stateStore.providerClass", sessions.STORE)
    return own


_CACHE = """
    WITH e AS (SELECT *, ['geocode', 'route', 'places', 'other'][event_id % 4 + 1] AS kind FROM events),
    w AS (SELECT user_id, ts, event_id, 'f' || event_id AS payload, event_type = 'error' AS negative, CASE WHEN event_type = 'error' THEN CASE kind WHEN 'places' THEN 600 ELSE 30 END WHEN kind = 'geocode' THEN 2592000 ELSE 86400 END AS ttl FROM e WHERE event_type IN ('error', 'purchase')),
    r AS (SELECT * FROM e WHERE event_type = 'view'),
    j AS (SELECT r.user_id, r.event_id AS read_id, r.ts, w.ts AS wts, w.payload, w.negative, w.ttl, row_number() OVER (PARTITION BY r.event_id ORDER BY w.ts DESC, w.event_id DESC) AS n FROM r LEFT JOIN w ON w.user_id = r.user_id AND w.ts <= r.ts)
    SELECT user_id, read_id, coalesce(NOT negative AND epoch_us(ts) - epoch_us(wts) <= CAST(ttl AS BIGINT) * 1000000, false) AS hit, CASE WHEN NOT negative AND epoch_us(ts) - epoch_us(wts) <= CAST(ttl AS BIGINT) * 1000000 THEN payload END AS payload FROM j WHERE n = 1"""


def _facts(events):
    """Events as reads (views) and writes (purchases, and errors as failures) of facts of four kinds."""
    kind = F.element_at(F.array(*map(F.lit, ("geocode", "route", "places", "other"))), (F.col("event_id") % 4 + 1).cast("int"))
    negative = F.col("event_type") == "error"
    return events.filter(F.col("event_type").isin("view", "error", "purchase")).select("user_id", "ts", F.col("event_id").alias("id"), (F.col("event_type") == "view").alias("is_read"), F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("payload"), negative.alias("negative"), state.fact_ttl(kind, negative).alias("ttl_s"))


@query(_CACHE)
def fact_cache_stream(spark, d):
    """Reads of a cache of facts, answered by a stateful stream."""
    stream = _streaming(spark).readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "*.parquet").parquet(_stream_path(d, "events"))
    return sessions.drained(sessions.fact_cache(_facts(stream), "user_id", "ts"), _folder(spark), "append").withColumnRenamed("key", "user_id")


@query("""
    SELECT conv_id, turn, substring(text, 1, 500) AS text, coalesce(array_to_string(list(role || '=' || substring(text, 1, 300)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), ' | '), '') AS context FROM conversations""")
def context_turns(spark, d):
    """Each turn with the three before it, texts cut."""
    rows = state.recent_context(table(spark, d, "conversations"), "conv_id", ["turn"], ["text", "role"])
    shown = F.transform("context", lambda t: F.concat(t["role"], F.lit("="), t["text"]))
    return rows.select("conv_id", "turn", "text", F.array_join(shown, " | ").alias("context"))


@query("""
    SELECT c_custkey, 'travel:v2:route:' || printf('%.6f,%.6f:%.6f,%.6f', c_custkey / 8.0 % 90, c_nationkey / 4.0, c_nationkey / 2.0, c_custkey / 16.0 % 180) || ':' || replace(lower(c_mktsegment), ' ', '_') || '_car' AS route_key,
           'travel:v2:places:overpass:hotel:' || printf('%.3f:%.3f', c_custkey / 8.0 % 90, c_nationkey / 4.0) || ':5000' AS places_key,
           CASE WHEN c_acctbal BETWEEN -180 AND 180 THEN c_acctbal END AS longitude
    FROM customer""")
def cache_keys(spark, d):
    c = table(spark, d, "customer")
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    origin, destination = (k / 8.0 % 90, n / 4.0), (n / 2.0, k / 16.0 % 180)
    said = F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit(" Car "))
    return c.select("c_custkey", state.route_key(origin, destination, said).alias("route_key"), state.places_key(F.lit("hotel"), *origin, F.lit(5000)).alias("places_key"), coordinate(F.col("c_acctbal").cast("string"), 180.0).alias("longitude"))


def _stream_path(d: str, name: str) -> str:
    # a glob, so that a table may be one file or a folder of files
    return f"{d.rstrip('/')}/{name}.parquet*"


_PATTERN = "(?i)" + "|".join(p for p in state.EMERGENCY)
_HURT = "(CASE WHEN {0} % 50 = 0 THEN {1} || ' Call an AMBULANCE now' WHEN {0} % 50 = 1 THEN {1} || ' self-harm' WHEN {0} % 50 = 2 THEN {1} || ' strokes endangered' ELSE {1} END)"


@query(f"""
    SELECT 'document' AS kind, doc_id AS id, 0 AS turn FROM documents WHERE regexp_matches({_HURT.format('doc_id', 'text')}, '{_PATTERN.replace("'", "''")}')
    UNION ALL SELECT 'conversation', conv_id, turn FROM conversations WHERE regexp_matches({_HURT.format('conv_id', 'text')}, '{_PATTERN.replace("'", "''")}')""")
def safety_gate(spark, d):
    hurt = lambda k, t: F.expr(_HURT.format(k, t))
    docs = table(spark, d, "documents").filter(state.is_urgent(hurt("doc_id", "text"))).select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("turn"))
    turns = table(spark, d, "conversations").filter(state.is_urgent(hurt("conv_id", "text"))).select(F.lit("conversation").alias("kind"), F.col("conv_id").alias("id"), "turn")
    return docs.unionByName(turns)


_EACH = " UNION ALL ".join(
    "SELECT kind, id, turn, '{0}' AS pattern FROM m WHERE regexp_matches(text, '(?i){0}')".format(p.replace("'", "''")) for p in state.EMERGENCY
)


@query(f"""
    WITH m AS (SELECT 'document' AS kind, doc_id AS id, 0 AS turn, {_HURT.format('doc_id', 'text')} AS text FROM documents UNION ALL SELECT 'conversation', conv_id, turn, {_HURT.format('conv_id', 'text')} FROM conversations)
    {_EACH}""")
def safety_hits(spark, d):
    """Which pattern hit in which message."""
    docs = table(spark, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("turn"), F.expr(_HURT.format("doc_id", "text")).alias("text"))
    turns = table(spark, d, "conversations").select(F.lit("conversation").alias("kind"), F.col("conv_id").alias("id"), "turn", F.expr(_HURT.format("conv_id", "text")).alias("text"))
    return state.urgent_hits(docs.unionByName(turns), "text").drop("text")


@query(f"SELECT conv_id, turn, role FROM conversations WHERE regexp_matches({_HURT.format('conv_id', 'text')}, '{_PATTERN.replace(chr(39), chr(39) * 2)}')")
def safety_stream(spark, d):
    schema = table(spark, d, "conversations").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(_stream_path(d, "conversations"))
    urgent = sessions.gate(stream.withColumn("text", F.expr(_HURT.format("conv_id", "text"))), "text").select("conv_id", "turn", "role")
    return sessions.drained(urgent, _folder(spark), "append")


@query(_CACHE)
def ttl_cache_asof(spark, d):
    """The batch twin of fact_cache_stream."""
    facts = _facts(table(spark, d, "events"))
    reads = facts.filter("is_read").select("user_id", "ts", F.col("id").alias("read_id"))
    writes = facts.filter("not is_read").select("user_id", "ts", "id", "payload", "negative", "ttl_s")
    return state.as_of(reads, writes, "user_id", "ts", tie="id")


@query("""
    WITH e AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END AS owner, ['geocode', 'route', 'places', 'other'][event_id % 4 + 1] AS kind FROM events),
    w AS (SELECT owner, ts, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) = 'error' AS negative, arg_max(CASE WHEN event_type = 'error' THEN CASE kind WHEN 'places' THEN 600 ELSE 30 END WHEN kind = 'geocode' THEN 2592000 ELSE 86400 END, event_id) AS ttl
          FROM e WHERE event_type IN ('error', 'purchase') GROUP BY owner, ts),
    j AS (SELECT r.owner, r.event_id AS read_id, NOT negative AND epoch_us(r.ts) - epoch_us(w.ts) <= CAST(ttl AS BIGINT) * 1000000 AS lives, w.event_id AS written FROM (SELECT * FROM e WHERE event_type = 'view') r ASOF LEFT JOIN w ON w.owner = r.owner AND r.ts >= w.ts)
    SELECT owner, read_id, coalesce(lives, false) AS hit, CASE WHEN lives THEN 'f' || written END AS payload FROM j""")
def ttl_cache_asof_hot(spark, d):
    """The cache with a third of all facts under one key, which is spread over many tasks."""
    facts = _facts(table(spark, d, "events")).withColumn("owner", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("user_id")))
    reads = facts.filter("is_read").select("owner", "ts", F.col("id").alias("read_id"))
    writes = facts.filter("not is_read").select("owner", "ts", "id", "payload", "negative", "ttl_s")
    return state.as_of(reads, writes, "owner", "ts", tie="id", spread=True)


@query("""
    WITH a AS (SELECT event_id % 1000 AS route, user_id % 3 AS priority, min(CASE WHEN event_type <> 'error' THEN value END) AS value, bool_and(event_type = 'error') AS failed FROM events GROUP BY 1, 2),
    b AS (SELECT route, min(priority) FILTER (WHERE NOT failed) AS p FROM a GROUP BY 1)
    SELECT a.route, CASE WHEN any_value(p) IS NOT NULL THEN 'p' || any_value(p) WHEN a.route % 2 = 0 THEN 'straight_line' END AS provider, CASE WHEN any_value(p) IS NOT NULL THEN 'OK' WHEN a.route % 2 = 0 THEN 'PARTIAL' ELSE 'FAILED' END AS status,
           coalesce(max(a.value) FILTER (WHERE priority = p), CASE WHEN a.route % 2 = 0 THEN CAST(a.route AS DOUBLE) END) AS value,
           coalesce(string_agg('p' || priority || ': failed', '; ' ORDER BY priority) FILTER (WHERE failed AND (p IS NULL OR priority < p)), '') AS errors
    FROM a JOIN b USING (route) GROUP BY a.route""")
def route_fallback(spark, d):
    e = table(spark, d, "events").select((F.col("event_id") % 1000).alias("route"), (F.col("user_id") % 3).alias("priority"), "event_type", "value")
    failed = F.col("event_type") == "error"
    attempts = e.groupBy("route", "priority").agg(F.min(F.when(~failed, F.col("value"))).alias("value"), F.bool_and(failed).alias("failed"))
    attempts = attempts.select("route", "priority", F.concat(F.lit("p"), F.col("priority").cast("string")).alias("provider"), "value", F.when(F.col("failed"), F.lit("failed")).alias("error"))
    line = attempts.select("route").distinct().filter("route % 2 = 0").withColumn("value", F.col("route").cast("double"))
    return state.first_success(attempts, "route", line)
