"""Keyed state over event tables: last turns, expiring facts, provider fallback, and the safety gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plansift.functions.geo import coordinate_key
from plansift.functions.text import cache_key
from plansift.operators.patterns import any_of, hits
from plansift.operators.spread import carry_forward

TURNS, SESSION_TTL = 10, 86_400

#: How long facts of a kind live, in seconds; other kinds as routes. Failures live shorter, failed searches for places a little longer.
TTL = {"geocode": 2_592_000, "route": 86_400, "places": 86_400}
NEGATIVE_TTL, FAILED_PLACES_TTL = 30, 600
CACHE = "travel:v2:"


def fact_ttl(kind: Column, failed: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in TTL.items() for x in kv])
    return F.when(failed & (kind == "places"), FAILED_PLACES_TTL).when(failed, NEGATIVE_TTL).otherwise(F.coalesce(known[kind], F.lit(TTL["route"])))


def route_key(origin: tuple[Column, Column], destination: tuple[Column, Column], mode: Column) -> Column:
    """The cache key of a route; coordinates count to 6 decimals."""
    return cache_key(CACHE, F.lit("route"), coordinate_key(*origin, 6), coordinate_key(*destination, 6), mode)


def places_key(kind: Column, lat: Column, lng: Column, radius: Column) -> Column:
    """The cache key of a search for places; coordinates count to 3 decimals."""
    return cache_key(CACHE, F.lit("places"), F.lit("overpass"), kind, F.format_string("%.3f", lat), F.format_string("%.3f", lng), radius)

# Patterns of messages that must not wait.
EMERGENCY = (
    r"\bambulance\b", r"\bemergency\b", r"\bmedical emergency\b", r"\bcall police\b", r"\bpolice emergency\b", r"\bfire emergency\b", r"\baccident\b",
    r"\bmajor accident\b", r"\bserious accident\b", r"\bsevere bleeding\b", r"\bheavy bleeding\b", r"\bunconscious\b", r"\bnot breathing\b", r"\bcan't breathe\b",
    r"\bcannot breathe\b", r"\bchest pain\b", r"\bheart attack\b", r"\bstroke\b", r"\bpoisoned\b", r"\bpoisoning\b", r"\btrapped\b", r"\bmissing person\b",
    r"\bdanger\b", r"\bimmediate danger\b", r"\bsuicide\b", r"\bself harm\b", r"\bself-harm\b",
    "అత్యవసర", "అంబులెన్స్", "ప్రమాదం", "రక్తస్రావం", "స్పృహలో లేరు", "ఊపిరి తీసుకోలేక", "గుండె నొప్పి", "గుండెపోటు", "మంటలు", "పోలీసులు కావాలి",
)


def is_urgent(message: Column, patterns: tuple[str, ...] = EMERGENCY) -> Column:
    """Whether any pattern occurs, in any case; false for a null."""
    return F.coalesce(message.rlike("(?iu)" + any_of(patterns)), F.lit(False))


def urgent_hits(messages: DataFrame, message: str, patterns: tuple[str, ...] = EMERGENCY) -> DataFrame:
    """messages once for each pattern that occurs in them, with the pattern as it is written."""
    return hits(messages, F.col(message), {p: p for p in patterns})


def last_turns(turns: DataFrame, key: str, ts: str, tie: str, n: int = TURNS, ttl: int | None = None) -> DataFrame:
    """key, history (the last n rows' tie column, oldest first), last. A gap longer than ttl seconds begins a new history.

    Only a key's last n rows are brought together: tasks cut theirs before the shuffle, and only gaps between those n can matter.
    """
    rows = turns.select(key, ts, tie).withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(ts), F.desc(tie)))).filter(F.col("_r") <= n)
    listed = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(ts, tie))).alias("x"), F.max(ts).alias("last"))
    if ttl is not None:
        # where the newest history begins: after the last gap
        gap = lambda x, i: (i > 0) & (F.unix_timestamp(x[ts]) - F.unix_timestamp(F.get("x", i - 1)[ts]) > ttl)
        begins = F.array_max(F.transform("x", lambda x, i: F.when(gap(x, i), i).otherwise(0)))
        listed = listed.withColumn("x", F.slice("x", begins + 1, F.lit(n)))
    return listed.select(key, F.transform("x", lambda x: x[tie]).alias("history"), "last")


CONTEXT, KEPT_TEXT, CONTEXT_TEXT = 3, 500, 300


def recent_context(turns: DataFrame, key: str, order: list[str], texts: list[str], n: int = CONTEXT) -> DataFrame:
    """turns with their texts cut as they are kept, and context: the n turns before each, oldest first, as an array of structs of the texts cut shorter."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-n, -1)
    said = F.struct(*[F.substring(F.coalesce(F.col(t).cast("string"), F.lit("")), 1, CONTEXT_TEXT).alias(t) for t in texts])
    rows = turns.withColumn("context", F.collect_list(said).over(w))
    return rows.withColumns({t: F.substring(F.col(t).cast("string"), 1, KEPT_TEXT) for t in texts})


def as_of(reads: DataFrame, writes: DataFrame, key: str, ts: str, tie: str = "payload", spread: bool = False, parts: int | None = None) -> DataFrame:
    """Each read with the latest write of its key at or before it. reads: key, ts, read_id; writes: key, ts, payload, negative, ttl_s, and tie, the highest of which counts among writes of one time.

    Both come together in one sorted pass a key (no join): hit is whether the write still lives and isn't a failure. spread: deal rows to ranges of key and time instead,
    so that a key of any size lies in many tasks, at the cost of writing them once.
    """
    write = F.struct(ts, "payload", "negative", "ttl_s")
    r = reads.select(key, ts, "read_id", F.lit(1).alias("_o"), F.lit(None).cast(writes.schema[tie].dataType).alias("_t"), F.lit(None).cast(writes.select(write).schema[0].dataType).alias("w"))
    w = writes.select(key, ts, F.lit(None).cast(reads.schema["read_id"].dataType).alias("read_id"), F.lit(0).alias("_o"), F.col(tie).alias("_t"), write.alias("w"))
    both = r.unionByName(w)
    if spread:
        rows = carry_forward(both, [key], [ts, "_o", "_t", "read_id"], "w", parts).drop("_part")
    else:
        span = Window.partitionBy(key).orderBy(ts, "_o", "_t").rowsBetween(Window.unboundedPreceding, 0)
        rows = both.withColumn("w", F.last("w", ignorenulls=True).over(span))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    lives = micros(ts) - micros(f"w.{ts}") <= F.col("w.ttl_s").cast("long") * 1_000_000
    hit = F.coalesce(lives & ~F.col("w.negative"), F.lit(False))
    return rows.filter("_o = 1").select(key, "read_id", hit.alias("hit"), F.when(hit, F.col("w.payload")).alias("payload"))


def first_success(attempts: DataFrame, key: str, straight_line: DataFrame) -> DataFrame:
    """key, provider, status, value, errors: the first success by priority; else the straight line (PARTIAL); else FAILED. attempts: key, provider, priority, value, error."""
    good = F.when(F.col("error").isNull(), F.struct("priority", "provider", "value"))
    best = attempts.groupBy(key).agg(F.min(good).alias("b"), F.sort_array(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("priority", "provider", "error")))).alias("e"))
    rows = best.join(straight_line.select(key, F.col("value").alias("line")), key, "left")
    tried = F.transform(F.filter("e", lambda e: F.col("b").isNull() | (e["priority"] < F.col("b.priority"))), lambda e: F.concat(e["provider"], F.lit(": "), e["error"]))
    return rows.select(
        key, F.coalesce("b.provider", F.when(F.col("line").isNotNull(), "straight_line")).alias("provider"),
        F.when(F.col("b").isNotNull(), "OK").when(F.col("line").isNotNull(), "PARTIAL").otherwise("FAILED").alias("status"),
        F.coalesce("b.value", "line").alias("value"), F.array_join(tried, "; ").alias("errors"),
    )
