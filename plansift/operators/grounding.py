"""Trip totals, rendering of evidence, and the audit of numbers against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plansift.functions.text import numbers, same_value, search_link, truncate

COMPONENTS = ("food", "stay", "transport")


def _product(*factors: Column | int) -> Column:
    """A product of whole numbers; null where no long holds it, so that odd numbers make a cost unknown and don't fail a job."""
    got = F.lit(1).cast("long")
    for f in factors:
        got = F.try_multiply(got, f if isinstance(f, Column) else F.lit(f))
    return got


def _sum(parts: Column, field: str) -> Column:
    return F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: F.try_add(a, p[field]))


def trip_totals(trips: DataFrame, key: str, rate: float, meals: int = 3) -> DataFrame:
    """Totals of trips with nights, days, persons, mode (0 driving, 1 transit, 2 walking), two_way, km, low and high (a price band), n; rate: the cost of a km.

    A component needs all its inputs; one without them, or whose cost no long holds, is absent; what lacks is named in `missing`. Transit has no known fare.
    """
    ways = F.when(F.col("two_way"), 2).otherwise(1)
    fuel = F.floor(F.col("km") * rate * ways)

    def item(name: str, ok: Column, low: Column, high: Column) -> Column:
        low, high = low.try_cast("long"), high.try_cast("long")
        return F.when(ok & low.isNotNull() & high.isNotNull(), F.struct(F.lit(name).alias("component"), low.alias("low"), high.alias("high")))

    parts = F.array_compact(
        F.array(
            item("transport", (F.col("mode") == 0) & F.col("km").isNotNull(), fuel, fuel),
            item("stay", (F.col("nights") > 0) & F.col("low").isNotNull(), _product(F.col("low"), F.col("nights")), _product(F.col("high"), F.col("nights"))),
            item("food", (F.col("days") > 0) & (F.col("n") > 2), _product(meals, F.col("low"), F.col("days"), F.col("persons")), _product(meals, F.col("high"), F.col("days"), F.col("persons"))),
        )
    )
    missing = F.array_compact(F.array(F.when(F.col("mode") == 1, "transit fare").when((F.col("mode") == 0) & F.col("km").isNull(), "distance"), F.when(F.col("nights") == 0, "nights"), F.when(F.col("days") == 0, "days")))
    assumptions = F.array_compact(F.array(F.when(F.col("mode") == 0, F.lit("fuel by distance")), F.when(F.col("nights") > 0, F.lit("one room"))))
    total = lambda f: F.when(F.size("parts") > 0, _sum(F.col("parts"), f))
    rows = trips.select(key, parts.alias("parts"), missing.alias("m"), assumptions.alias("a"))
    included = F.array_sort(F.transform("parts", lambda p: p["component"]))
    return rows.select(key, total("low").alias("low"), total("high").alias("high"), included.alias("included"), F.array_except(F.array(*map(F.lit, COMPONENTS)), included).alias("absent"), (F.size("parts") < len(COMPONENTS)).alias("partial"), F.array_join(F.array_distinct("m"), ", ").alias("missing"), F.size("a").alias("n_assumptions"))


def ungrounded(drafts: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """key, missing, n_missing: the distinct numbers of each draft whose value its evidence doesn't hold.

    Both sides come down to (key, value) rows, so that the check is one anti join on both.
    """
    said = drafts.select(key, F.explode(numbers(F.col("draft"))).alias("token")).withColumn("value", same_value(F.col("token")))
    held = evidence.select(key, F.explode(numbers(F.col("evidence"))).alias("token")).select(key, same_value(F.col("token")).alias("value"))
    gone = said.join(held, [key, "value"], "left_anti")
    return gone.groupBy(key).agg(F.sort_array(F.collect_set("token")).alias("missing"), F.count_distinct("token").alias("n_missing"))


#: The columns of an evidence table, beside its key and pos. What a kind doesn't say is null.
EVIDENCE = {
    "kind": "string", "source": "string", "key": "string", "value": "string", "unit": "string", "provider": "string", "approximate": "boolean", "role": "string", "name": "string", "error": "string",
    "hint": "string", "status": "string", "selected": "string", "component": "string", "scope": "string", "low": "bigint", "high": "bigint", "free_stated": "boolean",
    "samples": "array<struct<name:string,charges:string>>", "included": "array<string>", "text": "string", "source_tier": "string", "details": "string",
}
VALUE, TEXT = 400, 400


def evidence(rows: DataFrame, by: list[str], **columns: Column) -> DataFrame:
    """rows in the columns of EVIDENCE, to be put together by unionByName. by: the key and position columns."""
    return rows.select(*by, *[columns.get(n, F.lit(None)).cast(t).alias(n) for n, t in EVIDENCE.items()])


def fact_evidence(facts: DataFrame, by: list[str]) -> DataFrame:
    """Of route facts (fact, value, value_text, unit, provider, approximate), long texts cut."""
    value = F.coalesce(shown_number(F.col("value")), truncate(F.col("value_text"), VALUE))
    return evidence(facts, by, kind=F.lit("fact"), source=F.col("provider"), key=F.col("fact"), value=value, unit=F.col("unit"), provider=F.col("provider"), approximate=F.col("approximate"))


def calculation_evidence(calculations: DataFrame, by: list[str]) -> DataFrame:
    """Of calculations (fact, value, unit, status, estimated, provider)."""
    return evidence(calculations, by, kind=F.lit("calculation"), source=F.lit("calculation"), key=F.col("fact"), value=shown_number(F.col("value")), unit=F.col("unit"), status=F.col("status"), approximate=F.col("estimated"), provider=F.col("provider"))


#: What is told of stays, of places to eat and of places on the live map, beside their name; kept as JSON in `details`.
STAY = ("hotel_type", "temple_id", "temple_name", "address", "price_range", "rating", "rating_platform", "booking_links", "amenities", "check_in", "check_out", "phones", "map_link", "about")
FOOD = ("temple_id", "temple_name", "city", "address", "cuisines", "vegetarian", "pure_veg", "price_category", "cost_for_one", "cost_for_two", "rating", "reviews", "hours", "phone", "map_link", "distance_km", "open", "last_verified", "dataset_status")
LIVE = ("category", "cuisine", "phone", "website", "address", "latitude", "longitude", "distance_km")


def _listed(records: DataFrame, by: list[str], kind: str, source: str, tier: str, told: tuple[str, ...]) -> DataFrame:
    details = F.to_json(F.struct(*[F.col(c) for c in told if c in records.columns]))
    return evidence(records, by, kind=F.lit(kind), source=F.lit(source), source_tier=F.lit(tier), name=F.col("name"), details=details)


def stay_evidence(records: DataFrame, by: list[str]) -> DataFrame:
    """Of hotels (see json_layouts.hotels), each a row; it has no line of its own in render()."""
    return _listed(records, by, "hotel", "hotel_dataset", "internal_dataset", STAY)


def food_evidence(records: DataFrame, by: list[str]) -> DataFrame:
    """Of restaurants (see json_layouts.restaurants)."""
    return _listed(records, by, "restaurant", "restaurant_dataset", "internal_dataset", FOOD)


def live_evidence(records: DataFrame, by: list[str], source: str) -> DataFrame:
    """Of places on the live map, by the source that knows them."""
    return _listed(records, by, "poi", source, "open-data", LIVE)


def transit_notes(routes: DataFrame, by: list[str], capable: str, link: str) -> DataFrame:
    """A note for each route (mode, status, provider) asked for by transit that the provider capable of it didn't answer."""
    answered = F.col("status").isin("OK", "PARTIAL") & F.coalesce(F.col("provider") == capable, F.lit(False))
    missed = routes.filter((F.col("mode") == "transit") & ~answered)
    return evidence(missed, by, kind=F.lit("note"), source=F.lit("travel"), key=F.lit("transit_unavailable"), error=F.lit("No transit/bus data available for this route right now."), hint=F.lit(link))


def no_result_notes(requests: DataFrame, results: DataFrame, request: str, pos: Column, template: str, noun: str) -> DataFrame:
    """A note with a search link for each request (request, question) that has no row in results."""
    missed = requests.join(results.select(request).distinct(), request, "left_anti").withColumn("pos", pos)
    said = F.coalesce(F.nullif(F.trim("question"), F.lit("")), F.lit(noun))
    return evidence(missed, [request, "pos"], kind=F.lit("note"), source=F.lit(noun), key=F.lit("no_data"), error=F.lit(f"No {noun} found in the curated dataset or the live map for this query."), hint=search_link(template, said))


def shown_number(c: Column) -> Column:
    """A number as text, whole ones with one decimal."""
    return F.when(c == F.floor(c), F.concat(F.floor(c).cast("string"), F.lit(".0"))).otherwise(c.cast("string"))


def line() -> Column:
    """The lines of an evidence row; null for one that says nothing."""
    kind = F.col("kind")
    said = lambda n: F.coalesce(F.col(n), F.lit(""))
    none = lambda n: F.coalesce(F.col(n).cast("string"), F.lit("None"))
    fact = F.concat(none("key"), F.lit(": "), none("value"), F.lit(" "), said("unit"), F.when(F.col("approximate"), " (approx)").otherwise(""), F.lit(" ["), F.coalesce(F.nullif("provider", F.lit("")), F.col("source"), F.lit("")), F.lit("]"))
    place = F.concat(none("role"), F.lit(": "), none("name"))
    note = F.concat(F.coalesce(F.nullif("error", F.lit("")), F.nullif("key", F.lit("")), F.lit("note")), F.when(F.col("hint") != "", F.concat(F.lit(" - "), "hint")).otherwise(""))
    status = F.concat(F.lit("provider status: "), none("status"), F.when(F.col("selected") != "", F.concat(F.lit(", selected: "), "selected")).otherwise(""))
    part, sign = F.coalesce(F.nullif("component", F.lit("")), F.lit("cost")), F.when(F.col("unit") == "currency", "₹").otherwise("")
    low, high = F.col("low"), F.col("high")
    unpriced = F.concat(F.trim(F.concat(part, F.lit(" "), said("scope"))), F.when(F.col("free_stated"), ": free darshan listed in records; no priced entries").otherwise(": no priced entries"))
    priced = F.concat(part, F.lit(" "), said("scope"), F.lit(": "), sign, none("low"), F.when(high.isNull() | low.eqNullSafe(high), "").otherwise(F.concat(F.lit(" - "), sign, none("high"))))
    samples = F.transform("samples", lambda x: F.concat(F.lit("\n  "), F.coalesce(x["name"], F.lit("None")), F.lit(": "), F.coalesce(x["charges"], F.lit("None"))))
    item = F.concat(F.when(low.isNull() & high.isNull(), unpriced).otherwise(F.rtrim(priced)), F.coalesce(F.array_join(samples, ""), F.lit("")))
    covers = F.when(F.size("included") > 0, F.concat(F.lit(" (covers: "), F.array_join("included", ", "), F.lit(")"))).otherwise("")
    total = F.concat(F.lit("budget total: ₹"), none("low"), F.lit(" - ₹"), none("high"), covers)
    other = F.when(F.trim("text") != "", F.concat(F.when(F.col("name") != "", F.concat("name", F.lit(": "))).otherwise(""), F.substring(F.trim("text"), 1, TEXT)))
    return F.when(kind.isin("fact", "calculation"), fact).when(kind == "place", place).when(kind.isin("note", "error"), note).when(kind == "status", status).when(kind == "budget_item", item).when(kind == "budget_total", total).otherwise(other)


def render(rows: DataFrame, key: str) -> DataFrame:
    """key, shown: an answer of evidence alone, a line a row of an EVIDENCE table in order of pos. A key has an answer's few rows."""
    lined = rows.select(key, "pos", line().alias("line")).filter("line is not null")
    listed = lined.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("rows"))
    return listed.select(key, F.trim(F.array_join(F.transform("rows", lambda r: r["line"]), "\n")).alias("shown"))


# What is said of a transport cost that isn't known.
NO_ORIGIN, NO_DESTINATION = "your starting point (for travel cost)", "your destination (for travel cost)"
NO_ROUTE, NO_FARE, NO_COST = "travel cost (route unavailable)", "public transport fare (not in our dataset - check Redbus)", "travel cost (route gave no cost)"


def transport(trips: DataFrame) -> DataFrame:
    """trips (origin, destination, mode, roundtrip, oneway, route_ok, cost of one way) with transport_low, transport_high, transport_method, transport_note and transport_missing.

    Walking costs nothing and misses nothing; a fare by transit isn't known; anything else costs the way once, or twice for a round trip. Unknown costs are null.
    """
    c = F.col
    blank = lambda n: F.coalesce(F.trim(n), F.lit("")) == ""
    missing = (
        F.when(blank("origin"), NO_ORIGIN).when(blank("destination"), NO_DESTINATION).when(~F.coalesce("route_ok", F.lit(False)), NO_ROUTE)
        .when(c("mode") == "walking", None).when(c("mode") == "transit", NO_FARE).when(c("cost").isNull(), NO_COST)
    )
    rows = trips.withColumn("transport_missing", missing.cast("string"))
    reached = ~blank("origin") & ~blank("destination") & F.coalesce("route_ok", F.lit(False))
    priced = reached & c("transport_missing").isNull() & (c("mode") != "walking")
    once = F.round("cost").try_cast("long")
    cost = F.when(priced, F.when(c("roundtrip"), F.try_multiply(once, F.lit(2))).otherwise(once))
    method = F.when(priced, F.when(c("roundtrip"), "round_trip_2x_one_way (distance_times_cost_per_km)").otherwise("distance_times_cost_per_km"))
    note = F.when(reached & (c("mode") == "walking"), "transport_walking").when(priced & ~c("roundtrip") & ~c("oneway"), "one_way_only")
    return rows.withColumns({"transport_low": cost, "transport_high": cost, "transport_method": method, "transport_note": note})


# The keys of a budget's assumptions, in order.
ASSUMPTIONS = ("trip_duration", "nights_from_days", "nights", "persons", "rooms", "roundtrip", "fuel_rate", "per_room", "temple_excluded")


def budget_block(trips: DataFrame, key: str, meals: int = 3) -> DataFrame:
    """key, components (component, scope, low, high, in_total), assumptions (keys), included, absent, low, high, partial, missing, estimate_status, is_complete of each trip.

    trips: as transport() gives them, with days, nights, nights_from_days, persons, rooms, stay_excluded, stay_low, stay_high, meal_low, meal_high, seva_low, seva_high; what isn't
    known is null. Costs that aren't known are missing, never zero; only trip totals are summed. A partial total is named in missing, so the estimate stays partial.
    """
    c = F.col
    rooms = F.greatest(F.coalesce("rooms", F.lit(1)), F.lit(1))
    stays = ~c("stay_excluded") & c("stay_low").isNotNull()
    eats = c("meal_low").isNotNull()

    def item(component: str, scope: str, ok: Column, low: Column, high: Column, in_total: bool = True) -> Column:
        low, high = low.try_cast("long"), high.try_cast("long")
        return F.when(ok & (low.isNotNull() | high.isNotNull()), F.struct(F.lit(component).alias("component"), F.lit(scope).alias("scope"), low.alias("low"), high.alias("high"), F.lit(in_total).alias("in_total")))

    parts = F.array_compact(
        F.array(
            item("transport", "trip_total", c("transport_low").isNotNull(), c("transport_low"), c("transport_high")),
            item("stay", "per_night", stays, c("stay_low"), c("stay_high")),
            item("stay", "trip_total", stays & (c("nights") > 0), _product(c("stay_low"), c("nights"), rooms), _product(c("stay_high"), c("nights"), rooms)),
            item("food", "per_meal", eats, c("meal_low"), c("meal_high")),
            item("food", "per_day", eats & (c("days") > 0), _product(c("meal_low"), meals), _product(c("meal_high"), meals)),
            item("food", "trip_total", eats & (c("days") > 0) & (c("persons") > 0), _product(c("meal_low"), meals, c("days"), c("persons")), _product(c("meal_high"), meals, c("days"), c("persons"))),
            item("temple", "optional_sevas", c("seva_low").isNotNull() | c("seva_high").isNotNull(), c("seva_low"), c("seva_high"), False),
        )
    )
    sleeps = ~c("stay_excluded") & c("nights").isNotNull()
    holds = (c("days").isNotNull(), sleeps & c("nights_from_days"), sleeps & ~c("nights_from_days"), c("persons").isNotNull(), c("rooms").isNotNull() & ~c("stay_excluded"), c("roundtrip"), c("mode") == "driving", ~c("stay_excluded"), F.lit(True))
    assumptions = F.array_compact(F.array(*[F.when(h, F.lit(k)) for k, h in zip(ASSUMPTIONS, holds)]))
    rows = trips.select("*", parts.alias("components"), assumptions.alias("assumptions"))
    summed = F.filter("components", lambda p: p["in_total"] & (p["scope"] == "trip_total"))
    included = F.array_sort(F.transform(summed, lambda p: p["component"]))
    wanted = F.filter(F.array(*map(F.lit, COMPONENTS)), lambda x: ~(c("stay_excluded") & (x == "stay")))
    total = lambda f: F.when(F.size(summed) > 0, _sum(summed, f))
    rows = rows.withColumns({"included": included, "absent": F.array_except(wanted, included), "total_low": total("low"), "total_high": total("high")})
    gaps = F.array_compact(F.array(F.when(c("days").isNull(), "number of days/nights"), F.when(c("persons").isNull(), "number of persons")))
    has = F.size("included") > 0
    missing = F.array_compact(
        F.array(
            c("transport_missing"),
            F.when(~c("stay_excluded") & c("stay_low").isNull(), "hotel prices (no stays found for this place)"),
            F.when(c("meal_low").isNull(), "meal prices (no priced restaurants found for this place)"),
            F.when(has & (F.size("absent") > 0), F.concat(F.lit("this total only covers "), F.array_join("included", ", "), F.lit(" (missing: "), F.array_join("absent", ", "), F.lit(")"))),
            F.when(F.size(gaps) > 0, F.concat(F.lit("to get a full trip total, tell me "), F.array_join(gaps, " and "))),
        )
    )
    rows = rows.withColumn("missing", F.array_distinct(missing))
    complete = (F.size("missing") == 0) & has
    return rows.select(key, "components", "assumptions", "included", "absent", c("total_low").alias("low"), c("total_high").alias("high"), (has & (F.size("absent") > 0)).alias("partial"), "missing", F.when(complete, "complete").otherwise("partial").alias("estimate_status"), complete.alias("is_complete"))


def seva_records(requests: DataFrame, records: DataFrame) -> DataFrame:
    """request_id, path, by: the record of each request's first id that has one; else the first record, by path, that shares a word of three letters or more with the request.

    requests: request_id, ids, words; records: record_id, path, words. The words are met one by one, and of each word only its first record matters.
    """
    asked = requests.select("request_id", F.posexplode("ids").alias("pos", "record_id"))
    by_id = asked.join(records.select("record_id", "path"), "record_id").groupBy("request_id").agg(F.min_by("path", F.struct("pos", "path")).alias("path"))
    rest = requests.join(by_id.select("request_id"), "request_id", "left_anti").select("request_id", F.explode(F.array_distinct("words")).alias("word")).filter(F.length("word") >= 3)
    first = records.select("path", F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.min("path").alias("path"))
    by_word = rest.join(first, "word").groupBy("request_id").agg(F.min("path").alias("path"))
    return by_id.withColumn("by", F.lit("id")).unionByName(by_word.withColumn("by", F.lit("word")))


def merge_tiers(curated: DataFrame, live: DataFrame, key: str, order: str, most: tuple[int, int] = (5, 4)) -> DataFrame:
    """The first `most` rows of a key of each source by order, curated ones first, in the columns of both, with source_tier."""
    def cut(df, n, tier):
        w = Window.partitionBy(key).orderBy(order)
        return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).withColumn("source_tier", F.lit(tier))

    return cut(curated, most[0], "internal_dataset").unionByName(cut(live, most[1], "open-data"), allowMissingColumns=True)


def render_results(results: DataFrame, rows: DataFrame, key: str, result: str = "result") -> DataFrame:
    """key, shown: whole answers as text, result after result: its question, then what it asks back, or its error and its evidence, and a blank line.

    results: key, result (its place), question, status, query, error; rows: evidence with key, result and pos. An answer's lines are first put together result by result, then
    answer by answer, so that no more than a result's, then an answer's lines meet. A result without evidence, or with none that says anything, has its other lines.
    """
    lines = rows.select(key, result, "pos", line().alias("l")).filter("l is not null")
    of_result = lines.groupBy(key, result).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "l"))), lambda x: x["l"]), "\n").alias("lines"))
    given = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    asks = F.concat_ws("\n", F.concat(F.lit("Q: "), given("question")), F.coalesce(F.nullif("query", F.lit("")), F.lit("clarification needed")))
    tells = F.concat_ws("\n", F.concat(F.lit("Q: "), given("question")), F.concat(F.lit("("), F.nullif("error", F.lit("")), F.lit(")")), "lines", F.lit(""))
    blocks = results.join(of_result, [key, result], "left").select(key, result, F.when(F.col("status") == "NEEDS_CLARIFICATION", asks).otherwise(tells).alias("block"))
    answers = blocks.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(result, "block"))), lambda x: x["block"]), "\n").alias("shown"))
    return answers.withColumn("shown", F.regexp_replace("shown", r"(?U)^\s+|\s+\z", ""))
