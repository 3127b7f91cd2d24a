"""Scans of semi-structured JSON: many layouts into one schema, quarantine of what isn't JSON, flattening of captured responses."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from plansift.functions import text
from plansift.sources import json_files

HOTEL = "hotel_id string, hotel_name string, hotel_type string, address string, about string, price_range string, temple_id string, amenities array<string>, contact_numbers array<string>, booking_links map<string,string>, ratings struct<platform string, rating string>, check_in_time string, check_out_time string, google_map_link string, official_website string"


_FILE = f"struct<temple_id: string, associated_temple: string, hotels: array<struct<{HOTEL.replace(' string', ': string').replace(' array', ': array').replace(' map', ': map').replace(' struct<platform: string, rating: string>', ': struct<platform: string, rating: string>')}>>>"


def read_hotel_files(spark: SparkSession, path: str, bundled: bool = False) -> tuple[DataFrame, DataFrame]:
    """(one row a named hotel of the files under path, with the file's ids where the hotel has none of its own; the files that can't be read: source_file, reason)."""
    files = json_files.read_json_files(spark, path, bundled=bundled)
    parsed = files.filter("status = 'OK'").select("source_file", F.from_json("text", _FILE).alias("f")).select("source_file", "f.*")
    return hotels(parsed), files.filter("status = 'ERROR'").select("source_file", "reason")


def hotels(files: DataFrame) -> DataFrame:
    """files (temple_id, associated_temple, hotels, source_file) -> one row a hotel with a name."""
    rows = files.select("temple_id", "associated_temple", "source_file", F.posexplode("hotels").alias("pos", "h"))
    name = F.trim(F.coalesce("h.hotel_name", F.lit("")))
    said = lambda c: F.trim(F.coalesce(c, F.lit("")))
    few = lambda c, n: F.slice(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")), 1, n)
    return rows.filter(name != "").select(
        "source_file", "pos", name.alias("name"), F.coalesce(F.nullif("h.temple_id", F.lit("")), "temple_id", F.lit("")).alias("temple_id"),
        F.trim(F.coalesce("associated_temple", F.lit(""))).alias("temple_name"), F.trim(F.coalesce("h.address", F.lit(""))).alias("address"), F.trim(F.coalesce("h.price_range", F.lit(""))).alias("price_range"),
        F.map_filter(F.coalesce("h.booking_links", F.create_map().cast("map<string,string>")), lambda k, v: v.startswith("http")).alias("booking_links"),
        few(F.col("h.amenities"), 8).alias("amenities"), few(F.col("h.contact_numbers"), 3).alias("phones"),
        said("h.hotel_type").alias("hotel_type"), said("h.ratings.rating").alias("rating"), said("h.ratings.platform").alias("rating_platform"), said("h.check_in_time").alias("check_in"), said("h.check_out_time").alias("check_out"),
        said("h.google_map_link").alias("map_link"), said("h.official_website").alias("website"), text.clean(F.col("h.about")).alias("about"),
    ).withColumns({"place_tokens": text.tokens(F.concat_ws(" ", "temple_name", "address")), "name_tokens": text.tokens(F.col("name"))})


def unwrapped(v: Column, path: str, kind: str) -> Column:
    """The value at a path of a variant, whether bare or wrapped as {"value": x}; an object that isn't a wrapper gives null."""
    inner, own = F.try_variant_get(v, f"{path}.value", kind), F.try_variant_get(v, path, kind)
    if kind != "string":
        return F.coalesce(inner, own)
    # an object read as string would give its JSON text
    node = F.try_variant_get(v, path, "variant")
    return F.coalesce(inner, F.when(F.schema_of_variant(node).startswith("OBJECT"), None).otherwise(own))


def scalar_text(v: Column, path: str) -> Column:
    """A text, number or boolean at a path, bare or wrapped, as text; null for a list or an object that isn't a wrapper."""
    flat = lambda p: F.when(~F.schema_of_variant(F.try_variant_get(v, p, "variant")).rlike("^(OBJECT|ARRAY|VOID)"), F.try_variant_get(v, p, "string"))
    return F.coalesce(flat(f"{path}.value"), flat(path))


def there(v: Column, path: str) -> Column:
    """What stands at a path, whatever it is; of a wrapper what is wrapped. Null where nothing or null does."""
    own, inner = (F.try_variant_get(v, p, "variant") for p in (path, f"{path}.value"))
    held = F.coalesce(inner, own)
    return F.when(F.schema_of_variant(held) != "VOID", held)


def filled_strings(v: Column, *paths: str) -> Column:
    """The texts, trimmed, of the first list at the paths that holds anything; what isn't text and blank ones are left out. A bare text stands for the list of its characters."""
    chars = lambda x: F.split(F.when(F.schema_of_variant(F.try_variant_get(x, "$", "variant")) == "STRING", F.try_variant_get(x, "$", "string")), "")
    of = lambda p: F.coalesce(F.transform(F.try_variant_get(v, p, "array<variant>"), lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))), chars(F.try_variant_get(v, p, "variant")))
    first = F.coalesce(*[text.filled(of(p)) for p in paths], F.array().cast("array<string>"))
    return F.filter(F.transform(first, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def restaurants(texts: DataFrame, text_col: str = "value") -> DataFrame:
    """One record a restaurant document that has a name, whichever layout it has; what a layout doesn't say is '' or null.

    Of alternative fields the first that is there counts: a distance that is there and isn't a number gives null, it doesn't fall on to the next. Ratings, review
    counts and costs are kept as they are written, as text.
    """
    rows = texts.withColumn("v", F.try_parse_json(text_col))
    v = F.col("v")
    at = lambda kind, *paths: F.coalesce(*[unwrapped(v, p, kind) for p in paths])
    filled = lambda *paths: F.coalesce(*[F.nullif(F.trim(scalar_text(v, p)), F.lit("")) for p in paths])
    said = lambda *paths: F.coalesce(filled(*paths), F.lit(""))
    cuisine = filled_strings(v, "$.basicInformation.cuisineType", "$.cuisine.types")
    distance = F.coalesce(*[there(v, p) for p in ("$.travelInformation.distanceFromTempleKm", "$.distanceFromTemple.walkingDistance", "$.distanceFromTemple.drivingDistance")])
    opening, closing, days = (filled(f"$.workingHours.{k}") for k in ("openingTime", "closingTime", "workingDays"))
    hours = F.concat(opening, F.lit(" - "), closing, F.coalesce(F.concat(F.lit(" ("), days, F.lit(")")), F.lit("")))
    return rows.select(
        *[c for c in texts.columns if c != text_col], filled("$.restaurantName").alias("name"), said("$.associatedTemple.templeId").alias("temple_id"), said("$.associatedTemple.templeName").alias("temple_name"),
        said("$.location.city").alias("city"), said("$.location.fullAddress", "$.location.address", "$.location.landmark").alias("address"), F.round(F.trim(F.try_variant_get(distance, "$", "string")).try_cast("double"), 2).alias("distance_km"),
        at("boolean", "$.dietaryInformation.vegetarian", "$.foodType.vegetarian").alias("vegetarian"), at("boolean", "$.dietaryInformation.pureVegetarian", "$.foodType.pureVeg").alias("pure_veg"),
        filled("$.customerInformation.googleRating", "$.businessInformation.rating").alias("rating"), filled("$.customerInformation.totalReviews", "$.businessInformation.reviewCount").alias("reviews"),
        said("$.priceInformation.priceCategory", "$.businessInformation.priceRange").alias("price_category"), filled("$.priceInformation.averageCostForOne").alias("cost_for_one"), filled("$.priceInformation.averageCostForTwo").alias("cost_for_two"),
        F.slice(cuisine, 1, 6).alias("cuisines"), F.coalesce(hours, F.lit("")).alias("hours"), said("$.contactInformation.phoneNumber", "$.contact.phone").alias("phone"), said("$.googleMapsLink").alias("map_link"),
        (~F.contains(F.lower(said("$.businessStatus")), F.lit("closed"))).alias("open"), said("$.metadata.lastVerified").alias("last_verified"), said("$.metadata.status").alias("dataset_status"),
    ).filter(F.col("name").isNotNull()).withColumns({"place_tokens": text.tokens(F.concat_ws(" ", "temple_name", "city", "address")), "name_tokens": text.tokens(F.col("name"))})


def read_restaurant_files(spark: SparkSession, path: str, bundled: bool = False) -> tuple[DataFrame, DataFrame]:
    """(one row a named restaurant of the files under path; the files that can't be read or name none: source_file, reason)."""
    files = json_files.read_json_files(spark, path, required=("restaurantName",), bundled=bundled)
    return restaurants(files.filter("status = 'OK'").select("source_file", "text"), "text"), files.filter("status = 'ERROR'").select("source_file", "reason")


def quarantine(texts: DataFrame, text_col: str, required: tuple[str, ...]) -> DataFrame:
    """texts with status: ok, invalid_json, or invalid_record (no object, or a required string is missing, bare or wrapped)."""
    v = F.try_parse_json(text_col)
    missing = F.lit(False)
    for r in required:
        missing = missing | (F.coalesce(F.trim(unwrapped(F.col("_v"), f"$.{r}", "string")), F.lit("")) == "")
    is_object = F.schema_of_variant("_v").startswith("OBJECT")
    return texts.withColumn("_v", v).withColumn("status", F.when(F.col("_v").isNull(), "invalid_json").when(~is_object | missing, "invalid_record").otherwise("ok")).drop("_v")


def strict(checked: DataFrame) -> DataFrame:
    """The rows of quarantine(), or a failed job at the first that isn't ok."""
    return checked.filter(F.when(F.col("status") == "ok", F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("bad record: "), "status")).cast("boolean")))


POI = "struct<elements array<struct<id: bigint, lat: double, lon: double, center: struct<lat: double, lon: double>, tags: map<string,string>>>>".replace("struct<elements array", "struct<elements: array")
GEOCODED = "array<struct<display_name: string, lat: string, lon: string, importance: double>>"


def pois(responses: DataFrame, json_col: str) -> DataFrame:
    """Named elements with coordinates of captured point-of-interest responses."""
    rows = responses.withColumn("e", F.explode(F.from_json(json_col, POI)["elements"])).drop(json_col)
    lat, lon = F.coalesce("e.lat", "e.center.lat"), F.coalesce("e.lon", "e.center.lon")
    tag = lambda k: F.nullif(F.col("e.tags")[k], F.lit(""))
    address = F.concat_ws(", ", tag("addr:housenumber"), tag("addr:street"), tag("addr:city"))
    return rows.withColumns({"name": tag("name"), "lat": lat, "lon": lon, "address": address}).drop("e").filter("name is not null and lat is not null and lon is not null")


def routes(responses: DataFrame, json_col: str) -> DataFrame:
    """Long facts (key, value, value_text) of the first route of captured route responses: km, minutes, minutes in traffic, the first 12 steps.

    Metres are `distanceMeters` or `distance`; seconds a number, text as "165s", or an object with `seconds`; steps stand in the
    route or in its legs, each with `text` or a navigation instruction. A response with another code than Ok has no facts.
    """
    v = F.try_parse_json(json_col)
    rows = responses.withColumn("r", F.element_at(F.try_variant_get(v, "$.routes", "array<variant>"), 1)).withColumn("code", F.try_variant_get(v, "$.code", "string"))
    rows = rows.drop(json_col).filter("r is not null and coalesce(code, 'Ok') = 'Ok'")
    number = lambda *paths: F.coalesce(*[F.try_variant_get("r", p, "double") for p in paths])

    def seconds(name):
        said = F.regexp_extract(F.try_variant_get("r", f"$.{name}", "string"), r"^(\d+(?:\.\d+)?)s?$", 1).try_cast("double")
        return F.coalesce(number(f"$.{name}.seconds", f"$.{name}"), said)

    of = lambda x: F.coalesce(F.try_variant_get(x, "$.navigationInstruction.instructions", "string"), F.try_variant_get(x, "$.text", "string"))
    legs = F.flatten(F.transform(F.try_variant_get("r", "$.legs", "array<variant>"), lambda leg: F.coalesce(F.try_variant_get(leg, "$.steps", "array<variant>"), F.array().cast("array<variant>"))))
    steps = F.transform(F.coalesce(legs, F.try_variant_get("r", "$.steps", "array<variant>")), lambda x: F.trim(of(x)))
    steps = F.array_join(F.slice(F.filter(steps, lambda x: x.isNotNull() & (x != "")), 1, 12), " > ")
    fact = lambda k, v, t: F.struct(F.lit(k).alias("key"), v.alias("value"), t.alias("value_text"))
    none = F.lit(None).cast("string")
    minutes = lambda name: F.round(seconds(name) / 60, 2)
    facts = F.array(fact("distance_km", F.round(number("$.distanceMeters", "$.distance") / 1000, 2), none), fact("duration_min", minutes("duration"), none), fact("duration_in_traffic_min", minutes("durationInTraffic"), none), fact("steps", F.lit(None).cast("double"), steps))
    return rows.withColumn("f", F.explode(facts)).select(*[c for c in responses.columns if c != json_col], "f.*").filter("value is not null or value_text <> ''")


def geocoded(responses: DataFrame, json_col: str) -> DataFrame:
    """Candidates of captured geocoder responses, those without sound coordinates left out."""
    rows = responses.withColumn("c", F.explode(F.from_json(json_col, GEOCODED))).drop(json_col)
    rows = rows.withColumns({"name": F.col("c.display_name"), "lat": F.col("c.lat").try_cast("double"), "lon": F.col("c.lon").try_cast("double"), "importance": F.coalesce("c.importance", F.lit(0.0))}).drop("c")
    return rows.filter(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))


def append_places(places: DataFrame, entities: DataFrame) -> DataFrame:
    """places (place_id, name, place_type, aliases, latitude) with the entities whose name, before its first comma, isn't there yet and that have a latitude."""
    new = entities.withColumn("name", F.trim(F.element_at(F.split("canonical_name", ","), 1))).filter("latitude is not null")
    new = new.join(places.select(F.lower("name").alias("_n")).distinct(), F.lower("name") == F.col("_n"), "left_anti")
    return places.unionByName(new.select(F.col("entity_id").alias("place_id"), "name", F.col("entity_type").alias("place_type"), F.slice("aliases", 1, 4).alias("aliases"), "latitude"))


def stringify(c: Column) -> Column:
    """Nested JSON text as readable lines: "Key: value", or "Key:" and lines below for what is nested; empty ones left out. Null for what isn't JSON."""
    return _readable(c)


@F.arrow_udf(StringType())
def _readable(texts: pa.Array) -> pa.Array:
    import json

    def show(x):
        if isinstance(x, dict):
            parts = [(str(k).replace("_", " ").strip().title(), show(v), ":\n" if isinstance(v, (dict, list)) else ": ") for k, v in x.items()]
            return "\n".join(k + sep + v for k, v, sep in parts if v)
        if isinstance(x, list):
            return "\n".join(filter(None, map(show, x)))
        return "" if x is None else str(x).strip()

    def one(text):
        try:
            return show(json.loads(text)) if text is not None else None
        except (ValueError, RecursionError):
            return None

    return text.by_slices(one, texts)


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def items(v: Column, path: str) -> Column:
    """array<variant>: the array at a path, a lone value as an array of one, or an empty array."""
    lone = F.try_variant_get(v, path, "variant")
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.when(lone.isNotNull() & (F.schema_of_variant(lone) != "VOID"), F.array(lone)), F.array().cast("array<variant>"))


def strings(v: Column, path: str) -> Column:
    """array<string>: the strings at a path, whether one or an array; other values are left out."""
    return F.transform(F.filter(items(v, path), lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string"))


def first_said(v: Column, *paths: str) -> Column:
    """The first non-empty string or number at the paths, trimmed; null if there is none."""
    return F.coalesce(*[F.nullif(F.trim(unwrapped(v, p, "string")), F.lit("")) for p in paths])


#: The spellings of a master list's id.
RECORD_IDS = ("$.temple_id", "$.templeId", "$.id")


def master_list(texts: DataFrame, text_col: str = "value", ids: tuple[str, ...] = RECORD_IDS) -> DataFrame:
    """One row a record with an id: the texts' other columns, pos, record_id, record (variant).

    A text's root is the list itself or an object with it under `temples` or `entities`; what isn't an object is left out, and of a text's
    records of one id the last stays.
    """
    v = F.try_parse_json(text_col)
    listed = F.coalesce(*[F.try_variant_get(v, p, "array<variant>") for p in ("$", "$.temples", "$.entities")])
    other = [c for c in texts.columns if c != text_col]
    found = F.filter(F.transform(listed, lambda r, i: F.struct(i.alias("pos"), first_said(r, *ids).alias("record_id"), is_object(r).alias("good"), r.alias("record"))), lambda x: x["good"] & x["record_id"].isNotNull())
    rows = texts.withColumn("_t", F.monotonically_increasing_id()).select(*other, "_t", F.explode(found).alias("x")).select(*other, "_t", "x.pos", "x.record_id", "x.record")
    w = Window.partitionBy("_t", "record_id").orderBy(F.desc("pos"))
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_t", "_r")


def place_list(texts: DataFrame, text_col: str = "value") -> DataFrame:
    """place_id, name, place_type, aliases, latitude, longitude (as said, as text) of the places in texts {"places": [...]}; places without an id or a name are left out."""
    v = F.try_parse_json(text_col)
    rows = texts.select(F.explode(F.try_variant_get(v, "$.places", "array<variant>")).alias("p"))
    p = F.col("p")
    found = rows.select(first_said(p, "$.place_id").alias("place_id"), first_said(p, "$.canonical_name").alias("name"), F.coalesce(first_said(p, "$.place_type"), F.lit("place")).alias("place_type"), strings(p, "$.aliases").alias("aliases"), first_said(p, "$.location.latitude").alias("latitude"), first_said(p, "$.location.longitude").alias("longitude"))
    return found.filter("place_id is not null and name is not null")
