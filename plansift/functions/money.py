"""Amounts and trip parameters in text, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plansift.functions import checked

# How amounts are written (with the sign, right of a dash, and bare).
AMOUNT = r"₹\s?([0-9][0-9,]*(?:\.[0-9]+)?)"
RIGHT_SIDE = r"[–—\-]\s*(\d[\d,]*(?:\.\d+)?)\b"
BARE = r"\b(\d{1,3}(?:,\d{3})+|\d+)\b"


def _amounts(c: Column, pattern: str) -> Column:
    """All amounts as one checked array: an amount beyond what a long holds is an error, as what it would leave out isn't known."""
    return checked.each(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(1)), checked.number)


def amounts(c: Column) -> Column:
    """Signed amounts of a text as whole rupees; an empty array for a null, null for an amount that no long holds."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(AMOUNT), F.lit(1))
    return F.transform(found, lambda x: checked.number(x)["value"])


def price_range_checked(c: Column) -> Column:
    """Checked struct(low, high) of a price text: signed amounts and what stands right of a dash, else any whole numbers. Reason: out_of_range."""
    none = F.array().cast("array<long>")

    def read(x: Column) -> Column:
        marked = x["signed"]["status"] != checked.NONE
        reason = F.when(marked, F.coalesce(x["signed"]["reason"], x["right"]["reason"])).otherwise(x["bare"]["reason"])
        every = F.when(marked, F.concat(F.coalesce(x["signed"]["value"], none), F.coalesce(x["right"]["value"], none))).otherwise(F.coalesce(x["bare"]["value"], none))
        return checked.outcome(F.when(reason.isNull() & (F.size(every) > 0), F.struct(F.array_min(every).alias("low"), F.array_max(every).alias("high"))), reason)

    return checked.let(F.struct(_amounts(c, AMOUNT).alias("signed"), _amounts(c, RIGHT_SIDE).alias("right"), _amounts(c, BARE).alias("bare")), read)


def price_range(c: Column) -> Column:
    """struct(low, high) of a price text, null if it has no number or one that no long holds."""
    return price_range_checked(c)["value"]


def _first(c: Column, pattern: str, group: int = 1) -> Column:
    return checked.number(F.regexp_extract(c, "(?i)" + pattern, group), "int")


# How trips are described.
DAYS, NIGHTS, ROOMS = r"\b(\d+)\s*-?\s*days?\b", r"\b(\d+)\s*-?\s*nights?\b", r"\b(\d+)\s*-?\s*rooms?\b"
GROUP = r"\b(?:family\s+of|group\s+of)\s*(\d+)\b|\b(?:for|of|with)\s*(\d+)\s*(?:people|persons|adults|members|pax)\b"
PARTY = r"\b(\d+)\s*(?:people|persons|adults|members)\b"
ONE_WAY, ROUND_TRIP = r"(?i)\bone\s*-?\s*way\b|\boneway\b", r"(?i)\bround\s*-?\s*trip\b|\bto\s+and\s+fro\b|\bto-and-fro\b"
NO_STAY = r"(?i)\b(?:without|no|skip|exclude|not\s+tak(?:ing|e))\s+(?:a\s+|an\s+)?(?:hotel|stay|room|accommodation)\b"


def _trip_numbers(text: Column) -> dict[str, Column]:
    """Checked days, nights, persons and rooms."""
    stated = [_first(text, GROUP, 1), _first(text, GROUP, 2), _first(text, PARTY)]
    persons = checked.let(F.array(*stated), lambda all: F.coalesce(F.get(F.filter(all, lambda p: p["status"] != checked.NONE), F.lit(0)), F.get(all, F.lit(2))))
    return {"days": _first(text, DAYS), "nights": _first(text, NIGHTS), "persons": persons, "rooms": _first(text, ROOMS)}


def trip_params(c: Column) -> dict[str, Column]:
    """days, nights, persons, rooms, roundtrip, oneway, stay_excluded of a question; what isn't said, or is a number beyond an int's, is null."""
    text = F.coalesce(c, F.lit(""))
    n = _trip_numbers(text)
    days, rooms = (n[k]["value"] for k in ("days", "rooms"))
    oneway = text.rlike(ONE_WAY)

    def nights(x: Column) -> Column:
        by_days = (x["nights"]["status"] == checked.NONE) & x["days"].isNotNull()
        return F.struct(F.when(by_days, F.greatest(x["days"] - 1, F.lit(0))).otherwise(x["nights"]["value"]).alias("n"), by_days.alias("by_days"))

    slept = checked.let(F.struct(n["nights"].alias("nights"), days.alias("days")), nights)
    return {
        "days": days,
        "nights": slept["n"],
        "nights_from_days": slept["by_days"],
        "persons": n["persons"]["value"],
        "rooms": F.greatest(rooms, F.when(rooms.isNotNull(), F.lit(1))),
        "roundtrip": text.rlike(ROUND_TRIP) & ~oneway,
        "oneway": oneway,
        "stay_excluded": text.rlike(NO_STAY),
    }


def trip_numbers_checked(c: Column) -> Column:
    """Checked struct(days, nights, persons, rooms) as said. Reason: the first of them that is out of range."""
    return checked.together(**_trip_numbers(F.coalesce(c, F.lit(""))))


def trip_header(p: dict[str, Column]) -> Column:
    """A trip in words; parts that aren't known are left out."""
    part = lambda c, word: F.when(c.isNotNull(), F.concat(c.cast("string"), F.lit(f" {word}")))
    return F.concat_ws(", ", part(p["days"], "days"), part(p["nights"], "nights"), part(p["persons"], "persons"), part(p["rooms"], "rooms"), F.when(p["roundtrip"], F.lit("round trip")), F.when(p["oneway"], F.lit("one way")), F.when(p["stay_excluded"], F.lit("no stay")))


def fuel_rate(price: float, mileage: float) -> Column:
    return F.round(F.lit(price) / F.greatest(F.lit(mileage), F.lit(1.0)), 2)


def eta(minutes: Column, buffer: Column) -> Column:
    """struct(value, status, reason, estimated): travel time with a buffer."""
    reason = F.when(minutes.isNull(), "missing_duration").when(F.isnan(minutes), "invalid_duration").when(minutes < 0, "negative_duration").when(buffer < 0, "negative_buffer")
    ok = reason.isNull()
    return F.struct(F.when(ok, F.round(minutes + buffer, 2)).alias("value"), F.when(ok, "OK").otherwise("UNAVAILABLE").alias("status"), reason.alias("reason"), F.coalesce(ok & (buffer > 0), F.lit(False)).alias("estimated"))


def distance_cost(km: Column, rate: Column) -> Column:
    """struct(value, status, reason): cost of a distance."""
    reason = F.when(rate.isNull(), "missing_rate").when(rate < 0, "negative_rate").when(km.isNull(), "missing_distance").when(F.isnan(km), "invalid_distance").when(km < 0, "negative_distance")
    ok = reason.isNull()
    return F.struct(F.when(ok, F.round(km * rate, 2)).alias("value"), F.when(ok, "OK").otherwise("UNAVAILABLE").alias("status"), reason.alias("reason"))
