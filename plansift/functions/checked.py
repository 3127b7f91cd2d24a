"""Values read from text that may not be what they should be: value, status and reason side by side, row by row.

A checked value is a struct(value, status, reason). Status is OK (there is a value), NONE (nothing was said: null or blank) or
ERROR (something was said that isn't a value; reason says why). No function here fails a job, whatever the text; what comes of an error is the caller's choice: unwrap()
takes it as null, good() keeps the rows without one, errors() lists them, strict() fails at the first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OK, NONE, ERROR = "OK", "NONE", "ERROR"


def let(c: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(c), with c computed once however often fn names it: an expression that is written out in many places makes plans that take longer to compile than to run."""
    return F.get(F.transform(F.array(c), lambda x: fn(x)), F.lit(0))


def outcome(value: Column, reason: Column) -> Column:
    """value if it isn't null; else an ERROR for the reason, or NONE if there is none."""

    def result(x: Column) -> Column:
        has = x["value"].isNotNull()
        return F.struct(x["value"].alias("value"), F.when(has, OK).when(x["reason"].isNotNull(), ERROR).otherwise(NONE).alias("status"), F.when(~has, x["reason"]).alias("reason"))

    return let(F.struct(value.alias("value"), reason.cast("string").alias("reason")), result)


def _said(c: Column) -> Column:
    return F.nullif(F.trim(c.cast("string"), F.lit(" \t\r\n")), F.lit(""))


def number(c: Column, kind: str = "long", least: float | None = None, most: float | None = None) -> Column:
    """A number with or without thousands separators; cut to a whole one if kind is a whole number's. Reasons: not_a_number, out_of_range."""

    def sound(v: Column) -> Column:
        within = F.lit(True)
        if least is not None:
            within = within & (v >= least)
        if most is not None:
            within = within & (v <= most)
        return F.when(within, v)

    def read(plain: Column) -> Column:
        shaped = plain.rlike(r"^[+-]?\d+(\.\d+)?$")
        # digits before the point beyond a decimal's are out of range; those after it don't matter
        value = F.regexp_replace(plain, r"(\.\d{10})\d+$", "$1").try_cast("decimal(38,10)").try_cast(kind)
        return outcome(F.when(shaped, value if least is most is None else let(value, sound)), F.when(plain.isNotNull(), F.when(shaped, "out_of_range").otherwise("not_a_number")))

    return let(F.regexp_replace(_said(c), ",", ""), read)


def date(c: Column, *formats: str) -> Column:
    """The first of the formats that fits, as a timestamp. Reason: not_a_date."""
    said = _said(c)
    return outcome(F.coalesce(*[F.try_to_timestamp(said, F.lit(f)) for f in formats]), F.when(said.isNotNull(), F.lit("not_a_date")))


def json(c: Column, required: tuple[str, ...] = ()) -> Column:
    """JSON of an object, as a variant, with the required fields. Reasons: invalid_json, not_an_object, missing:field."""

    def read(x: Column) -> Column:
        v = x["v"]
        reason = F.when(v.isNull(), "invalid_json").when(~F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), "not_an_object")
        for field in required:
            lacks = F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{field}", "variant")) == "VOID", F.lit(True))
            reason = reason.when(lacks, f"missing:{field}")
        reason = F.when(x["said"].isNotNull(), reason)
        return outcome(F.when(reason.isNull(), v), reason)

    return let(let(_said(c), lambda said: F.struct(said.alias("said"), F.try_parse_json(said).alias("v"))), read)


def then(checked: Column, fn: Callable[[Column], Column], reason: str) -> Column:
    """fn of an OK value; an ERROR for that reason where it gives null. Else as it was."""
    return let(checked, lambda x: outcome(F.when(x["status"] == OK, fn(x["value"])), F.coalesce(x["reason"], F.when(x["status"] == OK, F.lit(reason)))))


def each(texts: Column, one: Callable[[Column], Column]) -> Column:
    """An array of texts as checked values together: the array of their values, or the first error. NONE for no texts."""

    def result(found: Column) -> Column:
        first = F.get(F.filter(found, lambda x: x["status"] == ERROR), F.lit(0))["reason"]
        return outcome(F.when(F.forall(found, lambda x: x["status"] != ERROR) & (F.size(found) > 0), F.transform(found, lambda x: x["value"])), first)

    return let(F.transform(texts, lambda t: one(t)), result)


def together(**parts: Column) -> Column:
    """Checked values as one: a struct of all values, null where nothing was said; or the first error, named by its part."""

    def result(x: Column) -> Column:
        first = F.coalesce(*[F.when(x[n]["status"] == ERROR, F.concat(F.lit(f"{n}:"), x[n]["reason"])) for n in parts])
        return outcome(F.when(first.isNull(), F.struct(*[x[n]["value"].alias(n) for n in parts])), first)

    return let(F.struct(*[p.alias(n) for n, p in parts.items()]), result)


def unwrap(df: DataFrame, *columns: str) -> DataFrame:
    """df with the values of checked columns, errors as null."""
    return df.withColumns({c: F.col(c)["value"] for c in columns})


def _bad(*columns: str) -> Column:
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.coalesce(F.col(c)["status"] == ERROR, F.lit(False))
    return bad


def good(df: DataFrame, *columns: str) -> DataFrame:
    """The rows without an error in the checked columns, which become their values."""
    return unwrap(df.filter(~_bad(*columns)), *columns)


def errors(df: DataFrame, *columns: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """keep, field, reason: one row an error in the checked columns, in one pass."""
    rows = df.select(*keep, F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c)["status"].alias("status"), F.col(c)["reason"].alias("reason")) for c in columns])).alias("e"))
    return rows.filter(F.col("e.status") == ERROR).select(*keep, "e.field", "e.reason")


def strict(df: DataFrame, *columns: str) -> DataFrame:
    """good(), or a failed job at the first error."""
    said = F.concat_ws(", ", *[F.when(F.col(c)["status"] == ERROR, F.concat(F.lit(f"{c}: "), F.col(c)["reason"])) for c in columns])
    return unwrap(df.filter(F.when(_bad(*columns), F.raise_error(F.concat(F.lit("bad record: "), said)).cast("boolean")).otherwise(F.lit(True))), *columns)
