"""Text functions as Columns: normalisation, tokens, numbers in text. All but truncate_nested stay in the JVM."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words that say nothing about a place.
STOPWORDS = (
    "the and for near from with please where what give some good best top any around into that this tell about need want "
    "looking show find hotel hotels room rooms stay lodging lodge restaurant restaurants cafe cafes food eat dining tiffin "
    "meals temple temples nearby available place"
).split()

# Patterns of citation markers and of numbers that aren't glued to words.
CITATION = r"\s*:contentReference\[[^\]]*\]\{[^}]*\}"
NUMBER = r"(?<![\w.])-?\d+(?:\.\d+)?(?![\w.])"
#: Letters, marks, digits and underscores, joined by hyphens and apostrophes.
WORD = r"[\p{L}\p{M}\p{N}_]+(?:['-]+[\p{L}\p{M}\p{N}_]+)*"


def normalize(c: Column) -> Column:
    """Name for look-up: lower case, separators as blanks, no quotes, single blanks. Null gives ''."""
    low = F.translate(F.lower(F.coalesce(c, F.lit(""))), "-_,./\\():;'\"", " " * 10)
    return F.trim(F.regexp_replace(low, r"(?U)\s+", " "))


def clean(c: Column, limit: int = 350) -> Column:
    """Without citation markers, cut to limit code points. Null gives ''."""
    return F.substring(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), CITATION, ""), 1, limit)


def truncate(c: Column, limit: int) -> Column:
    """Cut to limit code points with an ellipsis, where longer."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(" …"))).otherwise(c)


#: So many texts of a batch are turned into Python strings at a time.
SLICE = 256


def by_slices(one, *columns: pa.Array) -> pa.Array:
    """one(values) of each row, as strings, SLICE rows at a time."""
    out = []
    for low in range(0, len(columns[0]), SLICE):
        out.append(pa.array([one(*r) for r in zip(*(c.slice(low, SLICE).to_pylist() for c in columns))], pa.string()))
    return pa.concat_arrays(out) if out else pa.array([], pa.string())


@F.arrow_udf(StringType())
def _cut_nested(texts: pa.Array, limits: pa.Array) -> pa.Array:
    import json

    def cut(x, n):
        if isinstance(x, str):
            return x if len(x) <= n else x[:n] + " …"
        if isinstance(x, list):
            return [cut(y, n) for y in x]
        return {k: cut(y, n) for k, y in x.items()} if isinstance(x, dict) else x

    def one(text, n):
        try:
            return None if text is None else json.dumps(cut(json.loads(text), n), ensure_ascii=False)
        except (ValueError, RecursionError):
            return None

    return by_slices(one, texts, limits)


def truncate_nested(c: Column, limit: int) -> Column:
    """JSON text with all its strings, however deep, cut to limit code points with an ellipsis; null for what isn't JSON."""
    return _cut_nested(c, F.lit(limit))


def unglue(c: Column) -> Column:
    """An en dash put between amounts that were written together."""
    return F.regexp_replace(c, r"(?<=\d)₹(?=\d)", "–₹")


def tokens(c: Column) -> Column:
    """Distinct ASCII tokens of three characters or more that aren't stopwords."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[a-z0-9]+"), F.lit(0))
    return F.array_except(F.array_distinct(F.filter(found, lambda t: F.length(t) >= 3)), F.array(*map(F.lit, STOPWORDS)))


def words(c: Column) -> Column:
    """Distinct lower-cased word tokens of two characters or more."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(WORD), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: F.length(t) > 1))


def strip_thousands(c: Column) -> Column:
    return F.regexp_replace(c, r"(?<=\d),(?=\d{3}(?!\d))", "")


def numbers(c: Column) -> Column:
    """Distinct number tokens of a text, thousands separators removed."""
    return F.array_distinct(F.regexp_extract_all(strip_thousands(c), F.lit(NUMBER), F.lit(0)))


def same_value(token: Column) -> Column:
    """What two number tokens have in common if they are the same number, however long: 8.30 and 8.3, 5.0 and 5, 007 and 7."""
    whole = F.regexp_replace(F.regexp_extract(token, r"^[^.]*", 0), r"^0+(?=\d)", "")
    part = F.regexp_replace(F.regexp_extract(token, r"\.(\d+)$", 1), "0+$", "")
    return F.when(part != "", F.concat(whole, F.lit("."), part)).otherwise(whole)


def search_link(template: str, c: Column) -> Column:
    """A link from a template with {query}, form-encoded."""
    before, _, after = template.partition("{query}")
    return F.concat(F.lit(before), F.url_encode(F.trim(c)), F.lit(after))


def strip_marks(c: Column) -> Column:
    """Without trailing full stops, commas, semicolons, colons and blanks."""
    return F.regexp_replace(F.trim(c), r"[.,;:\s]+$", "")


def first_filled(*columns: Column) -> Column:
    """The first that isn't null, an empty string, array or map (all of one type; 0 and false count as filled). An array or map column must come through filled()."""
    return F.coalesce(*[F.when(c.cast("string") != "", c) for c in columns])


def filled(c: Column) -> Column:
    """An array or map, null if it is empty."""
    return F.when(F.size(c) > 0, c)


def cache_key(prefix: str, kind: Column, *parts: Column) -> Column:
    """prefix, kind and parts (trimmed, in small letters, blanks as underscores), joined by colons."""
    one = lambda p: F.replace(F.lower(F.trim(p.cast("string"))), F.lit(" "), F.lit("_"))
    return F.concat(F.lit(prefix), kind, F.lit(":"), F.concat_ws(":", *map(one, parts)))
