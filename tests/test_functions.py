"""Column functions against literal cases."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plansift.functions import checked, geo, money, text


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items())).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("said", "want"),
    [("₹700–₹1,000 per night (Approx.)", (700, 1000)), ("₹100–200", (100, 200)), ("₹10,000+", (10000, 10000)), (None, None), ("Free", None), ("₹99.9-150.5", (99, 150)), ("Room 12", (12, 12))],
)
def test_price_range(spark, said, want):
    got = one(spark, money.price_range(F.col("t")), t=said)
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(
    ("said", "want"),
    [
        ("2 nights in 2 rooms, one way trip", {"nights": 2, "rooms": 2, "oneway": True, "roundtrip": False}),
        ("0 rooms", {"rooms": 1}),
        ("for 2 days", {"persons": None, "days": 2, "nights": 1, "nights_from_days": True}),
        ("a group of 4, round-trip but one way", {"persons": 4, "roundtrip": False, "oneway": True}),
        ("3 adults without a hotel", {"persons": 3, "stay_excluded": True}),
        (None, {"days": None, "rooms": None, "oneway": False}),
    ],
)
def test_trip_params(spark, said, want):
    p = money.trip_params(F.col("t"))
    row = spark.createDataFrame([(said,)], "t string").select(*[p[k].alias(k) for k in want]).first().asDict()
    assert row == want


def test_normalize_and_tokens(spark):
    assert one(spark, text.normalize(F.col("t")), t="  Sri  Rama's-Temple, (Old) ") == "sri ramas temple old"
    assert one(spark, text.normalize(F.col("t")), t=None) == ""
    assert sorted(one(spark, text.tokens(F.col("t")), t="The best Hotel near Lake View 42 lake")) == ["lake", "view"]
    assert sorted(one(spark, text.words(F.col("t")), t="Café-bar's é ñandú x1")) == ["café-bar's", "x1", "ñandú"]


def test_clean_and_repair(spark):
    assert one(spark, text.clean(F.col("t")), t="a :contentReference[oaicite:1]{index=1} b") == "a b"
    assert one(spark, text.unglue(F.col("t")), t="₹700₹4500") == "₹700–₹4500"
    assert one(spark, text.truncate(F.col("t"), 3), t="abcd") == "abc …"


def test_numbers(spark):
    got = one(spark, text.numbers(F.col("t")), t="₹1,066 costs 8.30 in 60km")
    assert got == ["1066", "8.30"]


def test_distance(spark):
    km = one(spark, geo.route_km(F.col("a"), F.col("b"), F.col("c"), F.col("d")), a=17.385, b=78.0, c=17.385, d=79.0)
    assert 95 < km < 115
    assert one(spark, geo.route_minutes(F.col("a")), a=0.0) == 0.0
    assert one(spark, geo.coordinate(F.col("t"), 90), t="91") is None
    assert one(spark, money.fuel_rate(116.15, 14.0), t="x") == 8.3


def test_eta(spark):
    e = one(spark, money.eta(F.col("m"), F.lit(30)), m=120.0)
    assert (e.value, e.status, e.estimated) == (150.0, "OK", True)
    assert one(spark, money.eta(F.col("m"), F.lit(30)), m=-1.0).status == "UNAVAILABLE"
    assert one(spark, money.distance_cost(F.col("m"), F.lit(None).cast("double")), m=1.0).reason == "missing_rate"


NUMERALS = ["9" * n for n in (1, 9, 10, 18, 19, 20, 38, 39, 300)] + ["0" * 50 + "7", "1." + "3" * 60, "1,000", ",", "-5", "+7", "1e5", "0x1", "٣", "NaN", "Infinity", "", " ", None]


def test_checked_numbers(spark):
    df = spark.createDataFrame([(t,) for t in NUMERALS], "t string")
    got = {r.t: (r.n, r.d) for r in df.select("t", checked.number(F.col("t")).alias("n"), checked.number(F.col("t"), "double", -10, 10).alias("d")).collect()}
    assert {t: tuple(n) for t, (n, _) in got.items() if t and len(t) < 40} == {
        "9": (9, "OK", None), "9" * 9: (10**9 - 1, "OK", None), "9" * 10: (10**10 - 1, "OK", None), "9" * 18: (10**18 - 1, "OK", None), "9" * 19: (None, "ERROR", "out_of_range"), "9" * 20: (None, "ERROR", "out_of_range"), "9" * 38: (None, "ERROR", "out_of_range"),
        "9" * 39: (None, "ERROR", "out_of_range"), "1,000": (1000, "OK", None), ",": (None, "ERROR", "not_a_number"), "-5": (-5, "OK", None), "+7": (7, "OK", None), "1e5": (None, "ERROR", "not_a_number"), "0x1": (None, "ERROR", "not_a_number"),
        "٣": (None, "ERROR", "not_a_number"), "NaN": (None, "ERROR", "not_a_number"), "Infinity": (None, "ERROR", "not_a_number"), " ": (None, "NONE", None),
    }
    assert got["0" * 50 + "7"][0].value == 7 and got["1." + "3" * 60][0].value == 1 and got[None][0].status == got[""][0].status == "NONE"
    assert got["9"][1].value == 9.0 and got["1,000"][1].reason == "out_of_range"


def test_checked_json_and_dates(spark):
    df = spark.createDataFrame([('{"a": 1}',), ('{"a": null}',), ("[1]",), ("{",), ("",), (None,), ('{"b": "2024-01-01"}',), ("1",)], "t string")
    got = [(r.status, r.reason) for r in df.select(checked.json(F.col("t"), ("a",)).alias("j")).select("j.status", "j.reason").collect()]
    assert got == [("OK", None), ("ERROR", "missing:a"), ("ERROR", "not_an_object"), ("ERROR", "invalid_json"), ("NONE", None), ("NONE", None), ("ERROR", "missing:a"), ("ERROR", "not_an_object")]
    days = spark.createDataFrame([("2024-02-29",), ("2023-02-29",), ("31/12/2024",), ("x" * 1000,), (None,)], "t string").select("t", checked.date(F.col("t"), "yyyy-MM-dd", "dd/MM/yyyy").alias("d"))
    assert [r.d.status for r in days.collect()] == ["OK", "ERROR", "OK", "ERROR", "NONE"]
    assert checked.good(days, "d").count() == 3 and [tuple(r)[1:] for r in checked.errors(days, "d", keep=("t",)).collect()] == [("d", "not_a_date")] * 2
    with pytest.raises(Exception, match="bad record: d: not_a_date"):
        checked.strict(days, "d").collect()


DIGITS = st.text("0123456789", min_size=1, max_size=400)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(DIGITS, min_size=1, max_size=4))
def test_no_text_of_digits_fails_a_job(spark, numerals):
    """Numbers of any length in all parsers of money, trips, numbers and coordinates."""
    texts = [f"₹{n}–{numerals[-1]}.{n}" for n in numerals] + [f"{n} days {n} nights for {n} people in {n} rooms" for n in numerals] + numerals
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    rows = df.select("t", money.price_range_checked(t).alias("price"), money.amounts(t).alias("amounts"), money.trip_numbers_checked(t).alias("trip"), *money.trip_params(t).values(), F.transform(text.numbers(t), text.same_value).alias("same"), geo.coordinate(t, 90.0).alias("c"), geo.coordinate_checked(t, 90.0).alias("cc")).collect()
    for r in rows[len(numerals) : 2 * len(numerals)]:
        n = int(r.t.split()[0])
        assert (r.trip.status, r.trip.reason) == (("OK", None) if n < 2**31 else ("ERROR", "days:out_of_range"))
    for r in rows[2 * len(numerals) :]:
        n = int(r.t)
        assert tuple(r.price.value or ()) == ((n, n) if n < 2**63 else ()) and r.price.status == ("OK" if n < 2**63 else "ERROR")


def test_same_value(spark):
    pairs = {"8.30": "8.3", "5.0": "5", "007": "7", "0": "0", "00.10": "0.1", "9" * 60: "9" * 60, "10": "10", "1.050": "1.05"}
    df = spark.createDataFrame([(k,) for k in pairs], "t string").select("t", text.same_value(F.col("t")).alias("v"))
    assert {r.t: r.v for r in df.collect()} == pairs
