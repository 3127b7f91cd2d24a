"""Operators on small tables."""

from difflib import SequenceMatcher

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plansift.operators import documents, geo_joins, grounding, registry, resolve, state
from plansift.sources import json_layouts


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_layouts(spark):
    docs = ['{"restaurantName":{"value":"A"},"location":{"address":{"value":"x"}},"cuisine":{"types":["p","q"]}}', '{"restaurantName":{"value":null}}', '{"restaurantName":"B","travelInformation":{"distanceFromTempleKm":{"value":1.234}},"businessStatus":"CLOSED"}', "{bad", None, "[1]"]
    df = json_layouts.restaurants(spark.createDataFrame([(d,) for d in docs], "value string"))
    assert [(r.name, r.address, r.distance_km, r.cuisines, r.open) for r in df.orderBy("name").collect()] == [("A", "x", None, ["p", "q"], True), ("B", "", 1.23, [], False)]
    checked = json_layouts.quarantine(spark.createDataFrame([(d,) for d in docs], "value string"), "value", ("restaurantName",))
    assert [r.status for r in checked.collect()] == ["ok", "invalid_record", "ok", "invalid_json", "invalid_json", "invalid_record"]
    assert json_layouts.strict(checked.filter("status = 'ok'")).count() == 2
    with pytest.raises(Exception, match="bad record: invalid_"):
        json_layouts.strict(checked).collect()


def test_restaurant_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"restaurantName": {"value": " A "},\n "associatedTemple": {"templeId": "T1"}, "dietaryInformation": {"vegetarian": false}, "foodType": {"pureVeg": true}, "priceInformation": {"averageCostForOne": {"value": "₹200-300"}}, "customerInformation": {"totalReviews": 12}, "distanceFromTemple": {"walkingDistance": {"value": 0.456}, "drivingDistance": 9}, "location": {"landmark": "gate"}}')
    (tmp_path / "b.json").write_text("[]")
    good, bad = json_layouts.read_restaurant_files(spark, str(tmp_path))
    (r,) = good.collect()
    assert [x.reason for x in bad.collect()] == ["not_an_object"]
    assert (r.name, r.temple_id, r.vegetarian, r.pure_veg, r.cost_for_one, r.reviews, r.distance_km, r.address) == ("A", "T1", False, True, "₹200-300", "12", 0.46, "gate")


def test_first_filled(spark):
    from plansift.functions.text import filled, first_filled

    df = spark.createDataFrame([("", None, "c", [], [1]), (None, "b", "c", [2], [1])], "a string, b string, c string, x array<int>, y array<int>")
    got = df.select(first_filled(F.col("a"), F.col("b"), F.col("c")).alias("t"), F.coalesce(filled(F.col("x")), filled(F.col("y"))).alias("l"), first_filled(F.lit(0), F.lit(5)).alias("n"), first_filled(F.lit(False)).alias("f")).collect()
    assert [tuple(r) for r in got] == [("c", [1], 0, False), ("b", [2], 0, False)]


def test_hotel_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"temple_id": "T1", "associated_temple": " X ",\n "hotels": [{"hotel_name": "H", "booking_links": {"a": "https://b", "c": null}, "amenities": ["x", " "]}, {"hotel_name": ""}]}')
    (r,) = json_layouts.read_hotel_files(spark, str(tmp_path))[0].collect()
    assert (r.name, r.temple_id, r.temple_name, r.booking_links, r.amenities) == ("H", "T1", "X", {"a": "https://b"}, ["x"])


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. \n", max_size=400))
def test_chunks_fit_and_cover(text):
    got = documents.split_text(text, 40, 10)
    assert all(len(c) <= 40 for c in got)
    assert set("".join(got)) - set(" \n") == set(text) - set(" \n")


def test_chunks_of_a_table(spark):
    df = spark.createDataFrame([(1, "word " * 500), (2, None), (3, "")], "id long, t string")
    got = documents.chunks(df, "id", "t").toPandas()
    assert set(got.id) == {1} and (got.chunk.str.len() <= 800).all() and list(got.chunk_index) == list(range(len(got)))
    assert documents.append_new(documents.chunks(df, "id", "t"), documents.chunks(df, "id", "t"), "id").count() == 0


def test_fuzzy_pairs_lose_nothing(spark):
    names = ["golden temple", "golden temples", "silver lake", "goldn tempel", "lake silver", "x"]
    asked = ["golden temple", "goldentemple", "silver lak", "y"]
    m = spark.createDataFrame(list(enumerate(asked)), "m_id long, mention string")
    n = spark.createDataFrame([(x,) for x in names], "alias string")
    for limit in (0.72, 0.88):
        got = {(r.mention, r.alias) for r in resolve.fuzzy_pairs(m, n, limit).collect()}
        want = {(a, b) for a in asked for b in names if SequenceMatcher(None, a, b).ratio() >= limit}
        assert want <= got


def test_resolution_by_context(spark):
    scored = spark.createDataFrame([(1, "a", 0), (1, "b", 0), (2, "a", 40), (2, "b", 0), (3, "c", 0)], "m_id long, k string, context int")
    got = {r.m_id: (r.status, r.k, r.match_type) for r in resolve.decide_exact(scored, "k").collect()}
    assert got == {1: ("AMBIGUOUS", None, "exact_ambiguous"), 2: ("RESOLVED", "a", "exact_context"), 3: ("RESOLVED", "c", "exact")}
    near = spark.createDataFrame([(1, "a", 0, 0.95), (1, "b", 0, 0.9), (2, "a", 0, 0.9), (2, "b", 0, 0.9), (3, "a", 40, 0.9), (3, "b", 0, 0.99)], "m_id long, k string, context int, score double")
    got = {r.m_id: (r.status, r.k, r.match_type) for r in resolve.decide_fuzzy(near, "k").collect()}
    assert got == {1: ("RESOLVED", "a", "fuzzy"), 2: ("AMBIGUOUS", None, "fuzzy_ambiguous"), 3: ("RESOLVED", "a", "fuzzy_context")}


def test_names(spark):
    df = spark.createDataFrame([("Kancharla Gopanna (Bhakta Ramadasu).", True), ("Komuravelli Mallanna Jathara", False), ("", False)], "n string, p boolean")
    got = [[(v.variant, v.rule) for v in r.v] for r in df.select(registry.name_variants(F.col("n"), F.col("p")).alias("v")).collect()]
    assert ("Ramadasu", "last_word") in got[0] and ("Kancharla Gopanna", "main") in got[0]
    assert ("Komuravelli Jathara", "event") in got[1] and got[2] == []


def test_radius_join_is_exact(spark):
    import random

    random.seed(3)
    pts = [(i, 10 + random.random(), 70 + random.random()) for i in range(80)]
    a = spark.createDataFrame(pts[:10], "anchor_id long, lat double, lng double")
    p = spark.createDataFrame(pts, "point_id long, lat double, lng double")
    from plansift.functions.geo import haversine

    near = a.toDF("anchor_id", "x", "y").crossJoin(p).withColumn("d", haversine(F.col("x"), F.col("y"), F.col("lat"), F.col("lng"))).filter("d <= 20")
    assert rows(geo_joins.radius_join(a, p, 20.0, 99).select("anchor_id", "point_id")) == rows(near.select("anchor_id", "point_id"))


def test_radius_join_by_the_poles_and_over_the_date_line(spark):
    from plansift.functions.geo import haversine

    pts = [(i, lat, lng) for i, (lat, lng) in enumerate((a, b) for a in (-90.0, -89.7, -80.0, 0.0, 0.3, 74.9, 75.2, 89.6, 89.9, 90.0) for b in (-180.0, -179.9, -90.0, 0.1, 89.0, 179.8, 180.0))]
    pts += [(900, None, 1.0), (901, 95.0, 1.0)]
    a = spark.createDataFrame(pts, "anchor_id long, lat double, lng double")
    p = spark.createDataFrame(pts, "point_id long, lat double, lng double")
    for km in (5.0, 40.0, 700.0, 6000.0):
        near = a.toDF("anchor_id", "x", "y").crossJoin(p).withColumn("d", haversine(F.col("x"), F.col("y"), F.col("lat"), F.col("lng"))).filter((F.col("d") <= km) & ~F.col("anchor_id").isin(900, 901) & ~F.col("point_id").isin(900, 901))
        assert rows(geo_joins.radius_join(a, p, km, 999).select("anchor_id", "point_id")) == rows(near.select("anchor_id", "point_id"))


def test_near_names_go(spark):
    items = spark.createDataFrame([(1, "Hotel Sun", 1), (1, "Lake Palace", 2), (1, "Lake Palaces", 3), (2, "Hotel Sun", 1), (2, None, 2)], "k long, name string, rank int")
    known = spark.createDataFrame([(1, "hotel sun"), (1, None)], "k long, name string")
    assert rows(geo_joins.drop_near_names(items, known, "k", "name", "rank").select("k", "name")) == [(1, "Lake Palace"), (2, "Hotel Sun")]


def test_grounding(spark):
    d = spark.createDataFrame([(1, "₹1,066 and 9999")], "k long, draft string")
    e = spark.createDataFrame([(1, "total 1066.0")], "k long, evidence string")
    assert rows(grounding.ungrounded(d, e, "k")) == [(1, ["9999"], 1)]


def test_gate(spark):
    df = spark.createDataFrame([("Someone is unconscious and not breathing.",), ("strokes endangered",), (None,), ("గుండెపోటు వచ్చింది",)], "t string")
    assert [r.x for r in df.select(state.is_urgent(F.col("t")).alias("x")).collect()] == [True, False, False, True]


def test_stream_equals_batch(spark):
    from plansift.plans import QUERIES

    d = "/root/testdata/sf0.001"
    key = lambda df: {r.user_id: r.history for r in df.collect()}
    assert key(QUERIES["session_state_stream"](spark, d)) == key(QUERIES["session_last10"](spark, d))


def test_focus_and_priority(spark):
    df = spark.createDataFrame([("temple timings", "The temple timings: open at six.", "faq"), ("hello there", "x", None), ("", "y", "audio")], "q string, c string, k string")
    got = df.select(documents.focus(F.col("q"), F.col("c"), F.col("k")).alias("f"), documents.lexical(F.col("q"), F.col("c"), F.coalesce("k", F.lit(""))).alias("l"), documents.priority(F.col("k")).alias("p")).collect()
    assert got[0].f > 1 and got[1].f == 0 and got[2].l == 0 and [r.p for r in got] == [0.96, 0.70, 0.85]


def test_stringify(spark):
    df = spark.createDataFrame([('{"a_b": {"c": [1, "x"], "d": null, "e": true}}',), ("{",), (None,)], "t string")
    assert [r.x for r in df.select(json_layouts.stringify(F.col("t")).alias("x")).collect()] == ["A B:\nC:\n1\nx\nE: True", None, None]


def test_places(spark):
    places = spark.createDataFrame([("p", "Old Town", "t", ["o"], 1.0)], "place_id string, name string, place_type string, aliases array<string>, latitude double")
    e = spark.createDataFrame([("1", "t", "old town, X", ["a"], 2.0), ("2", "t", "New, Y", list("abcde"), 2.0), ("3", "t", "Far", [], None)], "entity_id string, entity_type string, canonical_name string, aliases array<string>, latitude double")
    assert [(r.place_id, len(r.aliases)) for r in json_layouts.append_places(places, e).collect()] == [("p", 1), ("2", 4)]


def test_as_of(spark):
    w = pd.DataFrame({"k": [1, 1, 1], "ts": pd.to_datetime([0, 100, 200], unit="s"), "payload": ["a", "b", "c"], "negative": [False, True, False], "ttl_s": [50, 30, 50]})
    r = pd.DataFrame({"k": [1] * 5, "ts": pd.to_datetime([-1, 50, 51, 101, 200], unit="s"), "read_id": range(5)})
    got = state.as_of(spark.createDataFrame(r), spark.createDataFrame(w), "k", "ts")
    assert rows(got.select("read_id", "hit", "payload")) == [(0, False, None), (1, True, "a"), (2, False, None), (3, False, None), (4, True, "c")]


SF = "/root/testdata/sf0.001"


def plain_fuzzy(mention, names, limit=0.88):
    """(score, alias, key) of the names (alias, key) near a mention, the best alias of each key, ten at most."""
    best = {}
    for alias, key in names:
        s = SequenceMatcher(None, mention, alias).ratio()
        if s >= limit and (key not in best or s > best[key][0]):
            best[key] = (s, alias, key)
    return [(round(s, 4), a, k) for s, a, k in sorted(best.values(), key=lambda x: (-x[0], x[1], x[2]))[:10]]


def part_names():
    import duckdb

    got = duckdb.sql(f"select p_partkey, p_name, p_brand from '{SF}/part.parquet'").fetchall()
    return got, {k: b for k, _, b in got}


def hurt(k, name):
    return name[:3] + name[4:] if k % 3 == 0 else name + "x" if k % 3 == 1 else name


def test_resolve_fuzzy_by_brute_force(spark):
    from plansift.plans import QUERIES

    parts, brand = part_names()
    want = {}
    for k, name, own in parts:
        if k % 100:
            continue
        scored = [(40 if brand[x] == own else 0, s, x) for s, _, x in plain_fuzzy(hurt(k, name), [(n, x) for x, n, _ in parts])]
        if not scored:
            continue
        top, lead = max(c for c, _, _ in scored), max(scored)[1]
        context, near = [x for c, _, x in scored if c == top], [x for _, s, x in scored if s == lead]
        want[k] = ("RESOLVED", context[0], "fuzzy_context") if top and len(context) == 1 else ("RESOLVED", near[0], "fuzzy") if len(near) == 1 else ("AMBIGUOUS", None, "fuzzy_ambiguous")
    assert {r.m_id: (r.status, r.key, r.match_type) for r in QUERIES["resolve_fuzzy"](spark, SF).collect()} == want and want


def test_resolve_mentions_by_brute_force(spark):
    from plansift.plans import QUERIES

    parts, brand = part_names()
    types = {"event": ("festival", "topic", "query_variation"), "landmark": ("landmark", "place", "festival", "event", "topic", "query_variation"), "person": ("person", "topic", "associated_person", "historical_person"), "place": ("place",)}
    kinds = ("festival", "person", "topic")
    named = [(n, k) for k, n, _ in parts]
    said = [(f"{n} {b.lower()}", k, kinds[k % 3]) for k, n, b in parts]
    asked = {k: (f"{n} {b.lower()}{' a' if k % 500 == 0 else ''}", "event" if k % 400 == 0 else "place" if k % 400 == 100 else "landmark" if k % 400 == 200 else "person" if k % 800 == 300 else None) for k, n, b in parts if k % 100 == 0}
    asked |= {k + 10_000_000: (hurt(k, n), None) for k, n, _ in parts if k % 100 == 0}
    want = {}
    for m, (text, kind) in asked.items():
        # all parts are places, so a type that isn't theirs leaves related mentions alone
        mine = named if kind in (None, "place") else []
        same = [k for n, k in mine if n == text]
        if same:
            want[m] = ("RESOLVED", same[0], "exact") if len(same) == 1 else ("AMBIGUOUS", None, "exact_ambiguous")
            continue
        if near := plain_fuzzy(text, mine):
            first = [k for s, _, k in near if s == near[0][0]]
            want[m] = ("RESOLVED", first[0], "fuzzy") if len(first) == 1 else ("AMBIGUOUS", None, "fuzzy_ambiguous")
            continue
        fits = [(a, k) for a, k, t in said if kind is None or kind == "place" or t in types[kind]]
        same = {k for a, k in fits if a == text}
        scored = [(1.0, k) for k in same] or sorted(((round(SequenceMatcher(None, text, a).ratio(), 4), a, k) for a, k in fits if SequenceMatcher(None, text, a).ratio() >= 0.82), key=lambda x: (-x[0], x[1], x[2]))[:10]
        best = {x[-1] for x in scored if x[0] == scored[0][0]}
        name = "related_exact" if same or scored and scored[0][0] == 1 else "related_fuzzy"
        want[m] = ("UNRESOLVED", None, "none") if not best else ("RESOLVED", best.pop(), name) if len(best) == 1 else ("AMBIGUOUS", None, name + "_ambiguous")
    assert {r.m_id: (r.status, r.key, r.match_type) for r in QUERIES["resolve_mentions"](spark, SF).collect()} == want


def test_poi_dedupe_by_brute_force(spark):
    from plansift.plans import QUERIES

    segment = {r.c_custkey: r.c_mktsegment for r in spark.read.parquet(f"{SF}/customer.parquet").collect()}
    near = sorted((r.anchor_id, r["rank"], r.point_id) for r in QUERIES["radius_topk"](spark, SF).collect())
    kept, want = {}, []
    for a, _, p in near:
        name = f"{segment[p]} house {p % 7}"
        seen = kept.setdefault(a, ["building house 1"])
        if all(SequenceMatcher(None, name.lower(), x).ratio() <= 0.72 for x in seen):
            seen.append(name.lower())
            want.append((a, name, p))
    got = QUERIES["poi_dedupe"](spark, SF).collect()
    assert sorted((r.anchor_id, r.name, r.point_id) for r in got if r.source_tier == "LIVE") == sorted(want) and want
    assert sum(r.source_tier == "CURATED" for r in got) == spark.read.parquet(f"{SF}/supplier.parquet").count()


def test_chunks_are_those_of_each_text_and_stored_once(spark):
    from plansift.plans import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = sorted((k, i, c) for k, t in texts.items() if t for i, c in enumerate(documents.split_text(t)))
    assert rows(QUERIES["doc_chunks"](spark, SF)) == want and all(0 < len(c) <= 800 for _, _, c in want)
    assert rows(QUERIES["chunk_store"](spark, SF)) == want


def test_session_state_is_touched_and_deleted(spark, tmp_path):
    from plansift.plans.state import _streaming
    from plansift.streaming import sessions

    hour = 3600
    moves = [(1, 0, 1, "turn"), (1, 20 * hour, 2, "touch"), (1, 40 * hour, 3, "turn"), (2, 0, 4, "turn"), (2, 1, 5, "delete"), (3, 0, 6, "turn"), (3, 30 * hour, 7, "turn"), (4, 0, 8, "turn"), (4, 25 * hour, 9, "touch"), (5, 0, 10, "touch")]
    pdf = pd.DataFrame([(k, pd.Timestamp(10**9 + t, unit="s"), i, a) for k, t, i, a in moves], columns=["k", "ts", "id", "action"])
    df = spark.createDataFrame(pdf)
    df.write.parquet(f"{tmp_path}/in")
    stream = _streaming(spark).readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    got = {r.key: list(r.history) for r in sessions.drained(sessions.last_turns(stream, "k", "ts", "id", "action"), f"{tmp_path}/out", "update").collect()}
    assert got == {1: [1, 3], 2: [], 3: [7], 4: [], 5: []}


def test_state_of_idle_sessions_goes(spark, tmp_path):
    """Later files move the watermark on, and timers drop what has expired: the store holds the last key alone."""
    from plansift.plans.state import _streaming
    from plansift.streaming import sessions

    for n in range(4):
        pdf = pd.DataFrame([(n, pd.Timestamp(10**9 + n * 10 * 86_400, unit="s"), n)], columns=["k", "ts", "id"])
        spark.createDataFrame(pdf).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    stream = _streaming(spark).readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    sessions.drained(sessions.last_turns(stream, "k", "ts", "id"), f"{tmp_path}/out", "update")
    held = spark.read.format("statestore").option("stateVarName", "turns").load(f"{tmp_path}/out/checkpoint")
    assert held.count() <= 2


def test_vector_search_in_blocks_and_parts(spark, monkeypatch):
    import random

    r = random.Random(5)
    v = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(300)] + [(999, [0.0] * 6), (998, [])], "vec_id long, v array<double>")
    q = v.filter("vec_id < 20").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    want = rows(documents.vector_topk(v, q, 4))
    monkeypatch.setattr(documents, "BLOCK", 2)
    monkeypatch.setattr(documents, "BLOCKS", 1)
    assert rows(documents.vector_topk(v, q, 4)) == want and len(want) == 80


def test_odd_restaurant_fields(spark):
    docs = {
        "A": '{"restaurantName":"A","basicInformation":{"cuisineType":[]},"cuisine":{"types":["p",7,{"a":1}," q ",["r"]]},"travelInformation":{"distanceFromTempleKm":"near"},"distanceFromTemple":{"walkingDistance":1.2},"customerInformation":{"totalReviews":12.5}}',
        "B": '{"restaurantName":{"value":"B"},"cuisine":{"types":"ab c"},"travelInformation":{"distanceFromTempleKm":{"value":null}},"distanceFromTemple":{"walkingDistance":{"value":null},"drivingDistance":{"value":" 3.004 "}},"customerInformation":{"totalReviews":"1,200"}}',
        "D": '{"restaurantName":"D","distanceFromTemple":{"walkingDistance":{"text":"x"},"drivingDistance":3.0},"cuisine":"bare"}',
    }
    rest = ['{"name":"C"}', '{"restaurantName":{"name":"x"}}', '{"restaurantName":" "}']
    got = json_layouts.restaurants(spark.createDataFrame([(d,) for d in [*docs.values(), *rest]], "value string"))
    assert {r.name: (r.cuisines, r.distance_km, r.reviews) for r in got.collect()} == {"A": (["p", "q"], None, "12.5"), "B": (["a", "b", "c"], 3.0, "1,200"), "D": ([], None, None)}


@pytest.mark.parametrize("parts", [1, 4, 23])
@pytest.mark.parametrize("n_keys", [1, 3, 300])
def test_as_of_spread_over_ranges(spark, parts, n_keys):
    import random

    r = random.Random(n_keys)
    at = lambda: pd.Timestamp(10**9 + r.randrange(4000), unit="s").to_pydatetime()
    key = lambda: None if r.random() < 0.02 else r.randrange(n_keys)
    writes = spark.createDataFrame([(key(), at(), i, f"p{i}", r.random() < 0.2, r.choice([5, 500, 10**6])) for i in range(700)], "k int, ts timestamp, id long, payload string, negative boolean, ttl_s int")
    reads = spark.createDataFrame([(key(), at(), i) for i in range(900)], "k int, ts timestamp, read_id long")
    want = sorted(state.as_of(reads, writes, "k", "ts", "id").collect(), key=repr)
    assert sorted(state.as_of(reads, writes, "k", "ts", "id", spread=True, parts=parts).collect(), key=repr) == want and len(want) == 900
    assert state.as_of(reads.limit(0), writes.limit(0), "k", "ts", "id", spread=True, parts=parts).collect() == []


def test_one_key_spreads_over_tasks(spark):
    """All rows have one key: no range holds more than twice its share."""
    from plansift.operators import spread

    rows = spark.range(20_000).select(F.lit(1).alias("k"), F.col("id").alias("ts"), F.when(F.col("id") % 97 == 0, F.col("id")).alias("v"))
    got = spread.carry_forward(rows, ["k"], ["ts"], "v", parts=16)
    assert max(r["count"] for r in got.groupBy("_part").count().collect()) <= 2 * 20_000 / 16
    assert got.filter("v <> ts - ts % 97").count() == 0 and got.filter("v is null").count() == 0


def test_last_turns_of_a_hot_key(spark):
    day = 86_400
    moves = [(1, n, n) for n in range(3000)] + [(2, 0, 1), (2, day, 2), (2, 2 * day + 1, 3), (2, 2 * day + 2, 4), (3, 5, 7), (3, 5, 6), (4, 0, 1)]
    df = spark.createDataFrame([(k, pd.Timestamp(10**9 + t, unit="s").to_pydatetime(), i) for k, t, i in moves], "k int, ts timestamp, id long")
    got = state.last_turns(df, "k", "ts", "id", ttl=day)
    assert {r.k: r.history for r in got.collect()} == {1: list(range(2990, 3000)), 2: [3, 4], 3: [6, 7], 4: [1]}
    assert "WindowGroupLimit" in got._jdf.queryExecution().toString()


def test_select_records_by_brute_force(spark):
    """Words that most records hold, requests for several words, ids and mentions, and a bound on what a request meets."""
    import random

    from plansift.functions.text import STOPWORDS
    from plansift.operators import selection

    r = random.Random(4)
    vocabulary = ["common", "lake", "hill", "river", "gate", "veg", "mill"]
    pick = lambda n: [w for w in vocabulary if r.random() < (0.9 if w == "common" else n)]
    records = [(i, f"T{r.randrange(40)}", pick(0.1), pick(0.1) + ["solo"] * (i % 3 == 0), r.choice([True, False, None]), r.choice([True, False, None]), r.choice([None, 1.5, 2.0, 7.0])) for i in range(400)]
    requests = [(q, "the open solo" if q % 6 == 0 else " ".join(pick(0.15)) if q % 3 else "the open", [f"T{r.randrange(60)}" for _ in range(r.randrange(3))] if q % 4 == 0 else None if q % 5 == 0 else [], [" ".join(pick(0.2)) for _ in range(r.randrange(3))]) for q in range(120)]
    rec = spark.createDataFrame(records, "record_id int, place_id string, place_tokens array<string>, name_tokens array<string>, vegetarian boolean, open boolean, distance_km double")
    req = spark.createDataFrame(requests, "request_id int, question string, ids array<string>, mentions array<string>")
    words = lambda t: [w for w in t.split() if len(w) > 2 and w not in STOPWORDS]
    want = []
    for q, question, ids, mentions in requests:
        said = set(words(question))
        first = next((m for m in mentions if any(set(words(m)) & set(x[2]) for x in records)), "")
        hits = [[x for x in records if x[1] in (ids or [])], [x for x in records if said & set(x[2])], [x for x in records if set(words(first)) & set(x[2])], [x for x in records if said & set(x[3])]]
        tier = next((t for t, h in enumerate(hits, 1) if h), None)
        if tier:
            green = bool(said & set(selection.VEGETARIAN))
            order = sorted(hits[tier - 1], key=lambda x: (green and not x[4], not x[5], 999.0 if x[6] is None else x[6], x[0]))[:5]
            some = green and any(x[4] for x in order)
            want += [(q, x[0], tier, n) for n, x in enumerate(order, 1) if not some or x[4]]
    assert rows(selection.select_records(req, rec)) == sorted(want) and len({w[2] for w in want}) == 4
    index = selection.best_by_word(rec)
    assert index.filter("size(best) > 5").count() == 0 and index.groupBy("kind", "word", "green").count().filter("count > 1").count() == 0


@pytest.mark.parametrize("block", [4096, 7])
def test_pruned_search_is_exact_and_skips(spark, monkeypatch, block):
    """Vectors in clusters, with copies and odd ones: all answers, and the more vectors the smaller the share that is scored."""
    import numpy as np

    from plansift.operators import pruned_search

    monkeypatch.setattr(pruned_search, "BLOCK", block)
    rng, shares = np.random.RandomState(3), []
    centres = rng.randn(60, 12)
    for n in (600, 3000) if block > 7 else (600,):
        x = centres[rng.randint(60, size=n)] + 0.15 * rng.randn(n, 12)
        x[n // 2 : n // 2 + 30] = x[5]
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        odd = [(n, None), (n + 1, []), (n + 2, [0.0] * 12), (n + 3, [1.0] * 3)]
        v = spark.createDataFrame([*((i, [float(a) for a in y]) for i, y in enumerate(x)), *odd], "vec_id long, v array<double>").repartition(4)
        q = v.filter("vec_id % 50 = 5 or vec_id >= " + str(n)).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
        got, scored = {}, {}
        for r in pruned_search.topk(v, q, 5, per_reference=20).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, round(r.score, 9))
            scored[r.query_id] = r.n_scored
        for i in range(5, n, 50):
            s = (unit * unit[i]).sum(axis=1).round(9)
            assert got[i] == {k + 1: (j, s[j]) for k, j in enumerate(np.lexsort((np.arange(n), -s))[:5].tolist())}
        shares.append(sum(scored.values()) / len(scored) / n)
        assert not {n, n + 1, n + 2} & set(got)
    assert shares[0] < 0.5 and shares[-1] <= shares[0]
    assert pruned_search.topk(v.limit(0), q, 5).collect() == [] and pruned_search.topk(v, q.limit(0), 5).collect() == []


def test_json_files_of_all_kinds(spark, tmp_path):
    from plansift.sources import json_files

    files = {"a.json": b'{"x": {"y": 5}, "n": "A"}', "b.json": b"\xef\xbb\xbf" + '{"n": "é"}'.encode(), "c.json": b'{"n": "\xff"}', "d.json": b" \n", "e.json": b"{", "f.json": b"[1]", "g.json": b'{"n": null}', "sub/h.json": b'{"n": "H", "pad": "' + b"x" * 300 + b'"}', "i.txt": b"{}"}
    (tmp_path / "sub").mkdir()
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = json_files.read_json_files(spark, str(tmp_path), {"n": ("$.n", "string"), "y": ("$.x.y", "int")}, ("n",), "*.json", 200)
    assert {r.source_file.rsplit("/", 1)[-1]: (r.status, r.reason, r.n, r.y) for r in got.collect()} == {
        "a.json": ("OK", None, "A", 5), "b.json": ("OK", None, "é", None), "c.json": ("ERROR", "not_utf8", None, None), "d.json": ("NONE", None, None, None), "e.json": ("ERROR", "invalid_json", None, None),
        "f.json": ("ERROR", "not_an_object", None, None), "g.json": ("ERROR", "missing:n", None, None), "h.json": ("ERROR", "too_large", None, None),
    }
    names = got.select("source_file")
    assert names.count() == 8 and "ReadSchema: struct<path:string>" in names._jdf.queryExecution().toString().replace("struct<path:string,length:bigint>", "struct<path:string>")


def test_commits_are_whole(spark, tmp_path, monkeypatch):
    from plansift.sources import committed

    path = str(tmp_path / "store")
    of = lambda *pairs: spark.createDataFrame(list(pairs), "k long, v string")
    held = lambda: sorted(map(tuple, committed.read(spark, path).collect()), key=repr)
    with pytest.raises(Exception, match="no table rows"):
        committed.read(spark, path)
    assert committed.append(of((1, "b"), (1, "a"), (2, "x"), (None, "n"), (None, "n")), path, ["k"]) == 1
    assert held() == [(1, "a"), (2, "x"), (None, "n")]
    # a writer that dies before its manifest leaves the old state
    real = committed.commit
    monkeypatch.setattr(committed, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        committed.append(of((3, "lost")), path, ["k"])
    monkeypatch.setattr(committed, "commit", real)
    assert held() == [(1, "a"), (2, "x"), (None, "n")] and committed.vacuum(spark, path) == 1 and len(held()) == 3
    # another writer comes first, with one of the same keys
    def late(*args):
        monkeypatch.setattr(committed, "commit", real)
        committed.append(of((4, "first"), (5, "first")), path, ["k"])
        real(*args)

    monkeypatch.setattr(committed, "commit", late)
    assert committed.append(of((5, "second"), (6, "second"), (None, "again")), path, ["k"]) == 3
    assert held() == [(1, "a"), (2, "x"), (4, "first"), (5, "first"), (6, "second"), (None, "n")]
    committed.replace(path, {"rows": of((9, "z")), "other": of((1, "o"))})
    assert held() == [(9, "z")] and committed.read(spark, path, "other").count() == 1
    with pytest.raises(FileExistsError):
        committed.replace(path, {"other": of((2, "o"))}, once=True)


def test_pattern_hits_by_brute_force(spark):
    """Many patterns, with and without plain text in them, in any case; odd texts."""
    import re

    from plansift.operators import patterns

    named = {p: p for p in (r"\bcall\b", "ambulance", r"a+b", r"x|y1", r"[0-9]{3}", r"(?:one|two) thing", r"fire\s+now", "అంబులెన్స్", "straße", r"\bs\b")} | {f"w{n}": rf"\bword{n}\b" for n in range(300)}
    texts = ["Call an AMBULANCE", "recall", "AAAB 12 345", "y1", "ONE THING", "thing", "fire   now", "firenow", "అంబులెన్స్ కావాలి", "STRASSE Straße", "word7 word77x WORD299", "", None, "s", "word" * 5000 + " word12"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(3)
    want = {(i, n) for i, t in enumerate(texts) if t for n, p in named.items() if re.search(p, t, re.IGNORECASE)}
    assert {(r.id, r.pattern) for r in patterns.hits(df, F.col("t"), named).collect()} == want and len(want) > 12
    assert patterns.hits(df, F.col("t"), {}).count() == 0
    assert [patterns.required_text(p) for p in (r"\bcan't breathe\b", "a|b", "ab+cde", "[xy]z", "(?:ab)")] == ["can't breathe", "", "cde", "z", "ab"]


def test_late_turns_take_their_place(spark, tmp_path):
    """Rows in any order within the delay, over many batches, on top of sessions that there are already: as the batch twin over all rows."""
    import random

    from plansift.plans.state import _streaming
    from plansift.streaming import sessions

    r, hour = random.Random(8), 3600
    moves = [(k, r.randrange(0, 60 * hour), 1000 * k + n) for k in range(12) for n in range(r.randrange(1, 25))]
    frame = lambda rows: pd.DataFrame([(k, pd.Timestamp(10**9 + t, unit="s"), i) for k, t, i in rows], columns=["k", "ts", "id"])
    want = {x.k: (x.history, x.last) for x in state.last_turns(spark.createDataFrame(frame(moves)), "k", "ts", "id", ttl=state.SESSION_TTL).collect()}
    # what came in the first ten hours is there from a batch; the rest comes up to eight hours late
    start = state.last_turns(spark.createDataFrame(frame([m for m in moves if m[1] < 10 * hour])), "k", "ts", "id", ttl=state.SESSION_TTL)
    flow = sorted((m for m in moves if m[1] >= 10 * hour), key=lambda m: m[1] + r.randrange(0, 8 * hour))
    for n in range(0, len(flow), -(-len(flow) // 5)):
        spark.createDataFrame(frame(flow[n : n + -(-len(flow) // 5)])).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    own = _streaming(spark)
    stream = own.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = sessions.drained(sessions.last_turns(stream, "k", "ts", "id", delay="8 hours", start=own.createDataFrame(start.toPandas())), f"{tmp_path}/out", "update")
    last = {}
    for x in sorted(got.collect(), key=lambda x: x.batch):
        if x.history:  # an empty one tells of a session that went
            last[x.key] = (list(x.history), x["last"])
    begun = {x.k: (x.history, x.last) for x in start.collect()}
    assert begun | last == want


def test_whole_answers(spark):
    """Results of every status, with and without evidence, in order."""
    results = [(1, 0, " What? ", "OK", None, None), (1, 1, None, "NEEDS_CLARIFICATION", "", "not shown"), (1, 2, "Where?", "NEEDS_CLARIFICATION", "which town?", None), (1, 3, "Far?", "ERROR", None, "no route"), (1, 4, "", "OK", None, ""), (2, 0, None, "OK", None, None)]
    rows = [(1, 0, 2, "place", "origin", "A", None), (1, 0, 1, "chunk", None, None, "  one\ntwo "), (1, 0, 3, "hotel", None, "H", None), (1, 2, 0, "place", "never", "shown", None), (1, 3, 0, "place", "to", "B", None)]
    r = spark.createDataFrame(results, "k int, result int, question string, status string, query string, error string")
    e = spark.createDataFrame(rows, "k int, result int, pos int, kind string, role string, name string, text string")
    e = grounding.evidence(e, ["k", "result", "pos"], kind=F.col("kind"), role=F.col("role"), name=F.col("name"), text=F.col("text"))
    got = {x.k: x.shown for x in grounding.render_results(r, e, "k").collect()}
    assert got == {1: "Q: What?\none\ntwo\norigin: A\n\nclarification needed\nQ: Where?\nwhich town?\nQ: Far?\n(no route)\nto: B", 2: ""}


def test_related_by_spelling_before_unknown_targets_go(spark):
    """Two spellings of one alias are two of the ten; unknown targets take places among them, and then go."""
    from plansift.operators import resolve

    m = spark.createDataFrame([(1, "old gate keeper", None)], "m_id int, mention string, asked string")
    entities = spark.createDataFrame([("a", "person"), ("b", "person")], "target string, entity_type string")
    near = [("old gate keepers", f"Old Gate-Keepers{n}", "t", "r", "x") for n in range(8)] + [("old gate keepers", s, "t", "r", "a") for s in ("Old Gate Keepers", "OLD GATE KEEPERS")] + [("old gates keeperss", "z", "t", "r", "b")]
    records = spark.createDataFrame(near, "alias string, spelling string, mention_type string, relation string, target string")
    got = resolve.related(m, records, entities)
    assert sorted((r.target, r.alias) for r in got.collect()) == [("a", "old gate keepers")] * 2
    assert sorted(r.target for r in resolve.related(m, records.drop("spelling"), entities).collect()) == ["a", "b"]
