"""Work that must not grow faster than its input: the same answers as brute force, from few rows."""

from pyspark.sql import functions as F

from plansift.functions.geo import haversine
from plansift.operators import geo_joins


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_dense_points_are_found_within_a_fraction_of_the_radius(spark, monkeypatch):
    import random

    random.seed(5)
    pts = [(i, 20 + random.random() / 2, 75 + random.random() / 2) for i in range(2500)] + [(i, 20.2, 75.2) for i in range(3000, 3600)] + [(9000, 20.6, 75.6)]
    p = spark.createDataFrame(pts, "point_id long, lat double, lng double")
    a = spark.createDataFrame([*pts[:60], *pts[2500:2520], pts[-1], (9001, 21.1, 75.5)], "anchor_id long, lat double, lng double")
    asked, within = [], geo_joins._within

    def seen(places, points, km, k):
        asked.append((km, places.count(), points.count()))
        return within(places, points, km, k)

    monkeypatch.setattr(geo_joins, "_within", seen)
    got = rows(geo_joins.radius_join(a, p, 60.0, 4))
    d = a.toDF("anchor_id", "x", "y").crossJoin(p).select("anchor_id", "point_id", haversine(F.col("x"), F.col("y"), F.col("lat"), F.col("lng")).alias("d")).filter("d <= 60").collect()
    best = {}
    for r in d:
        best.setdefault(r.anchor_id, []).append((r.d, r.point_id))
    assert got == sorted((i, q, km, n + 1) for i, found in best.items() for n, (km, q) in enumerate(sorted(found)[:4]))
    # one place of 600 counts as four points, twenty anchors there as one; few are left for the whole radius
    assert asked[0][0] < 60 and asked[0][1:] == (63, 2505) and asked[-1][0] == 60 and asked[-1][1] <= 3


def test_near_names_of_many_keys_are_gone_through_together(spark):
    items = spark.range(3000).selectExpr("id div 3 as k", "element_at(array('Hotel Sun', 'Hotel Suns', 'Lake Palace'), cast(id % 3 + 1 as int)) as name", "cast(3 - id % 3 as int) as rank", "map('a', id) as note")
    known = spark.createDataFrame([(1, "lake palaces")], "k long, name string")
    got = geo_joins.drop_near_names(items, known, "k", "name", "rank")
    assert got.columns == items.columns and "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()
    assert sorted((r["k"], r["name"]) for r in got.collect()) == sorted([(k, "Hotel Suns") for k in range(1000)] + [(k, "Lake Palace") for k in range(1000) if k != 1])


def test_bundled_documents_read_as_files_do(spark, tmp_path):
    from plansift.sources import json_files, json_layouts

    docs = {"a.json": '{"temple_id": "T1", "hotels": [{"hotel_name": "Sun"}]}', "b.json": "{", "c.json": "[1]", "d.json": " \n", "e.json": "", "f.txt": "{}"}
    for name, value in docs.items():
        (tmp_path / "files").mkdir(exist_ok=True)
        (tmp_path / "files" / name).write_text(value)
    path = str(tmp_path / "bundle")
    json_files.write_json_bundles(spark.createDataFrame([*docs.items()] * 1, "name string, value string").coalesce(1), path, "name")
    assert len([f for f in (tmp_path / "bundle").iterdir() if f.name.startswith("part-")]) == 1
    seen = lambda df: sorted((r.source_file.rsplit("/", 1)[-1], r.file_bytes, r.status, r.reason, r.text) for r in df.collect())
    for pattern in ("*", "*.json"):
        assert seen(json_files.read_json_files(spark, path, pattern=pattern, largest=50, bundled=True)) == seen(json_files.read_json_files(spark, str(tmp_path / "files"), pattern=pattern, largest=50))
    good, bad = json_layouts.read_hotel_files(spark, path, bundled=True)
    assert [(r["name"], r["temple_id"]) for r in good.collect()] == [("Sun", "T1")] and rows(bad) == [("b.json", "invalid_json"), ("c.json", "not_an_object")]


def test_names_of_many_entities_are_compared_once(spark, monkeypatch):
    from plansift.operators import resolve

    names = spark.range(400).selectExpr("element_at(array('golden temple', 'golden temples', 'lotus pond'), cast(id % 3 + 1 as int)) as alias", "id as key")
    entities = spark.range(400).selectExpr("id as key", "if(id < 300, 'temple', 'place') as entity_type")
    mentions = spark.range(60).selectExpr("id as m_id", "element_at(array('golden tample', 'lotus pond', 'golden templess'), cast(id % 3 + 1 as int)) as mention", "if(id % 2 = 0, 'place', null) as asked")
    met, pairs = [], resolve.fuzzy_pairs

    def seen(m, n, limit):
        met.append((m.count(), n.count()))
        return pairs(m, n, limit)

    monkeypatch.setattr(resolve, "fuzzy_pairs", seen)
    got = rows(resolve.fuzzy(mentions.filter("m_id < 3"), names, "key"))
    assert [k for m, k, _ in got if m == 2] == list(range(1, 31, 3)) and [k for m, k, _ in got if m == 0] == list(range(0, 30, 3)) and [k for m, k, _ in got if m == 1] == list(range(2, 32, 3))
    found = {r.m_id: (r.status, r.key, r.match_type) for r in resolve.resolve(mentions, names, entities).collect()}
    assert len(found) == 60 and found[1] == found[4] == ("AMBIGUOUS", None, "exact_ambiguous") and found[0] == ("AMBIGUOUS", None, "fuzzy_ambiguous")
    assert all(m <= 3 and n <= 3 for m, n in met)


def test_exact_by_context_is_what_rows_of_all_candidates_give(spark):
    from plansift.operators import resolve

    e = spark.range(600).selectExpr("id as k", "concat('n', id % 4) as alias", "if(id % 11 = 0, null, id * 7 % 13) as city", "id * 5 % 17 as district")
    m = spark.range(0, 600, 7).selectExpr("id as m_id", "concat('n', id % 5) as alias", "id % 15 as city", "id % 19 as district", "if(id % 2 = 0, id + 4 * (id % 3), null) as itself")
    pairs = m.withColumnsRenamed({"city": "c", "district": "d"}).join(e, "alias")
    score = resolve.context_score(F.col("itself") == F.col("k"), F.lit(False), F.col("c") == F.col("city"), F.col("d") == F.col("district"))
    levels = [(65, ["city", "district"]), (40, ["city"]), (25, ["district"]), (0, [])]
    want = resolve.decide_exact(pairs.select("m_id", "k", score.alias("context")), "k")
    got = resolve.exact_by_context(m, e, "k", levels)
    key = lambda df: sorted((r.m_id, r.status, r.k, r.match_type, r.context, r.n) for r in df.collect())
    assert key(got) == key(want) and len({r[4] for r in key(got)}) > 3


def test_records_are_dealt_before_their_mentions_are_read(spark):
    from plansift.operators import registry

    records = spark.createDataFrame([(i, '{"founders": ["A (Great B)", 7], "festivals": [], "faq": 3}' if i % 2 else "{}") for i in range(40)], "k long, j string").coalesce(1).select("k", F.try_parse_json("j").alias("record"))
    found = registry.mentions(records, "k")
    plan = found._jdf.queryExecution().executedPlan().toString()
    generate = plan.index("Generate")
    # the records are shuffled below the first reading, and nothing afterwards
    assert "Exchange hashpartitioning(k" in plan[generate:] and "Exchange" not in plan[:generate]
    assert sorted((r.target, r.mention) for r in found.collect()) == sorted((i, m) for i in range(1, 40, 2) for m in ("A", "A (Great B)", "Great B", "B"))


def test_long_texts_are_chunked_and_embedded_in_slices(spark):
    from plansift.operators import documents

    texts = [None, "", "word " * 900, "é\nü"] * 200
    docs = spark.createDataFrame(list(enumerate(texts)), "k long, t string").coalesce(1)
    got = documents.chunks(docs, "k", "t")
    assert "MapInArrow" in got._jdf.queryExecution().toString()
    assert rows(got) == sorted((k, i, c) for k, t in enumerate(texts) if t for i, c in enumerate(documents.split_text(t)))
    seen = documents.embed(docs, "t", lambda some: [[3.0 * len(t), 4.0 * len(t)] for t in some]).collect()
    assert {r.k: r.v for r in seen} == {k: [0.6, 0.8] if t else [0.0, 0.0] for k, t in enumerate(texts)}


def test_vectors_meet_queries_in_blocks_not_in_pairs(spark):
    import math

    from plansift.operators import documents

    x = [[float((i * 7 + j * 3) % 11 - 5) for j in range(5)] for i in range(400)]
    odd = [(500, None), (501, []), (502, [0.0] * 5), (503, [1.0] * 3), (None, x[3]), (504, [2 * a for a in x[3]]), (505, [float("nan")] * 5)]
    v = spark.createDataFrame([*enumerate(x), *odd], "vec_id long, v array<double>").repartition(3)
    q = v.filter("vec_id % 50 = 3 or vec_id > 499").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    found = documents.vector_topk(v, q, 6)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Join" not in plan
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    unit = {i: [a / math.sqrt(sum(b * b for b in y)) for a in y] for i, y in [*enumerate(x), (None, x[3]), (504, x[3])] if any(y)}
    for i in range(3, 400, 50):
        # what isn't a number is first, as in SQL; equal vectors have equal scores, of which the unnamed one is least
        ranked = sorted(((-round(sum(a * b for a, b in zip(unit[i], y)), 9), -1 if k is None else k) for k, y in unit.items()))[:5]
        assert [k for _, k, _ in sorted(got[i])] == [505] + [None if k == -1 else k for _, k in ranked]
    assert [k for _, k, _ in sorted(got[503])] == [503] and not {500, 501, 502} & set(got)


def test_pruned_search_asks_shelves_not_rings(spark, monkeypatch):
    """Random vectors, where nothing can be skipped: a query makes a row a shelf of vectors, however many rings there are."""
    import random

    from plansift.operators import documents, pruned_search

    r, asks, cut = random.Random(2), [], pruned_search.cut
    v = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(16)]) for i in range(1200)], "vec_id long, v array<double>")
    q = v.filter("vec_id % 40 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))

    def seen(df, *scratch):
        kept = cut(df, *scratch)
        if "query_id" in df.columns and "score" not in df.columns and len(df.columns) > 2:
            asks.append(kept.count())
        return kept

    monkeypatch.setattr(pruned_search, "cut", seen)
    monkeypatch.setattr(pruned_search, "BLOCK", 300)
    got = pruned_search.topk(v, q, 4, per_reference=20).select("query_id", "vec_id", F.round("score", 9).alias("score"), "rank")
    assert rows(got) == rows(documents.vector_topk(v, q, 4).select("query_id", "vec_id", F.round("score", 9).alias("score"), "rank"))
    # 30 queries, 5 shelves
    assert len(asks) == 2 and max(asks) <= 30 * 6


def test_only_turns_that_can_matter_are_held(spark, tmp_path):
    import pandas as pd

    from plansift.plans.state import _streaming
    from plansift.streaming import sessions

    moves = [(1, n, n, "turn") for n in range(40)] + [(2, n, n, "delete" if n == 30 else "turn") for n in range(33)] + [(3, n, n, "touch" if n % 2 else "turn") for n in range(40)]
    df = spark.createDataFrame(pd.DataFrame([(k, pd.Timestamp(10**9 + t, unit="s"), i, a) for k, t, i, a in moves], columns=["k", "ts", "id", "action"]))
    df.write.parquet(f"{tmp_path}/in")
    stream = _streaming(spark).readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    got = sessions.drained(sessions.last_turns(stream, "k", "ts", "id", "action"), f"{tmp_path}/out", "update").collect()
    assert {r.key: (list(r.history), r["last"].timestamp() % 1000) for r in got} == {1: ([*range(30, 40)], 39), 2: ([31, 32], 32), 3: ([*range(20, 40, 2)], 39)}
    held = spark.read.format("statestore").option("stateVarName", "turns").load(f"{tmp_path}/out/checkpoint").collect()
    # the ten last turns and what comes after the first of them; after a delete, what follows it
    assert {r.key.key: len(r.value.ids) for r in held} == {1: 10, 2: 3, 3: 20}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_names_are_dealt_before_their_variants_are_made(spark):
    from plansift.plans import QUERIES

    plan = _plan(QUERIES["name_variants"](spark, "/root/testdata/sf0.001"))
    generate = plan.index("Generate")
    assert "Exchange" not in plan[:generate] and "Exchange hashpartitioning(p_partkey" in plan[generate:]


def test_costs_of_lines_are_told_without_a_second_grouping(spark):
    from plansift.plans import QUERIES

    plan = _plan(QUERIES["eta_cost"](spark, "/root/testdata/sf0.001"))
    assert plan.count("HashAggregate") <= 2 and "Generate" not in plan
    assert plan.index("Exchange hashpartitioning(l_orderkey") > plan.rindex("HashAggregate")


def test_urgent_words_are_tried_by_their_letters(spark):
    import re

    from plansift.operators import state
    from plansift.operators.patterns import any_of

    odd = (r"\bdangerous\b", r"x+y", "plain text")
    said = [re.sub(r"\\b", "", p) for p in state.EMERGENCY]
    texts = [t.format(p) for p in [*said, "dangerous", "xxy", "PLAIN TEXT", "ſtroke", "stroKe", "SUICIDE", "self_harm", "poison"] for t in ("{}", "a {}.", "a{}", "{}s", "é{}", "{}é")] + ["", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for patterns in (state.EMERGENCY, (*state.EMERGENCY, *odd), odd, (r"\bdanger\b", r"\bdanger\b")):
        want = [bool(r.x) for r in df.select(F.col("t").rlike("(?iu)" + "|".join(patterns)).alias("x")).collect()]
        assert [r.x for r in df.select(state.is_urgent(F.col("t"), patterns).alias("x")).collect()] == want and any(want)
    # one try at a place where none of the words begins
    assert any_of(state.EMERGENCY).count(r"\b") == 2


def test_sections_go_through_a_text_once_for_all_fields(spark):
    from plansift.operators import documents

    texts = [
        '{"temple_id": 7, "name": {"value": " N "}, "overview": {"b": 1.50, "a": [true, null, "x"]}, "history": ["one", {"title": "T", "k": 2}, null, 3], "faq": null, "rituals": "", "audio": 1e3}',
        '{"temple_id": "", "name": "N", "overview": "lost"}', '{"temple_id": "1", "name": "N", "secret": "x"}', '{"temple_id": "1", "name": "N", "overview": "cut', "[1]", "", None,
    ]
    df = documents.sections(spark.createDataFrame(list(enumerate(texts)), "k int, value string"))
    assert "get_json_object" not in _plan(df) and _plan(df).count("try_parse_json") + _plan(df).count("parse_json") <= 2
    assert sorted((r.k, r.temple_id, r["name"], r.content_type, r.pos, r.section, r.content) for r in df.collect()) == [
        (0, "7", "N", "audio", 0, "audio", "1000.0"), (0, "7", "N", "history", 0, "history[0]", "one"), (0, "7", "N", "history", 1, "T", "Title: T\nK: 2"),
        (0, "7", "N", "history", 3, "history[3]", "3"), (0, "7", "N", "overview", 0, "overview", "B: 1.5\nA:\nTrue\nx"),
    ]


def test_nested_texts_are_cut_in_slices(spark):
    import json

    import pyarrow as pa

    from plansift.functions import text

    seen = []

    class Column(list):
        def slice(self, low, n):
            seen.append(n)
            return pa.array(self[low : low + n])

    assert text.by_slices(lambda a, b: None if a is None else a + b, Column(["a", None] * 300), Column(["b"] * 600)).to_pylist() == ["ab", None] * 300
    assert set(seen) == {text.SLICE} and len(seen) == 6 and text.by_slices(str, pa.array([], pa.string())).to_pylist() == []
    values = [None, "{", '{"a": ["12345678", {"b": "é2345678", "c": 1}]}'] * 300
    got = spark.createDataFrame(list(enumerate(values)), "k int, v string").coalesce(1).select("k", text.truncate_nested(F.col("v"), 4).alias("x")).collect()
    assert [r.x and json.loads(r.x) for r in sorted(got)] == [None, None, {"a": ["1234 …", {"b": "é234 …", "c": 1}]}] * 300


def test_related_mentions_are_paired_and_never_grouped(spark):
    from plansift.operators import resolve

    records = spark.createDataFrame([("a", k, r, t) for t in range(40) for k, r in (("topic", "faq"), ("festival", "faq"), ("person", None))] + [("b", "topic", "faq", 99)], "alias string, mention_type string, relation string, target int")
    entities = spark.createDataFrame([(t, e) for t in range(20) for e in ("place", "landmark")], "target int, entity_type string")
    asked = {1: None, 2: "event", 3: "person", 4: "landmark", 5: "temple"}
    mentions = spark.createDataFrame([(i, "a", x) for i, x in asked.items()] + [(6, "b", None), (7, "ab", None)], "m_id int, mention string, asked string")
    found = resolve.related_exact(mentions, records, entities)
    plan = _plan(found)
    # whatever is grouped is grouped below the join with the mentions
    assert "Aggregate" not in plan[: plan.index("Join")] and "Aggregate" in plan
    said = {1: {("faq", "festival"), (None, "person")}, 2: {("faq", "festival")}, 3: {("faq", "topic"), (None, "person")}, 4: {("faq", "festival"), (None, "person")}, 5: set()}
    assert sorted((r.m_id, r.target, str(r.relation), r.alias, r.mention_type, r.score) for r in found.collect()) == sorted((i, t, str(r), "a", k, 1.0) for i, x in said.items() for t in range(20) for r, k in x)
    assert {r.m_id: (r.status, r.key, r.match_type) for r in resolve.decide_related(resolve.related(mentions, records, entities)).collect()} == {i: ("AMBIGUOUS", None, "related_exact_ambiguous") for i in (1, 2, 3, 4)}
    one = resolve.decide_related(resolve.related(mentions, records, entities.filter("target = 7"))).collect()
    assert sorted(tuple(r) for r in one) == [(i, "RESOLVED", 7, "related_exact") for i in (1, 2, 3, 4)]


def test_places_of_askers_are_found_once_a_text(spark, monkeypatch):
    from plansift.operators import places, resolve

    held = spark.createDataFrame([("R1", "Asia", ["far east", "anywhere"]), ("R2", "America", ["anywhere"]), ("R3", "Old America", ["the great west"]), ("R4", "America Old", ["the great wests"])], "place_id string, name string, aliases array<string>")
    said = ("asia", "anywhere", "americas", "the great westx", "far eest", "lost", "the great west")
    asked = spark.range(700).selectExpr("id as key", f"element_at(array{said}, cast(id % {len(said)} + 1 as int)) as norm")
    met, pairs = [], resolve.fuzzy_pairs

    def seen(m, n, limit):
        met.append(m.count())
        return pairs(m, n, limit)

    monkeypatch.setattr(resolve, "fuzzy_pairs", seen)
    got = rows(places.in_geography(asked, held))
    want = {"asia": "R1", "americas": "R2", "the great westx": "R3", "the great west": "R3"}
    assert got == [(k, want[said[k % len(said)]]) for k in range(700) if want.get(said[k % len(said)])]
    assert met == [4]


def test_few_pieces_go_to_the_names_and_without_mentions_none_is_read(spark, monkeypatch):
    from plansift.operators import resolve

    names = spark.range(300).selectExpr("concat('lodging number ', id) as alias", "id as key")
    mentions = spark.createDataFrame([(1, "lodging number 17x"), (2, "loging number 231"), (3, "nothing"), (4, "")], "m_id long, mention string")
    few = resolve.fuzzy_pairs(mentions, names, 0.9)
    assert _plan(few).count("BroadcastHashJoin") == 1 and "SortMergeJoin" not in _plan(few)
    monkeypatch.setattr(resolve, "SENT", 0)
    assert rows(few) == rows(resolve.fuzzy_pairs(mentions, names, 0.9)) and len(rows(few)) > 20
    none = resolve.fuzzy_pairs(mentions.filter("m_id > 3"), names, 0.9)
    assert none.collect() == [] and "Range" not in _plan(none)


def test_a_mention_that_most_requests_have_is_dealt_to_several_tasks(spark, monkeypatch):
    from plansift.operators import resolve

    mentions = spark.range(900).selectExpr("id div 2 as k", "if(id % 2 = 0, 'all', concat('m', id % 7)) as m_id")
    resolved = spark.createDataFrame([("all", "RESOLVED", "A"), ("m1", "AMBIGUOUS", None), ("m3", "RESOLVED", "C"), ("m5", "RESOLVED", "B")], "m_id string, status string, key string")
    monkeypatch.setattr(resolve, "OFTEN", 100)
    got = resolve.request_ids(mentions, resolved, ["k"])
    want = [(k, ["A"] + {3: ["C"], 5: ["B"]}.get((2 * k + 1) % 7, [])) for k in range(450)]
    assert rows(got) == want
    # 450 mentions of one name are met by five rows of it
    held = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_at" in held and "Generate" in held
