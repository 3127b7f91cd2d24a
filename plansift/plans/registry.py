"""Queries over the entity registry and the resolution of mentions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plansift.functions.text import normalize
from plansift.operators import places, registry, resolve
from plansift.plans.base import joined, query, table
from plansift.plans.costing import _NORM
from plansift.plans.documents import _layouts
from plansift.sources import committed, json_layouts
from plansift.sources.shared import cut, shared_dir


def _part_aliases(spark, d):
    return registry.aliases(table(spark, d, "part").select("p_partkey", "p_name", F.lit(0).alias("pos")), "p_partkey", "p_name", "pos")


@query(f"SELECT {_NORM.format('p_name')} AS alias, array_to_string(list_sort(list(DISTINCT p_partkey)), ',') AS ids, CAST(count(DISTINCT p_partkey) AS INT) AS n FROM part GROUP BY 1")
def alias_index(spark, d):
    return registry.alias_index(_part_aliases(spark, d), "p_partkey").withColumn("ids", joined("ids"))


@query(f"SELECT {_NORM.format('p_name')} AS alias, count(DISTINCT p_partkey) AS n FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) > 1")
def alias_ambiguity(spark, d):
    return registry.ambiguous(_part_aliases(spark, d), "p_partkey")


def _entities(spark, d):
    one = lambda t, kind, prefix, key, name, parent, order: table(spark, d, t).select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("entity_id"), F.lit(kind).alias("entity_type"), F.col(name).alias("canonical_name"), parent.alias("parent_id"), F.lit(order).alias("load"))
    ref = lambda c: F.concat(F.lit("N"), F.col(c).cast("string"))
    none = F.lit(None).cast("string")
    return one("nation", "place", "N", "n_nationkey", "n_name", none, 0).unionByName(one("supplier", "stay", "S", "s_suppkey", "s_name", ref("s_nationkey"), 1)).unionByName(one("customer", "food", "C", "c_custkey", "c_name", ref("c_nationkey"), 2))


_ENTITIES = """(SELECT 'N' || n_nationkey AS entity_id, 'place' AS entity_type, n_name AS canonical_name, NULL AS parent_id FROM nation
    UNION ALL SELECT 'S' || s_suppkey, 'stay', s_name, 'N' || s_nationkey FROM supplier
    UNION ALL SELECT 'C' || c_custkey, 'food', c_name, 'N' || c_nationkey FROM customer)"""
_HELD = "(SELECT 'N' || n_nationkey AS id FROM nation WHERE n_regionkey <> 4)"


@query(f"SELECT entity_id, entity_type, canonical_name, parent_id, {_NORM.format('canonical_name')} AS alias FROM {_ENTITIES}")
def registry_build(spark, d):
    entities = registry.last_wins(_entities(spark, d), "entity_id", "load").drop("load")
    names = registry.aliases(entities.select("entity_id", "canonical_name", F.lit(0).alias("pos")), "entity_id", "canonical_name", "pos")
    return entities.join(names.select("entity_id", "alias"), "entity_id")


@query(f"""
    SELECT 'entities' AS "check", entity_type AS key, count(*) AS n FROM {_ENTITIES} GROUP BY 2
    UNION ALL SELECT 'ambiguous_alias', a, count(*) FROM (SELECT {_NORM.format('p_name')} AS a FROM part) GROUP BY a HAVING count(*) > 1
    UNION ALL SELECT 'unknown_reference', parent_id, count(*) FROM {_ENTITIES} WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM {_HELD}) GROUP BY 2
    UNION ALL SELECT CASE event_id % 5 WHEN 4 THEN 'invalid_json' ELSE 'invalid_record' END, event_type, count(*) FROM events WHERE event_id % 5 IN (2, 3, 4) GROUP BY ALL
    UNION ALL SELECT 'ambiguous_mention', a, count(DISTINCT t) FROM (SELECT {_NORM.format("p_name || ' visit'")} AS a, p_partkey AS t FROM part WHERE p_partkey % 10 <> 3) GROUP BY a HAVING count(DISTINCT t) > 1
    UNION ALL SELECT 'unknown_mention', 'T' || p_partkey, 1 FROM part WHERE p_partkey % 10 = 3""")
def registry_report(spark, d):
    """All checks of a build, written as a table and read back."""
    entities = _entities(spark, d)
    kinds = entities.groupBy(F.col("entity_type").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    twice = registry.ambiguous(_part_aliases(spark, d), "p_partkey").withColumnRenamed("alias", "key")
    orphans = orphan_refs(spark, d).groupBy(F.col("parent_id").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    bad = json_layouts.quarantine(_layouts(spark, d).join(table(spark, d, "events").select("event_id", "event_type"), "event_id"), "value", ("restaurantName",))
    bad = bad.groupBy("status", F.col("event_type").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    part = table(spark, d, "part")
    target = F.concat(F.lit("T"), F.col("p_partkey").cast("string"))
    said = part.select(normalize(F.concat("p_name", F.lit(" visit"))).alias("alias"), target.alias("target"))
    several, unknown = registry.ambiguous_mentions(said, part.filter("p_partkey % 10 <> 3").select(target.alias("entity_id")))
    checks = {
        "entities": kinds, "ambiguous_alias": twice, "unknown_reference": orphans, "invalid_json": bad.filter("status = 'invalid_json'"), "invalid_record": bad.filter("status = 'invalid_record'"),
        "ambiguous_mention": several.withColumnRenamed("alias", "key"), "unknown_mention": unknown.groupBy(F.col("target").alias("key")).agg(F.count(F.lit(1)).alias("n")),
    }
    path = shared_dir(spark)
    registry.write_report(path, registry.report(spark, checks))
    return committed.read(spark, path, "report")


@query(f"SELECT 'entity' AS kind, entity_id, entity_type AS detail FROM {_ENTITIES} UNION ALL SELECT 'alias', entity_id, {_NORM.format('canonical_name')} FROM {_ENTITIES} UNION ALL SELECT 'mention', 'S' || s_suppkey, 'supplier ' || s_suppkey FROM supplier")
def registry_tables(spark, d):
    """The registry written as three tables and read back; entities without a name are left out."""
    entities = registry.last_wins(_entities(spark, d), "entity_id", "load").drop("load")
    names = registry.aliases(entities.select("entity_id", "canonical_name", F.lit(0).alias("pos")), "entity_id", "canonical_name", "pos")
    said = table(spark, d, "supplier").select(F.concat(F.lit("supplier "), F.col("s_suppkey").cast("string")).alias("alias"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("target"), F.lit("topic").alias("mention_type"))
    nameless = entities.limit(1).withColumns({"entity_id": F.lit("X"), "canonical_name": F.lit("")})
    path = shared_dir(spark)
    registry.write_registry(path, entities.unionByName(nameless), names, said)
    e, a, m = registry.read_registry(spark, path)
    rows = e.select(F.lit("entity").alias("kind"), "entity_id", F.col("entity_type").alias("detail"))
    return rows.unionByName(a.select(F.lit("alias").alias("kind"), "entity_id", F.col("alias").alias("detail"))).unionByName(m.select(F.lit("mention").alias("kind"), F.col("target").alias("entity_id"), F.col("alias").alias("detail")))


@query("""
    SELECT s_suppkey // 10 AS file, CAST(s_suppkey AS VARCHAR) AS record_id, CASE WHEN s_suppkey % 5 = 0 THEN 'again' ELSE s_name END AS name FROM supplier""")
def master_list(spark, d):
    """Lists of ten suppliers in the three accepted roots, with ids in three spellings and some records twice."""
    s = table(spark, d, "supplier").withColumn("file", F.floor(F.col("s_suppkey") / 10))
    k = F.col("s_suppkey")
    one = F.when(k % 3 == 0, F.to_json(F.struct(k.alias("temple_id"), F.col("s_name").alias("name")))).when(k % 3 == 1, F.to_json(F.struct(F.lit("").alias("temple_id"), k.cast("string").alias("templeId"), F.col("s_name").alias("name")))).otherwise(F.to_json(F.struct(k.alias("id"), F.col("s_name").alias("name"))))
    again = F.when(k % 5 == 0, F.to_json(F.struct(k.cast("string").alias("id"), F.lit("again").alias("name"))))
    files = s.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", one.alias("j")))).alias("x"), F.collect_list(again).alias("y"))
    listed = F.concat(F.lit("["), F.array_join(F.concat(F.transform("x", lambda r: r["j"]), "y", F.array(F.lit('"no record"'), F.lit('{"name": "no id"}'))), ","), F.lit("]"))
    value = F.when(F.col("file") % 3 == 0, listed).when(F.col("file") % 3 == 1, F.concat(F.lit('{"temples": '), listed, F.lit("}"))).otherwise(F.concat(F.lit('{"temples": 1, "entities": '), listed, F.lit("}")))
    found = json_layouts.master_list(files.select("file", value.alias("value")))
    return found.select("file", "record_id", json_layouts.first_said(F.col("record"), "$.name").alias("name"))


def _records(spark, d):
    """Parts as JSON records with founders, history, festivals, questions and query variations."""
    k, name, brand, kind = F.col("p_partkey"), F.col("p_name"), F.col("p_brand"), F.col("p_type")
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    quoted = lambda *parts: F.to_json(F.struct(text(*parts).alias("x")))
    bare = lambda *parts: F.regexp_replace(quoted(*parts), r'^\{"x":|\}$', "")
    founder = bare(brand, " (Great ", kind, ").")
    founders = F.when(k % 2 == 0, founder).otherwise(text("[", founder, ", 7]"))
    history = text('[{"section": "Early", "people": ["Old ', brand, '", 7], "name": "', name, ' Raja"}, "just text", {"title": "", "person": "Lone ', kind, '"}]')
    festivals = text('[{"festival": "', name, ' Great festival"}, {"note": "none"}]')
    faq = text('[{"question": "What is the ', name, '?", "answer": "', brand, '", "topic": "', kind, ' topic"}]')
    variations = text('["', name, ' visit", {"query": "', name, ' hours"}]')
    json = text('{"temple_id": "T', k.cast("string"), '", "founders": ', founders, ', "history": ', history, ', "festivals": ', festivals, ', "faq": ', faq, ', "query_variations": ', variations, "}")
    return table(spark, d, "part").select(F.concat(F.lit("T"), k.cast("string")).alias("temple_id"), F.try_parse_json(json).alias("record"))


_SAID = {
    ("person", "associated_person", "founders", None): ("p_brand || ' (Great ' || p_type || ')'", "p_brand", "'Great ' || p_type", "p_type"),
    ("person", "associated_person", "history.people", "Early"): ("'Old ' || p_brand",),
    ("person", "historical_person", "history.name", "Early"): ("p_name || ' Raja'",),
    ("person", "associated_person", "history.person", "history[2]"): ("'Lone ' || p_type",),
    ("festival", "festival", "festivals.festival", None): ("p_name || ' Great festival'", "string_split(p_name, ' ')[1] || ' festival'"),
    ("topic", "faq_topic", "faq.question", "faq[0]"): ("'What is the ' || p_name || '?'",),
    ("topic", "faq_topic_phrase", "faq.question", "faq[0]"): ("'the ' || p_name",),
    ("topic", "faq_answer_topic", "faq.answer", "faq[0]"): ("p_brand",),
    ("topic", "faq_topic", "faq.topic", "faq[0]"): ("p_type || ' topic'",),
    ("topic", "query_variation", "query_variations", "query_variations[0]"): ("p_name || ' visit'",),
    ("topic", "query_variation", "query_variations.query", "query_variations[1]"): ("p_name || ' hours'",),
}
_MENTIONS = " UNION ALL ".join(
    f"SELECT p_partkey, 'T' || p_partkey AS target, {m} AS mention, '{kind}' AS mention_type, '{relation}' AS relation, '{field}' AS source_field, " + (f"'{section}'" if section else "p_name || ' Great festival'" if kind == "festival" else "NULL") + " AS source_section FROM part"
    for (kind, relation, field, section), said in _SAID.items()
    for m in said
)


@query(f"SELECT target, {_NORM.format('mention')} AS alias, min(mention) AS mention, mention_type, relation, source_field, source_section FROM ({_MENTIONS}) GROUP BY ALL")
def mention_extract(spark, d):
    return registry.mentions(_records(spark, d), "temple_id")


@query("""
    SELECT 'flag' AS kind, 'N' || n_nationkey AS id, CASE WHEN n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey % 3 <> 2) THEN 1 ELSE 0 END AS n FROM nation WHERE n_regionkey <> 4
    UNION ALL SELECT 'unknown', 'N' || n_nationkey, count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 4 AND c_custkey % 3 <> 2 GROUP BY 2""")
def emergency_flags(spark, d):
    c = table(spark, d, "customer")
    key = F.concat(F.lit('"N'), F.col("c_nationkey").cast("string"), F.lit('"'))
    value = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit('{"temple_id": '), key, F.lit("}"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit('{"temple_id": "", "templeId": '), key, F.lit("}"))).otherwise(F.concat(F.lit("["), key, F.lit("]")))
    flagged, unknown = registry.emergency_flags(_parents(spark, d).withColumnRenamed("id", "entity_id"), c.select(value.alias("value")))
    return flagged.select(F.lit("flag").alias("kind"), F.col("entity_id").alias("id"), F.col("emergency").cast("long").alias("n")).unionByName(unknown.select(F.lit("unknown").alias("kind"), "id", "n"))


def _parents(spark, d):
    return table(spark, d, "nation").filter("n_regionkey <> 4").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("id"))


@query(f"""
    SELECT parent_id, coalesce(array_to_string(list_sort(list(entity_id) FILTER (WHERE entity_type = 'food')), ','), '') AS food, coalesce(array_to_string(list_sort(list(entity_id) FILTER (WHERE entity_type = 'stay')), ','), '') AS stay
    FROM {_ENTITIES} WHERE parent_id IN (SELECT id FROM {_HELD}) GROUP BY parent_id""")
def relationship_lists(spark, d):
    linked = registry.with_parent(_entities(spark, d).filter("parent_id is not null"), _parents(spark, d), "parent_id", "id").filter("linked")
    lists = linked.groupBy("parent_id").pivot("entity_type", ["food", "stay"]).agg(F.sort_array(F.collect_list("entity_id")))
    return lists.select("parent_id", *[F.coalesce(joined(c), F.lit("")).alias(c) for c in ("food", "stay")])


@query(f"SELECT entity_id, parent_id FROM {_ENTITIES} WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM {_HELD})")
def orphan_refs(spark, d):
    children = _entities(spark, d).filter("parent_id is not null")
    return registry.with_parent(children, _parents(spark, d), "parent_id", "id").filter("not linked").select("entity_id", "parent_id")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'second' ELSE 'first' END AS source, CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS n FROM part")
def duplicate_ids(spark, d):
    part = table(spark, d, "part")
    rows = part.select("p_partkey", F.lit("first").alias("source"), F.lit(0).alias("load")).unionByName(part.filter("p_partkey % 3 = 0").select("p_partkey", F.lit("second").alias("source"), F.lit(1).alias("load")))
    twice = registry.duplicates(rows, "p_partkey")
    kept = registry.last_wins(rows, "p_partkey", "load")
    return kept.join(twice, "p_partkey", "left").select("p_partkey", "source", F.coalesce("n", F.lit(1)).cast("int").alias("n"))


@query("""
    WITH p AS (SELECT p_partkey, p_name AS n, p_brand || ' ' || p_type AS i, 'Ugadi Great ' || p_name || ' festival' AS e FROM part)
    SELECT p_partkey, n || ' (' || i || ')' AS variant, 'whole' AS rule FROM p
    UNION ALL SELECT p_partkey, n, 'main' FROM p UNION ALL SELECT p_partkey, i, 'inner' FROM p
    UNION ALL SELECT p_partkey, string_split(i, ' ')[-1], 'last_word' FROM p WHERE p_partkey % 2 = 0
    UNION ALL SELECT p_partkey, e, 'whole' FROM p UNION ALL SELECT p_partkey, 'Ugadi festival', 'event' FROM p""")
def name_variants(spark, d):
    # dealt by key before names become many rows; what is told apart of a key then stays in its task
    part = table(spark, d, "part").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    one = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(" "), "p_type", F.lit(")."))
    two = F.concat(F.lit("Ugadi Great "), "p_name", F.lit(" festival"))
    names = part.select("p_partkey", F.explode(F.array(F.struct(one.alias("name"), (F.col("p_partkey") % 2 == 0).alias("person")), F.struct(two.alias("name"), F.lit(False).alias("person")))).alias("x"))
    found = names.select("p_partkey", F.explode(registry.name_variants(F.col("x.name"), F.col("x.person"))).alias("v")).select("p_partkey", "v.variant", "v.rule")
    return registry.distinct_mentions(found.withColumn("variant", F.regexp_replace("variant", r"\.$", "")).withColumn("id", normalize(F.col("variant"))), ["p_partkey", "id", "rule"], "variant").drop("id")


@query("""
    SELECT p_partkey, 'What is the ' || p_name || '?' AS topic, 'faq_topic' AS relation FROM part
    UNION ALL SELECT p_partkey, 'the ' || p_name, 'faq_topic_phrase' FROM part
    UNION ALL SELECT p_partkey, p_brand || ' ' || p_type, 'faq_answer_topic' FROM part WHERE p_partkey % 2 = 0""")
def faq_topics(spark, d):
    answer = F.when(F.col("p_partkey") % 2 == 0, F.concat_ws(" ", "p_brand", "p_type")).otherwise(F.concat("p_name", F.lit(" is one of the many things that we have in the shop")))
    rows = table(spark, d, "part").select("p_partkey", F.explode(registry.faq_topics(F.concat(F.lit("What is the "), "p_name", F.lit("?")), answer)).alias("t"))
    return rows.select("p_partkey", "t.topic", "t.relation")


@query(f"""
    WITH a AS (SELECT {_NORM.format('p_name')} AS alias, p_partkey, p_brand, p_size FROM part),
    s AS (SELECT m.p_partkey AS m_id, e.p_partkey, CASE WHEN e.p_brand = m.p_brand THEN 40 ELSE 0 END + CASE WHEN e.p_size = m.p_size THEN 25 ELSE 0 END + CASE WHEN m.p_partkey % 200 = 0 AND m.p_partkey = e.p_partkey THEN 100 ELSE 0 END AS context
          FROM a m JOIN a e USING (alias) WHERE m.p_partkey % 100 = 0),
    t AS (SELECT *, max(context) OVER (PARTITION BY m_id) AS top, count(*) OVER (PARTITION BY m_id) AS n FROM s)
    SELECT m_id, CASE WHEN count(*) = 1 THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS status, CASE WHEN count(*) = 1 THEN min(p_partkey) END AS p_partkey,
           CASE WHEN count(*) > 1 THEN 'exact_ambiguous' WHEN max(top) > 0 THEN 'exact_context' ELSE 'exact' END AS match_type, CAST(max(top) AS INT) AS context, max(n) AS n
    FROM t WHERE context = top GROUP BY m_id""")
def resolve_exact(spark, d):
    part = table(spark, d, "part").withColumn("alias", normalize(F.col("p_name")))
    mentions = part.filter("p_partkey % 100 = 0").select(F.col("p_partkey").alias("m_id"), "alias", "p_brand", "p_size", F.when(F.col("p_partkey") % 200 == 0, F.col("p_partkey")).alias("itself"))
    score = resolve.CITY, resolve.DISTRICT
    levels = [(sum(score), ["p_brand", "p_size"]), (score[0], ["p_brand"]), (score[1], ["p_size"]), (0, [])]
    return resolve.exact_by_context(mentions, part.select("p_partkey", "alias", "p_brand", "p_size"), "p_partkey", levels)


def _damaged(spark, d):
    """Mentions with a letter lost or two letters added, as the names of the searches: parts whose number is divisible by 100."""
    name = normalize(F.col("p_name"))
    k = (F.col("p_partkey") % 3).cast("int")
    hurt = F.when(k == 0, F.concat(F.substring(name, 1, 3), F.expr("substring(n, 5)"))).when(k == 1, F.concat(F.col("n"), F.lit("x"))).otherwise(F.col("n"))
    return table(spark, d, "part").withColumn("n", name).filter("p_partkey % 100 = 0").select(F.col("p_partkey").alias("m_id"), hurt.alias("mention"))


def _names(spark, d):
    return _part_aliases(spark, d).select("alias").distinct()


@query(f"""
    WITH n AS (SELECT DISTINCT {_NORM.format('p_name')} AS alias FROM part),
    m AS (SELECT p_partkey AS m_id, CASE p_partkey % 3 WHEN 0 THEN substring(x, 1, 3) || substring(x, 5) WHEN 1 THEN x || 'x' ELSE x END AS mention FROM (SELECT p_partkey, {_NORM.format('p_name')} AS x FROM part WHERE p_partkey % 100 = 0))
    SELECT m_id, mention, alias FROM m, n
    WHERE 2 * least(length(mention), length(alias)) >= 0.88::DOUBLE * (length(mention) + length(alias)) AND levenshtein(mention, alias) <= (1 - 0.88::DOUBLE) * (length(mention) + length(alias))""")
def fuzzy_prefilter(spark, d):
    return resolve.fuzzy_pairs(_damaged(spark, d), _names(spark, d), resolve.FUZZY).select("m_id", "mention", "alias")


@query()
def resolve_fuzzy(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("key"), "p_brand")
    found = resolve.fuzzy(_damaged(spark, d), _part_aliases(spark, d).select("alias", F.col("p_partkey").alias("key")), "key")
    asked = table(spark, d, "part").select(F.col("p_partkey").alias("m_id"), F.col("p_brand").alias("m_brand"))
    scored = found.join(part, "key").join(asked, "m_id").withColumn("context", resolve.context_score(F.lit(False), F.lit(False), F.col("p_brand") == F.col("m_brand"), F.lit(False)))
    return resolve.decide_fuzzy(scored, "key")


def _related(spark, d):
    """(mentions, records, entities): each part's name and brand, said as a festival, a person or a topic of it; some are asked for by a type, some damaged."""
    part = table(spark, d, "part")
    kinds = F.element_at(F.array(*map(F.lit, ("festival", "person", "topic"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    records = part.select(normalize(F.concat_ws(" ", "p_name", "p_brand")).alias("alias"), kinds.alias("mention_type"), kinds.alias("relation"), F.col("p_partkey").alias("target"))
    entities = part.filter("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("target"), F.lit("place").alias("entity_type"))
    mention = normalize(F.concat_ws(" ", "p_name", "p_brand", F.when(F.col("p_partkey") % 500 == 0, F.lit("a"))))
    asked = F.when(F.col("p_partkey") % 400 == 0, F.lit("event")).when(F.col("p_partkey") % 400 == 100, F.lit("place")).when(F.col("p_partkey") % 400 == 200, F.lit("landmark")).when(F.col("p_partkey") % 800 == 300, F.lit("person"))
    mentions = part.filter("p_partkey % 100 = 0").select(F.col("p_partkey").alias("m_id"), mention.alias("mention"), asked.alias("asked"))
    return mentions, records, entities


@query(f"""
    WITH p AS (SELECT p_partkey, {_NORM.format("p_name || ' ' || p_brand")} AS alias, ['festival', 'person', 'topic'][p_partkey % 3 + 1] AS kind FROM part),
    m AS (SELECT p_partkey AS m_id, alias, CASE WHEN p_partkey % 400 = 0 THEN 'event' WHEN p_partkey % 400 = 100 THEN 'place' WHEN p_partkey % 400 = 200 THEN 'landmark' WHEN p_partkey % 800 = 300 THEN 'person' END AS asked FROM p WHERE p_partkey % 100 = 0 AND p_partkey % 500 <> 0)
    SELECT m_id, p_partkey AS target, kind AS relation, alias, kind AS mention_type, CAST(1.0 AS DOUBLE) AS score FROM m JOIN p USING (alias)
    WHERE p_partkey % 7 <> 0 AND (asked IS NULL OR asked = 'place' OR (asked = 'event' AND kind IN ('festival', 'topic')) OR (asked = 'landmark' AND kind IN ('festival', 'topic')) OR (asked = 'person' AND kind IN ('person', 'topic')))""")
def resolve_related(spark, d):
    """The related mentions of equal text; resolve_mentions goes on to near ones."""
    mentions, records, entities = _related(spark, d)
    return resolve.related_exact(mentions.filter("m_id % 500 <> 0"), records, entities)


@query()
def resolve_mentions(spark, d):
    """Mentions by alias, by near alias, by related mention."""
    mentions, records, entities = _related(spark, d)
    names = _part_aliases(spark, d).select("alias", F.col("p_partkey").alias("key"))
    exact = _damaged(spark, d).select((F.col("m_id") + 10_000_000).alias("m_id"), "mention", F.lit(None).cast("string").alias("asked"))
    return resolve.resolve(mentions.unionByName(exact), names, table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.lit("place").alias("entity_type")), records)


_RESOLVED_NATION = "(conv_id + turn) % (SELECT count(*) FROM nation)"
_RESOLVED_SUPPLIER = "(conv_id * 7 + turn) % (SELECT count(*) FROM supplier)"
_SAID_PART = "(conv_id * 3 + turn) % (SELECT count(*) FROM part)"


@query(f"""
    WITH q AS (SELECT conv_id, turn, {_RESOLVED_NATION} AS n, {_RESOLVED_SUPPLIER} AS s, {_SAID_PART} AS p FROM conversations),
    r AS (SELECT conv_id, turn, 'N' || n AS id FROM q
          UNION ALL SELECT conv_id, turn, 'S' || s FROM q WHERE turn % 2 = 0
          UNION ALL SELECT conv_id, turn, 'P' || p FROM q JOIN part ON p_partkey = p WHERE p_name IN (SELECT p_name FROM part GROUP BY 1 HAVING count(*) = 1))
    SELECT conv_id, turn, array_to_string(list_sort(list(DISTINCT id)), ',') AS ids FROM r GROUP BY 1, 2""")
def mention_ids(spark, d):
    """A turn's mentions: a nation as a place, a supplier as a temple (on odd turns as a stay, which stands for no entity), a part, whose name others may have, and a name of the wrong type."""
    nation, supplier, part = (table(spark, d, t) for t in ("nation", "supplier", "part"))
    entities = nation.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("key"), F.lit("place").alias("entity_type"), "n_name")
    entities = entities.unionByName(supplier.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("key"), F.lit("temple").alias("entity_type"), F.col("s_name").alias("n_name")))
    entities = entities.unionByName(part.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("key"), F.lit("landmark").alias("entity_type"), F.col("p_name").alias("n_name")))
    names = entities.select("key", normalize(F.col("n_name")).alias("alias"))
    n, s, p = nation.count(), supplier.count(), part.count()
    # turns are dealt out before they become many mentions
    turns = table(spark, d, "conversations").select("conv_id", "turn").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv_id", "turn")
    turns = turns.select("conv_id", "turn", ((F.col("conv_id") + F.col("turn")) % n).alias("n"), ((F.col("conv_id") * 7 + F.col("turn")) % s).alias("s"), ((F.col("conv_id") * 3 + F.col("turn")) % p).alias("p"))
    said = turns.join(nation.select(F.col("n_nationkey").cast("long").alias("n"), "n_name"), "n").join(supplier.select(F.col("s_suppkey").alias("s"), "s_name"), "s").join(part.select(F.col("p_partkey").alias("p"), "p_name"), "p")
    one = lambda c, kind: F.struct(normalize(F.col(c)).alias("mention"), kind.alias("asked"))
    listed = F.array(one("n_name", F.lit("place")), one("s_name", F.when(F.col("turn") % 2 == 0, "temple").otherwise("stay")), one("p_name", F.lit("landmark")), one("n_name", F.lit("person")))
    mentions = said.select("conv_id", "turn", F.explode(listed).alias("x")).select("conv_id", "turn", "x.*").filter(F.col("asked").isin(*resolve.RESOLVABLE))
    mentions = cut(mentions.select("conv_id", "turn", "mention", "asked"))
    # what is said alike is resolved once
    asked = mentions.select("mention", "asked").distinct().withColumn("m_id", F.concat_ws("/", "asked", "mention"))
    resolved = resolve.resolve(asked, names, entities.select("key", "entity_type"))
    return resolve.request_ids(mentions.withColumn("m_id", F.concat_ws("/", "asked", "mention")), resolved, ["conv_id", "turn"]).withColumn("ids", joined("ids"))


@query("""
    WITH q AS (SELECT conv_id, turn, turn % 4 AS id, (turn + 2) % 5 AS dep, row_number() OVER (PARTITION BY conv_id, turn % 4 ORDER BY turn, text) AS r FROM conversations),
    k AS (SELECT * FROM q WHERE r = 1)
    SELECT k.conv_id, k.turn, k.id, CASE WHEN e.id IS NOT NULL THEN k.dep END AS depends_on FROM k LEFT JOIN k e ON e.conv_id = k.conv_id AND e.id = k.dep AND e.turn < k.turn""")
def request_clean(spark, d):
    w = Window.partitionBy("conv_id", "id").orderBy("turn", "text")
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text", (F.col("turn") % 4).alias("id"), ((F.col("turn") + 2) % 5).alias("dep"))
    kept = rows.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r", "text")
    earlier = kept.select("conv_id", F.col("id").alias("dep"), F.col("turn").alias("e_turn"))
    joined = kept.join(earlier, ["conv_id", "dep"], "left")
    return joined.select("conv_id", "turn", "id", F.when(F.col("e_turn") < F.col("turn"), F.col("dep")).alias("depends_on"))


@query("""
    WITH c AS (SELECT p_name, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_name ORDER BY p_retailprice DESC, p_partkey) AS r, lead(p_retailprice) OVER (PARTITION BY p_name ORDER BY p_retailprice DESC, p_partkey) AS nx FROM part)
    SELECT p_name, p_partkey, coalesce(p_retailprice - nx < 0.05, false) AS ambiguous, (SELECT array_to_string(list(x.p_partkey ORDER BY x.r), ',') FROM c x WHERE x.p_name = c.p_name AND x.r <= 3) AS shortlist FROM c WHERE r = 1""")
def candidate_gap(spark, d):
    """The best candidate of a name; ambiguous if the next is within 0.05 of it; the first five with names, three of them shown."""
    w = Window.partitionBy("p_name").orderBy(F.desc("p_retailprice"), "p_partkey")
    rows = table(spark, d, "part").select("p_name", "p_partkey", "p_retailprice", F.row_number().over(w).alias("r"), F.lead("p_retailprice").over(w).alias("next")).filter("r <= 5")
    best = rows.filter("r = 1").select("p_name", "p_partkey", F.coalesce(F.col("p_retailprice") - F.col("next") < 0.05, F.lit(False)).alias("ambiguous"))
    few = rows.filter("p_name <> ''").groupBy("p_name").agg(F.sort_array(F.collect_list(F.struct("r", "p_partkey"))).alias("x"))
    return best.join(few, "p_name").select("p_name", "p_partkey", "ambiguous", F.slice(F.transform("x", lambda c: c["p_partkey"]), 1, 3).alias("shortlist")).withColumn("shortlist", joined("shortlist"))


def _places(spark, d):
    """(entities, aliases, places, candidates): nations, and suppliers of which some have no sound latitude; regions as a list of places; a geocoder's answers."""
    nation, supplier, region = (table(spark, d, t) for t in ("nation", "supplier", "region"))
    entities = nation.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("entity_id"), F.lit("place").alias("entity_type"), F.col("n_name").alias("canonical_name"), F.lit("10.5").alias("latitude"), F.lit("70").alias("longitude"))
    k = F.col("s_suppkey")
    entities = entities.unionByName(supplier.select(F.concat(F.lit("S"), k.cast("string")).alias("entity_id"), F.lit("stay").alias("entity_type"), F.col("s_name").alias("canonical_name"), F.when(k % 5 == 0, "200").when(k % 5 == 1, "north").otherwise("12.25").alias("latitude"), F.lit("71").alias("longitude")))
    aliases = entities.select("entity_id", normalize(F.col("canonical_name")).alias("alias"))
    place = F.struct(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("place_id"), F.concat(F.lit("Region of "), F.col("r_name")).alias("canonical_name"), F.array(F.col("r_name"), F.lit("anywhere")).alias("aliases"), F.struct(F.lit(20.5).alias("latitude"), F.lit("75.5").alias("longitude")).alias("location"))
    listed = json_layouts.place_list(region.select(F.to_json(F.struct(F.array(place, place.withField("place_id", F.lit(""))).alias("places"))).alias("value")))
    near = F.struct(F.lit(1).alias("rank"), F.lit("first").alias("name"), F.lit(0.5).alias("importance")), F.struct(F.lit(2).alias("rank"), F.lit("second").alias("name"), F.when(k % 2 == 0, 0.48).otherwise(0.3).alias("importance"))
    candidates = supplier.select(F.concat(F.lit("somewhere "), k.cast("string")).alias("query"), F.explode(F.array(*near)).alias("c")).select("query", "c.*", F.lit(1.5).alias("latitude"), F.lit(2.5).alias("longitude"))
    return entities, aliases, listed, candidates


@query("""
    WITH m AS (SELECT *, s_suppkey % 9 AS c, s_suppkey % 5 > 1 AS sound FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    t AS (SELECT *, CASE WHEN c = 0 AND sound THEN 1 WHEN c = 1 THEN 2 WHEN c IN (2, 3) THEN 3 WHEN c = 5 THEN 4 WHEN c = 7 AND sound THEN 1 WHEN c = 8 THEN 2 END AS tier FROM m)
    SELECT s_suppkey, CASE WHEN c = 5 AND s_suppkey % 2 = 0 THEN 'AMBIGUOUS' WHEN tier IS NOT NULL THEN 'RESOLVED' WHEN c = 0 OR c = 6 THEN 'INVALID' ELSE 'UNRESOLVED' END AS status, CAST(tier AS INT) AS tier,
           CASE WHEN tier IS NULL THEN NULL WHEN c IN (0, 7) THEN 'S' || s_suppkey WHEN c IN (1, 8) THEN 'N' || n_nationkey WHEN c IN (2, 3) THEN 'R' || r_regionkey WHEN s_suppkey % 2 = 1 THEN 'first' END AS place_id,
           CASE WHEN tier IS NULL THEN NULL WHEN c IN (0, 7) THEN 12.25 WHEN c IN (1, 8) THEN 10.5 WHEN c IN (2, 3) THEN 20.5 WHEN s_suppkey % 2 = 1 THEN 1.5 END::DOUBLE AS latitude
    FROM t""")
def place_cascade(spark, d):
    """Places asked for by id, by name, as a region (one name damaged), by a geocoder's query; by what several places are called, and by nothing."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("s_suppkey")
    c, sid = k % 9, F.concat(F.lit("S"), k.cast("string"))
    spelled = F.element_at(F.array(*[F.to_json(F.struct(F.lit(" ").alias("entity_id"), sid.alias(key))) if key != "entity_id" else F.to_json(F.struct(sid.alias(key))) for key in places.ID_KEYS]), (k % len(places.ID_KEYS) + 1).cast("int"))
    text = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    value = (
        F.when(c == 0, spelled).when(c == 1, text(F.concat(F.lit(" "), F.col("n_name")))).when(c == 2, text(F.col("r_name"))).when(c == 3, text(F.concat(F.lit("Region of "), F.col("r_name"), F.lit("x"))))
        .when(c == 4, text(F.lit("anywhere"))).when(c == 5, F.to_json(F.struct(F.concat(F.lit("somewhere "), k.cast("string")).alias("query")))).when(c == 6, F.lit('{"note": 1}')).when(c == 7, text(sid)).otherwise(F.to_json(F.struct(F.lit("T0").alias("temple_id"), F.lower("n_name").alias("name"))))
    )
    found = places.resolve_places(s.select(k.alias("key"), F.try_parse_json(value).alias("value")), *_places(spark, d))
    return found.select(F.col("key").alias("s_suppkey"), "status", F.col("tier").cast("int").alias("tier"), "place_id", "latitude")


@query("""
    SELECT s_suppkey, CASE s_suppkey % 5 WHEN 3 THEN 'UNRESOLVED' WHEN 4 THEN 'UNRESOLVED' ELSE 'RESOLVED' END AS status, CAST(CASE WHEN s_suppkey % 5 < 3 THEN 2 END AS INT) AS tier, CASE WHEN s_suppkey % 5 < 3 THEN 'N' || s_nationkey END AS place_id,
           CASE WHEN s_suppkey % 5 < 3 THEN 10.5::DOUBLE END AS latitude FROM supplier""")
def place_cascade_related(spark, d):
    """Places that only a related mention names: as it is spelled, with a letter lost, and by a mention of several; by their own name, and by a mention of an entity that isn't known."""
    s, nation = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")), table(spark, d, "nation")
    k, number = F.col("s_suppkey"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")
    said = lambda: F.concat(F.lit("founder "), F.translate(number, "0123456789", "abcdefghij"), F.lit(" of "), F.lower("n_name"))
    c = k % 5
    value = F.when(c == 0, said()).when(c == 1, F.regexp_replace(said(), "^f", "")).when(c == 2, F.col("n_name")).when(c == 3, F.lit("patron of them all")).otherwise(F.lit("the lost quarter"))
    record = lambda alias, target: nation.select(normalize(alias).alias("alias"), F.lit("person").alias("mention_type"), F.lit("founder").alias("relation"), target.alias("target"))
    ref = F.concat(F.lit("N"), F.col("n_nationkey").cast("string"))
    records = record(said(), ref).unionByName(record(F.lit("patron of them all"), ref)).unionByName(record(F.lit("the lost quarter"), F.lit("X9")))
    found = places.resolve_places(s.select(k.alias("key"), F.try_parse_json(F.concat(F.lit('"'), value, F.lit('"'))).alias("value")), *_places(spark, d), records)
    return found.select(F.col("key").alias("s_suppkey"), "status", F.col("tier").cast("int").alias("tier"), "place_id", "latitude")


@query("""
    SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'RESOLVED' WHEN c_custkey % 4 = 1 THEN 'RESOLVED' WHEN c_custkey % 4 = 2 THEN 'AMBIGUOUS' ELSE 'NONE' END AS status, CAST(CASE c_custkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 END AS INT) AS pos,
           CASE WHEN c_custkey % 4 < 2 THEN 'N' || c_nationkey END AS place_id
    FROM customer""")
def anchor_pick(spark, d):
    """A request's candidates in order: the first that resolves, unless an ambiguous one comes first; beyond the third none counts."""
    c = table(spark, d, "customer")
    k, text = F.col("c_custkey"), lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    nation, none, twice = text(F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))), text(F.lit("no such place")), text(F.lit("somewhere 0"))
    other = text(F.lit("nor this"))
    listed = F.when(k % 4 == 0, F.array(nation, twice)).when(k % 4 == 1, F.array(none, nation, twice)).when(k % 4 == 2, F.array(none, twice, nation)).otherwise(F.array(none, none, other, text(F.lit("nor that")), nation))
    held = _places(spark, d)

    def resolver(asked):
        # what is said alike is resolved once
        said = asked.select("key", F.to_json("value").alias("j"))
        one = places.resolve_places(said.select(F.col("j").alias("key")).distinct().withColumn("value", F.try_parse_json("key")), *held)
        return said.join(one.withColumnRenamed("key", "j"), "j").drop("j")

    found = places.anchors(c.select(k.alias("request_id"), listed.alias("candidates")), resolver)
    return found.select(F.col("request_id").alias("c_custkey"), "status", F.col("pos").cast("int").alias("pos"), "place_id")
