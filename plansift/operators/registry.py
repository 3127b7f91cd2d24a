"""Entity registry: entities, aliases and mentions as tables, and the report on their quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plansift.functions.text import normalize, strip_marks
from plansift.sources import committed
from plansift.sources.json_layouts import first_said, is_object, items, strings

# Words that mark an event's name.
EVENT_WORDS = ("jathara", "jatara", "jatra", "festival", "brahmotsavam", "utsavam", "mahotsavam")


def last_wins(entities: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: that of the highest order."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return entities.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def duplicates(entities: DataFrame, key: str) -> DataFrame:
    """key, n of keys that occur several times; to be asked before last_wins."""
    return entities.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def aliases(names: DataFrame, key: str, name: str, pos: str) -> DataFrame:
    """(alias, key, spelling): the distinct normalised names of an entity; the first spelling stays."""
    rows = names.select(key, F.col(name).alias("spelling"), pos, normalize(F.col(name)).alias("alias")).filter("alias <> ''")
    return rows.groupBy("alias", key).agg(F.min_by("spelling", pos).alias("spelling"))


def alias_index(alias_rows: DataFrame, key: str) -> DataFrame:
    """alias, ids (sorted), n."""
    return alias_rows.groupBy("alias").agg(F.array_sort(F.collect_set(key)).alias("ids")).withColumn("n", F.size("ids"))


def ambiguous(alias_rows: DataFrame, key: str) -> DataFrame:
    """alias, n of aliases that stand for several entities."""
    return alias_rows.groupBy("alias").agg(F.count_distinct(key).alias("n")).filter("n > 1")


def with_parent(children: DataFrame, parents: DataFrame, ref: str, key: str) -> DataFrame:
    """children with linked: whether their parent exists."""
    known = parents.select(F.col(key).alias("_p")).distinct()
    return children.join(known, F.col(ref) == F.col("_p"), "left").withColumn("linked", F.col("_p").isNotNull()).drop("_p")


def name_variants(c: Column, person: Column) -> Column:
    """array<struct(variant, rule)> of a name: whole, outside and inside its brackets, a person's last word inside, and an event's short name."""
    whole = strip_marks(c)
    main = strip_marks(F.regexp_extract(c, r"^(.*?)\s*\(([^()]*)\)", 1))
    inner = strip_marks(F.regexp_extract(c, r"^(.*?)\s*\(([^()]*)\)", 2))
    inner_words = F.split(inner, r"\s+")
    bare = F.split(F.trim(F.regexp_replace(c, r"\s*\([^()]*\)", "")), r"\s+")
    marked = F.filter(bare, lambda t, i: (i > 0) & F.regexp_replace(F.lower(t), r"^[.,;:]+|[.,;:]+$", "").isin(*EVENT_WORDS))
    row = lambda v, rule: F.struct(v.alias("variant"), F.lit(rule).alias("rule"))
    fixed = F.array(
        F.when(whole != "", row(whole, "whole")),
        F.when(main != "", row(main, "main")),
        F.when(inner != "", row(inner, "inner")),
        F.when(person & (F.size(inner_words) >= 2), row(F.element_at(inner_words, -1), "last_word")),
    )
    events = F.transform(marked, lambda t: F.struct(F.concat_ws(" ", F.element_at(bare, 1), t).alias("variant"), F.lit("event").alias("rule")))
    events = F.filter(events, lambda e: (F.size(bare) >= 3) & (normalize(e["variant"]) != normalize(c)))
    return F.concat(F.array_compact(fixed), events)


# The words that a question may begin with, and those that may follow.
ASKING, FOLLOWING = r"(?i)^(what|who|where|when|why|how|which)\b", r"(?i)^(is|are|was|were|does|do|did|can|could|should)\b"


def faq_topics(question: Column, answer: Column) -> Column:
    """array<struct(topic, relation)>: the question, what remains of it without its asking words, and a short answer."""
    q = F.trim(question)
    rest = F.regexp_replace(q, ASKING, "")
    rest = F.regexp_replace(F.trim(rest), FOLLOWING, "")
    rest = F.trim(F.regexp_replace(rest, r"[ ?.]+$", ""))
    row = lambda v, rule: F.struct(v.alias("topic"), F.lit(rule).alias("relation"))
    short = F.size(F.split(F.trim(answer), r"\s+")).between(1, 8) & (F.trim(answer) != "")
    return F.array_compact(F.array(F.when(q != "", row(question, "faq_topic")), F.when(rest != "", row(rest, "faq_topic_phrase")), F.when(short, row(answer, "faq_answer_topic"))))


def distinct_mentions(rows: DataFrame, identity: list[str], spelling: str) -> DataFrame:
    """One row an identity; of its spellings the least."""
    return rows.groupBy(*identity).agg(F.min(spelling).alias(spelling))


# Where records name people and events, as (part, fields, relation).
PEOPLE = ("person", "people", "persons", "founder", "founders", "associated_person", "associated_people")
NAMED = ("name", "person_name")
EVENTS = ("festival", "name", "title", "festival_name", "event", "event_name")
TOPICS = ("topic", "subject", "name")
VARIATIONS = ("query", "question", "variation", "text")


def mentions(records: DataFrame, target: str, record: str = "record") -> DataFrame:
    """Names by which JSON records (a variant column) may be meant: the target, mention, alias (normalised), mention_type, relation, source_field, source_section.

    People come from founders and history, events from festivals, topics from questions, their short answers and query variations; names with brackets
    and events give their variants as well. One row a target, alias, type, relation, field and section: spellings alone don't count. Records are dealt by target before they are gone
    through, as small files hold many; what is found of a target stays in its task.
    """
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    records = records.repartition(parts, target)
    v = F.col(record)
    none = F.lit(None).cast("string")
    row = lambda value, kind, relation, field, section: F.struct(value.alias("value"), F.lit(kind).alias("mention_type"), relation.alias("relation"), F.lit(field).alias("source_field"), section.alias("source_section"))

    def each(part: str, fields, kind: str, relation: str, section, one: bool) -> Column:
        """Of every object in a part's list, the strings under the fields (with one: only where they aren't lists)."""

        def field(x, i, f: str) -> Column:
            values = strings(x, f"$.{f}")
            if one:
                values = F.when(F.try_variant_get(x, f"$.{f}", "array<variant>").isNull(), values).otherwise(F.array().cast("array<string>"))
            return F.transform(values, lambda y: row(y, kind, F.lit(relation), f"{part}.{f}", section(x, i)))

        def of(x, i):
            return F.when(is_object(x), F.flatten(F.array(*[field(x, i, f) for f in fields])))

        return F.flatten(F.filter(F.transform(items(v, f"$.{part}"), of), lambda a: a.isNotNull()))

    def called(part, *names):
        return lambda x, i: F.coalesce(first_said(x, *[f"$.{n}" for n in names]), F.format_string(f"{part}[%d]", i))

    numbered = lambda part: lambda x, i: F.format_string(f"{part}[%d]", i)

    def asked(x, i):
        question, answer = first_said(x, "$.question", "$.query", "$.title"), first_said(x, "$.answer", "$.response")
        topics = faq_topics(F.coalesce(question, F.lit("")), F.coalesce(answer, F.lit("")))
        field = lambda t: F.when(t["relation"] == "faq_answer_topic", "faq.answer").otherwise("faq.question")
        made = F.transform(topics, lambda t: F.struct(t["topic"].alias("value"), F.lit("topic").alias("mention_type"), t["relation"].alias("relation"), field(t).alias("source_field"), numbered("faq")(x, i).alias("source_section")))
        return F.when(is_object(x), made)

    founders = F.transform(strings(v, "$.founders"), lambda y: row(y, "person", F.lit("associated_person"), "founders", none))
    bare = F.filter(F.transform(items(v, "$.query_variations"), lambda x, i: F.when(F.schema_of_variant(x) == "STRING", row(F.try_variant_get(x, "$", "string"), "topic", F.lit("query_variation"), "query_variations", numbered("query_variations")(x, i)))), lambda r: r.isNotNull())
    found = F.flatten(
        F.array(
            founders,
            each("history", PEOPLE, "person", "associated_person", called("history", "section", "title"), False),
            each("history", NAMED, "person", "historical_person", called("history", "section", "title"), True),
            each("festivals", EVENTS, "festival", "festival", called("festivals", "festival", "name", "title"), True),
            F.flatten(F.filter(F.transform(items(v, "$.faq"), asked), lambda a: a.isNotNull())),
            each("faq", TOPICS, "topic", "faq_topic", numbered("faq"), True),
            bare,
            each("query_variations", VARIATIONS, "topic", "query_variation", numbered("query_variations"), True),
        )
    )
    rows = records.select(F.col(target).alias("target"), F.explode(found).alias("m")).select("target", "m.*")
    kind = F.col("mention_type")
    # topics stand as they are; events have short names, people don't
    spelled = F.when(kind == "topic", F.array(F.trim("value"))).otherwise(F.transform(F.filter(name_variants(F.col("value"), kind == "person"), lambda x: (x["rule"] != "event") | (kind == "festival")), lambda x: x["variant"]))
    rows = rows.withColumn("mention", F.explode(spelled)).withColumn("alias", normalize(F.col("mention"))).filter("alias <> ''")
    identity = ["target", "alias", "mention_type", "relation", "source_field", "source_section"]
    return distinct_mentions(rows.select(*identity, "mention"), identity, "mention")


def ambiguous_mentions(records: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(alias, n of aliases that stand for several known targets), (the mentions of targets that aren't known). records: alias, target; entities: entity_id."""
    known = entities.select(F.col("entity_id").alias("target")).distinct()
    several = records.join(known, "target", "left_semi").groupBy("alias").agg(F.count_distinct("target").alias("n")).filter("n > 1")
    return several, records.join(known, "target", "left_anti")


def emergency_flags(entities: DataFrame, documents: DataFrame, text_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """(entities with emergency: whether a document names their id, the named ids that aren't entities: id, n of documents). Documents that aren't objects or name none don't count."""
    v = F.try_parse_json(text_col)
    named = documents.select(first_said(v, "$.temple_id", "$.templeId").alias("id")).filter("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    flagged = entities.join(named.select(F.col("id").alias("_e")), F.col("entity_id") == F.col("_e"), "left").withColumn("emergency", F.col("_e").isNotNull()).drop("_e")
    return flagged, named.join(entities.select(F.col("entity_id").alias("id")), "id", "left_anti")


TABLES = ("entities", "aliases", "mentions")


def write_registry(path: str, entities: DataFrame, aliases: DataFrame, mentions: DataFrame, mode: str = "errorifexists") -> int:
    """The registry as three tables under path, which change together: readers see the old ones or the new ones. mode: errorifexists or overwrite."""
    return committed.replace(path, dict(zip(TABLES, (entities, aliases, mentions))), once=mode == "errorifexists")


def read_registry(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables; entities without an id or a name, and aliases or mentions of no text, are left out."""
    entities, aliases, mentions = (committed.read(spark, path, name) for name in TABLES)
    return entities.filter("entity_id <> '' and canonical_name <> ''"), aliases.filter("alias <> ''"), mentions.filter("alias <> ''")


def report(spark: SparkSession, checks: dict[str, DataFrame]) -> DataFrame:
    """check, key, n of all checks; each gives key and n."""
    rows = None
    for name, df in checks.items():
        one = df.select(F.lit(name).alias("check"), F.col("key").cast("string").alias("key"), F.col("n").cast("long").alias("n"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def write_report(path: str, rows: DataFrame) -> int:
    """A report becomes the table `report` under path, beside the registry's tables if they are there."""
    return committed.replace(path, {"report": rows})
