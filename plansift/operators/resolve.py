"""Resolution of mentions: exact, fuzzy, related; with context and ambiguity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from plansift.sources.shared import cut, discard

FUZZY, RELATED, PLACE = 0.88, 0.82, 0.90
CITY, DISTRICT = 40, 25
#: So many rows of pieces, and so many characters in them, are sent to all tasks; a text said by more mentions than OFTEN is dealt to several tasks.
SENT, SENT_CHARS, OFTEN = 500_000, 32 << 20, 100_000

# Which mention types and relations answer to a requested type; other types answer to themselves.
RELATED_TYPES = {
    "person": ("person", "topic", "associated_person", "historical_person"),
    "festival": ("festival", "topic", "query_variation"),
    "event": ("festival", "topic", "query_variation"),
    "topic": ("topic", "festival", "query_variation"),
    "landmark": ("landmark", "place", "festival", "event", "topic", "query_variation"),
}

# The types of mention that stand for an entity.
RESOLVABLE = ("temple", "person", "festival", "event", "landmark", "place")


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Likeness of the standard library's matcher, mention first; it isn't symmetric."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype=float)


def may_match(a: Column, b: Column, limit: float) -> Column:
    """What every pair of ratio >= limit fulfils: near lengths and few insertions and deletions."""
    both = F.length(a) + F.length(b)
    return (2 * F.least(F.length(a), F.length(b)) >= limit * both) & (F.levenshtein(a, b) <= (1 - limit) * both)


def _pieces(n: Column, limit: float) -> tuple[Column, Column]:
    """(most edits that any alias within the limit can be away, width of the pieces) of a mention of n characters; the last piece takes the rest."""
    edits = F.floor((1 - limit) * (n + n * (2 - limit) / limit)).cast("int")
    return edits, F.floor(n / F.least(edits + 1, n)).cast("int")


def fuzzy_pairs(mentions: DataFrame, names: DataFrame, limit: float) -> DataFrame:
    """mention x alias rows that may_match. mentions: m_id, mention; names: alias and what goes with it.

    A pair within d edits shares one of the mention's d + 1 pieces, and it stands at most d places off. So the join is on
    (piece, where it stands), the mention's pieces being sent to the places around, and near lengths; never a cross join.
    The aliases' pieces have the widths that mentions of near length are cut into. The mentions' pieces are counted: if they are few, they go to the aliases, whose pieces then are neither moved nor kept;
    if there are none, no alias is read. Aliases are dealt out before they become many rows.
    """
    parts = int(mentions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    m = mentions.withColumn("n", F.length("mention")).filter("n > 0")
    d, width = _pieces(F.col("n"), limit)
    m = m.withColumns({"d": d, "step": width}).withColumn("k", F.least(F.col("d") + 1, F.col("n")))
    n, step, k = F.col("n"), F.col("step"), F.col("k")
    pieces = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.struct((i * step + 1).alias("start"), F.substring("mention", i * step + 1, F.when(i == k - 1, n - i * step).otherwise(step)).alias("piece")))
    probe = m.withColumn("x", F.explode(pieces)).withColumn("start", F.explode(F.sequence(F.greatest(F.lit(1), F.col("x.start") - F.col("d")), F.col("x.start") + F.col("d"))))
    probe = probe.select(*mentions.columns, F.col("n").alias("_n"), F.col("x.piece").alias("piece"), "start").distinct()
    asked, chars = probe.agg(F.count(F.lit(1)), F.sum(F.length("mention"))).first()
    if asked <= SENT and (chars or 0) <= SENT_CHARS:
        probe = F.broadcast(probe)

    long = F.length("alias")
    lengths = F.sequence(F.greatest(F.lit(1), F.ceil(long * limit / (2 - limit) - 1e-9).cast("int")), F.greatest(F.lit(1), F.floor(long * (2 - limit) / limit + 1e-9).cast("int")))

    def widths(n: Column) -> Column:
        d, step = _pieces(n, limit)
        return F.array(step, n - (F.least(d + 1, n) - 1) * step)

    every = F.array_distinct(F.flatten(F.transform(lengths, widths)))
    grams = F.flatten(F.transform(every, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(long - (w - 1), F.lit(1))), lambda i: F.struct(i.alias("start"), F.substring("alias", i, w).alias("piece")))))
    dealt = names.repartition(parts, F.xxhash64("alias")) if asked else names.filter(F.lit(False))
    index = dealt.withColumn("_g", F.explode(F.array_distinct(grams))).select(*names.columns, "_g.start", "_g.piece")
    near = 2 * F.least(F.col("_n"), long) >= limit * (F.col("_n") + long)
    met = probe.join(index, ["piece", "start"]).filter(near).drop("piece", "start", "_n")
    return met.dropDuplicates(["m_id", "alias", *[c for c in names.columns if c != "alias"]]).filter(may_match(F.col("mention"), F.col("alias"), limit))


def of_type(asked: Column, entity_type: Column) -> Column:
    """Whether an entity is of the type asked for, if one is."""
    return asked.isNull() | (entity_type == asked)


def _least(rows: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """rows without those that `most` others of the same `by` come before; rows must be distinct."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r")


def alike(mentions: DataFrame, names: DataFrame, limit: float) -> DataFrame:
    """mention, alias, s: the texts of mentions and names whose likeness reaches the limit, each pair of texts once, however many ids have them."""
    met = fuzzy_pairs(mentions.select(F.col("mention").alias("m_id"), "mention").distinct(), names.select("alias").distinct(), limit)
    return met.select("mention", "alias", ratio("mention", "alias").alias("s")).filter(F.col("s") >= limit)


def fuzzy(mentions: DataFrame, names: DataFrame, key: str, limit: float = FUZZY, most: int = 10) -> DataFrame:
    """m_id, key, score (4 decimals): the `most` best entities of each mention, by likeness, then alias. Of an alias only its `most` least keys can be among them."""
    keys = _least(names.select("alias", key).distinct(), ["alias"], [key], most)
    best = alike(mentions, names, limit).join(keys, "alias").groupBy("mention", key).agg(F.min(F.struct((-F.col("s")).alias("s"), "alias")).alias("x"))
    best = _least(best.select("mention", key, (-F.col("x.s")).alias("s"), "x.alias"), ["mention"], [F.desc("s"), "alias", key], most)
    return mentions.select("m_id", "mention").join(best, "mention").select("m_id", key, F.round("s", 4).alias("score"))


def context_score(ids: Column, parent: Column, city: Column, district: Column, itself: Column | None = None, related: Column | None = None) -> Column:
    """What the context names, each a condition or null: the entity's id 100, the entity as the context's place 100, its place 80, its relation to that place 80, its city 40, its district 25."""
    point = lambda c, v: F.when(c, v).otherwise(0)
    none = F.lit(False)
    return point(ids, 100) + point(none if itself is None else itself, 100) + point(parent, 80) + point(none if related is None else related, 80) + point(city, CITY) + point(district, DISTRICT)


def decide_exact(scored: DataFrame, key: str) -> DataFrame:
    """m_id, status, key, match_type, context, n: of exact candidates (m_id, key, context) the one of best context, if it is alone."""
    top = scored.groupBy("m_id").agg(F.max("context").alias("context"), F.count(F.lit(1)).alias("n"))
    return _exact(scored.join(top, ["m_id", "context"]).groupBy("m_id", "context", "n").agg(F.count(F.lit(1)).alias("ties"), F.min(key).alias(key)), key)


def _exact(best: DataFrame, key: str) -> DataFrame:
    """m_id, status, key, match_type, context, n of the best context's ties and their least key."""
    alone = F.col("ties") == 1
    return best.select("m_id", F.when(alone, "RESOLVED").otherwise("AMBIGUOUS").alias("status"), F.when(alone, F.col(key)).alias(key), F.when(alone & (F.col("context") > 0), "exact_context").when(alone, "exact").otherwise("exact_ambiguous").alias("match_type"), "context", "n")


def exact_by_context(mentions: DataFrame, entities: DataFrame, key: str, levels: list[tuple[int, list[str]]]) -> DataFrame:
    """As decide_exact of all entities of a mention's alias, without a row for each of them.

    mentions: m_id, alias, itself (the key of the entity that the context names, or null) and the context's values; entities: key, alias and theirs, under the same names. levels: (score, the columns that agree), highest
    first and the last without columns; an entity has the score of the first level that it fulfils, and 100 more if it is the one named. Entities are counted by level's columns, and a
    mention meets a count a level: the highest level that any entity fulfils.
    """
    rows, met = mentions, []
    for i, (_, columns) in enumerate(levels):
        by = ["alias", *columns]
        rows = rows.join(entities.groupBy(*by).agg(F.count(F.lit(1)).alias(f"_n{i}"), F.min(key).alias(f"_k{i}")), by, "left")
        met.append(F.when(F.col(f"_n{i}").isNotNull(), F.struct(F.lit(levels[i][0]).alias("context"), F.col(f"_n{i}").alias("ties"), F.col(f"_k{i}").alias(key))))
    # the named one is above all others
    own = mentions.select("m_id", "alias", "itself", *dict.fromkeys(c for _, columns in levels for c in columns))
    fits = entities.select(F.col("alias").alias("_a"), F.col(key).alias("itself"), *[F.col(c).alias(f"_{c}") for c in own.columns[3:]])
    score = F.coalesce(*[F.when(F.lit(True) if not columns else F.coalesce(F.concat(*[(F.col(c) == F.col(f"_{c}")).cast("string") for c in columns]) == "true" * len(columns), F.lit(False)), value) for value, columns in levels])
    named = own.join(fits, "itself").filter("alias = _a").groupBy("m_id").agg(F.max(score + 100).alias("_own"), F.count(F.lit(1)).alias("_times"))
    rows = rows.join(named, "m_id", "left").filter(F.col(f"_n{len(levels) - 1}").isNotNull())
    best = F.coalesce(F.when(F.col("_own").isNotNull(), F.struct(F.col("_own").alias("context"), F.col("_times").alias("ties"), F.col("itself").alias(key))), *met)
    return _exact(rows.select("m_id", F.col(f"_n{len(levels) - 1}").alias("n"), best.alias("x")).select("m_id", "n", "x.*"), key)


def decide_fuzzy(scored: DataFrame, key: str) -> DataFrame:
    """m_id, status, key, match_type: best context if above 0 and alone; else the likeness of the first by (context, likeness), if alone with it."""
    w = Window.partitionBy("m_id").orderBy(F.desc("context"), F.desc("score"), key)
    ranked = scored.withColumns({"top": F.first("context").over(w), "lead": F.first("score").over(w)})
    ranked = ranked.groupBy("m_id").agg(
        F.sum((F.col("context") == F.col("top")).cast("int")).alias("nc"), F.max("top").alias("top"),
        F.min(F.when(F.col("context") == F.col("top"), F.col(key))).alias("kc"),
        F.sum((F.col("score") == F.col("lead")).cast("int")).alias("ns"), F.min(F.when(F.col("score") == F.col("lead"), F.col(key))).alias("ks"),
    )
    by_context = (F.col("top") > 0) & (F.col("nc") == 1)
    by_score = F.col("ns") == 1
    return ranked.select("m_id", F.when(by_context | by_score, "RESOLVED").otherwise("AMBIGUOUS").alias("status"), F.when(by_context, F.col("kc")).when(by_score, F.col("ks")).alias(key), F.when(by_context, "fuzzy_context").when(by_score, "fuzzy").otherwise("fuzzy_ambiguous").alias("match_type"))


def related_fits(asked: Column, mention_type: Column, relation: Column, entity_type: Column) -> Column:
    """Whether a related mention answers to the type asked for: by its own type or relation, or by its target's type."""
    allowed = F.create_map(*[x for k, v in RELATED_TYPES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    types = F.coalesce(allowed[asked], F.array(asked))
    return asked.isNull() | F.coalesce(F.array_contains(types, mention_type), F.lit(False)) | F.coalesce(F.array_contains(types, relation), F.lit(False)) | F.coalesce(entity_type == asked, F.lit(False))


def _said_of(records: DataFrame, entities: DataFrame) -> DataFrame:
    """alias, target, relation, kinds: a row for what records say of a known target, with the pairs of mention type and entity type that it stands under."""
    pair = F.struct("mention_type", "entity_type")
    return records.join(entities.select("target", "entity_type"), "target").groupBy("alias", "target", "relation").agg(F.collect_set(pair).alias("kinds"))


def _fitting() -> Column:
    """The mention types under which a row of _said_of answers to the type asked for."""
    fits = F.filter("kinds", lambda x: related_fits(F.col("asked"), x["mention_type"], F.col("relation"), x["entity_type"]))
    return F.transform(fits, lambda x: x["mention_type"])


def related_exact(mentions: DataFrame, records: DataFrame, entities: DataFrame) -> DataFrame:
    """Related mentions of the same text and a fitting type whose target is known. mentions: m_id (unique), mention, asked; records: alias, mention_type, relation, target; entities: target, entity_type.

    What is alike is brought together before mentions meet it, so pairs are handed on as they come, never grouped.
    """
    found = mentions.join(_said_of(records, entities), F.col("mention") == F.col("alias")).withColumn("fitting", _fitting()).filter(F.size("fitting") > 0)
    return found.select("m_id", "target", "relation", "alias", F.array_min("fitting").alias("mention_type"), F.lit(1.0).alias("score"))


def related(mentions: DataFrame, records: DataFrame, entities: DataFrame, limit: float = RELATED, most: int = 10) -> DataFrame:
    """m_id, target, relation, alias, mention_type, score of related mentions, as related_exact; mentions that it has none for get near ones: of the `most` nearest those whose target is known.

    Near ones are told apart by target, relation and spelling: records may have a column spelling; else the alias stands for it.
    """
    exact = related_exact(mentions, records, entities)
    # a text answers to a type or it doesn't, whatever the targets
    kinds = records.join(entities.select("target", "entity_type"), "target").select("alias", "mention_type", "relation", "entity_type").distinct()
    fits = related_fits(F.col("asked"), F.col("mention_type"), F.col("relation"), F.col("entity_type"))
    rest = mentions.join(kinds, (F.col("mention") == F.col("alias")) & fits, "left_anti")
    spelled = records if "spelling" in records.columns else records.withColumn("spelling", F.col("alias"))
    known = entities.select("target", "entity_type", F.lit(True).alias("known"))
    # a spelling has one alias; of what answers alike to every type, only the `most` least can be among the nearest
    held = spelled.groupBy("alias", "target", "relation", "spelling").agg(F.array_sort(F.collect_set("mention_type")).alias("types")).join(known, "target", "left")
    held = _least(held, ["alias", "relation", "entity_type", "types"], ["target", "spelling"], most)
    fitting = F.filter("types", lambda t: related_fits(F.col("asked"), t, F.col("relation"), F.col("entity_type")))
    near = rest.join(alike(rest, records, limit), "mention").join(held, "alias").withColumn("mention_type", F.array_min(fitting)).filter(F.size(fitting) > 0)
    near = near.groupBy("m_id", "target", "relation", "spelling").agg(F.max_by("alias", "s").alias("alias"), F.min("mention_type").alias("mention_type"), F.round(F.max("s"), 4).alias("score"), F.max("known").alias("known"))
    w = Window.partitionBy("m_id").orderBy(F.desc("score"), "alias", "target", "relation", "spelling")
    near = near.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most).filter("known")
    return exact.unionByName(near.select(*exact.columns))


def decide_related(found: DataFrame) -> DataFrame:
    """m_id, status, key, match_type of related mentions: the target of the best score, if it is one."""
    by_score = found.groupBy("m_id", "score").agg(F.min("target").alias("key"), F.max("target").alias("last"))
    best = by_score.groupBy("m_id").agg(F.max(F.struct("score", "key", "last")).alias("x")).select("m_id", "x.*")
    kind = F.when(F.col("score") == 1, "related_exact").otherwise("related_fuzzy")
    alone = F.col("key") == F.col("last")
    return best.select("m_id", F.when(alone, "RESOLVED").otherwise("AMBIGUOUS").alias("status"), F.when(alone, F.col("key")).alias("key"), F.concat(kind, F.when(alone, "").otherwise("_ambiguous")).alias("match_type"))


def resolve(mentions: DataFrame, names: DataFrame, entities: DataFrame, records: DataFrame | None = None, context: Column | None = None) -> DataFrame:
    """m_id, status, key, match_type of every mention: by equal alias, else by a near one, else by a related mention; each, once the one before is written, only for what that leaves.

    mentions: m_id, mention (normalised), asked (a type or null) and what context needs; names: alias, key; entities: key, entity_type and what
    context needs; records: alias, mention_type, relation, target. context: a score of (mention, entity) rows, 0 by default.
    """
    spark, scratch = mentions.sparkSession, []
    said = mentions.filter("mention <> ''")
    # without a context, what is said alike is resolved once
    one = F.to_json(F.struct("mention", "asked"))
    live = said if context is not None else cut(said.select(one.alias("m_id"), "mention", "asked").distinct(), scratch)
    # dealt by key, as a text may be the name of most
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    typed = cut(names.repartition(parts, "key").join(entities, "key"), scratch)
    fits = of_type(F.col("asked"), F.col("entity_type"))
    if context is not None:
        same = live.join(typed, F.col("mention") == F.col("alias")).filter(fits).groupBy("m_id", "key").agg(F.max(context).alias("context"))
        exact = decide_exact(same, "key")
    else:
        count = [F.count_distinct("key").alias("ties"), F.min("key").alias("key")]
        of_any, of_one = typed.groupBy("alias").agg(*count), typed.groupBy("alias", "entity_type").agg(*count)
        same = live.filter("asked is null").join(of_any, F.col("mention") == F.col("alias")).drop("alias").unionByName(live.join(of_one, (F.col("mention") == F.col("alias")) & (F.col("asked") == F.col("entity_type"))).drop("alias", "entity_type"))
        exact = _exact(same.select("m_id", F.lit(0).alias("context"), F.col("ties").alias("n"), "ties", "key"), "key")
    out = cut(exact.select("m_id", "status", "key", "match_type"), scratch)
    rest = live.join(out.select("m_id"), "m_id", "left_anti")
    # of an alias only the ten least keys of a type can be among the ten best
    few = _least(typed.select("alias", "key", "entity_type").distinct(), ["alias", "entity_type"], ["key"], 10)
    pairs = rest.join(alike(rest, names, FUZZY), "mention").join(few, "alias").filter(fits)
    best = pairs.groupBy("m_id", "key").agg(F.min(F.struct((-F.col("s")).alias("s"), "alias")).alias("x")).select("m_id", "key", (-F.col("x.s")).alias("s"), "x.alias")
    near = _least(best, ["m_id"], [F.desc("s"), "alias", "key"], 10)
    if context is None:
        near = near.withColumn("context", F.lit(0))
    else:
        near = near.join(live, "m_id").join(entities, "key").filter(fits).groupBy("m_id", "key", "s").agg(F.max(context).alias("context"))
    out = cut(out.unionByName(decide_fuzzy(near.select("m_id", "key", "context", F.round("s", 4).alias("score")), "key")), scratch)
    if records is not None:
        rest = live.join(out.select("m_id"), "m_id", "left_anti")
        out = cut(out.unionByName(decide_related(related(rest.select("m_id", "mention", "asked"), records, entities.select(F.col("key").alias("target"), "entity_type")))), scratch)
    if context is None:
        out = cut(said.select("m_id", one.alias("_said")).join(out.withColumnRenamed("m_id", "_said"), "_said").drop("_said"), scratch)
    scratch.pop()  # the answer reads the last
    discard(spark, scratch)
    none = F.lit(None).cast("string")
    left = mentions.join(out.select("m_id"), "m_id", "left_anti").select("m_id", F.lit("UNRESOLVED").alias("status"), none.cast(entities.schema["key"].dataType).alias("key"), F.lit("none").alias("match_type"))
    return out.unionByName(left)


def request_ids(mentions: DataFrame, resolved: DataFrame, request: list[str]) -> DataFrame:
    """The request's columns and ids: the sorted distinct keys of its resolved mentions. mentions: request, m_id; a request names few entities.

    Mentions are gone through twice; those of an m_id that occurs often are dealt to several tasks by their request, and its key is sent to each.
    """
    good = resolved.filter("status = 'RESOLVED'").select("m_id", "key")
    often = F.broadcast(mentions.groupBy("m_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > OFTEN).select("m_id", F.ceil(F.col("_n") / OFTEN).cast("int").alias("_n")))
    shares = F.coalesce("_n", F.lit(1))
    held = good.join(often, "m_id", "left").select("m_id", "key", F.explode(F.sequence(F.lit(0), shares - 1)).alias("_at"))
    dealt = mentions.join(often, "m_id", "left").withColumn("_at", F.pmod(F.hash(*request), shares))
    return dealt.join(held, ["m_id", "_at"]).groupBy(*request).agg(F.array_sort(F.collect_set("key")).alias("ids"))


def first_tier(tiers: DataFrame, key: str, tier: str = "tier") -> DataFrame:
    """The rows of each key's lowest tier."""
    low = tiers.groupBy(key).agg(F.min(tier).alias(tier))
    return tiers.join(low, [key, tier])
