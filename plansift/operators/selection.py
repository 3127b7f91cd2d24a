"""Curated records for requests: by place id, by place words, by mentions in order, by name; the first that answers wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plansift.functions.text import tokens
from plansift.sources.shared import cut, discard

MOST, FAR = 5, 999.0

# Words that ask for vegetarian food; they choose among the records of a place and never pin a place.
VEGETARIAN = ("veg", "vegetarian", "pureveg", "pure")


def best_by_word(records: DataFrame, most: int = MOST, food: bool = True) -> DataFrame:
    """kind, word, green, best: of each place id, place word and name word its `most` best records, best first.

    The index is ordered by what records are worth, not by what is asked: open records come first, near ones before far ones, those of no known distance last; with green, vegetarian ones before
    all others. So the best of all records that hold any of some words are among the best of each of those words, and no request reads more. A common word is cut in
    every task before the shuffle.
    """
    kinds = F.array(
        F.struct(F.lit("id").alias("kind"), F.array("place_id").alias("words")), F.struct(F.lit("place").alias("kind"), F.col("place_tokens").alias("words")), F.struct(F.lit("name").alias("kind"), F.col("name_tokens").alias("words")),
    )
    worth = {"closed": F.when(F.col("open"), 0).otherwise(1), "far": F.coalesce("distance_km", F.lit(FAR)).cast("double"), "meat": F.when(F.col("vegetarian"), 0).otherwise(1)} if food else {n: F.lit(0) for n in ("closed", "far", "meat")}
    rows = records.select("record_id", *[c.alias(n) for n, c in worth.items()], F.inline(kinds)).select("kind", F.explode(F.array_distinct("words")).alias("word"), "record_id", *worth).filter("word is not null")
    found = None
    for green, order in ((False, ["closed", "far", "record_id"]), *([(True, ["meat", "closed", "far", "record_id"])] if food else [])):
        w = Window.partitionBy("kind", "word").orderBy(*order)
        top = rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most)
        one = top.groupBy("kind", "word").agg(F.array_sort(F.collect_list(F.struct(*order, *[n for n in worth if n not in order]))).alias("x"))
        one = one.select("kind", "word", F.lit(green).alias("green"), F.transform("x", lambda r: F.struct(*[r[n].alias(n) for n in ("meat", "closed", "far", "record_id")])).alias("best"))
        found = one if found is None else found.unionByName(one)
    return found


def select_records(requests: DataFrame, records: DataFrame, most: int = MOST, food: bool = True) -> DataFrame:
    """request_id, record_id, tier, rank: up to `most` records of each request's first tier that has any.

    requests: request_id, question, ids, mentions; records: record_id, place_id, place_tokens, name_tokens and, for food, vegetarian, open,
    distance_km. Tiers: 1 ids, 2 the question's words among the place's, 3 the first mention with such words, 4 the question's words among the name's. Open
    records come first, near ones before far ones and those of no known distance; if vegetarian food is asked for and there is some, all else goes.

    Tier after tier is asked for what the ones before left open, and a request meets at most `most` records a word, however common its words are (see best_by_word).
    """
    scratch: list[str] = []
    spark = requests.sparkSession
    index = cut(best_by_word(records, most, food), scratch)
    green = F.arrays_overlap("said", F.array(*map(F.lit, VEGETARIAN))) if food else F.lit(False)
    left = cut(requests.select("request_id", "mentions", "ids", tokens(F.col("question")).alias("said")).withColumn("green", F.coalesce(green, F.lit(False))), scratch)
    said = lambda df: df.select("request_id", "green", F.lit(0).alias("pos"), F.explode("said").alias("word"))
    tiers = (
        ("id", lambda df: df.select("request_id", "green", F.lit(0).alias("pos"), F.explode(F.array_distinct("ids")).alias("word"))),
        ("place", said),
        ("place", lambda df: df.select("request_id", "green", F.posexplode("mentions").alias("pos", "m")).select("request_id", "green", "pos", F.explode(tokens(F.col("m"))).alias("word"))),
        ("name", said),
    )
    found = []
    for tier, (kind, asks) in enumerate(tiers, 1):
        met = asks(left).join(index.filter(F.col("kind") == kind).drop("kind"), ["word", "green"])
        # the first mention that meets anything; elsewhere all words count
        met = met.withColumn("_low", F.min("pos").over(Window.partitionBy("request_id"))).filter("pos = _low")
        rows = met.select("request_id", "green", F.inline("best")).distinct()
        order = [F.when(F.col("green"), F.col("meat")).otherwise(0), "closed", "far", "record_id"]
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("request_id").orderBy(*order))).filter(F.col("rank") <= most)
        rows = cut(rows.withColumn("tier", F.lit(tier)))
        found.append(rows)
        left = left.join(rows.select("request_id").distinct(), "request_id", "left_anti")
        if tier < len(tiers):
            left = cut(left, scratch)
    best = found[0]
    for rows in found[1:]:
        best = best.unionByName(rows)
    discard(spark, scratch)
    if food:
        some = F.max(F.col("green") & (F.col("meat") == 0)).over(Window.partitionBy("request_id"))
        best = best.withColumn("some", some).filter(~F.col("some") | (F.col("meat") == 0))
    return best.select("request_id", "record_id", "tier", "rank")
