"""Mixes of sources by weights, fitted to a budget of words.

Each source gets a target: a share of the whole budget by its weight, at most CAP times its size, what is cut off being shared
again by weight until no target is above. A source's documents are all taken as often as its size goes into the target;
what is left of the target, less than its size, is fitted by taking some documents once more, whose sizes sum up to it:

1. Documents are counted by source and exact size; only these counts are looked at to choose.
2. Of each size the same share is taken, rounded down, so that the mix keeps the source's spread of sizes, short of the rest by RESERVE words or more.
3. Large sizes first, further documents fill the rest until at most 2 * RESERVE words lack.
4. A bounded knapsack, as bit sets over the words that lack, finds how many of each size sum up to exactly that, or as near as any choice comes.
5. The documents of a size are taken in the order of a seeded hash of their id, so that reruns agree.

A source's counts (a row a distinct size) meet in one task, its documents never do: where over HOT documents of a source, and over a SIZES-th part of all
documents, have one size, they are dealt to ranges of the hash, which are counted first, and only the range in which the taking ends is put in order. Sources are numbered in ranges, and shared out by sums over all of them.

Null and empty texts have size 0 and are taken 0 words of; a null source is a source of its own, after all others. Null ids and repeated rows count as documents like
any other; which of two with one id is taken can't matter. A source without words has target 0. An empty table gives no rows. A text is read whole in its task, other columns play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plansift.llm.common import cut, discard, small, word_count

WEIGHTS, SHARE, CAP, SEED = (3, 1, 2), Fraction(3, 2), 2, 42
RESERVE, HOT, SIZES = 32_768, 1024, 100_000

def fit(counts: Sequence[tuple[int, int]], budget: int, reserve: int = RESERVE) -> dict[int, int]:
    """How many documents of each size to take, for (size, how many there are): their sum is near to budget, which the sum of all isn't below."""
    counts = sorted((size, n) for size, n in counts if size > 0 and n > 0)
    total = sum(size * n for size, n in counts)
    if not total or budget <= 0:
        return {}
    even = max(0, budget - reserve)
    taken = {size: n * even // total for size, n in counts}
    lack = budget - sum(size * n for size, n in taken.items())
    for size, n in reversed(counts):
        if lack <= 2 * reserve:
            break
        more = min(n - taken[size], (lack - reserve) // size)
        taken[size] += more
        lack -= size * more
    # in no order of size, so that neither short nor long documents are favoured
    rest = sorted(((size, n - taken[size]) for size, n in counts if n > taken[size]), key=lambda x: zlib.crc32(b"%d" % x[0]))
    for size, n in knapsack(rest, lack).items():
        taken[size] += n
    return {size: n for size, n in taken.items() if n}


def knapsack(items: Sequence[tuple[int, int]], budget: int) -> dict[int, int]:
    """Of each (size, how many), how many to take so that the sum is as near to budget as any is; of two as near the less."""
    if budget <= 0 or not items:
        return {}
    top = 2 * budget  # more is never as near as nothing
    mask = (1 << (top + 1)) - 1
    reached, stages, at = 1, [], {}
    for size, n in items:
        before, left, part = reached, min(n, top // size), 1
        while left > 0:
            step = min(part, left)
            reached |= (reached << (size * step)) & mask
            left -= step
            part *= 2
        if reached != before:
            stages.append((size, reached & ~before))
        if reached >> budget & 1:
            break
    below = (reached & ((1 << (budget + 1)) - 1)).bit_length() - 1
    above = reached >> (budget + 1)
    best = below
    if above:
        first = budget + (above & -above).bit_length()
        best = first if first - budget < budget - below else below
    # back from the sum: a stage's size is taken until a sum that was reached before it
    for size, new in reversed(stages):
        while new >> best & 1:
            at[size] = at.get(size, 0) + 1
            best -= size
    return at


def _numbered(names: DataFrame, scratch: list[str]) -> DataFrame:
    """source, number: from 0, by code point, null last. Counts of ranges go to the driver, one a range."""
    placed = cut(names.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last()).withColumn("place", F.monotonically_increasing_id()), scratch)
    part = F.shiftright("place", 33)
    before, sums = 0, []
    for row in sorted(placed.groupBy(part.alias("part")).count().collect()):
        sums.append((row["part"], before))
        before += row["count"]
    offsets = names.sparkSession.createDataFrame(sums, "part long, before long")
    return placed.withColumn("part", part).join(F.broadcast(offsets), "part").select("source", (F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1)).alias("number"))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: Fraction | float = SHARE, cap: int = CAP, scratch: list[str] | None = None) -> DataFrame:
    """source, source_size, target, of source, source_size. Sums over all sources are taken once a round, until no target is above cap times its size.

    scratch gets the folders that the result reads.
    """
    scratch = [] if scratch is None else scratch
    whole = _numbered(sizes.select("source"), scratch)
    cycle = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    rows = cut(sizes.join(whole, sizes["source"].eqNullSafe(whole["source"])).select(sizes["source"], "source_size", cycle.cast("decimal(38,0)").alias("w"), (F.col("source_size").cast("decimal(38,0)") * cap).alias("most")), scratch)
    if rows.isEmpty():
        return rows.select("source", "source_size", F.lit(0.0).alias("target"))
    share = Fraction(share)
    budget = share * int(rows.agg(F.sum("source_size")).first()[0])
    level: Fraction | None = None  # words a weight of 1 gets
    while True:
        # a source is capped if w * level > most
        capped = F.lit(False) if level is None else F.col("w") * F.lit(str(level.numerator)).cast("decimal(38,0)") > F.col("most") * F.lit(str(level.denominator)).cast("decimal(38,0)")
        got = rows.agg(F.sum(F.when(capped, F.col("most"))), F.sum(F.when(~capped, F.col("w")))).first()
        used, free = int(got[0] or 0), int(got[1] or 0)
        following = (budget - used) / free if free else level
        if following == level:
            break
        level = following
    return rows.select("source", "source_size", F.when(capped, F.col("most").cast("double")).otherwise(F.col("w").cast("double") * float(level)).alias("target"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, share: Fraction | float = SHARE, cap: int = CAP, seed: int = SEED, reserve: int = RESERVE, hot: int = HOT) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (how often the mix holds the document), taken (copies times size).

    weights: of the sources in order, again and again; share: the mix's size as a multiple of all sizes, below cap, which is the most copies of a document.
    """
    scratch: list[str] = []
    key = F.col(id_col).cast("long")
    docs = cut(df.select(key.alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 1).alias("h")))
    counts = cut(docs.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), scratch)
    aim = targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, cap, scratch)

    def chosen(pdf):
        whole, goal = int(pdf.source_size.iloc[0]), float(pdf.target.iloc[0])
        each = min(int(goal // whole), cap) if whole else 0
        sizes = pdf["size"].tolist()
        more = fit(list(zip(sizes, pdf.n.tolist())), round(goal - each * whole), reserve) if each < cap else {}
        return pdf.assign(each=each, more=[more.get(s, 0) for s in sizes])[["source", "size", "n", "source_size", "target", "each", "more"]]

    aim = small(cut(aim, scratch)).withColumnRenamed("source", "_source")
    joined = counts.join(aim, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    plan = cut(joined.groupBy("source").applyInPandas(chosen, "source string, size long, n long, source_size long, target double, each long, more long"), scratch)

    # documents of one source and size, where there are many, are dealt to ranges of the hash; so many at most have one size that this makes SIZES of them at most
    many_of = max(hot, (plan.agg(F.sum("n")).first()[0] or 0) // SIZES)
    many = F.broadcast(cut(plan.filter(F.col("n") > many_of).select(F.col("source").alias("_source"), F.col("size").alias("_size"), F.ceil(F.col("n") / many_of).cast("long").alias("ranges"))))
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size"))
    unit = F.shiftright("h", 10) / float(1 << 53)
    dealt = docs.join(many, same, "left").withColumn("range", F.coalesce(F.floor(unit * F.col("ranges")), F.lit(0))).drop("_source", "_size")
    there = dealt.filter(F.col("ranges").isNotNull()).groupBy(F.col("source").alias("_source"), F.col("size").alias("_size"), "range").agg(F.count(F.lit(1)).alias("in_range"))
    before = F.coalesce(F.sum("in_range").over(Window.partitionBy("_source", "_size").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    there = there.withColumn("before", before)
    by_range = plan.join(there, same, "left").withColumn("range", F.coalesce("range", F.lit(0))).withColumn("n", F.coalesce("in_range", "n")).withColumn("more", F.col("more") - F.coalesce("before", F.lit(0)))
    by_range = small(cut(by_range.select(F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("range").alias("_range"), "n", "source_size", "target", "each", "more")))
    discard(df.sparkSession, scratch)
    met = dealt.drop("ranges").join(by_range, same & (F.col("range") == F.col("_range"))).drop("_source", "_size", "_range")
    part = (F.col("more") > 0) & (F.col("more") < F.col("n"))
    nth = F.row_number().over(Window.partitionBy("source", "size", "range").orderBy("h", "doc_id"))
    some = met.filter(part).withColumn("copies", F.col("each") + F.when(nth <= F.col("more"), 1).otherwise(0))
    others = met.filter(~part).withColumn("copies", F.col("each") + F.when(F.col("more") > 0, 1).otherwise(0))
    return some.unionByName(others).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
