"""Running values along a key's rows, however many rows one key has.

A window that is partitioned by a key puts all of the key's rows into one task. Here rows are dealt to ranges of (key, order), so that a key with
a third of all rows lies in a third of the ranges; each range is gone through by itself, and what the ranges before have left
is carried on: of each range only its first and last key matter to others, so that is a table of a row or two a range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plansift.sources.shared import cut


def ranged(rows: DataFrame, by: list[str], parts: int | None = None, scratch: list[str] | None = None) -> DataFrame:
    """rows with _part, the number of the range of `by` they lie in; written, so that the ranges stay what they are. parts: by default as many as a shuffle has."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(rows.repartitionByRange(parts, *by).withColumn("_part", F.spark_partition_id()), scratch)


def carry_forward(rows: DataFrame, keys: list[str], order: list[str], column: str, parts: int | None = None, scratch: list[str] | None = None) -> DataFrame:
    """rows with column's nulls replaced by the last value before them, in order, of the same keys; _part stays in.

    Rows that are equal in keys and order lie in one range, so order should tell rows apart. Null keys are a key. An empty table gives none.
    """
    at = ranged(rows, [*keys, *order], parts, scratch)
    same = lambda df, names: [F.col(k).eqNullSafe(df[n]) for k, n in zip(keys, names)]
    whole = F.struct(*keys)
    edges = at.groupBy("_part").agg(F.min(whole).alias("low"), F.max(whole).alias("high"))
    high = edges.select(F.col("_part").alias("_p"), *[F.col(f"high.{k}").alias(f"_h{n}") for n, k in enumerate(keys)])
    # what each range leaves for the next: the last value of its last key
    names = [f"_h{n}" for n in range(len(keys))]
    of_last = at.join(F.broadcast(high), [F.col("_part") == F.col("_p"), *same(high, names)])
    left = of_last.groupBy("_part", *keys).agg(F.max_by(column, F.when(F.col(column).isNotNull(), F.struct(*order))).alias("v")).withColumn("asks", F.lit(False))
    asks = edges.select("_part", *[F.col(f"low.{k}").alias(k) for k in keys], F.lit(None).cast(rows.schema[column].dataType).alias("v"), F.lit(True).alias("asks"))
    # a range asks before it leaves: a key's rows here are two a range at most
    along = Window.partitionBy(*keys).orderBy("_part", F.desc("asks")).rowsBetween(Window.unboundedPreceding, 0)
    carried = left.unionByName(asks).withColumn("v", F.last("v", ignorenulls=True).over(along)).filter("asks and v is not null")
    carried = carried.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], F.col("v").alias("_v"))
    within = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = at.withColumn(column, F.last(column, ignorenulls=True).over(within))
    names = [f"_k{n}" for n in range(len(keys))]
    met = own.join(F.broadcast(carried), [F.col("_part") == F.col("_p"), *same(carried, names)], "left")
    return met.withColumn(column, F.coalesce(column, "_v")).drop("_p", "_v", *names)
