"""Radius search by grid cells, and the greedy removal of near-equal names."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plansift.functions.geo import haversine
from plansift.operators.resolve import may_match, ratio
from plansift.sources.shared import cut, discard

KM_A_DEGREE = 111.19
#: A radius is halved so often at most.
FINEST = 12


def radius_join(anchors: DataFrame, points: DataFrame, km: float, k: int) -> DataFrame:
    """anchor_id, point_id, distance_km, rank: the k points nearest to each anchor within km, ties to smaller point_id.

    anchors: anchor_id, lat, lng; points: point_id, lat, lng; coordinates beyond their range or null take no part. Of points at one place only the k least can be among the nearest, and
    anchors at one place are asked once. Where points are dense, places are first looked for within a fraction of the radius: who has k there is done, as all others are farther; the rest
    go on to twice the radius. So the pairs of an anchor don't grow with the points, if those near it are about as dense as those around.
    """
    spark, scratch = points.sparkSession, []
    sound = lambda df: df.filter(F.col("lat").between(-90, 90) & F.col("lng").between(-180, 180))
    here = Window.partitionBy("lat", "lng").orderBy("point_id")
    few = sound(points).select("point_id", "lat", "lng").withColumn("_r", F.row_number().over(here)).filter(F.col("_r") <= k).drop("_r")
    p, asked = cut(few, scratch), sound(anchors).select("anchor_id", "lat", "lng")
    left = cut(asked.select("lat", "lng").distinct(), scratch)
    n, cells = p.select(*_cell(km)).agg(F.count(F.lit(1)), F.count_distinct("cy", "cx")).first()
    halvings = min(FINEST, int(math.log(n / cells / (2 * k), 4))) if cells and n > 2 * k * cells else 0
    found = None
    for step in range(halvings, -1, -1):
        near = cut(_within(left, p, km / 2**step, k), None if step == 0 and found is None else scratch)
        if step:
            full = near.groupBy("a_lat", "a_lng").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= k).select("a_lat", "a_lng")
            left = cut(left.join(full, (F.col("lat") == F.col("a_lat")) & (F.col("lng") == F.col("a_lng")), "left_anti"), scratch)
            near = near.join(full, ["a_lat", "a_lng"], "left_semi")
        found = near if found is None else found.unionByName(near)
    if halvings:
        found = cut(found)
    discard(spark, scratch)
    w = Window.partitionBy("anchor_id").orderBy("distance_km", "point_id")
    back = asked.join(found, (F.col("lat") == F.col("a_lat")) & (F.col("lng") == F.col("a_lng")))
    return back.select("anchor_id", "point_id", "distance_km", F.row_number().over(w).alias("rank")).filter(F.col("rank") <= k)


def _band_height(km: float) -> float:
    return (km + 0.005) / KM_A_DEGREE  # distances are rounded to 2 decimals


def _cell_of(b: Column, lng: Column, km: float) -> tuple[Column, Column]:
    """(how many cells a band of latitude has, the one a longitude lies in); an anchor may lie in the next band towards the pole."""
    height = _band_height(km)
    far = F.least(F.lit(90.0), F.greatest(F.abs((b - 1) * height), F.abs((b + 2) * height)))
    # half a chord's longitude grows towards the poles: sin(dlng / 2) = sin(d / 2) / cos(lat)
    ratio = F.lit(math.sin(math.radians(height / 2))) / F.cos(F.radians(far))
    n = F.when(ratio >= 1, 1).otherwise(F.greatest(F.lit(1), F.floor(360 / F.degrees(2 * F.asin(F.least(ratio, F.lit(1.0))))).cast("int")))
    return n, F.pmod(F.floor((lng + 180) / 360 * n), n.cast("long")).cast("int")


def _cell(km: float) -> tuple[Column, Column]:
    """cy, cx: the cell of a row's lat and lng."""
    band = F.floor(F.col("lat") / _band_height(km)).cast("int")
    return band.alias("cy"), _cell_of(band, F.col("lng"), km)[1].alias("cx")


def _within(places: DataFrame, points: DataFrame, km: float, k: int) -> DataFrame:
    """a_lat, a_lng, point_id, distance_km: the k points nearest to each place (lat, lng) within km.

    Bands of latitude are as high as the radius, and a band's cells at least as wide as the radius at the far end of the next band towards the pole, an even share of its circle; a place
    looks into the three cells around it in its own band and the two beside, round the date line too. So the join is on equal cells. In a band by a pole all points are one cell.
    """
    height = _band_height(km)
    whole = int(90 / height) + 2  # bands on either side of the equator
    band = F.floor(F.col("lat") / height).cast("int")
    a = places.select(F.col("lat").alias("a_lat"), F.col("lng").alias("a_lng"), F.explode(F.sequence(band - 1, band + 1)).alias("cy"))
    n, own = _cell_of(F.col("cy"), F.col("a_lng"), km)
    a = a.filter(F.abs("cy") <= whole).withColumn("cx", F.explode(F.array_distinct(F.array(F.pmod(own - 1, n), own, F.pmod(own + 1, n)))))
    near = a.join(points.select("point_id", "lat", "lng", *_cell(km)), ["cy", "cx"])
    near = near.withColumn("distance_km", haversine(F.col("a_lat"), F.col("a_lng"), F.col("lat"), F.col("lng"))).filter(F.col("distance_km") <= km)
    w = Window.partitionBy("a_lat", "a_lng").orderBy("distance_km", "point_id")
    return near.select("a_lat", "a_lng", "point_id", "distance_km", F.row_number().over(w).alias("_r")).filter(F.col("_r") <= k).drop("_r")


def drop_near_names(items: DataFrame, known: DataFrame, key: str, name: str, order: str, limit: float = 0.72) -> DataFrame:
    """items whose names aren't near a known name of their key, nor near one kept before them; items without a name go.

    Each key's items must be few, as after a top-k: they are gone through together. known: key and name, as many as there are: an item meets those of its key as rows, most of
    which their lengths and edits rule out before they are compared.
    """
    asked = items.filter(F.col(name).isNotNull()).withColumn("_low", F.lower(name))
    held = known.filter(F.col(name).isNotNull()).select(key, F.lower(name).alias("_known")).distinct()
    pairs = asked.select(key, "_low").distinct().join(held, key).filter(may_match(F.col("_low"), F.col("_known"), limit))
    near = pairs.withColumn("_s", ratio("_low", "_known")).filter(F.col("_s") > limit).select(key, "_low").distinct()
    rest = asked.join(near, [key, "_low"], "left_anti")

    @F.pandas_udf("array<boolean>")
    def greedy(lows: pd.Series, orders: pd.Series) -> pd.Series:
        """Which of each key's names are kept; names come again under many keys, so likenesses are remembered."""
        from difflib import SequenceMatcher
        from functools import lru_cache

        @lru_cache(1 << 16)
        def alike(a: str, b: str) -> bool:
            return SequenceMatcher(None, a, b).ratio() > limit

        out = []
        for names, order in zip(lows, orders):
            seen, keep = [], [False] * len(names)
            for i in sorted(range(len(names)), key=lambda i: (True, 0) if pd.isna(order[i]) else (False, order[i])):
                keep[i] = not any(alike(names[i], x) for x in seen)
                if keep[i]:
                    seen.append(names[i])
            out.append(keep)
        return pd.Series(out, dtype="object")

    lists = rest.groupBy(key).agg(F.collect_list(F.struct("_low", order, F.struct(*items.columns).alias("item"))).alias("x"))
    kept = lists.withColumn("keep", greedy(F.col("x._low"), F.col(f"x.{order}")))
    return kept.select(F.explode(F.filter(F.arrays_zip("x", "keep"), lambda z: z["keep"])).alias("z")).select("z.x.item.*")
