"""Exact nearest vectors without scoring all of them: reference points and the triangle inequality of angles.

Every vector belongs to its nearest reference (one of at most REFERENCES of the vectors, chosen by a hash) and, by its angle to it, to one of
at most RINGS rings around it. Of a ring only the least and the greatest angle and a count are kept, REFERENCES * RINGS rows at most, which go to all tasks. The angle between
a query and any vector of a ring is at least what the two angles to the reference differ by; so a query first visits its nearest rings until
it has k vectors, and then only those rings that can hold anything as near as the k-th of them. Within a ring the same bound holds for each vector.

The result is exact whatever the data; how much is skipped depends on them: vectors in clusters are skipped by whole rings, vectors of no structure in many dimensions hardly at all.
Vectors that are null, empty or zero, or of another length than the references, take no part. Queries meet the vectors by shelves of neighbouring rings, a row a query and shelf, and are
scored SOME at once; rings of over BLOCK vectors, and shelves of over BLOCK queries, are dealt to parts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plansift.operators import blocks
from plansift.sources.shared import cut, discard

REFERENCES, RINGS, BLOCK, SOME = 2048, 16, 4096, 256


def _units(df: DataFrame, key: str, column: str) -> DataFrame:
    """key, v: unit vectors as packed doubles."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            keys, out = [], []
            for k, v in zip(b[key], b[column]):
                if k is None or v is None or not len(v):
                    continue
                x = np.asarray(v, dtype=float)
                norm = np.sqrt((x * x).sum())
                if np.isfinite(norm) and norm > 0:
                    keys.append(k)
                    out.append((x / norm).tobytes())
            yield pd.DataFrame({key: pd.Series(keys, dtype="object"), "v": pd.Series(out, dtype="object")})

    return df.select(key, column).mapInPandas(run, f"{key} {kind}, v binary")


def _rows(column) -> np.ndarray:
    return np.stack([np.frombuffer(v) for v in column])


def _angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1.0, 1.0))


def topk(vectors: DataFrame, queries: DataFrame, k: int, references: int = REFERENCES, rings: int = RINGS, per_reference: int = 256) -> DataFrame:
    """query_id, vec_id, score, rank, n_scored: the k vectors (vec_id, v) of largest cosine to each query (query_id, q), ties to smaller vec_id; n_scored is how many vectors the query was compared to."""
    spark, scratch = vectors.sparkSession, []
    v, q = cut(_units(vectors, "vec_id", "v"), scratch), cut(_units(queries, "query_id", "q"), scratch)
    total = v.count()
    points = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(references, max(1, total // per_reference))).collect()
    if not points:
        return q.select("query_id", F.lit(None).cast(vectors.schema["vec_id"].dataType).alias("vec_id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("n_scored")).limit(0)
    size = len(points[0]["v"])
    ref = _rows([p["v"] for p in points if len(p["v"]) == size])
    kinds = {n: df.schema[n].dataType.simpleString() for df, n in ((v, "vec_id"), (q, "query_id"))}

    def assign(batches):
        for b in batches:
            b = b[b["v"].str.len() == size]
            if len(b):
                angle = _angles(_rows(b["v"]), ref)
                near = angle.argmin(axis=1)
                yield b.assign(ref=near.astype(np.int32), angle=angle[np.arange(len(b)), near])

    placed = cut(v.mapInPandas(assign, f"vec_id {kinds['vec_id']}, v binary, ref int, angle double"), scratch)
    limits = {r["ref"]: r["cuts"] for r in placed.groupBy("ref").agg(F.percentile_approx("angle", [i / rings for i in range(1, rings)], 1000).alias("cuts")).collect()}
    cuts = spark.createDataFrame([(r, c) for r, c in limits.items()], "ref int, cuts array<double>")
    placed = cut(placed.join(F.broadcast(cuts), "ref").withColumn("ring", F.size(F.filter("cuts", lambda c: c < F.col("angle")))).drop("cuts"), scratch)
    of_ring = sorted(tuple(r) for r in placed.groupBy("ref", "ring").agg(F.min("angle"), F.max("angle"), F.count(F.lit(1))).collect())
    at, _, low, high, count = (np.array(c) for c in zip(*of_ring))
    # neighbouring rings lie on a shelf, BLOCK vectors at most; a larger ring has a shelf of several parts to itself
    shelves, held = [], 0
    for n in count.tolist():
        new = not shelves or held + n > BLOCK
        shelves.append(shelves[-1] + new if shelves else 0)
        held = n if new else held + n
    shelf = np.array(shelves)
    laid = spark.createDataFrame([(*r[:2], place, int(shelf[place]), max(1, -(-r[4] // BLOCK))) for place, r in enumerate(of_ring)], "ref int, ring int, place int, shelf int, parts int")
    placed = placed.join(F.broadcast(laid), ["ref", "ring"]).drop("ring").withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts").cast("int"))

    def reach(kth):
        """Up to which angle a vector can be as near as the k-th of those found."""
        return np.where(kth <= -1, np.pi, np.arccos(np.clip(kth, -1.0, 1.0)) + 1e-6)

    def visits(first: bool):
        """The shelves that a query visits: first for the nearest rings, as many as hold k vectors, and then, when its k-th best score so far is known, for all that can be as near."""

        def run(batches):
            for b in batches:
                b, out = b[b["v"].str.len() == size], []
                for begin in range(0, len(b), SOME):
                    some = b.iloc[begin : begin + SOME]
                    theta = _angles(_rows(some["v"]), ref)[:, at]
                    least = np.maximum(0.0, np.maximum(theta - high, low - theta))
                    far = None if first else reach(some["kth"].to_numpy())
                    for i, (key, vec) in enumerate(zip(some["query_id"], some["v"])):
                        if first:
                            most = np.partition(least[i], k - 1)[k - 1] if len(at) > k else np.pi
                            near = np.flatnonzero(least[i] <= most)
                            near = near[np.lexsort((theta[i, near], least[i, near]))]
                            near = near[: int(np.searchsorted(np.cumsum(count[near]), k)) + 1]
                            out += [(key, vec, int(n), near[shelf[near] == n].tolist(), -2.0) for n in np.unique(shelf[near])]
                        else:
                            out += [(key, vec, int(n), None, some["kth"].iloc[i]) for n in np.unique(shelf[least[i] <= far[i]])]
                yield pd.DataFrame(out, columns=["query_id", "v", "shelf", "places", "kth"])

        return run

    asked = f"query_id {kinds['query_id']}, v binary, shelf int, places array<int>, kth double"

    def score(c: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({n: pd.Series([], dtype="object") for n in ("query_id", "vec_id", "score", "n_scored")})]
        if len(c) and len(a):
            c = c.sort_values(["place", "angle"])
            x, angle, ids, places, of = _rows(c["v"]), c["angle"].to_numpy(), c["vec_id"].to_numpy(), c["place"].to_numpy(), c["ref"].to_numpy()
            order = np.unique(ids, return_inverse=True)[1]
        for begin in range(0, len(a) if len(c) else 0, SOME):
            some = a.iloc[begin : begin + SOME]
            y, kth = _rows(some["v"]), some["kth"].to_numpy()
            near, n_scored = np.full((len(some), len(c)), -np.inf), np.zeros(len(some), dtype=np.int64)

            def compare(rows, i: int, j: int) -> None:
                near[rows, i:j] = y[rows] @ x[i:j].T  # noqa: B023
                n_scored[rows] += j - i  # noqa: B023

            listed = some["places"].explode() if some["places"].iloc[0] is not None else None
            if listed is not None:
                ask, place = np.repeat(np.arange(len(some)), some["places"].str.len()), listed.to_numpy().astype(np.int64)
                for p in np.unique(place):
                    i, j = np.searchsorted(places, p, "left"), np.searchsorted(places, p, "right")
                    compare(ask[place == p], i, j)
            else:
                far = reach(kth)
                for r in np.unique(of):
                    s, e = np.searchsorted(of, r, "left"), np.searchsorted(of, r, "right")
                    # a vector's own angle tells whether it can be near enough
                    theta = _angles(y, ref[r : r + 1])[:, 0]
                    i, j = s + np.searchsorted(angle[s:e], theta - far, "left"), s + np.searchsorted(angle[s:e], theta + far, "right")
                    go = np.flatnonzero(i < j)
                    if len(go) and (j[go].max() - i[go].min()) * len(go) <= 1.2 * (j - i)[go].sum():
                        compare(go, i[go].min(), j[go].max())
                        continue
                    for g in go:
                        compare(np.array([g]), i[g], j[g])
            rows, columns, s = blocks.k_best(near, lambda i, j: (x[j] * y[i]).sum(axis=1), order, k, kth)  # noqa: B023
            keys = some["query_id"].to_numpy()
            found.append(pd.DataFrame({"query_id": keys[rows], "vec_id": pd.Series(ids[columns], dtype="object"), "score": s, "n_scored": 0}))
            found.append(pd.DataFrame({"query_id": keys, "vec_id": None, "score": None, "n_scored": n_scored}))
        return pd.concat(found[1:] or found)

    def meet(asks: DataFrame) -> DataFrame:
        """The k best that a query finds on each shelf, and rows without a vector that tell how many it was compared to."""
        asks = cut(asks, scratch)
        # a row a shelf at most
        shares = asks.groupBy("shelf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("shares"))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        c = placed.join(F.broadcast(shares), "shelf").withColumn("share", every("shares"))
        a = asks.join(F.broadcast(shares), "shelf").join(F.broadcast(laid.select("shelf", "parts").distinct()), "shelf").withColumn("share", F.pmod(F.xxhash64("query_id"), "shares").cast("int")).withColumn("part", every("parts"))
        by = ["shelf", "part", "share"]
        return c.select(*by, "vec_id", "v", "angle", "ref", "place").groupBy(*by).cogroup(a.select(*by, "query_id", "v", "places", "kth").groupBy(*by)).applyInPandas(score, f"query_id {kinds['query_id']}, vec_id {kinds['vec_id']}, score double, n_scored long")

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = lambda met: met.filter("vec_id is not null").drop("n_scored").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    begun = cut(meet(q.mapInPandas(visits(True), asked)), scratch)
    kth = best(begun).filter(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    bounded = q.join(kth, "query_id", "left").withColumn("kth", F.coalesce("kth", F.lit(-2.0)))
    # nothing that is as near as the k-th of the first is left out, the first among them
    rest = cut(meet(bounded.mapInPandas(visits(False), asked)))
    scored = cut(begun.unionByName(rest).groupBy("query_id").agg(F.sum("n_scored").alias("n_scored")))
    discard(spark, scratch)
    return best(rest).join(scored, "query_id")
