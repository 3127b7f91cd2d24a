"""Approximate nearest neighbours by cross-polytope hashing.

A unit vector is turned by a pseudo-rotation (three rounds of random signs and a fast Hadamard transform)
and goes to the nearest signed axis. A bucket is the answers of several rotations together: as many as it takes for the buckets of a table to
hold about FILL vectors each, so that for n vectors of width d (the next power of two) there are

    2 ** max(log2(2 d), ceil(log2(n / FILL)))

buckets a table. All rotations but the last choose among 2 d axes, the last among as many as are left to choose. Each of TABLES tables has rotations of its own, and
a query looks into those joint buckets that its vector comes nearest to: each rotation's axes are ranked by how far they lie behind the nearest one (the squared
difference of the coordinates), and of all combinations those of the least sum are taken. How many follows from n, too: a query compares itself to about

    share(n) = min(1, SHARE * n ** -FALL)

of all vectors, so the work of a query grows like n to the power of 1 - FALL. With more vectors the nearest ones are nearer and are met by fewer
probes. Candidates are ranked by their exact cosine in double precision. On random vectors of 64 numbers, the hardest case, the share of true
neighbours met and of vectors compared was measured for 2,000 to 615,384 vectors (see the README); clustered vectors are met sooner.

The buckets a query looks into are never listed before it meets the vectors: what travels is the cost of the last of them in each table. A table's buckets lie in ranges
of about HELD bytes of vectors; a query comes to each range once, and there its buckets are found, a rotation at a time, by leaving out what costs too much already.
Vectors travel once a table, as a byte a number with a bound for how far that is off; of what a query meets in a range, all that may be among its k + 1 nearest by those bounds goes on, and
the exact cosine of what is left of all ranges comes from the whole vectors. Where a byte a number can't tell a crowd of vectors apart, these are sent whole to those who ask there. Equal vectors are hashed once; each keeps its k + 1 least ids, which is as many as an answer can hold.
Where much more than that lies in a range, vectors or queries are dealt to blocks, so that no task holds a
whole hot bucket. A query for which fewer than k others turn up is answered by an exact search in blocks.

Vectors that are null, empty, zero, or hold a null or a number that isn't finite take no part, nor do rows
without an id. Vectors of different lengths are no candidates of each other. Repeated rows count once. An empty table, or one without queries, gives no rows.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plansift.llm.common import cut, discard, slices, small

TABLES, FILL, SHARE, FALL, DENSE = 6, 1, 6.3, 0.35, 512
#: Bytes of the vectors of a range of a table's buckets, how many ranges there are at least, how many buckets and costs stand in memory at a time, and of how many
#: vectors of a range a query hears by their codes; where those can't tell more than that apart, whole vectors can
HELD, RANGES, CELLS, COSTS, CROWD = 1 << 25, 4, 1 << 20, 1 << 16, 256


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the normalised Hadamard matrix; their length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def _signs(y: np.ndarray, turn: int, seed: int) -> np.ndarray:
    width = y.shape[1]
    rng = np.random.RandomState([seed, turn, width])
    for _ in range(3):
        y = hadamard(y * rng.choice([-1.0, 1.0], width))
    return y


@functools.lru_cache(64)
def _matrix(turn: int, width: int, seed: int) -> np.ndarray:
    return _signs(np.eye(width), turn, seed)


def turned(x: np.ndarray, turn: int, seed: int = 7) -> np.ndarray:
    """Unit rows after the pseudo-rotation of that number. Up to DENSE numbers wide, all three rounds are worked out once, as one matrix."""
    width = 1 << max(0, int(x.shape[1] - 1).bit_length())
    if width <= DENSE:
        return x @ _matrix(turn, width, seed)[: x.shape[1]]
    y = np.zeros((len(x), width))
    y[:, : x.shape[1]] = x
    return _signs(y, turn, seed)


def choices(n: int, numbers: int, fill: int = FILL) -> list[int]:
    """Among how many signed axes each rotation of a table chooses, for n vectors of that many numbers."""
    most = 2 << max(0, int(numbers - 1).bit_length())
    bits = max(0, math.ceil(math.log2(max(1, n) / fill)))
    out = [most]
    bits -= most.bit_length() - 1
    while bits > 0:
        step = min(bits, most.bit_length() - 1)
        out.append(1 << step)
        bits -= step
    return out


def probes(n: int, numbers: int, tables: int = TABLES, share: float = SHARE, fall: float = FALL) -> int:
    """How many buckets of each table a query looks into."""
    part = min(1.0, share * max(1, n) ** -fall)
    return max(1, math.ceil(part * math.prod(choices(n, numbers)) / tables))


def _axes(x: np.ndarray, table: int, sizes: list[int]):
    """For each rotation of a table the coordinates along its signed axes."""
    for r, size in enumerate(sizes):
        y = turned(x, 1000 * table + r)[:, : size // 2]
        yield np.concatenate([y, -y], axis=1)


def own_bucket(x: np.ndarray, table: int, sizes: list[int]) -> np.ndarray:
    """The bucket of each row."""
    out = np.zeros(len(x), np.int64)
    for z in _axes(x, table, sizes):
        out = out * z.shape[1] + z.argmax(axis=1)
    return out


def _behind(x: np.ndarray, table: int, sizes: list[int]) -> list[np.ndarray]:
    """For each rotation of a table how far each row's axes lie behind the nearest one."""
    return [(z.max(axis=1, keepdims=True) - z) ** 2 for z in _axes(x, table, sizes)]


def limits(behind: list[np.ndarray], count: int) -> np.ndarray:
    """For each row the cost of the bucket that is the count-th nearest, and a little more, as elsewhere a product's last digits may come out otherwise."""
    count = min(count, math.prod(z.shape[1] for z in behind))
    return np.array([_limit([np.sort(z) for z in row], count) for row in zip(*behind)]) * (1 + 1e-9)


def _limit(lists: list[np.ndarray], count: int) -> float:
    """The count-th least of all sums of a number from each sorted list; all lists begin with 0."""
    *front, last = lists
    best = front[0] if front else np.zeros(1)
    for z in front[1:]:
        # of two sorted lists the i-th and j-th, from 1, need not be summed up where i * j is over count
        if len(best) * len(z) > 4 * count:
            best = np.sort(best)
            sums = np.concatenate([best[: count // (j + 1)] + z[j] for j in range(min(len(z), count))])
        else:
            sums = np.add.outer(best, z).ravel()
        best = np.partition(sums, count - 1)[:count] if len(sums) > 4 * count else sums
    many = count // 4 + 64
    while True:
        some = np.sort(np.partition(best, many - 1)[:many] if many < len(best) else best)
        if len(some) * len(last) >= count:
            limit = _nth(some, last, count)
            if len(some) == len(best) or limit <= some[-1]:
                return limit
        many *= 2


def _nth(a: np.ndarray, b: np.ndarray, count: int) -> float:
    """The count-th least of all sums of a number from a and one from b, both sorted and not below 0."""
    low, high = -1.0, float(a[-1] + b[-1]) * 1.001 + 1e-9
    under, over = np.zeros(len(b), np.int64), np.full(len(b), len(a))
    for _ in range(60):
        if (over - under).sum() <= 256:
            break
        mid = (low + high) / 2
        at = np.searchsorted(a, mid - b, "right")
        if at.sum() >= count:
            high, over = mid, at
        else:
            low, under = mid, at
    between = np.concatenate([a[i:j] + x for i, j, x in zip(under.tolist(), over.tolist(), b) if i < j])
    at = count - int(under.sum()) - 1
    return float(np.partition(between, at)[at])


def within(behind: list[np.ndarray], most: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, bucket, cost of all buckets from low to below high that cost a row no more than most has for it; by row, then bucket."""
    rest = math.prod(z.shape[1] for z in behind)
    row, name, cost = np.arange(len(most)), np.zeros(len(most), np.int64), np.zeros(len(most))
    for z in behind:
        size = z.shape[1]
        rest //= size
        first, last = low // rest, (high - 1) // rest
        # where all that is left has one name, as before the first rotation, other axes need not be looked at
        begin, end = (first, last + 1) if rest * size >= high else (0, size)
        step = max(1, COSTS // (end - begin))
        found = []
        for i in range(0, len(row), step):
            of = row[i : i + step]
            c = cost[i : i + step, None] + z[of, begin:end]
            at = np.flatnonzero(c <= most[of, None])
            of, axis = np.divmod(at, end - begin)
            names, c, of = name[i + of] * size + (begin + axis), c.ravel()[at], row[i + of]
            if end - begin == size:
                inside = (names >= first) & (names <= last)
                of, names, c = of[inside], names[inside], c[inside]
            found.append((of, names, c))
        row, name, cost = map(np.concatenate, zip(*found)) if found else (row, name, cost)
    return row, name, cost


def near_buckets(x: np.ndarray, table: int, sizes: list[int], count: int) -> np.ndarray:
    """The buckets that each row comes nearest to, the nearest first."""
    behind = _behind(x, table, sizes)
    row, bucket, cost = within(behind, limits(behind, count), 0, math.prod(sizes))
    order = np.lexsort((bucket, cost, row))
    begins = np.searchsorted(row[order], np.arange(len(x)))
    return bucket[order[begins[:, None] + np.arange(count)]]


def _packed(df: DataFrame, four: bool) -> DataFrame:
    """vec_id, v: the sound vectors' numbers as bytes, 4 each if they are floats, else 8; -0.0 as 0.0."""

    def run(batches):
        for b in (part for batch in batches for part in slices(batch)):
            b = b.filter(pc.and_(b.column(0).is_valid(), pc.fill_null(pc.greater(pc.list_value_length(b.column(1)), 0), False)))
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32 if four else np.float64, copy=False) + 0  # a null becomes nan
            ends = np.cumsum(pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False), dtype=np.int64)
            begins = np.append(0, ends[:-1])
            sound = np.logical_and.reduceat(np.isfinite(x), begins) & np.logical_or.reduceat(x != 0, begins)
            v = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer((np.append(0, ends) * x.itemsize).astype(np.int32)), pa.py_buffer(x)])
            yield pa.RecordBatch.from_arrays([b.column(0), v], ["vec_id", "v"]).filter(pa.array(sound))

    return df.mapInArrow(run, "vec_id long, v binary")


def _matrix_of(v: pa.Array, kind: str) -> np.ndarray:
    """The rows of a column of bytes of one length."""
    of = np.frombuffer(v.buffers()[1], np.int64 if pa.types.is_large_binary(v.type) else np.int32)
    return np.frombuffer(v.buffers()[2], np.uint8)[of[v.offset] : of[v.offset + len(v)]].view(kind).reshape(len(v), -1)


def _even(x: np.ndarray) -> np.ndarray:
    """Each row times a power of two, so that no square is too large or too small; this rounds nothing."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _even(x)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _by_size(batches, kind: str):
    """size, key, v, unit rows: few rows of an Arrow batch (key, v) at a time, of one length."""
    for batch in batches:
        for part in slices(batch) if batch.num_rows else ():
            sizes = pc.binary_length(part.column(1)).to_numpy()
            for size in np.unique(sizes):
                some = part.filter(pa.array(sizes == size))
                yield int(size), some.column(0), some.column(1), _unit(_matrix_of(some.column(1), kind).astype(float))


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))


def _batch(schema: str, *columns) -> pa.RecordBatch:
    """Columns of the schema's types, with its names."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], [field.split()[0] for field in schema.split(", ")])


def _coded(df: DataFrame, tables: int, n: int, kind: str, held: int) -> DataFrame:
    """size, wide, key, codes, scale, off, buckets: the unit vector as bytes that times scale are off by no more than off in any direction, its bucket in each table, and how many of those make a range. n: how many vectors there are."""
    width, schema = np.dtype(kind).itemsize, "size int, wide long, key long, codes binary, scale float, off float, buckets array<long>"

    def run(batches):
        for size, key, _, x in _by_size(batches, kind):
            sizes = choices(n, size // width)
            scale = (np.abs(x).max(axis=1) / 127).astype(np.float32)
            codes = np.rint(x / scale[:, None]).astype(np.int8)
            # besides, what single precision rounds in a sum of so many products
            off = np.sqrt(((x - codes * scale[:, None].astype(float)) ** 2).sum(1)) * 1.001 + 2e-7 * (x.shape[1] + 8)
            flat = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(0, codes.size + 1, x.shape[1], dtype=np.int32)), pa.py_buffer(codes)])
            yield _batch(schema, np.full(len(x), size, np.int32), np.full(len(x), _wide(sizes, n, size, held)), key, flat, scale, off.astype(np.float32), _lists(np.stack([own_bucket(x, t, sizes) for t in range(tables)], axis=1)))

    return df.select("key", "v").mapInArrow(run, schema)


def _limited(df: DataFrame, tables: int, n: int, kind: str, held: int, share: float) -> DataFrame:
    """size, ranges, key, v, most: up to which cost a query looks into the buckets of each table, and in how many ranges those lie."""
    width, schema = np.dtype(kind).itemsize, "size int, ranges int, key long, v binary, most array<double>"

    def run(batches):
        for size, key, v, x in _by_size(batches, kind):
            sizes = choices(n, size // width)
            count = probes(n, size // width, tables, share)
            most = np.stack([limits(_behind(x, t, sizes), count) for t in range(tables)], axis=1)
            yield _batch(schema, np.full(len(x), size, np.int32), np.full(len(x), _ranges(n, size, held), np.int32), key, v, _lists(most))

    return df.select("key", "v").mapInArrow(run, schema)


def _ranges(n: int, size: int, held: int) -> int:
    """In how many ranges the buckets of a table lie, for n vectors of so many bytes."""
    return max(RANGES, -(-n * size // held))


def _wide(sizes: list[int], n: int, size: int, held: int) -> int:
    """How many buckets make a range."""
    return -(-math.prod(sizes) // _ranges(n, size, held))


def _blocks(n: Column, held: int) -> Column:
    """Where over twice as many bytes as planned lie together they are dealt to blocks."""
    return F.greatest(F.lit(1), F.ceil(n * F.col("size") / (2 * held))).cast("long")


def _met(cands: DataFrame, asks: DataFrame, groups: DataFrame, n: int, k: int, kind: str, held: int, scratch: list[str]) -> DataFrame:
    """ask, key: what may be among the k + 1 nearest that each query meets, and all equal to the last. cands: size, tab, part, key, bucket, codes, scale, off; asks: size, tab, part, key, v, most."""
    rows = cut(_bounded(cands, asks, n, k, kind, held, False, scratch), scratch)
    pairs, crowds, at = rows.filter("tab is null").select("ask", "key"), rows.filter("tab is not null"), ["size", "tab", "part"]
    if crowds.isEmpty():
        return pairs
    # where a byte a number can't tell many vectors apart, those who ask there meet them whole
    there = crowds.filter("key is not null").select(*at, "key")
    asks = asks.join(small(crowds.filter("key is null").select(*at, F.col("ask").alias("key"))), [*at, "key"], "left_semi")
    whole = groups.join(small(there.select("key").distinct()), "key", "left_semi").select("key", F.col("v").alias("codes"))
    cands = cands.drop("codes").join(small(there), [*at, "key"], "left_semi").join(whole, "key")
    return cut(pairs.unionByName(_bounded(cands, asks, n, k, kind, held, True, scratch).select("ask", "key")).distinct(), scratch)


def _bounded(cands: DataFrame, asks: DataFrame, n: int, k: int, kind: str, held: int, exact: bool, scratch: list[str]) -> DataFrame:
    """ask, key, and nulls; where too many may be among the nearest for codes to tell, also ask, null, size, tab, part, and each of those too many as key, key, size, tab, part. exact: codes are the vectors' own bytes."""
    width, at = np.dtype(kind).itemsize, ["size", "tab", "part"]
    # only those of several blocks need a row; a block is a whole one but for the last
    there = cands.groupBy(*at).agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("m"))
    asked = asks.groupBy(*at).agg(F.lit(0).cast("long").alias("n"), F.count(F.lit(1)).alias("m"))
    full = there.unionByName(asked).groupBy(*at).agg(_blocks(F.sum("n"), held).alias("blocks"), _blocks(F.sum("m"), held).alias("shares")).filter("blocks > 1 or shares > 1")
    full = small(cut(full, scratch))
    dealt = lambda df: df.join(full, at, "left").withColumns({"blocks": F.coalesce("blocks", F.lit(1)), "shares": F.coalesce("shares", F.lit(1))})
    every = lambda name: F.explode(F.sequence(F.lit(0).cast("long"), F.col(name).cast("long") - 1))
    c = dealt(cands).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks"))).withColumn("share", every("shares"))
    a = dealt(asks).withColumn("share", F.pmod(F.xxhash64("key"), F.col("shares"))).withColumn("block", every("blocks"))
    at = [*at, "block", "share"]
    schema = "ask long, key long, low double, high double, size int, tab int, part int"

    def meet(group, c, a):
        size, tab, part = (x.as_py() for x in group[:3])
        done, dense, given = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))], [], 0
        crowd = np.zeros(len(c), bool)
        if len(c) and len(a):
            c, a = c.combine_chunks(), a.combine_chunks()
            order = np.argsort(c["bucket"].to_numpy(), kind="stable")
            bucket, key, scale, off = (c[x].to_numpy()[order] for x in ("bucket", "key", "scale", "off"))
            codes = _matrix_of(c["codes"].chunk(0), kind if exact else "i1")[order]
            if exact:
                codes = codes if width == 4 else _even(codes)
                scale, off = 1 / np.sqrt(np.einsum("ij,ij->i", codes, codes, dtype=float)), np.full(len(key), 1e-12)
            sizes = choices(n, size // width)
            low = part * _wide(sizes, n, size, held)
            high = min(low + _wide(sizes, n, size, held), math.prod(sizes))
            start = np.searchsorted(bucket, np.arange(low, high + 1))
            y, ask, most = _matrix_of(a["v"].chunk(0), kind), a["key"].to_numpy(), a["most"].to_numpy()
            real, rows, step = float if exact else np.float32, max(1, CELLS // codes.shape[1]), max(1, CELLS // probes(n, size // width))
            for i in range(0, len(y), step):
                few, found = _unit(y[i : i + step].astype(float)), []
                asking = few.astype(real)
                if tab >= 0:
                    row, near, _ = within(_behind(few, tab, sizes), most[i : i + step], low, high)
                    near -= low
                    begins, many = start[near], start[near + 1] - start[near]
                    of = np.searchsorted(row, np.arange(len(few) + 1))
                for j in range(len(few)):
                    if tab >= 0:
                        m = many[of[j] : of[j + 1]]
                        ends = np.cumsum(m)
                        if not len(m) or not ends[-1]:
                            continue
                        some = np.repeat(begins[of[j] : of[j + 1]] - ends + m, m) + np.arange(ends[-1])
                    else:
                        some = np.arange(len(key))
                    about = np.concatenate([codes.take(some[b : b + rows], axis=0).astype(real) @ asking[j] for b in range(0, len(some), rows)]) * scale[some]
                    under, over, last = about - off[some], about + off[some], max(0, len(some) - 1 - k)
                    best = np.flatnonzero(over >= np.partition(under, last)[last])
                    if not exact and (len(best) > CROWD or len(best) > 8 * (k + 1) and given + len(best) > 4 * (k + 1) * (i + j + 1) + 1000):
                        dense.append(ask[i + j])
                        crowd[some[best]] = True
                        best = np.argpartition(under, last)[last:]
                    given += len(best)
                    found.append((np.full(len(best), ask[i + j]), key[some[best]], under[best].astype(float), over[best].astype(float)))
                if found:
                    done.append(tuple(map(np.concatenate, zip(*found))))
        columns, none = list(map(np.concatenate, zip(*done))), pa.nulls(sum(len(x[0]) for x in done), pa.int32())
        many = key[crowd] if crowd.any() else np.zeros(0, np.int64)
        told, of = np.concatenate([np.array(dense, np.int64), many]), pa.concat_arrays([pa.nulls(len(dense), pa.int64()), pa.array(many)])
        far, here = np.full(len(told), np.inf), (np.full(len(told), x, np.int32) for x in (size, tab, part))
        return pa.Table.from_batches([_batch(schema, *columns, none, none, none), _batch(schema, told, of, -far, far, *here)])

    met = c.select(*at, "key", "bucket", "codes", "scale", "off").groupBy(*at).cogroup(a.select(*at, "key", "v", "most").groupBy(*at)).applyInArrow(meet, schema)
    met = met.repartition("ask").groupBy("ask", "key", "size", "tab", "part").agg(F.max("low").alias("low"), F.min("high").alias("high"))
    best = Window.partitionBy("ask")
    met = met.withColumn("r", F.row_number().over(best.orderBy(F.desc("low")))).withColumn("least", F.max(F.when(F.col("r") == k + 1, F.col("low"))).over(best))
    return met.filter("least is null or high >= least").select("ask", "key", "size", "tab", "part")


def _scored(pairs: DataFrame, groups: DataFrame, asks: DataFrame, kind: str) -> DataFrame:
    """ask, key, ids, score: the exact cosine."""

    def run(batches):
        for batch in batches:
            for part in slices(batch) if batch.num_rows else ():
                sizes = pc.binary_length(part["v"]).to_numpy()
                for size in np.unique(sizes):
                    some = part.filter(pa.array(sizes == size))
                    x, y = (_even(_matrix_of(some[c], kind).astype(float)) for c in ("v", "y"))
                    score = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
                    yield pa.RecordBatch.from_arrays([some["ask"], some["key"], some["ids"], pa.array(score)], ["ask", "key", "ids", "score"])

    rows = groups.join(small(pairs), "key").join(asks.select(F.col("key").alias("ask"), F.col("v").alias("y")), "ask")
    return rows.select("ask", "key", "ids", "v", "y").mapInArrow(run, "ask long, key long, ids array<long>, score double")


def nearest(df: DataFrame, query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, share: float = SHARE, held: int = HELD) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each row that query (a condition on vec_id) holds for. share: see SHARE; the more, the more neighbours are met. held: see HELD; it changes no result."""
    scratch: list[str] = []
    four = df.schema[vector_col].dataType.simpleString() == "array<float>"
    kind = "<f4" if four else "<f8"
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), (F.col(vector_col) if four else F.col(vector_col).cast("array<double>")).alias("v"))
    few = Window.partitionBy("v").orderBy("vec_id")
    own = _packed(rows, four).withColumn("r", F.dense_rank().over(few)).filter(F.col("r") <= k + 1)
    groups = cut(own.groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")).withColumn("key", F.xxhash64("v")), scratch)
    n = groups.count()
    asked = cut(_packed(rows.filter(query), four).distinct().select(F.xxhash64("v").alias("key"), F.col("vec_id").alias("query_id"), "v"), scratch)
    askers = cut(asked.select("key", "query_id"))
    parts = max(1, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), asked.count() // 64))
    asks = cut(_limited(asked.dropDuplicates(["key"]).repartition(parts), tables, n, kind, held, share), scratch)
    coded = cut(_coded(groups, tables, n, kind, held), scratch)
    cands = coded.select("size", "wide", "key", F.posexplode("buckets").alias("tab", "bucket"), "codes", "scale", "off").withColumn("part", F.expr("cast(bucket div wide as int)"))
    looks = asks.select("size", "ranges", "key", "v", F.posexplode("most").alias("tab", "most")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("ranges") - 1)))
    found = cut(_answers(_scored(_met(cands, looks, groups, n, k, kind, held, scratch), groups, asks, kind), k))
    # queries that met too few vectors, unless there are no more
    short = askers.select("key").distinct().join(found.filter(F.size("near") > k).select(F.col("ask").alias("key")), "key", "left_anti")
    short = cut(short, scratch)
    if not short.isEmpty():
        whole = {"tab": F.lit(-1), "part": F.lit(0)}
        every = coded.withColumns(whole | {"bucket": F.lit(0).cast("long")})
        rest = _met(every, asks.join(short, "key", "left_semi").withColumns(whole | {"most": F.lit(0.0)}), groups, n, k, kind, held, scratch)
        rest = cut(_answers(_scored(rest, groups, asks, kind), k))
        found = found.join(small(cut(short.withColumnRenamed("key", "ask"))), "ask", "left_anti").unionByName(rest)
    discard(df.sparkSession, scratch)
    near = askers.join(found.withColumnRenamed("ask", "key"), "key")
    near = near.withColumn("near", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k))
    near = near.select("query_id", F.posexplode("near").alias("at", "x"))
    return near.select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score")


def _answers(scored: DataFrame, k: int) -> DataFrame:
    """ask, near: the nearest rows, copies written out, as an array of (vec_id, score), k + 1 at most."""
    # all rows of the k + 1 best scores: of vectors with one score those with the least ids count
    kept = scored.withColumn("r", F.rank().over(Window.partitionBy("ask").orderBy(F.desc("score")))).filter(F.col("r") <= k + 1)
    rows = kept.select("ask", F.explode("ids").alias("vec_id"), "score")
    first = Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id")
    rows = rows.dropDuplicates(["ask", "vec_id"]).withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1)
    return rows.groupBy("ask").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))), lambda x: F.struct(x["vec_id"].alias("vec_id"), x["score"].alias("score"))).alias("near"))
