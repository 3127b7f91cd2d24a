"""Exact Jaccard join of documents' word shingles, by partition of the token universe.

Words are cut at ASCII white space after A-Z became a-z; a document's set holds its distinct shingles of
WIDTH words (the whole sequence, if it has fewer words) as 64-bit hashes. Equal sets form a class; all that
follows is about classes. Two sets link if 100 |a and b| >= 80 |a or b|: then their difference is at
most (|a| + |b|) / 9.

Sets fall into bands of size. For each band the token universe is hashed into segments, and a set's
part of a segment, as a whole, is a signature. A segment is allotted either coverage 1 (the part
must be equal) or 2 (it may differ by one token: the part and its one-deletion neighbours are
signatures); which, is a matter of cost: the number of signatures and the chance that a few common
tokens fill a part. Were a linking pair to agree in no segment, its difference would reach the sum of the coverage: so a
pair of which one set has enough coverage agrees somewhere. Empty parts give no signature and no
coverage; a set that is left with too little for some partner adds its empty parts too. What coverage a set has to
spare for all partners that aren't larger lets it skip its most frequent signatures. A set larger than its band's partners also looks
into the next lower bands that can hold partners.

Signatures meet in Spark groups of bounded size, as packed arrays. Those that several classes hold are kept. Within
such a bucket only pairs of different components matter, as the result is components: a few rounds test each member
against a random pivot of its bucket, which joins groups of near copies in linear work; what
then still lies in one bucket and in several components is tested pair by pair, in large buckets within
blocks of bounded size, so that the pairs are never rows. Every test is the exact intersection of the two sets.

A text is held whole in its task, as are the sets of two that are tested. Nulls and blank texts have an empty set and link with nothing; an empty table gives no rows. Rows of one id, and of none, count as documents of
their own. A component's id is its least doc_id (null if it has none but null ids).
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plansift.llm.common import cut, discard, map_rows, small, text_or_empty

WIDTH, RATIO, COMMON, GROUP, FLUSH, PIVOTS, SMALL, BLOCK, WHOLE = 5, 1.6, 0.2, 1_000_000, 750_000, 3, 8, 512, 8192

_U = np.uint64
_MULTIPLIERS = [_U(int.from_bytes(xxhash.xxh64_digest(f"place {k}".encode()), "big") | 1) for k in range(64)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Words(dict):
    """word -> its hash; begins anew when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


class Shingler:
    def __init__(self, width: int = WIDTH):
        self.width, self.known = width, _Words()

    def set_of(self, text: str) -> np.ndarray:
        """The sorted distinct shingle hashes of a text."""
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, _U)
        known = self.known
        h = np.array([known[w] for w in words], dtype=_U)
        k = min(self.width, len(h))
        n = len(h) - k + 1
        with np.errstate(over="ignore"):
            total = np.full(n, k, _U)
            for j in range(k):
                total += h[j : j + n] * _MULTIPLIERS[j]
            return np.unique(_mix(total))


def class_of(s: np.ndarray) -> int:
    """The 64-bit name of a set."""
    return int.from_bytes(xxhash.xxh64_digest(s.tobytes()), "big", signed=True)


class Bands:
    """Bands of set sizes, their segments and what coverage sets need in them."""

    def __init__(self, ratio: float = RATIO, common: float = COMMON):
        self.low, self.ratio, self.common = [1], ratio, common
        self.plan: dict[int, tuple[int, int]] = {}

    def of(self, n: int) -> int:
        while self.low[-1] <= n:
            self.low.append(max(self.low[-1] + 1, int(self.low[-1] * self.ratio)))
        lo, hi = 0, len(self.low) - 1
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self.low[mid] <= n else (lo, mid)
        return lo

    def top(self, band: int) -> int:
        """The largest size of a band."""
        return self.low[band + 1] - 1

    def need(self, n: int, band: int) -> int:
        """The coverage that a set of n tokens needs to meet any partner of the band that isn't larger."""
        return (n + min(n, self.top(band))) // 9 + 1

    def schemes(self, n: int) -> list[int]:
        """The set's own band, then lower ones that hold sizes of 0.8 n or more."""
        own = self.of(n)
        found = [own]
        while found[-1] > 0 and self.top(found[-1] - 1) * 5 >= 4 * n:
            found.append(found[-1] - 1)
        return found

    def segments(self, band: int) -> tuple[int, int]:
        """(segments of coverage 2, segments in all) of a band: the cheapest that give what its largest sets need and a tenth to spare."""
        if band not in self.plan:
            size, top = self.low[band], self.top(band)
            need = self.need(top * 5 // 4, band)
            want = need + math.ceil(need / 10) + (need > 1)
            best = None
            for two in range(want // 2 + want % 2 + 1):
                one = max(0, want - 2 * two)
                c = size / max(1, one + two)
                share = math.exp(-c * (1 - self.common))
                cost = one * (1 + 8 * share) + two * (c + 1) * (1 + 8 * math.exp(-max(0.0, c - 1) * (1 - self.common)))
                if best is None or cost < best[0]:
                    best = cost, two, one + two
            self.plan[band] = best[1:] if need > 1 else (0, 0)
        return self.plan[band]

    def signatures(self, s: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(signatures, whether each may be skipped, coverage to spare) of a set in a band's scheme."""
        two, m = self.segments(band)
        if not m:
            return np.zeros(0, _U), np.zeros(0, bool), 0
        with np.errstate(over="ignore"):
            seg = (((s >> _U(32)) * _U(m)) >> _U(32)).astype(np.int64)  # sets are sorted, so segments are too
            starts = np.flatnonzero(np.diff(seg, prepend=-1))
            held = seg[starts]
            count = np.diff(starts, append=len(s))
            part = _mix(s * _U(0x9E3779B97F4A7C15) + _U(band))
            total = np.add.reduceat(part, starts)
            name = _mix(np.arange(m, dtype=_U) + _U(band << 32)) | _U(1)
            out, free = [_mix(total * name[held] + name[held])], [held >= two]
            coverage = int(np.where(held < two, np.minimum(count, 2), 1).sum())
            if two:
                owner = np.repeat(np.arange(len(starts)), count)
                near = (held[owner] < two) & (count[owner] > 1)
                less, of = (total[owner] - part)[near], held[owner][near]
                out.append(_mix(less * name[of] + name[of]))
                free.append(np.zeros(len(less), bool))
            spare = coverage - self.need(len(s), band)
            # in its own band it also meets larger sets, up to 5 / 4 of its size
            if coverage < (self.need(len(s), band) if self.of(len(s)) != band else (len(s) + len(s) * 5 // 4) // 9 + 1):
                empty = np.setdiff1d(np.arange(m), held)
                single = held[(held < two) & (count == 1)]
                bare = np.concatenate([empty, single])
                out.append(_mix(name[bare]))
                free.append(np.zeros(len(bare), bool))
        return np.concatenate(out), np.concatenate(free), max(0, spare)


def sets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n (size of its set), class (null for an empty set)."""

    def run(batches):
        shingler = Shingler()
        for rows in batches:
            out = []
            for k, h, text in rows:
                s = shingler.set_of(text)
                out.append((k, h, len(s), class_of(s) if len(s) else None))
            yield out

    text = text_or_empty(text_col)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return map_rows(rows, run, "doc_id long, text_hash long, n long, class long")


_HEAD = np.dtype([("class", "<i8"), ("n", "<i4"), ("spare", "<u2", 2), ("count", "<u4")])


def _packed(df: DataFrame, text_col: str, groups: int) -> DataFrame:
    """(p, head, sigs): all signatures, dealt to groups by value. head has one _HEAD a class, sigs 6 bytes a signature in the order of head.

    Of a signature's 48 bits the lowest tells whether it may be skipped, the next whether it is of a band below its set's own.
    A partition sends a class once.
    """

    def run(batches):
        shingler, bands, seen = Shingler(), Bands(), set()
        heads, sigs, owner, held = [], [], [], 0

        def flush():
            nonlocal heads, sigs, owner, held
            if not sigs:
                return []
            sig, who = np.concatenate(sigs), np.repeat(np.arange(len(heads)), owner)
            p = ((sig >> _U(32)) * _U(groups) >> _U(32)).astype(np.int64)
            order = np.lexsort((who, p))
            sig, who, p = sig[order], who[order], p[order]
            head = np.array(heads, _HEAD)
            out = []
            edges = np.flatnonzero(np.diff(p, prepend=-1, append=groups + 1))
            for a, b in zip(edges, edges[1:]):
                ids, count = np.unique(who[a:b], return_counts=True)
                h = head[ids]
                h["count"] = count
                six = np.ascontiguousarray(sig[a:b] & _U(0xFFFFFFFFFFFF)).view(np.uint8).reshape(-1, 8)[:, :6]
                out.append((int(p[a]), h.tobytes(), six.tobytes()))
            heads, sigs, owner, held = [], [], [], 0
            return out

        for rows in batches:
            for (text,) in rows:
                s = shingler.set_of(text)
                if len(s) < 4:  # such sets link with equal ones alone
                    continue
                k = class_of(s)
                if k in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(k)
                spares, mine = [0, 65535], []
                for j, band in enumerate(bands.schemes(len(s))):
                    sig, free, spare = bands.signatures(s, band)
                    spares[j > 0] = min(spares[1], spare) if j else min(spare, 65535)
                    mine.append((sig & ~_U(3)) | free.astype(_U) | _U(2 * (j > 0)))
                sig = np.concatenate(mine)
                if not len(sig):
                    continue
                heads.append((k, len(s), tuple(spares), 0))
                sigs.append(sig)
                owner.append(len(sig))
                held += len(sig)
                if held >= FLUSH:
                    yield flush()
        yield flush()

    return map_rows(df.select(text_or_empty(text_col).alias("text")), run, "p long, head binary, sigs binary")


_BUCKETS = "bucket long, class long, n long, size long, free boolean, below boolean, spare int"


def _buckets(pdf):
    """The signatures of a group that several classes hold."""
    import pandas as pd

    head = np.concatenate([np.frombuffer(h, _HEAD) for h in pdf["head"]])
    raw = np.frombuffer(b"".join(pdf.sigs), np.uint8).reshape(-1, 6)
    sig = np.zeros((len(raw), 8), np.uint8)
    sig[:, :6] = raw
    sig = sig.view("<u8").ravel()
    who = np.repeat(np.arange(len(head)), head["count"])
    value = sig >> _U(2)
    order = np.argsort(value, kind="stable")
    v = value[order]
    same = v[1:] == v[:-1]
    several = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    order = order[several]
    out = pd.DataFrame({"bucket": value[order].astype(np.int64), "class": head["class"][who[order]], "n": head["n"][who[order]].astype(np.int64), "free": (sig[order] & _U(1)).astype(bool), "below": (sig[order] & _U(2)).astype(bool)})
    out["spare"] = head["spare"][who[order], out.below.to_numpy().astype(int)].astype(np.int32)
    # the copies of a class that several partitions sent count once
    out = out.drop_duplicates(["bucket", "class"])
    out["size"] = out.groupby("bucket")["class"].transform("size")
    out = out[out["size"] > 1]
    own = (~out.below).groupby(out.bucket).transform("any")  # of two sets from above the band, another band takes care
    out = out[own]
    with np.errstate(over="ignore"):
        out["bucket"] = _mix(out.bucket.to_numpy().astype(_U) * _U(0x9E3779B97F4A7C15) + _U(int(pdf.p.iloc[0]))).astype(np.int64)
    return out[["bucket", "class", "n", "size", "free", "below", "spare"]]


def _shared(df: DataFrame, text_col: str, tokens: int, scratch: list[str]) -> DataFrame:
    """The buckets' rows (bucket, class, n, below, asks) that can still hold a link; asks: whether the class must look there."""
    from pyspark.sql import Window

    groups = max(1, math.ceil(0.65 * tokens / GROUP))
    rows = cut(_packed(df, text_col, groups).groupBy("p").applyInPandas(_buckets, _BUCKETS), scratch)
    costly = Window.partitionBy("class", "below", "free").orderBy(F.desc("size"), "bucket")
    asks = ~F.col("free") | (F.row_number().over(costly) > F.col("spare"))
    rows = rows.withColumn("asks", asks).drop("free", "spare", "size")
    live = cut(rows.groupBy("bucket").agg(F.max("asks").alias("any")).filter("any").select("bucket"), scratch)
    return cut(rows.join(small(live), "bucket"), scratch)


def _tested(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """pairs (a, b) with linked: whether their sets link. held: (class, set)."""

    def run(batches):
        for rows in batches:
            out = []
            for a, b, x, y in rows:
                x, y = np.frombuffer(x, _U), np.frombuffer(y, _U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append((a, b, 9 * both >= 4 * (len(x) + len(y))))
            yield out

    joined = pairs.join(held.select(F.col("class").alias("a"), F.col("set").alias("x")), "a").join(held.select(F.col("class").alias("b"), F.col("set").alias("y")), "b")
    return map_rows(joined.select("a", "b", "x", "y"), run, "a long, b long, linked boolean")


def _counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections. Tokens of many sets are multiplied out, those of a few listed by pairs of their owners."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, at, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    total = np.zeros((n, n), np.float32)
    often = many > 32
    number = np.cumsum(often) - 1
    use = often[at]
    who, col = owner[use], number[at[use]]
    order = np.argsort(col, kind="stable")
    who, col = who[order], col[order]
    for low in range(0, int(often.sum()), 8192):
        a, b = np.searchsorted(col, (low, low + 8192))
        part = np.zeros((n, 8192), np.float32)
        part[who[a:b], col[a:b] - low] = 1
        total += part @ part.T
    use = (many[at] > 1) & ~use
    who, col = owner[use], at[use]
    order = np.argsort(col, kind="stable")
    who, col = who[order], col[order]
    flat = np.zeros(n * n, np.int64)
    for step in range(1, 32):  # owners stand in order within a token, so each pair is met once
        same = col[step:] == col[:-step]
        if not same.any():
            break
        flat += np.bincount(who[:-step][same] * n + who[step:][same], minlength=n * n)
    few = flat.reshape(n, n)
    return total.astype(np.int64) + few + few.T


def _blocked(rows: DataFrame, held: DataFrame) -> DataFrame:
    """Links (a, b) that join all that link within each bucket, of rows (bucket, class, k, comp).

    Buckets that share classes are taken together, while that makes no group of over WHOLE classes, so that each set
    is sent once. A group is dealt to blocks of about BLOCK classes; two blocks meet in one task, which tests all their pairs of
    different components at once and returns no more links than are needed to connect what is connected.
    """
    first = rows.groupBy("bucket").agg(F.min("class").alias("a"))
    near = components(rows.join(first, "bucket").filter("class <> a").select("a", F.col("class").alias("b")).distinct())
    large = near.groupBy("comp").agg(F.count(F.lit(1)).alias("size")).withColumnRenamed("comp", "group")
    rows = rows.join(near.select(F.col("node").alias("class"), F.col("comp").alias("group")), "class").join(large, "group")
    whole = F.col("size") <= WHOLE
    rows = rows.select(F.when(whole, F.col("group")).otherwise(F.col("bucket")).alias("bucket"), whole.alias("whole"), F.when(whole, F.col("size")).otherwise(F.col("k")).alias("k"), "class", "comp").distinct()

    def links(pdf):
        import pandas as pd

        pdf = pdf.drop_duplicates("class").sort_values("class")
        sets = [np.frombuffer(x, _U) for x in pdf["set"]]
        size = np.array([len(s) for s in sets])
        comp = pdf["comp"].to_numpy()
        both = _counts(sets)
        good = np.triu((9 * both >= 4 * (size[:, None] + size[None, :])) & (comp[:, None] != comp[None, :]), 1)
        name, up, out = pdf["class"].to_numpy(), {}, []

        def find(x):
            while up.get(x, x) != x:
                x = up[x]
            return x

        for i, j in zip(*np.nonzero(good)):
            a, b = find(comp[i]), find(comp[j])
            if a != b:
                up[max(a, b)] = min(a, b)
                out.append((name[i], name[j]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    n = F.ceil(F.col("k") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("class", F.lit("block")), n).cast("int")
    dealt = rows.select("bucket", "whole", "class", "comp", mine.alias("i"), F.explode(F.sequence(F.lit(0), n - 1)).alias("j"))
    dealt = dealt.withColumns({"i": F.least("i", "j"), "j": F.greatest("i", "j")})
    return dealt.join(held, "class").groupBy("bucket", "whole", "i", "j").applyInPandas(links, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, comp): the least node reachable by links (a, b). Each turn every node goes to its least neighbour and on to where that goes; links are then drawn anew between the places, so that they soon get few."""
    spark, scratch = links.sparkSession, []
    edges = cut(links.select("a", "b").filter("a <> b").distinct(), scratch)
    names: DataFrame | None = None
    while True:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("to")))
        up = cut(both.groupBy("node").agg(F.least("node", F.min("to")).alias("comp")), scratch)
        step = cut(up.join(up.toDF("comp", "far"), "comp").select("node", F.col("far").alias("comp")), scratch)
        if names is None:
            names = step
        else:
            names = cut(names.join(step.toDF("comp", "far"), "comp", "left").select("node", F.coalesce("far", "comp").alias("comp")), scratch)
        kept = scratch.pop()  # of names
        drawn = edges.join(step.toDF("a", "x"), "a").join(step.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        edges = cut(drawn.filter("a <> b").distinct(), scratch)
        last = scratch.pop()  # of edges
        discard(spark, scratch)
        scratch += [last, kept]
        if edges.isEmpty():
            scratch.remove(kept)
            discard(spark, scratch)
            return names


def _linked(df: DataFrame, members: DataFrame, tokens: int, id_col: str, text_col: str) -> DataFrame | None:
    """(node, comp) of the classes that link with another."""
    spark, scratch = df.sparkSession, []
    shared = _shared(df, text_col, tokens, scratch)
    wanted = shared.select("class").distinct()
    # a class's set comes from a row of it, found by id (0 for null) and text, so that null ids and several texts of one id do too
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("text_hash").alias("_text"))
    first = members.filter("class is not null").groupBy("class").agg(F.min(key).alias("r"))
    one = first.join(wanted, "class").select("class", "r.none", "r._id", "r._text")

    def run(batches):
        shingler, sent = Shingler(), set()
        for rows in batches:
            out = []
            for k, text in rows:
                if k not in sent and class_of(s := shingler.set_of(text)) == k:
                    if len(sent) > 200_000:
                        sent.clear()
                    sent.add(k)
                    out.append((k, s.tobytes()))
            yield out

    id, text = F.col(id_col).cast("long"), text_or_empty(text_col)
    texts = df.select(id.isNull().alias("none"), F.coalesce(id, F.lit(0)).alias("_id"), F.xxhash64(text).alias("_text"), text.alias("text"))
    one = small(cut(one, scratch))
    held = map_rows(texts.join(one, ["none", "_id", "_text"]).select("class", "text"), run, "class long, set binary").dropDuplicates(["class"])
    held = cut(held, scratch)
    comp: DataFrame | None = None
    tested: DataFrame | None = None

    def labelled() -> DataFrame:
        if comp is None:
            return shared.withColumn("comp", F.col("class"))
        known = comp.withColumnRenamed("node", "class")
        return shared.join(known, "class", "left").withColumn("comp", F.coalesce("comp", "class"))

    for turn in range(PIVOTS + 1):
        rows = cut(labelled(), scratch)
        # in the first turn a class is likely to be the pivot of all its buckets, so that a group of near copies takes one test a member;
        # later on each bucket has a pivot of its own, so that who is left is tested against many
        chance = F.xxhash64("class", F.lit(turn)) if turn == 0 else F.xxhash64("class", "bucket", F.lit(turn))
        live = rows.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("k"), F.max_by(F.struct("class", "comp"), chance).alias("pivot")).filter("low <> high")
        # what lies in one component, or was tested whole as it holds two classes, is done with
        live = cut((live if turn == 0 else live.filter("k > 2")).select("bucket", "k", "pivot"), scratch)
        left, most = live.agg(F.sum(F.col("k") * (F.col("k") - 1) / 2), F.sum("k")).first()
        if left is None:
            break
        mine = cut(rows.join(small(live), "bucket"), scratch)
        shared = mine.select("bucket", "class", "n", "below", "asks")
        last = turn == PIVOTS or left <= 2 * most
        if last:
            blocks = _blocked(mine.filter(F.col("k") > SMALL), held)
            mine = mine.filter(F.col("k") <= SMALL).drop("pivot", "k")
            x = mine.select("bucket", *[F.col(c).alias(f"x_{c}") for c in ("class", "n", "below", "asks", "comp")])
            larger = (F.col("n") < F.col("x_n")) | ((F.col("n") == F.col("x_n")) & (F.col("class") < F.col("x_class")))
            pairs = x.filter("x_asks").join(mine, "bucket").filter(larger & (F.col("comp") != F.col("x_comp")) & ~(F.col("below") & F.col("x_below")) & (5 * F.col("n") >= 4 * F.col("x_n")))
            pairs = pairs.select(F.least("class", "x_class").alias("a"), F.greatest("class", "x_class").alias("b"))
        else:
            pairs = mine.filter(F.col("comp") != F.col("pivot.comp")).select(F.least("class", "pivot.class").alias("a"), F.greatest("class", "pivot.class").alias("b"))
        pairs = pairs.distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        result = cut(_tested(pairs, held), scratch)
        tested = result.select("a", "b") if tested is None else tested.unionByName(result.select("a", "b"))
        links = result.filter("linked").select("a", "b")
        if last:
            links = cut(links.unionByName(blocks), scratch)
        if not links.isEmpty():
            if comp is None:
                comp = components(links)
            else:
                # links between components found so far, then their members' new names
                of = comp.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
                ends = links.join(of, "a", "left").join(of.toDF("b", "cb"), "b", "left")
                new = components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))).toDF("comp", "to")
                old = comp.join(new, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
                alone = new.select(F.col("comp").alias("node"), F.col("to").alias("comp")).join(comp.select("node"), "node", "left_anti")
                comp = cut(old.unionByName(alone))
        if last:
            break
    # comp's own folder, and those of comps before it, which plans may still read, stay
    discard(spark, scratch)
    return comp


def _placed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_hash, n, class, comp, component of every row: comp names its component by a class (null for an empty set), component by the least doc_id there."""
    members = cut(sets(df, id_col, text_col))
    tokens = members.agg(F.sum("n")).first()[0] or 0
    comp = _linked(df, members, tokens, id_col, text_col)
    least = members.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"))
    if comp is not None:
        least = least.join(comp.withColumnRenamed("node", "class"), "class", "left").withColumn("comp", F.coalesce("comp", "class"))
        whole = least.groupBy("comp").agg(F.min("least").alias("component"))
        least = least.join(whole, "comp").select("class", "comp", "component")
    else:
        least = least.select("class", F.col("class").alias("comp"), F.col("least").alias("component"))
    # a class of very many copies doesn't meet in one task while classes are few enough to be sent; beyond that the join is one of a skewed side, which Spark splits
    return members.join(small(cut(least)), "class", "left")


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    placed = _placed(df, id_col, text_col)
    return placed.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one row of each component: that of the least id (null ids last), then of the least text hash; of equal ones, any. Rows with an empty set stay."""
    placed = _placed(df, id_col, text_col).filter("class is not null")
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("text_hash").alias("text"))
    found = placed.select("comp", row.alias("row")).groupBy("comp", "row").agg(F.count(F.lit(1)).alias("times"))
    found = cut(found)
    best = small(cut(found.groupBy("comp").agg(F.min("row").alias("best"))))
    found = found.join(best, "comp").filter((F.col("row") != F.col("best")) | (F.col("times") > 1))
    # names that the table has no column of
    none, own, hashed, is_best, nth = (f"_{n}{'_' * max(len(c) for c in df.columns)}" for n in ("none", "id", "text", "best", "nth"))
    marked = cut(found.select(F.col("row.none").alias(none), F.col("row.id").alias(own), F.col("row.text").alias(hashed), (F.col("row") == F.col("best")).alias(is_best)))
    at = [none, own, hashed]
    id, text = F.col(id_col).cast("long"), text_or_empty(text_col)
    rows = df.withColumns({none: id.isNull(), own: F.coalesce(id, F.lit(0)), hashed: F.xxhash64(text)})
    kept = rows.join(marked.drop(is_best), at, "left_anti").select(*df.columns)
    repeated = marked.filter(F.col(is_best)).drop(is_best)
    if repeated.isEmpty():
        return kept
    from pyspark.sql import Window

    # of rows equal in id and text the one whose other columns hash least
    order = Window.partitionBy(*at).orderBy(F.xxhash64(*[c for c in df.columns if "map<" not in df.schema[c].dataType.simpleString()]))
    firsts = rows.join(repeated, at, "left_semi").withColumn(nth, F.row_number().over(order)).filter(F.col(nth) == 1)
    return kept.unionByName(firsts.select(*df.columns))
