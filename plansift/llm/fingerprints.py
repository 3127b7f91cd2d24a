"""Document fingerprints from closed syncmers, in DataFrame functions alone.

A text's tokens are its runs of characters other than white space, lower-cased, cut after TOKEN code points. Each S tokens in a
row have a hash; a run of K tokens is a closed syncmer if the least of its inner hashes is its first
or its last. Whether a run is chosen thus depends on the run alone, so that equal passages give equal
anchors wherever they stand. An anchor is the run's hash and the place of its first token. The
fingerprint holds all anchors, each hash once, at its first place. The likeness of two
fingerprints is the Jaccard likeness of their sets of hashes.

A text of fewer than K tokens has its code points as tokens; one of fewer than K code points is one anchor, and so is
one of which no run is chosen.
Nulls count as empty texts; blank texts have no anchors and an empty fingerprint. Two empty
fingerprints are alike by 1, an empty one and another by 0. Rows of one id follow each other in the order of a hash of their text; rows without an id
have no next document. Repeated rows give repeated rows, an empty table gives none. Other columns play no part. A text is worked on whole, in one task; of one with more than
4,194,303 tokens the anchors are all kept, but places beyond that count as that place, in which alone the alignment is coarser.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K, S, TOKEN = 5, 2, 16

#: An anchor is one long: HASH bits of hash above PLACE bits of place (later places count as the last).
HASH, PLACE = 40, 22


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _hash(*columns: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - HASH)


def _anchors(hashes: Column) -> Column:
    """Sorted array<long> of a token hash array's anchors."""

    def runs(h: Column) -> Column:
        inner = F.transform(F.sequence(F.lit(0), F.size(h) - S), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(S)]))

        def chosen(g: Column) -> Column:
            last = K - S
            places = F.filter(
                F.sequence(F.lit(0), F.size(h) - K),
                lambda i: F.least(F.get(g, i), F.get(g, i + last)) <= F.least(*[F.get(g, i + j) for j in range(1, last)]),
            )
            return F.transform(places, lambda i: F.shiftleft(_hash(*[F.get(h, i + j) for j in range(K)]), PLACE) + F.least(i, F.lit((1 << PLACE) - 1)))

        return _let(inner, chosen)

    whole = F.array(F.shiftleft(_hash(F.concat_ws(",", h_text(hashes))), PLACE))
    none = F.array().cast("array<long>")
    found = _let(F.when(F.size(hashes) >= K, runs(hashes)).otherwise(none), lambda r: F.when((F.size(r) > 0) | (F.size(hashes) == 0), r).otherwise(whole))
    return F.sort_array(found)


def h_text(hashes: Column) -> Column:
    return F.transform(hashes, lambda h: h.cast("string"))


def sketch(text: Column) -> Column:
    """array<long>: the anchors in order of hash."""
    low = F.lower(text)
    tokens = F.regexp_extract_all(low, F.lit(rf"\S{{1,{TOKEN}}}"), F.lit(0))
    letters = F.regexp_extract_all(low, F.lit(r"\S"), F.lit(0))
    hashes = _let(tokens, lambda t: F.transform(F.when(F.size(t) >= K, t).otherwise(letters), lambda w: F.xxhash64(w)))

    def once(anchors: Column) -> Column:
        return F.filter(anchors, lambda a, i: (i == 0) | (F.shiftright(a, PLACE) != F.shiftright(F.get(anchors, i - 1), PLACE)))

    return _let(_let(hashes, _anchors), once)


def written(sketch: Column) -> Column:
    """A sketch as text: hash:place of each anchor, comma-joined; hash in hex, place in decimal."""
    one = lambda a: F.concat(F.lower(F.lpad(F.hex(F.shiftright(a, PLACE)), HASH // 4, "0")), F.lit(":"), (a.bitwiseAND(F.lit((1 << PLACE) - 1))).cast("string"))
    return F.array_join(F.transform(sketch, one), ",")


def likeness(a: Column, b: Column) -> Column:
    """Of two sketches, 0 to 1."""
    bare = lambda x: F.transform(x, lambda v: F.shiftright(v, PLACE))
    pair = F.struct(bare(a).alias("a"), bare(b).alias("b"))
    # each holds a hash once
    share = _let(pair, lambda p: _let(F.size(F.array_intersect(p["a"], p["b"])), lambda both: both / (F.size(p["a"]) + F.size(p["b"]) - both)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(share)


def aligned(a: Column, b: Column) -> Column:
    """Of neighbours among the anchors two sketches share, the part that stands equally far apart in both, so that what is inserted or lost costs one gap; 1 for one shared anchor, 0 for none."""
    mask, tag = F.lit((1 << PLACE) - 1), 1 << PLACE
    # both in one order of hash, a's before b's: a shared hash stands twice in a row
    tagged = lambda x, t: F.transform(x, lambda v: F.shiftleft(F.shiftright(v, PLACE), PLACE + 1) + v.bitwiseAND(mask) + t)

    def shifts(m: Column) -> Column:
        """place in a and shift to b, of each shared hash, in order of place."""
        pair = F.filter(F.sequence(F.lit(0), F.size(m) - 2), lambda i: F.shiftright(F.get(m, i), PLACE + 1) == F.shiftright(F.get(m, i + 1), PLACE + 1))
        at = lambda i: F.get(m, i).bitwiseAND(mask)
        return F.sort_array(F.transform(pair, lambda i: F.shiftleft(at(i), PLACE + 1) + at(i + 1) - at(i) + tag))

    def steady(s: Column) -> Column:
        shift = lambda i: F.get(s, i).bitwiseAND(F.lit((tag << 1) - 1))
        same = F.filter(F.sequence(F.lit(1), F.size(s) - 1), lambda i: shift(i) == shift(i - 1))
        return F.when(F.size(s) == 0, 0.0).when(F.size(s) == 1, 1.0).otherwise(F.size(same) / (F.size(s) - 1))

    merged = F.sort_array(F.concat(tagged(a, 0), tagged(b, tag)))
    return _let(merged, lambda m: F.when(F.size(m) < 2, 0.0).otherwise(_let(shifts(m), steady)))


def _bounds(df: DataFrame, id_col: str, per_bucket: int, most: int) -> list[int]:
    """Ids that begin the buckets: real ids of the table, of about equal row counts; at most `most` of them."""
    n, low = df.select(F.count(id_col), F.min(id_col)).first()
    if not n:
        return []
    buckets = max(1, min(most, n // per_bucket))
    if buckets == 1:
        return [low]
    at = df.select(F.percentile_approx(id_col, [k / buckets for k in range(1, buckets)], 20 * buckets)).first()[0]
    return sorted({low, *at})


def with_next(df: DataFrame, id_col: str, columns: list[str], per_bucket: int = 2048, most: int = 16_384) -> DataFrame:
    """df with next_<column>s of the row of the next higher id; after the last comes the first.

    Rows are dealt to buckets of neighbouring ids; the row that begins a bucket is also sent, as a
    guest, to the bucket before it (the very first row to the last bucket), so one shuffle does.
    Equal ids follow each other in the order of the columns' hash. Rows without an id have no next.
    """
    bounds = _bounds(df, id_col, per_bucket, most)
    if len(bounds) == 0:
        return df.withColumns({f"next_{c}": F.lit(None).cast(df.schema[c].dataType) for c in columns})
    held = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<long>")
    steps = max(1, len(bounds).bit_length())
    # the last bound that is not above the id, by halving
    place = F.aggregate(
        F.lit([1 << k for k in range(steps - 1, -1, -1)]),
        F.lit(0),
        lambda at, step: F.when((at + step < len(bounds)) & (F.get(held, F.least(at + step, F.lit(len(bounds) - 1))) <= F.col(id_col)), at + step).otherwise(at),
    )
    rows = df.withColumn("_bucket", F.when(F.col(id_col).isNotNull(), place).otherwise(-1 - F.pmod(F.xxhash64(*columns), F.lit(256)).cast("int")))
    begins = F.col("_bucket").between(0, len(bounds)) & (F.get(held, F.col("_bucket")) == F.col(id_col))
    before = F.when(F.col("_bucket") == 0, len(bounds) - 1).otherwise(F.col("_bucket") - 1)
    own = F.struct(F.col("_bucket").alias("bucket"), F.lit(0).alias("guest"))
    guest = F.struct(before.alias("bucket"), F.lit(1).alias("guest"))
    sent = rows.withColumn("_to", F.explode(F.when(begins, F.array(own, guest)).otherwise(F.array(own)))).drop("_bucket")
    sent = sent.select("*", "_to.bucket", "_to.guest").drop("_to")
    from pyspark.sql import Window

    w = Window.partitionBy("bucket").orderBy("guest", id_col, *[F.xxhash64(c) for c in columns])
    nexts = {f"next_{c}": F.when(F.col(id_col).isNotNull(), F.lead(c).over(w)) for c in columns}
    return sent.withColumns(nexts).filter("guest = 0").drop("bucket", "guest")


def fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, sketch of every text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("sketch", sketch(F.col("text")))


def compare_with_edit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint beside that of its edited text (its last quarter replaced by the beginning of the next document) and the next document's."""
    rows = with_next(fingerprint(df, id_col, text_col), "doc_id", ["text", "sketch"])
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - quarter), F.coalesce(F.substring("next_text", F.lit(1), quarter), F.lit("")))
    rows = rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        "sketch",
        F.coalesce("next_sketch", F.array().cast("array<long>")).alias("next_sketch"),
        F.explode(F.array(edited)).alias("edited"),
    )
    rows = rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "sketch",
        "next_sketch",
        # an explode of one element: what is above it uses the sketch as computed
        F.explode(F.array(sketch(F.col("edited")))).alias("edited_sketch"),
    )
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        written(F.col("sketch")).alias("fingerprint"),
        written(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        aligned(F.col("sketch"), F.col("edited_sketch")).alias("aligned_edited"),
    )
