"""Conflict-constrained best-fit packing of documents into sequences.

A document's weight is its estimated token count, ceil(code points / CHARS). A longer document than
a bin is cut into pieces of a whole bin each, and a rest. Two pieces conflict if they belong to the
same cluster of duplicates; and a bin holds at most PER_SOURCE pieces of one source. Open bins stand
in the order of what room they have left and carry a bitmap of their clusters and PER_SOURCE bitmaps
of their sources; a piece, largest first, goes to the tightest bin with room for it whose bitmaps
allow it: the search goes from the smallest room that suffices to its successors.

Documents are dealt to shards of about SHARD rows by a hash of id and text, so that a hot source or cluster is
spread over all of them; each shard is packed by itself, which costs at most its last few open bins.

Pieces of full size are bins of their own. A null or empty text weighs nothing and gets one piece of
length 0; a null source never conflicts, a null cluster neither. Rows of one id and text are packed
as often as they occur. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITY, CHARS, PER_SOURCE, SHARD = 8192, 4, 4, 4096


def best_fit(items: list[tuple[int, int | None, int | None]], capacity: int, per_source: int = PER_SOURCE) -> list[int]:
    """Bin numbers for (weight, source, cluster) items, taken in the order given."""
    rooms: list[tuple[int, int]] = []  # (room left, bin), in order
    sources: list[list[int]] = []  # of each bin, bitmaps: k-th is set where k + 1 pieces of the source are in
    clusters: list[int] = []
    out = []
    for weight, source, cluster in items:
        s = 0 if source is None else 1 << source
        c = 0 if cluster is None else 1 << cluster
        for i in range(bisect_left(rooms, (weight, -1)), len(rooms)):
            room, b = rooms[i]
            if not clusters[b] & c and not sources[b][-1] & s:
                del rooms[i]
                break
        else:
            room, b = capacity, len(clusters)
            sources.append([0] * per_source)
            clusters.append(0)
        for k in range(per_source):
            if not sources[b][k] & s:
                sources[b][k] |= s
                break
        clusters[b] |= c
        if room > weight:
            insort(rooms, (room - weight, b))
        out.append(b)
    return out


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster: Column | None = None, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard: int = SHARD) -> DataFrame:
    """One row a piece: doc_id, row_hash (of id and text), piece, start, length (code points), n_tokens, shard, bin, slot, bin_tokens.

    cluster: the documents' duplicate cluster, any long column; by default equal texts are duplicates.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    chars = capacity * CHARS
    rows = df.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("doc_id"),
        F.col(id_col).isNull().alias("no_id"),
        F.length(text).cast("long").alias("n"),
        # 0 stands for none, as a null would turn the column into doubles
        F.when(F.col(source_col).isNotNull(), F.xxhash64(F.col(source_col).cast("string"))).otherwise(0).alias("source"),
        F.coalesce(F.xxhash64(text) if cluster is None else cluster.cast("long"), F.lit(0)).alias("cluster"),
        F.xxhash64(F.col(id_col).cast("long"), text).alias("h"),
    )
    total = df.select(F.count(F.lit(1))).first()[0]
    shards = max(1, -(-total // shard))

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["no_id", "doc_id", "h"], kind="stable")
        number = {k: i for i, k in enumerate(x for x in pdf.source.unique().tolist() if x)}
        count = pdf.cluster.value_counts()
        several = set(count[count > 1].index)
        alike: dict = {}
        pieces = []
        for k, none, n, s, c, h in zip(pdf.doc_id.tolist(), pdf.no_id.tolist(), pdf.n.tolist(), pdf.source.tolist(), pdf.cluster.tolist(), pdf.h.tolist()):
            # only what has several pieces can conflict, and so needs a bit
            c = alike.setdefault(c or (none, k), len(alike)) if c in several and c or n > chars else None
            for p, start in enumerate(range(0, max(n, 1), chars)):
                length = min(chars, n - start)
                pieces.append((-(-length // CHARS), None if none else k, h, p, start, length, number.get(s), c))
        pieces.sort(key=lambda x: -x[0])
        bins = best_fit([(x[0], x[6], x[7]) for x in pieces], capacity, per_source)
        filled, slots, out = {}, {}, []
        for b, x in zip(bins, pieces):
            filled[b] = filled.get(b, 0) + x[0]
            slots[b] = slots.get(b, -1) + 1
            out.append((*x[1:6], x[0], b, slots[b]))
        got = pd.DataFrame(out, columns=["doc_id", "row_hash", "piece", "start", "length", "n_tokens", "bin", "slot"])
        got["doc_id"] = got.doc_id.astype("Int64")
        got["shard"] = int(pdf.shard.iloc[0])
        got["bin_tokens"] = got.bin.map(filled)
        return got[["doc_id", "row_hash", "piece", "start", "length", "n_tokens", "shard", "bin", "slot", "bin_tokens"]]

    dealt = rows.withColumn("shard", F.pmod("h", F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(run, "doc_id long, row_hash long, piece long, start long, length long, n_tokens long, shard long, bin long, slot long, bin_tokens long")


def sequences(df: DataFrame, packed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """pack()'s rows with the text of each piece in place of row_hash.

    Pieces of one document lie in one shard; a document of many pieces is joined to its text once a piece. Null texts are '' here, rows
    of one id and text give their pieces as often as they occur, and further columns of df, whatever their names, play no part.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = df.select(F.xxhash64(F.col(id_col).cast("long"), text).alias("row_hash"), F.col(id_col).cast("long").alias("_id"), text.alias("text")).dropDuplicates(["row_hash", "_id"])
    joined = packed.join(texts, (packed["row_hash"] == texts["row_hash"]) & F.col("doc_id").eqNullSafe(F.col("_id"))).drop("row_hash", "_id")
    return joined.withColumn("text", F.when(F.col("length") == F.length("text"), F.col("text")).otherwise(F.substring("text", F.col("start").cast("int") + 1, F.col("length").cast("int"))))
