"""The trie of conversations' prefixes, by ternary search trees over range shards.

Every distinct beginning of a conversation (its first d turns) is a node. Conversations, as sequences of turn keys, are put in
lexicographic order and cut into ranges of about SHARD conversations and TURNS turns, wherever that falls, so that neither a common first
turn nor a conversation that occurs a million times makes a range larger. A shard numbers its turns (its dictionary) and puts
its distinct sequences into a ternary search tree, the middle one first, then the middle ones of both halves and so on,
which keeps the tree balanced. One traversal, without recursion, sums up members, leaves and savings from the leaves to the root.

What a shard knows is final but for nodes on the path of its first or its last sequence, which the shards before and after may share.
Those are merged by the digests of their paths: FAN neighbouring shards a group and round, whose inner nodes become final, until one group is left. A group has the nodes of
2 * FAN paths. Ids of conversations that end at such a node go on as texts of at most CHUNK ids, in order, and are hashed in one pass by whoever
gets them.

Null roles and texts are empty ones. Turns come in the order of their number, null first; turns of one number by role, then by the digest of their text; repeated rows are
turns of their own. Rows without a conversation take no part, nor do other columns. An empty table gives no rows. A conversation's keys (16 bytes a turn) are held in one
task, its texts aren't. Turns and paths are told apart by 128 bits of a SHA-256 and of a BLAKE2b.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plansift.llm.common import cut, discard, small, text_or_empty, word_count

SHARD, TURNS, FAN, CHUNK, BATCH = 8192, 1 << 17, 64, 512, 4096

#: A node, or part of one. level, shard: where it was met; side: 0 on the path of the shard's first sequence, 1 on its last's alone, null if it is final there.
NODE = "level int, shard long, side int, depth long, path binary, parent binary, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, words long, ends string, chunk long"


class Tree:
    """A ternary search tree of sequences of numbers.

    Each of its nodes has a number, lower and higher siblings and the tree of what follows; together with the ones it hangs from by
    "follows", it stands for a prefix. Node 0 is the root, the empty prefix, and has no number.
    """

    def __init__(self):
        self.number, self.low, self.high, self.follows, self.up, self.depth = [-1], [0], [0], [0], [-1], [0]
        self.members, self.least, self.words, self.ends = [0], [None], [0], [None]

    def insert(self, sequence: Sequence[int], words: Sequence[int], ids: list[int]) -> None:
        """Adds the conversations ids, all of which are that sequence; ids ascend."""
        at = 0
        self._count(at, ids)
        for d, x in enumerate(sequence):
            here, link = self.follows[at], self.follows
            place = at
            while here and self.number[here] != x:
                link = self.low if x < self.number[here] else self.high
                place, here = here, link[here]
            if not here:
                here = link[place] = len(self.number)
                for column, value in ((self.number, x), (self.low, 0), (self.high, 0), (self.follows, 0), (self.up, at), (self.depth, d + 1), (self.members, 0), (self.least, None), (self.words, words[d]), (self.ends, None)):
                    column.append(value)
            at = here
            self._count(at, ids)
        self.ends[at] = ids

    def _count(self, at: int, ids: list[int]) -> None:
        self.members[at] += len(ids)
        if self.least[at] is None or ids[0] < self.least[at]:
            self.least[at] = ids[0]

    def prefix_order(self) -> Iterator[int]:
        """All nodes, each after the one it follows, siblings by number, without recursion."""
        yield 0
        stack: list[tuple[int, bool]] = [(self.follows[0], False)]
        while stack:
            here, seen = stack.pop()
            if not here:
                continue
            if seen:
                yield here
                stack.append((self.high[here], False))
                stack.append((self.follows[here], False))
            else:
                stack.append((here, True))
                stack.append((self.low[here], False))


def balanced(n: int) -> Iterator[int]:
    """0 to n - 1, the middle first, then the middles of both halves, and so on."""
    parts = [(0, n)]
    while parts:
        following = []
        for a, b in parts:
            if a < b:
                m = (a + b) // 2
                yield m
                following += [(a, m), (m + 1, b)]
        parts = following


def _joined(ids: Iterable[int]) -> str:
    return ",".join(map(str, ids))


def _path(parent: bytes, turn: bytes) -> bytes:
    return hashlib.blake2b(parent + turn, digest_size=16).digest()


ROOT = hashlib.blake2b(b"", digest_size=16).digest()


def shard_nodes(rows: list[tuple[int, tuple[bytes, ...], list[int]]], shard: int) -> Iterator[tuple]:
    """NODE rows of (conv_id, keys, words of each turn), which are in the order of keys, then conv_id."""
    distinct: list[tuple[tuple[bytes, ...], list[int], list[int]]] = []
    for conv, keys, words in rows:
        if distinct and distinct[-1][0] == keys:
            distinct[-1][2].append(conv)
        else:
            distinct.append((keys, words, [conv]))
    number = {k: n for n, k in enumerate(sorted({k for keys, _, _ in distinct for k in keys}))}
    key = list(number)
    tree = Tree()
    for m in balanced(len(distinct)):
        keys, words, ids = distinct[m]
        tree.insert([number[k] for k in keys], words, ids)
    order = list(tree.prefix_order())
    # the paths of the first and the last sequence, which other shards may share
    side, path = {0: 0}, {0: ROOT}
    for s, keys in ((0, distinct[0][0]), (1, distinct[-1][0])):
        at = 0
        for k in keys:
            x, here = number[k], tree.follows[at]
            while tree.number[here] != x:
                here = tree.low[here] if x < tree.number[here] else tree.high[here]
            side.setdefault(here, s)
            path[here] = _path(path[at], k)
            at = here
    n = len(tree.number)
    children, leaves, saved = [0] * n, [0] * n, [0] * n
    for at in reversed(order):
        if at in side:  # only what is final below counts here
            continue
        up = tree.up[at]
        leaves[at] += not children[at]
        saved[at] += (tree.members[at] - 1) * tree.words[at]
        children[up] += 1
        leaves[up] += leaves[at]
        saved[up] += saved[at]
    for at in order:
        up, ids = tree.up[at], tree.ends[at] or []
        shared = at in side
        known = up >= 0 and up not in side
        yield (
            0, shard, side.get(at), tree.depth[at], path.get(at), None if known or up < 0 else path[up], tree.least[at], tree.least[up] if known else None, tree.members[at], children[at], leaves[at], saved[at], tree.words[at],
            None if shared else hashlib.sha256(_joined(ids).encode()).hexdigest(), None,
        )
        if shared:
            for c in range(0, len(ids), CHUNK):
                yield (0, shard, side[at], tree.depth[at], path[at], None, None, None, None, None, None, None, None, _joined(ids[c : c + CHUNK]), c // CHUNK)


def merged(parts: list[dict], level: int, shard: int, last: bool) -> Iterator[tuple]:
    """NODE rows of what neighbouring shards know of the nodes they may share; all are final if there is no other group.

    What a group's first shard has on its first path and its last shard on its last may be shared with other groups.
    """
    parts = sorted(parts, key=lambda p: (p["shard"], p["side"], p["depth"]))
    nodes: dict[bytes, dict] = {}  # in prefix order, as each is first met there
    for p in parts:
        node = nodes.setdefault(p["path"], {k: p[k] for k in ("path", "parent", "depth", "words")} | {"conv_id": p["conv_id"], "n": 0, "children": 0, "leaves": 0, "saved": 0})
        node["conv_id"] = min(node["conv_id"], p["conv_id"])
        for k, of in (("n", "n_convs"), ("children", "n_children"), ("leaves", "n_leaves"), ("saved", "saved_tokens")):
            node[k] += p[of]
    side: dict[bytes, int] = {}
    if not last:
        for s, of in ((0, parts[0]["shard"]), (1, parts[-1]["shard"])):
            here = [p for p in parts if p["shard"] == of]
            # a shard's last path branches off its first one where its side-1 nodes begin
            keep = {p["path"] for p in here if p["side"] == 0}
            if s:
                by_path = {p["path"]: p for p in here}
                deepest = max((p for p in here if p["side"] == 1), key=lambda p: p["depth"], default=None) or max(here, key=lambda p: p["depth"])
                keep, at = set(), deepest
                while at:
                    keep.add(at["path"])
                    at = by_path.get(at["parent"])
            for path in keep:
                side.setdefault(path, s)
    for path, node in reversed(nodes.items()):
        if path in side:
            continue
        node["leaves"] += not node["children"]
        node["saved"] += (node["n"] - 1) * node["words"]
        if up := nodes.get(node["parent"]):
            up["children"] += 1
            up["leaves"] += node["leaves"]
            up["saved"] += node["saved"]
    for path, x in nodes.items():
        yield (level, shard, side.get(path), x["depth"], path, x["parent"], x["conv_id"], None, x["n"], x["children"], x["leaves"], x["saved"], x["words"], None, None)


def _schema(columns: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(columns), prefers_large_types=False)


def _batches(rows: Iterable[tuple], schema) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for row in rows:
        out.append(row)
        if len(out) == BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", by: Column | None = None) -> DataFrame:
    """conv_id, turns (array of key and words, in order), and base, which is by (of conv_id), the conversations of one base lying together."""
    role, text = text_or_empty(role_col), text_or_empty(text_col)
    key = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    rows = df.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), key.alias("key"), word_count(F.col(text_col)).alias("words")).filter(F.col("conv_id").isNotNull())
    rows = rows.withColumn("base", F.col("conv_id") if by is None else by).repartition("base")
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "key", "words")))
    return rows.groupBy("base", "conv_id").agg(F.transform(turns, lambda t: F.struct(t["key"].alias("key"), t["words"].alias("words"))).alias("turns"))


def rebuilt(df: DataFrame, every: int = 20, most: int = 4, **columns: str) -> DataFrame:
    """conv_id, turns: each conversation c with its first h turns taken from conversation c - c % every, h = crc32(c) % most."""
    rows = conversations(df, by=F.col("conv_id") - F.col("conv_id") % every, **columns)
    head = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("turns", 1, most - 1))).over(Window.partitionBy("base"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    rest = F.slice("turns", h + 1, F.size("turns") + 1)
    return rows.withColumn("head", F.coalesce(head, F.slice("turns", 1, 0))).select("conv_id", F.concat(F.slice("head", F.lit(1), h), rest).alias("turns"))


def trie(sequences: DataFrame, shard: int = SHARD, fan: int = FAN) -> DataFrame:
    """One row a node, of conv_id and turns (array of key, which is binary, and words): conv_id (its smallest member's), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark, scratch, used = sequences.sparkSession, [], []
    rows = cut(sequences.select("conv_id", F.col("turns.key").alias("keys"), F.col("turns.words").alias("words")), scratch)
    total, turns = rows.agg(F.count(F.lit(1)), F.sum(F.size("keys"))).first()
    shards = max(1, -(-total // shard), -(-(turns or 0) // TURNS))
    schema = _schema(NODE)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        got = [(c, tuple(k), w) for b in batches for c, k, w in zip(*(column.to_pylist() for column in b.columns))]
        if got:
            yield from _batches(shard_nodes(got, TaskContext.get().partitionId()), schema)

    ranged = rows.repartitionByRange(shards, "keys", "conv_id").sortWithinPartitions("keys", "conv_id")
    first = cut(ranged.mapInArrow(build, NODE), used)
    discard(spark, scratch)
    shared = first.filter(F.col("side").isNotNull() & F.col("n_convs").isNotNull())

    def merging(level: int, last: bool):
        def merge(parts: pa.Table) -> pa.Table:
            return pa.Table.from_batches(_batches(merged(parts.to_pylist(), level, parts["group"][0].as_py(), last), schema), schema)

        return merge

    # merge groups of neighbouring shards until one is left
    met, level, final = shared, 0, []
    while True:
        level += 1
        groups = met.agg(F.max("shard")).first()[0]
        last = groups is None or groups < fan

        met = cut(met.withColumn("group", F.floor(F.col("shard") / fan)).groupBy("group").applyInArrow(merging(level, last), NODE), used)
        final.append(met.filter(F.col("side").isNull()))
        if last:
            break
        met = met.filter(F.col("side").isNotNull())
    merged_nodes = final[0]
    for more in final[1:]:
        merged_nodes = merged_nodes.unionByName(more)
    merged_nodes = cut(merged_nodes.select("path", "parent", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens"), used)

    # whose parents became known by merging: of a shard's nodes by shard and path, of merged ones by path
    ids = small(merged_nodes.select(F.col("path").alias("_path"), F.col("conv_id").alias("_conv")))
    of_shard = small(cut(shared.select("shard", "path").join(ids, F.col("path") == F.col("_path")).select(F.col("shard").alias("_shard"), F.col("path").alias("_path"), "_conv"), used))
    alone = first.filter(F.col("side").isNull())
    waiting = alone.join(of_shard, (F.col("shard") == F.col("_shard")) & (F.col("parent") == F.col("_path")), "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_conv"))
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")

    ended = _schema("_ended binary, ends string")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            here, digest = None, None
            for b in batches:
                for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if path != here:
                        if digest:
                            yield here, digest.hexdigest()
                        here, digest = path, hashlib.sha256(text.encode())
                    else:
                        digest.update(b"," + text.encode())
            if digest:
                yield here, digest.hexdigest()

        yield from _batches(rows(), ended)

    chunks = first.filter(F.col("chunk").isNotNull()).repartition("path").sortWithinPartitions("path", "shard", "chunk")
    ends = chunks.select("path", "ends").mapInArrow(hashed, "_ended binary, ends string")
    nodes = merged_nodes.join(ids, F.col("parent") == F.col("_path"), "left").withColumn("parent_conv_id", F.col("_conv")).join(ends, F.col("path") == F.col("_ended"), "left")
    nodes = nodes.withColumn("ends", F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())))
    return waiting.select(*columns, F.col("ends").alias("ends_sha256")).unionByName(nodes.select(*columns, F.col("ends").alias("ends_sha256")))
