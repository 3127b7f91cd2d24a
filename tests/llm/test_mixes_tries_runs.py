"""Source mixes, prefix tries and periodic runs against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import os
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plansift.llm import mixing, periodic, prefixes, queries
from plansift.llm.common import table

SPACES = re.compile("[^\x20\x09-\x0d]+")


def words_of(text):
    return SPACES.findall(text or "")


# ---- mixes


def documents(spark, many=0):
    r = random.Random(5)
    rows = [(k, " ".join("w" for _ in range(r.randint(0, 40))) + r.choice(["", " ", "\x0b x", " y"]), r.choice(["b", "a", "ä", "Z", None]), 1, "x") for k in range(300)]
    rows += [(k, "one two three", "hot", 1, "x") for k in range(1000, 1000 + many)]
    rows += [(None, "null id", "a", None, None), (None, "null id", "a", None, None), (7, None, "b", 1, None), (8, "", None, 1, None), rows[3], (9, " \n", "blank", 2, None), (10, "w " * 70_000, "long", 2, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size long, target string").repartition(5)


def targets(sizes):
    """Of {source: size}, by shares that are dealt anew until none is above twice its source's size."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: Fraction((3, 1, 2)[k % 3]) for k, s in enumerate(order)}
    got, free, left = {}, list(order), Fraction(3, 2) * sum(sizes.values())
    while free:
        share = left / sum(weight[s] for s in free)
        above = [s for s in free if weight[s] * share > 2 * sizes[s]]
        if not above:
            got |= {s: weight[s] * share for s in free}
            break
        for s in above:
            got[s] = Fraction(2 * sizes[s])
            left -= got[s]
            free.remove(s)
    return got


@pytest.mark.parametrize("many,hot", [(0, 1024), (500, 1024), (500, 16)])
def test_mix(spark, many, hot):
    df = documents(spark, many)
    rows = mixing.mix(df, hot=hot).collect()
    assert len(rows) == df.count()
    assert collections.Counter((r.doc_id, r.source, r.size) for r in rows) == collections.Counter((r.doc_id, r.source, len(words_of(r.text))) for r in df.collect())
    sizes = collections.Counter()
    for r in rows:
        sizes[r.source] += r.size
    want, taken, by_source = targets(sizes), collections.Counter(), collections.defaultdict(list)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.taken == r.copies * r.size and r.copies in (0, 1, 2)
        assert r.target == pytest.approx(float(want[r.source]), rel=1e-12)
        taken[r.source] += r.taken
        by_source[r.source].append(r.size)
    for s, target in want.items():
        # as near as any choice of documents comes
        each = min(2, int(target // sizes[s])) if sizes[s] else 0
        sums = 1
        for n in by_source[s]:
            sums |= sums << n
        near = min(abs(k + each * sizes[s] - target) for k in range(sums.bit_length()) if sums >> k & 1) if each < 2 else abs(2 * sizes[s] - target)
        assert abs(taken[s] - target) <= near + 1
    again = mixing.mix(df.repartition(3), hot=hot).collect()
    assert collections.Counter(map(tuple, rows)) == collections.Counter(map(tuple, again))
    if many:
        assert collections.Counter(map(tuple, rows)) == collections.Counter(map(tuple, mixing.mix(df, hot=7).collect()))


def test_mix_empty(spark):
    df = documents(spark)
    assert mixing.mix(df.limit(0)).collect() == []
    blank = mixing.mix(df.filter("source = 'blank'")).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in blank] == [(0, 0, 0.0, 0)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(1, 6)), max_size=8, unique_by=lambda x: x[0]), st.integers(0, 400))
def test_knapsack(items, budget):
    got = mixing.knapsack(items, budget)
    assert all(0 < n <= dict(items)[size] for size, n in got.items())
    sums = {0}
    for size, n in items:
        sums = {s + size * k for s in sums for k in range(n + 1)}
    assert abs(sum(s * n for s, n in got.items()) - budget) == min(abs(s - budget) for s in sums)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 400), st.integers(1, 2000)), min_size=1, max_size=40, unique_by=lambda x: x[0]), st.floats(0, 1), st.sampled_from([100, 1000, 32_768]))
def test_fit(counts, part, reserve):
    total = sum(s * n for s, n in counts)
    budget = int(total * part)
    got = mixing.fit(counts, budget, reserve)
    assert all(0 <= n <= dict(counts)[size] for size, n in got.items())
    assert abs(sum(s * n for s, n in got.items()) - budget) <= max(s for s, _ in counts) // 2 + 1


# ---- tries


def talks(spark):
    r = random.Random(1)
    turns = [("user", "hello there"), ("assistant", "yes, how can I help"), ("user", None), (None, "so \x0b be it"), ("user", "hello"), ("", "")]
    rows = []
    for c in [*range(0, 130), -3, -20]:
        rows += [(c, t, *r.choice(turns[: 2 + t]), "x", 1) for t in range(r.randint(0, 5))]
    rows += [(c, t, *turns[t], "x", 1) for c in range(200, 260) for t in range(3)]  # one conversation again and again
    rows += [(300, t, *turns[t % 5], "x", 1) for t in range(700)] + [(301, t, *turns[t % 5], "x", 1) for t in range(690)]
    rows += [(5, None, "user", "null turn", None, None), (5, None, "user", "another", None, None), (5, 1, "user", "twice", None, None), (5, 1, "user", "twice", None, None), (None, 0, "user", "no conversation", None, None)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, path string, n_convs long").repartition(4)


def remainder(c, m):
    return c - m * int(c / m)


def nodes(rows):
    """All nodes by plain dictionaries of prefixes."""
    own = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            own[c].append(((t is not None, t or 0), role.encode(), key, text))
    own = {c: [(x[1].decode(), x[3]) for x in sorted(t)] for c, t in own.items()}
    members, ends = collections.defaultdict(set), collections.defaultdict(list)
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        seq = (*own.get(c - remainder(c, 20), [])[:h], *t[h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].add(c)
        ends[seq].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p in sorted(members, key=len, reverse=True):
        leaves[p] += not children[p]
        saved[p] += (len(members[p]) - 1) * len(words_of(p[-1][1])) if p else 0
        if p:
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
    return collections.Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], sha(p)) for p, m in members.items())


@pytest.mark.parametrize("shard,fan,chunk", [(8192, 64, 512), (30, 3, 7), (4, 2, 1)])
def test_trie(spark, shard, fan, chunk, monkeypatch):
    monkeypatch.setattr(prefixes, "CHUNK", chunk)
    df = talks(spark)
    want = nodes((r.conv_id, r.turn, r.role, r.text) for r in df.collect())
    got = prefixes.trie(prefixes.rebuilt(df), shard, fan).collect()
    assert collections.Counter(map(tuple, got)) == want


def test_trie_of_few_turns(spark):
    df = talks(spark)
    assert prefixes.trie(prefixes.rebuilt(df.limit(0))).collect() == []
    alone = prefixes.trie(prefixes.conversations(df.filter("conv_id = 200"))).collect()
    assert [(r.depth, r.n_convs, r.n_children) for r in sorted(alone, key=lambda r: r.depth)] == [(0, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 0)]


def test_tree_is_balanced():
    tree = prefixes.Tree()
    for m in prefixes.balanced(1000):
        tree.insert([m], [1], [m])

    def height(at):
        return at and 1 + max(height(tree.low[at]), height(tree.high[at]))

    assert height(tree.follows[0]) == 10
    assert [tree.number[at] for at in tree.prefix_order()] == [-1, *range(1000)]


# ---- runs


def plain_runs(w, least=12):
    """By each period, the stretches whose words are those so far before."""
    w, best = np.asarray(w), {}
    n = len(w)
    for p in range(1, n // 2 + 1):
        same = np.flatnonzero(np.diff(np.concatenate([[0], (w[:-p] == w[p:]).astype(np.int8), [0]])))
        for a, b in zip(same[::2].tolist(), same[1::2].tolist()):
            if b - a >= p and b - a + p >= least:
                best.setdefault((a, b - a + p), p)
    return sorted((a, length, p) for (a, length), p in best.items())


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 5).flatmap(lambda k: st.lists(st.integers(1, k), max_size=80)), st.integers(1, 3))
def test_runs(w, times):
    w = w * times
    assert periodic.runs(np.array(w, np.int64) - 1 if w else np.zeros(0, np.int64)) == plain_runs(w)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=40), st.lists(st.integers(0, 9), max_size=30), st.integers(2, 9), st.integers(0, 40))
def test_runs_of_repeated_words(period, before, times, cut):
    w = before + (period * times)[: max(0, len(period) * times - cut)]
    known = {x: n for n, x in enumerate(dict.fromkeys(w))}
    w = np.array([known[x] for x in w], np.int64)
    assert periodic.runs(w) == plain_runs(w)


def test_positions():
    r, got, want = random.Random(2), periodic.Positions(500_000), [500_000]
    for x in r.sample(range(400_000), 3000) + list(range(600_000, 603_000)):
        before, after = got.around(x)
        assert (before, after) == (max((y for y in want if y < x), default=None), min((y for y in want if y > x), default=None)) if len(want) < 300 else True
        got.add(x)
        want.append(x)
    assert list(got) == sorted(want) and len(got) == len(want)


def test_runs_of_long_texts():
    w = np.concatenate([np.arange(1000), np.tile(np.arange(1000, 1700), 40), np.zeros(20_000, np.int64)])
    assert periodic.runs(w) == [(1000, 28_000, 700), (29_000, 20_000, 1)]


def query_row(doc_id, text):
    words = words_of(text)
    h, n = (zlib.crc32(str(doc_id).encode()), len(words)) if doc_id is not None else (1, 0)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    number = {x: k for k, x in enumerate(dict.fromkeys(words))}
    found = plain_runs([number[x] for x in words])
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    four = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *four, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_query(spark, monkeypatch):
    sf_dir = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents", "doc_id", "text").collect()]
    got = collections.Counter(tuple(r) for r in queries.op13_periodic_runs(spark, sf_dir).collect())
    assert got == collections.Counter(query_row(*d) for d in docs)
    odd = [(None, "a b " * 20), (None, None), (1, None), (2, ""), (3, " \t\n"), (4, "x " * 5000), (4, "x " * 5000), (5, "a b " * 30), (6, "é ñ\x0b日本 " * 40), (11, "a b c d e f " * 2)]
    df = spark.createDataFrame([(*row, "y", 3) for row in odd], "doc_id long, text string, runs string, n_words long").repartition(3)
    monkeypatch.setattr(queries, "table", lambda *_: df)
    got = collections.Counter(tuple(r) for r in queries.op13_periodic_runs(spark, "").collect())
    want = collections.Counter(query_row(*d) for d in odd if d[0] is not None)
    want.update([(None, 1, 0, 40, 2, 20_000, hashlib.sha256(b"0,40,2\n").hexdigest(), hashlib.sha256(b"a b").hexdigest()), query_row(None, None)])
    assert got == want
    monkeypatch.setattr(queries, "table", lambda *_: df.limit(0))
    assert queries.op13_periodic_runs(spark, "").collect() == []
