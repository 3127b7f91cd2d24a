"""The pipeline's stages and the registered queries on the smallest tables."""

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

from plansift.llm import queries

SF, BIG = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_stages(spark):  # the smallest tables have too few toxic documents to learn from
    from plansift.llm.common import cut, table

    docs = table(spark, BIG, "documents")
    columns, left = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = cut(stage(spark, docs, BIG))
        left.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert left[1] < left[0] and left[2] < left[1] and left[3] == left[2] and left[4] >= left[3]


def test_stages_on_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (2, "a b c d e f g", "en", "s", 13), (3, "a b c d e f g", None, "s", None), (3, "a b c d e f g", None, "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs.limit(0), SF).count()
        docs = stage(spark, docs, SF)
        assert docs.filter("doc_id = 2").count() == 1
    assert docs.filter("doc_id = 3").count() == 0 and docs.filter("doc_id is null").count() == 1


def test_run_by_brute_force(spark, tmp_path):
    import collections
    import random

    from plansift.llm import jaccard, packing, pii, toxicity

    r = random.Random(8)
    words = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("ana", "ore", "ito", "ula", "emi")]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    texts = []
    for i in range(160):
        t = prose(r.randint(40, 90))
        if i % 3 == 0:
            t += " vile nasty scum"
        elif i % 8 == 1:
            t += f" mail a{i}@example.org, or +1 (988) 555-{2000 + i}"
        texts.append(t)
    for i in range(20):
        texts.append(texts[i] if i % 2 else texts[i].replace(texts[i].split()[3], "other", 1))
    texts += ["", None, prose(9000)]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(160)], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs, labels = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    score = toxicity._Scorer(toxicity.train(docs, labels, keep=~toxicity.held_out(F.col("_id"))), toxicity.BITS)
    kept = [(i, t) for i, t in enumerate(texts) if score(t or "") < toxicity.CUT]
    assert {i for i, _ in kept if i < 160} == {i for i in range(160) if i % 3}
    shingler, chosen, sets = jaccard.Shingler(), [], {}
    for i, t in kept:  # in order of id, so the first of a component comes first
        s = sets[i] = frozenset(shingler.set_of(t or "").tolist())
        chosen.append(i)
    up = {i: i for i in chosen}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, i in enumerate(chosen):
        for j in chosen[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    left = {i for i in chosen if find(i) == i}
    assert len(left) < len(chosen)
    weights = pii.train(docs.filter(F.col("doc_id").isin(*left)))
    masked = {r.doc_id: r.text or "" for r in pii.redact(docs.filter(F.col("doc_id").isin(*left)), weights).collect()}
    for i, t in masked.items():
        assert "@example.org" not in t and ("[EMAIL]" in t) == ("@example.org" in (texts[i] or ""))
    pieces = collections.defaultdict(list)
    for p in got:
        pieces[p.doc_id].append((p.start, p.text))
        assert len(p.text) == p.length
    assert {i: "".join(t for _, t in sorted(ps)) for i, ps in pieces.items()} == masked
    filled = collections.Counter()
    for p in got:
        filled[p.shard, p.bin] += p.n_tokens
    assert max(filled.values()) <= packing.CAPACITY and all(filled[p.shard, p.bin] == p.bin_tokens for p in got)


@pytest.mark.parametrize("name", [*queries.QUERIES])
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    got = df.collect()
    assert got
    if name in queries.ORACLE_SQL:
        con = duckdb.connect()
        for t in ("pages", "conversations"):
            con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        found = con.execute(queries.ORACLE_SQL[name])
        names = [c[0] for c in found.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(tuple(r[n] for n in names) for r in got) == sorted(found.fetchall()) or sorted((tuple(r[n] for n in names) for r in got), key=repr) == sorted(found.fetchall(), key=repr)
