"""Contracts recomputed in plain Python from the given tables."""

import re

from plansift.llm import queries, warc
from plansift.llm.common import table

SF = "/root/testdata/sf0.01"
#: The phrases that every licence scan looks for.
PHRASES = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
LOWER = {c: c + 32 for c in range(65, 91)}


def test_license_base_columns(spark):
    texts = {r.doc_id: r.text or "" for r in table(spark, SF, "documents", "doc_id", "text").collect()}
    rows = queries.op2_license_scan(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    some = 0
    for r in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", texts[r.doc_id].translate(LOWER))
        at = [(i, label) for i in range(len(words)) for phrase, label in PHRASES.items() if tuple(words[i : i + len(phrase)]) == phrase]
        places = [i for i, _ in at]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(at), min(places, default=None), max(places, default=None))
        assert r.base_labels == ",".join(sorted({label for _, label in at})) and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
        some += bool(at)
    assert some >= 10


def test_likeness_is_that_of_the_fingerprints_shown(spark):
    rows = sorted(queries.op1_fingerprints(spark, SF).collect(), key=lambda r: r.doc_id)
    hashes = lambda f: {x.partition(":")[0] for x in f.split(",")} - {""}

    def near(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    for r, after in zip(rows, [*rows[1:], rows[0]]):
        own = hashes(r.fingerprint)
        assert abs(r.near_edited - near(own, hashes(r.edited_fingerprint))) < 1e-12
        assert abs(r.near_next - near(own, hashes(after.fingerprint))) < 1e-12


def test_a_shuffle_hands_on_sorted_pieces(spark, tmp_path):
    """A range gets about a piece an archive that feeds it, not rows in any order, so that merging them is all there is to do."""
    pages = table(spark, SF, "pages", "page_id", "url", "html").limit(400)
    warc.write(pages, f"file://{tmp_path}/w", per_archive=40)
    captures = warc.read(spark, f"file://{tmp_path}/w")
    captures.write.parquet(f"{tmp_path}/captures")
    held = spark.read.parquet(f"{tmp_path}/captures")
    dealt = [list(map(warc._order, p)) for p in held.repartitionByRange(3, "url_key", "captured", "page_id").rdd.glom().collect()]
    for part in dealt:
        assert len(part) > 50 and sum(a > b for a, b in zip(part, part[1:])) <= 12
    rows = [tuple(r) for r in warc.index(held, 100).collect()]
    assert rows == sorted(rows, key=warc._order) and len(rows) == pages.count()
