"""The registered queries of the corpus operators, and SQL where it can express them."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plansift.llm import bpe, fingerprints, html, jaccard, licenses, mixing, neighbours, packing, periodic, pii, prefixes, toxicity, warc
from plansift.llm.common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and how near it is to that and to the next document."""
    return fingerprints.compare_with_edit(table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and licence texts in every document."""
    return licenses.scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: the rules' spans, and those that the field adds."""
    return pii.find(table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth one."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 50 == 0)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces, packed into sequences."""
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text", "source")).drop("row_hash")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score; learnt from labels of rows that aren't held out."""
    return toxicity.classify(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of near duplicates."""
    return jaccard.join(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's visible text."""
    return html.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"), keep=("url",))


def op9_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record in the archives written from all pages, read back and merged."""
    found = warc.archive(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    got = bpe.encode(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path(), decoded=True)
    return got.select("doc_id", "n_tokens", F.sha2(F.col("ids_text").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document a mix of 150 % of all words takes."""
    return mixing.mix(table(spark, sf_dir, "documents", "doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of conversations, each of which begins with some turns of its twenty's first one."""
    return prefixes.trie(prefixes.rebuilt(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")))


def repeated(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """A tenth of all documents, by the hash of their id, go on from some word with a few words again and again."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of words in every document, a tenth of which are made to repeat themselves, and what is left without repetitions."""
    got = periodic.find(table(spark, sf_dir, "documents", "doc_id", "text"), change=repeated)
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    length = -best["less"]
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return got.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), length.alias("length"), best["period"].alias("period"), F.floor(1000 * length / best["period"]).alias("exponent_milli"),
        sha(lines).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_fingerprints, op2_license_scan, op3_personal_data, op4_nearest_neighbours, op5_best_fit_packing, op6_toxicity, op7_ngram_jaccard_join, op8_html_extraction, op9_warc_index, op10_bpe, op11_source_mix, op12_prefix_trie,
        op13_periodic_runs,
    )
}

ORACLE_SQL = {
    "op9_warc_index": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS payload, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
        m AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY payload) END AS original FROM p)
        SELECT m.page_id, m.n AS payload_bytes, sha1(m.payload) AS payload_digest,
               CASE WHEN m.original <> m.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN m.original <> m.page_id THEN m.original END AS refers_to
        FROM m""",
    "op12_prefix_trie": r"""
        WITH own AS (
            SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS turns
            FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
        hashed AS (
            SELECT *, CAST((list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                lambda c, byte: list_reduce(list_prepend(xor(c, byte), [CAST(0 AS BIGINT) FOR i IN range(8)]), lambda v, bit: CASE WHEN v % 2 = 1 THEN xor(v // 2, CAST(3988292384 AS BIGINT)) ELSE v // 2 END))) AS BIGINT) AS reg FROM own),
        convs AS (
            SELECT a.conv_id, list_concat(coalesce(b.turns, [])[1 : xor(a.reg, CAST(4294967295 AS BIGINT)) % 4], a.turns[xor(a.reg, CAST(4294967295 AS BIGINT)) % 4 + 1 :]) AS turns
            FROM hashed a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 20),
        begun AS (SELECT conv_id, turns, d, turns[1 : d] AS path FROM convs, unnest(range(len(turns) + 1)) AS t(d)),
        node AS (
            SELECT path, d, min(conv_id) AS conv_id, count(*) AS n, any_value(CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(path[d].text, '[^\x20\x09-\x0D]+')) END) AS words,
                   sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(turns) = d), '')) AS ends
            FROM begun GROUP BY path, d),
        child AS (SELECT path[1 : d - 1] AS up, d - 1 AS upd, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1, 2),
        full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN child ON child.up = node.path AND child.upd = node.d),
        above AS (SELECT path[1 : u] AS up, u, CASE WHEN n_children = 0 THEN 1 ELSE 0 END AS leaf, (n - 1) * words AS saved FROM full_node, unnest(range(d + 1)) AS t(u)),
        sums AS (SELECT up, u, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY up, u)
        SELECT x.conv_id, x.d AS depth, p.conv_id AS parent_conv_id, x.n AS n_convs, x.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, x.ends AS ends_sha256
        FROM full_node x JOIN sums s ON s.up = x.path AND s.u = x.d LEFT JOIN node p ON x.d > 0 AND p.d = x.d - 1 AND p.path = x.path[1 : x.d - 1]""",
}
