"""Toxicity scores by FTRL-proximal logistic regression over hashed n-grams and skip-grams.

A text's features are its distinct words, word pairs and word pairs with one word between them, hashed
to 2**BITS. train() takes at most ROWS labelled rows, those whose ids have the least hashes. Their
features are made on the executors; one task, of size bounded by ROWS, runs FTRL-proximal over them
(per-coordinate rates, L1 and L2) for EPOCHS passes. Features in over COMMON of the rows of label 0 are
left out, as function words say nothing and cost most. L1 leaves few weights, which are broadcast: some
hundreds or thousands, and never more than 2**BITS.

The score is the logistic function of bias plus weights over the features' counts capped at one each.
Nulls count as empty texts; an empty text scores the bias alone. Training rows without a label, a text or an id are left out;
with rows of one class alone every score is that class's, with none 0. Repeated rows give repeated rows, an empty table gives none; a text is held whole in its task.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plansift.llm.common import map_rows, slices, text_or_empty

BITS, ROWS, EPOCHS, COMMON = 20, 20_000, 5, 0.1
# chosen on rows of crc32 remainder 0, learnt from those of remainder 2
ALPHA, BETA, L1, L2 = 2.0, 1.0, 4.0, 0.1
CUT = 0.7

_LETTERS = bytes(b if b >= 128 or chr(b).isalnum() and not chr(b).isupper() or chr(b) == "'" else b + 32 if chr(b).isupper() else 32 for b in range(256))


class _Hashes(dict):
    """word -> its hash; begins anew when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = zlib.crc32(word)
        return h


class Features:
    def __init__(self, bits: int = BITS):
        self.bits, self.known = bits, _Hashes()

    def all(self, text: str) -> np.ndarray:
        """Feature numbers, with repeats."""
        known = self.known
        h = np.array([known[w] for w in text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split()], dtype=np.uint64)
        parts = [h * np.uint64(0x9E3779B97F4A7C15)]
        if len(h) > 1:
            parts.append((h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:] * np.uint64(0x165667B19E3779F9) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        if len(h) > 2:
            parts.append((h[:-2] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:] * np.uint64(0x165667B19E3779F9) + np.uint64(2)) * np.uint64(0x9E3779B97F4A7C15))
        return (np.concatenate(parts) >> np.uint64(64 - self.bits)).astype(np.int64)

    def distinct(self, text: str) -> np.ndarray:
        return np.unique(self.all(text))


class Ftrl:
    """FTRL-proximal logistic regression: z and n of each coordinate, the last of which is the bias; they live as long as the learner does."""

    def __init__(self, size: int, odds: float = 0.0, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.z[size] = -odds * beta / alpha  # so that the bias begins at these log odds

    def weights(self, at: np.ndarray) -> np.ndarray:
        """The weights of coordinates; the bias, which has no penalty, must come last."""
        z, rate = self.z[at], (self.beta + np.sqrt(self.n[at])) / self.alpha
        w = np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / (rate + self.l2))
        w[-1] = -z[-1] / rate[-1]
        return w

    def learn(self, x: np.ndarray, y: int) -> None:
        """One row: its distinct features and its label."""
        x = np.append(x, len(self.z) - 1)
        w, n = self.weights(x), self.n[x]
        g = 1 / (1 + math.exp(-max(-35.0, min(35.0, w.sum())))) - y
        self.z[x] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[x] = n + g * g


def train(docs: DataFrame, labels: DataFrame, keep: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = ROWS, epochs: int = EPOCHS, bits: int = BITS, common: float = COMMON) -> tuple[np.ndarray, np.ndarray, float]:
    """(feature numbers, their weights, bias). keep: which ids may be learnt from, as a condition on _id."""
    spark = docs.sparkSession
    found = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_y")).filter("_id is not null and _y in (0, 1)")
    if keep is not None:
        found = found.filter(keep)
    chosen = found.groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    marked = {r["_id"]: r["_y"] for r in chosen.collect()}  # at most `rows` ids and labels
    if not marked:
        return np.zeros(0, np.int64), np.zeros(0), -35.0
    mean = sum(marked.values()) / len(marked)
    odds = math.log(max(mean, 1e-15) / max(1 - mean, 1e-15))
    if mean in (0.0, 1.0):
        return np.zeros(0, np.int64), np.zeros(0), odds
    held = spark.sparkContext.broadcast(marked)

    def select(batches):
        features = Features(bits)
        for got in batches:
            yield [(k, held.value[k], features.distinct(t).astype(np.int32).tobytes()) for k, t in got if k in held.value and t is not None]

    def learn(batches):
        # flat: the rows' features one after another, so that what a task holds is their 4 bytes each
        found: list[tuple[int, int, int, int, bytes]] = []
        for b in batches:
            for k, y, x in zip(*(c.to_pylist() for c in b.columns)):
                found.append((zlib.crc32(f"order {k}".encode()), k, y, x))
        found.sort()
        found = [r for r, before in zip(found, [None, *found]) if before is None or r[1] != before[1]]
        size = 1 << bits
        count, clean = np.zeros(size, np.int32), sum(y == 0 for _, _, y, _ in found)
        for _, _, y, x in found:
            if y == 0:
                count[np.frombuffer(x, np.int32)] += 1
        use = count <= max(1.0, common * clean)
        rows = []
        while found:  # the features left take the place of all
            _, _, y, x = found.pop()
            x = np.frombuffer(x, np.int32)
            rows.append((x[use[x]], y))
        rows.reverse()
        model = Ftrl(size, odds)
        for _ in range(epochs):
            for x, y in rows:
                model.learn(x, y)
        w = model.weights(np.arange(size + 1))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w[at], pa.float64())], ["feature", "weight"])

    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_t"))
    sample = map_rows(texts, select, "id long, y int, x binary")
    got = sample.repartition(1).mapInArrow(learn, "feature long, weight double").toPandas()  # at most `rows` rows meet in this task
    bias = got.feature == 1 << bits
    return got.feature[~bias].to_numpy(np.int64), got.weight[~bias].to_numpy(float), float(got.weight[bias].sum()) if len(got) else odds


class _Scorer:
    """Scores of texts by a model."""

    def __init__(self, model: tuple[np.ndarray, np.ndarray, float], bits: int):
        at, w, self.bias = model
        self.weights, self.features = np.zeros(1 << bits, np.float32), Features(bits)
        self.weights[at] = w

    def __call__(self, text: str) -> float:
        x = self.features.all(text)
        x = np.unique(x[self.weights[x] != 0])
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, self.bias + float(self.weights[x].sum(dtype=float))))))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """doc_id, score of every whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = _Scorer(held.value, bits)
        for rows in batches:
            yield [(k, scorer(t)) for k, t in rows]

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return map_rows(rows, run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text_col: str = "text", cut: float = CUT, bits: int = BITS) -> DataFrame:
    """The rows of docs, with all their columns, that score below cut."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = _Scorer(held.value, bits)
        for t in texts:
            yield pa.array([scorer(x) for part in slices(t) for x in part.to_pylist()], pa.float64())

    return docs.filter(scored(text_or_empty(text_col)) < cut)


def held_out(id_col: Column) -> Column:
    """Rows that a model must not learn from: crc32 of the id as text leaves 1 by 3."""
    return F.crc32(id_col.cast("string").cast("binary")) % 3 == 1


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, learnt from the rows that aren't held out. A null id is not held out."""
    model = train(docs, labels, keep=~held_out(F.col("_id")))
    return score(docs, model).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
