"""Documents: sections, chunks, and their retrieval by vector, words and focus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plansift.functions.text import words
from plansift.operators import blocks
from plansift.sources import committed
from plansift.sources.json_layouts import first_said, is_object, stringify

CHUNK, OVERLAP, SEPARATORS = 800, 120, ("\n\n", "\n", ". ", " ", "")
CANDIDATES, KEPT, BLOCK, BLOCKS, PART = 20, 5, 256, 16, 4096
#: So many texts of a batch are turned into Python strings at a time.
SLICE = 256

# What a content type is worth by itself.
PRIORITY = {
    "overview": 1.00, "summary": 1.00, "religious_significance": 1.00, "spiritual_significance": 0.98, "sthala_puranam": 0.98, "history": 0.98,
    "faq": 0.96, "festivals": 0.95, "rituals": 0.95, "special_poojas": 0.95, "architecture": 0.90, "architectural_style": 0.90, "temple_layout": 0.88,
    "travel": 0.75, "travel_tips": 0.65, "nearby_places": 0.55, "nearby_infrastructure": 0.55, "audio": 0.85,
}
OTHER_PRIORITY = 0.70

# The vocabularies that a question's focus is read from.
FOCUS = {
    "timing": "timing timings time times hours opening opens open closing closes darshan visiting visit".split(),
    "access": "reach route travel airport railway station bus distance directions".split(),
    "festival": "festival festivals jathara utsavam celebration celebrations".split(),
    "history": "history built construction constructed inaugurated founded foundation founder founders".split(),
    "religious": "deity god goddess religious spiritual significance worship ritual rituals pooja puja".split(),
    "facility": "facility facilities parking water shops amenities".split(),
}
# The narrative fields of a record, which become documents; all other fields are operational facts.
NARRATIVE = (
    "overview summary sthala_puranam religious_significance spiritual_significance architecture architectural_style history temple_layout rituals "
    "special_poojas festivals travel travel_tips best_time_to_visit accommodation accessibility nearby_places nearby_infrastructure healing_beliefs "
    "miracles_and_devotee_experiences faq audio"
).split()

TIMING_PHRASES = ("temple timings", "darshan timings", "darshan time", "opening hours", "visiting hours", "temple hours")


def lines(docs: DataFrame, key: str, text_col: str, separator: str = "\n") -> DataFrame:
    """key, pos, section, content: a row a non-blank line of a text."""
    rows = docs.select(key, F.posexplode(F.split(text_col, separator)).alias("pos", "content"))
    return rows.filter(F.trim("content") != "").select(key, "pos", F.format_string("line[%d]", "pos").alias("section"), "content")


def sections(records: DataFrame, text_col: str = "value", fields: tuple[str, ...] = tuple(NARRATIVE)) -> DataFrame:
    """Documents of JSON records (text): the record's other columns, temple_id, name, content_type, pos, section, content, last_verified.

    A list gives a row an item, named by its title, name, heading or section, else field[i]; anything else one row named as its field. Fields that
    aren't listed, what is empty, and records without an id or a name (see quarantine) give none. Keys stay in the record's order.
    """
    text, v = F.col(text_col), F.col("_v")
    other = [c for c in records.columns if c != text_col]

    def of(field: str, said: Column) -> Column:
        one = F.try_variant_get(v, f"$.{field}", "variant")
        listed = F.try_variant_get(v, f"$.{field}", "array<variant>")
        each = F.from_json(said, "array<string>")  # what isn't a string, as its JSON text
        title = lambda x: F.when(is_object(x), first_said(x, "$.title", "$.name", "$.heading", "$.section"))
        # a variant would bring an object's keys into another order; of strings it has the quotes
        json = lambda x, own: F.when(F.schema_of_variant(x) == "STRING", F.to_json(x)).otherwise(own)
        row = lambda pos, section, json: F.struct(F.lit(field).alias("content_type"), pos.alias("pos"), section.alias("section"), json.alias("json"))
        items = F.transform(listed, lambda x, i: row(i, F.coalesce(title(x), F.format_string(f"{field}[%d]", i)), json(x, F.get(each, i))))
        alone = F.when(one.isNotNull(), F.array(row(F.lit(0), F.lit(field), json(one, said))))
        return F.coalesce(items, alone, F.array().cast("array<struct<content_type:string,pos:int,section:string,json:string>>"))

    # the text is gone through twice, however many fields there are; a record's rows come from one array, which no filter repeats
    said = [f"_f{n}" for n in range(len(fields))]
    rows = records.withColumn("_v", F.try_parse_json(text)).select(*other, "_v", F.json_tuple(text, *fields).alias(*said))
    known = {"temple_id": first_said(v, "$.temple_id"), "name": first_said(v, "$.name"), "last_verified": first_said(v, "$.last_verified")}
    found = F.when(known["temple_id"].isNotNull() & known["name"].isNotNull(), F.flatten(F.array(*map(of, fields, map(F.col, said)))))
    rows = rows.select(*other, *[c.alias(n) for n, c in known.items()], found.alias("_s"))
    rows = rows.select(*other, *known, F.explode_outer("_s").alias("s")).filter("s is not null")
    shown = rows.select(*other, "temple_id", "name", "s.content_type", "s.pos", "s.section", stringify(F.col("s.json")).alias("content"), "last_verified")
    return shown.filter("content <> ''")


def split_text(text: str, size: int = CHUNK, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most size characters: cut at the first separator that occurs, pieces merged up to size with the tail of the chunk before as overlap."""
    at = next((k for k, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    sep, rest = separators[at], separators[at + 1 :]
    if sep:
        head, *tail = text.split(sep)
        pieces = [p for p in [head, *(sep + t for t in tail)] if p]
    else:
        pieces = list(text)
    out: list[str] = []
    small: list[str] = []
    for p in pieces:
        if len(p) < size:
            small.append(p)
            continue
        out += _merge(small, size, overlap)
        small = []
        out += split_text(p, size, overlap, rest) if rest else [p]
    return out + _merge(small, size, overlap)


def _merge(pieces: list[str], size: int, overlap: int) -> list[str]:
    out: list[str] = []
    held: list[str] = []
    first = total = 0
    for p in pieces:
        if held[first:] and total + len(p) > size:
            if chunk := "".join(held[first:]).strip():
                out.append(chunk)
            while first < len(held) and (total > overlap or total + len(p) > size):
                total -= len(held[first])
                first += 1
        held.append(p)
        total += len(p)
    if chunk := "".join(held[first:]).strip():
        out.append(chunk)
    return out


def chunks(docs: DataFrame, key: str, text_col: str) -> DataFrame:
    """key, chunk_index, chunk: every text's chunks in order; a null or blank text has none."""

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, chunk_index int, chunk string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, SLICE):
                some = b.slice(low, SLICE)
                at, index, found = [], [], []
                for n, t in enumerate(some.column(1).to_pylist()):
                    for i, c in enumerate(split_text(t) if t else ()):
                        at.append(n)
                        index.append(i)
                        found.append(c)
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(at, pa.int64())), pa.array(index, pa.int32()), pa.array(found, pa.string())], ["key", "chunk_index", "chunk"])

    return docs.select(key, text_col).mapInArrow(run, schema).withColumnRenamed("key", key)


def append_new(chunk_rows: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """What of chunk_rows isn't yet in kept, by key and chunk_index, each once."""
    return committed.one_of_key(chunk_rows, [key, "chunk_index"]).join(kept.select(key, "chunk_index").distinct(), [key, "chunk_index"], "left_anti")


def ingest(chunk_rows: DataFrame, path: str, key: str) -> int:
    """Appends chunks to the store at path, which the first call creates; a chunk that is there already, or twice in a call, is stored once. All at once or not at all (see sources.committed)."""
    return committed.append(chunk_rows, path, [key, "chunk_index"])


def _norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def embed(docs: DataFrame, text_col: str, model, batch: int = 32, column: str = "v") -> DataFrame:
    """docs with the unit vectors of their texts. model: a function of a list of `batch` texts at most that gives a vector each; it is sent to the tasks. A vector of zeros stays as it is; null texts count as empty."""

    @F.arrow_udf("array<double>")
    def vectors(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            out: list = []
            for low in range(0, len(texts), batch):
                some = []
                for v in model([t or "" for t in texts.slice(low, batch).to_pylist()]):
                    norm = sum(x * x for x in v) ** 0.5
                    some.append([x / norm for x in v] if norm else list(v))
                out.append(pa.array(some, pa.list_(pa.float64())))
            yield pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.float64()))

    return docs.withColumn(column, vectors(F.col(text_col).cast("string")))


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int, group: str | None = None) -> DataFrame:
    """query_id, vec_id, score, rank: exact cosine search of a set of queries (query_id, q) over all vectors (vec_id, v).

    Vectors are dealt to parts of about PART, queries to bundles of about BLOCKS blocks; a bundle meets a part in a task, which scores a block of BLOCK at once, as a matrix product,
    and hands on each query's k best of the part. Vectors of another length than a query's aren't compared to it. group: a column of both tables; a query searches the vectors of its group alone.
    """
    v = vectors.withColumn("v", F.col("v").cast("array<double>")).filter(F.size("v") > 0).withColumn("n", _norm(F.col("v"))).filter("n > 0")
    q = queries.withColumn("q", F.col("q").cast("array<double>")).withColumn("m", _norm(F.col("q"))).filter("m > 0").withColumn("q", F.transform("q", lambda x: x / F.col("m")))
    of = [] if group is None else [group]
    if group is not None:
        q = q.filter(F.col(group).isNotNull())
    bundles, parts = max(1, -(-queries.count() // (BLOCK * BLOCKS))), max(1, -(-vectors.count() // PART))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    v = v.select(*of, "vec_id", "v", "n", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).alias("part"), every(bundles).alias("bundle"))
    q = q.select(*of, "query_id", "q", F.pmod(F.xxhash64("query_id"), F.lit(bundles)).alias("bundle"), every(parts).alias("part"))
    block, by = BLOCK, [*of, "bundle", "part"]

    def score(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = [[], [], []]
        if asked.num_rows and held.num_rows:
            asked, held = asked.combine_chunks(), held.combine_chunks()
            norm, order = held["n"].to_numpy(), blocks.order_of(held["vec_id"].combine_chunks())
            of_length = {size: (at, y) for size, at, y in blocks.by_length(asked["q"].combine_chunks())}
            for size, at, x in blocks.by_length(held["v"].combine_chunks()):
                q_at, y = of_length.get(size, ((), ()))
                for low in range(0, len(q_at), block):
                    some, n = y[low : low + block], norm[at]
                    with np.errstate(all="ignore"):
                        rows, columns, s = blocks.k_best(some @ x.T / n, lambda i, j: (x[j] * some[i]).sum(axis=1) / n[j], order[at], k)  # noqa: B023
                    for o, a in zip(out, (q_at[low + rows], at[columns], s)):
                        o.append(a)
        i, j, s = (np.concatenate(o or [np.zeros(0, int)]) for o in out)
        return pa.table({"query_id": asked["query_id"].take(pa.array(i)), "vec_id": held["vec_id"].take(pa.array(j)), "score": pa.array(s, pa.float64())})

    kinds = [f"{c} {df.schema[c].dataType.simpleString()}" for df, c in ((q, "query_id"), (v, "vec_id"))]
    scored = q.groupBy(*by).cogroup(v.groupBy(*by)).applyInArrow(score, ", ".join([*kinds, "score double"]))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def lexical(query: Column, content: Column, meta: Column) -> Column:
    """0.6 of the question's words in the content, 0.2 in the metadata, 0.2 for the phrase as a whole."""
    q = words(query)
    share = lambda c: F.size(F.array_intersect(q, words(c))) / F.size(q)
    phrase = F.trim(F.regexp_replace(F.lower(query), r"(?U)\s+", " "))
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(share(content) * 0.60 + share(meta) * 0.20 + F.when((phrase != "") & F.contains(F.lower(content), phrase), 0.20).otherwise(0.0))


def focus(query: Column, content: Column, kind: Column) -> Column:
    """How far a text answers to what the question is about, 0 to 2."""
    q, d = words(query), words(content)
    sets = {k: F.array(*map(F.lit, v)) for k, v in FOCUS.items()}
    asks = {k: F.arrays_overlap(q, s) for k, s in sets.items()}
    none = F.array().cast("array<string>")
    terms = F.array_distinct(F.concat(*[F.when(asks[k], s).otherwise(none) for k, s in sets.items()]))
    hit = F.size(F.array_intersect(terms, d))
    has = lambda k: F.arrays_overlap(d, sets[k])
    add = lambda c, x: F.when(c, x).otherwise(0.0)
    both = lambda w: F.array_contains(q, w) & F.array_contains(d, w)
    said = F.lower(content)
    phrase = F.lit(False)
    for p in TIMING_PHRASES:
        phrase = phrase | F.contains(said, F.lit(p))
    low = F.lower(kind)
    score = (
        hit / F.size(terms)
        + add(asks["timing"] & has("timing"), 0.35) + add(asks["timing"] & (low == "faq"), 0.20) + add(asks["timing"] & both("darshan"), 0.25)
        + add(asks["timing"] & F.arrays_overlap(q, F.array(F.lit("timing"), F.lit("timings"), F.lit("hours"))) & phrase, 0.50)
        + add(asks["festival"] & has("festival"), 0.35) + add(asks["festival"] & low.isin("faq", "festivals", "best_time_to_visit"), 0.15)
        + add(asks["history"] & has("history"), 0.35) + add(asks["history"] & (low == "history"), 0.20)
        + add(asks["access"] & has("access"), 0.35) + add(asks["access"] & low.isin("travel", "travel_tips", "nearby_infrastructure", "faq"), 0.15)
    )
    return F.when((F.size(terms) == 0) | (hit == 0), F.lit(0.0)).otherwise(F.least(score, F.lit(2.0)))


def priority(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    return F.coalesce(table[kind], F.lit(OTHER_PRIORITY))


def rerank(found: DataFrame, k: int = KEPT) -> DataFrame:
    """found (query_id, vec_id, score, question, content, meta, kind) with final, cut to the k best of a query."""
    final = F.col("score") * 0.55 + lexical(F.col("question"), F.col("content"), F.col("meta")) * 0.20 + focus(F.col("question"), F.col("content"), F.col("kind")) * 0.20 + priority(F.col("kind")) * 0.05
    w = Window.partitionBy("query_id").orderBy(F.desc("final"), "vec_id")
    return found.withColumn("final", F.round(final, 6)).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
