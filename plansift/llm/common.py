"""What the corpus operators share: table access, intermediate tables in the shared folder, Arrow helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plansift.sources.shared import cut, discard, shared_dir  # noqa: F401

SLICE, BYTES, SENT = 512, 4 << 20, 500_000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The given columns (all, if none) of a table under sf_dir; sf_dir may be any path Spark reads."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def small(df: DataFrame, rows: int = SENT) -> DataFrame:
    """A table that was cut(), marked to be sent to all tasks if it holds at most that many rows (of a few numbers each); else as it is."""
    return F.broadcast(df) if df.count() <= rows else df


def slices(batch: pa.RecordBatch | pa.Array) -> Iterator:
    """Parts of at most SLICE rows and, but for single rows, BYTES bytes, so that few rows at a time stand in memory as Python values."""
    n = len(batch)
    if n <= 1 or n <= SLICE and batch.nbytes <= BYTES:
        yield batch
    else:
        yield from slices(batch.slice(0, n // 2))
        yield from slices(batch.slice(n // 2))


def map_rows(df: DataFrame, fn: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """Run fn over each partition's rows as tuples, a slice of an Arrow batch at a time.

    fn gets an iterator of lists of tuples (one list a slice) and yields lists of tuples.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema), prefers_large_types=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for part in slices(b) if b.num_rows else ():
                    yield list(zip(*(c.to_pylist() for c in part.columns)))

        for out in fn(rows()):
            if out:
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


_SPACE = r"\x20\x09-\x0D"


def word_count(text: Column) -> Column:
    """Words between ASCII white space; 0 for a null. No array of them is built: each word's first letter and the blank before it are cut out and counted."""
    padded = F.concat(F.lit(" "), F.coalesce(text.cast("string"), F.lit("")))
    return F.floor((F.length(padded) - F.length(F.regexp_replace(padded, f"[{_SPACE}][^{_SPACE}]", ""))) / 2).cast("long")
