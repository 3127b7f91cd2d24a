"""Tables that change all at once: rows are staged as files, and a manifest, put in place last, says which files count.

Under a path, data/ holds a folder for every write, manifests/ a file for every state, numbered, with the folders of each of the
path's tables. A write that dies before its manifest stands leaves the old state, whatever it had staged (vacuum() deletes that). A manifest is written
aside and renamed to its number only if that isn't taken; a writer that comes second looks again at what is there and stages only what is still new.
The store must rename without overwriting, as HDFS and local disks do.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ROWS = "rows"


class Taken(Exception):
    """Another writer has put its manifest in place first."""


def _path(spark: SparkSession, *parts: str):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join(p.strip("/") if n else p.rstrip("/") for n, p in enumerate(parts)))


def state(spark: SparkSession, path: str) -> tuple[int, dict[str, list[str]]]:
    """(number of the newest manifest, folders of each table); (0, {}) where nothing was committed."""
    folder = _path(spark, path, "manifests")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return 0, {}
    numbers = [int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit()]
    if not numbers:
        return 0, {}
    newest = max(numbers)
    (line,) = spark.read.text(_path(spark, path, "manifests", f"{newest:020d}").toString(), wholetext=True).collect()
    return newest, json.loads(line.value)


def commit(spark: SparkSession, path: str, number: int, tables: dict[str, list[str]]) -> None:
    """Puts manifest `number` in place, or raises Taken."""
    target = _path(spark, path, "manifests", f"{number:020d}")
    aside = _path(spark, path, "manifests", f"_{uuid.uuid4().hex}")
    conf = spark._jsc.hadoopConfiguration()
    fs = target.getFileSystem(conf)
    out = fs.create(aside, False)
    out.write(bytearray(json.dumps(tables, sort_keys=True).encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else fs.getUri(), conf)
    none = spark._sc._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    none[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        context.rename(aside, target, none)
    except Exception as e:
        fs.delete(aside, False)
        if "FileAlreadyExistsException" in str(e):
            raise Taken(number) from None
        raise


def _stage(rows: DataFrame, path: str) -> str:
    folder = f"data/{uuid.uuid4().hex}"
    rows.write.parquet(_path(rows.sparkSession, path, folder).toString())
    return folder


def _folders(spark: SparkSession, path: str, folders: list[str], schema: StructType) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[_path(spark, path, f).toString() for f in folders])


def read(spark: SparkSession, path: str, table: str = ROWS, schema: StructType | None = None) -> DataFrame:
    """The table's rows as the newest manifest has them. schema: needed where there may be none yet."""
    _, tables = state(spark, path)
    folders = tables.get(table, [])
    if not folders and schema is None:
        raise AnalysisException(f"no table {table} was committed under {path}")
    return _folders(spark, path, folders, schema or spark.read.parquet(_path(spark, path, folders[0]).toString()).schema)


def one_of_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key: the least of those there are, by its other columns in order; tasks pre-aggregate, so that a repeated key is no hot one. Columns that have no order, as maps, are taken from any of them."""
    others = [c for c in rows.columns if c not in keys]
    if not others:
        return rows.distinct()
    try:
        least = rows.groupBy(*keys).agg(F.min(F.struct(*others)).alias("_x"))
        return least.select(*keys, "_x.*").select(*rows.columns)
    except AnalysisException:
        return rows.dropDuplicates(keys)


def append(rows: DataFrame, path: str, keys: list[str], table: str = ROWS) -> int:
    """Adds the rows whose keys aren't there yet, one a key; the number of the state that has them. All or nothing; null keys are keys."""
    spark = rows.sparkSession
    schema = rows.schema

    def fresh(new: DataFrame, folders: list[str]) -> DataFrame:
        if not folders:
            return new
        held = _folders(spark, path, folders, schema).select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
        return new.join(held, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left_anti")

    number, tables = state(spark, path)
    known = tables.get(table, [])
    folder = _stage(fresh(one_of_key(rows, keys), known), path)
    while True:
        try:
            commit(spark, path, number + 1, tables | {table: [*tables.get(table, []), folder]})
            return number + 1
        except Taken:
            number, tables = state(spark, path)
            since = [f for f in tables.get(table, []) if f not in known]
            known = [*known, *since]
            if since:
                folder = _stage(fresh(_folders(spark, path, [folder], schema), since), path)


def replace(path: str, tables: dict[str, DataFrame], once: bool = False) -> int:
    """All given tables become these rows, in one step; others stay. once: only where none of them is there."""
    spark = next(iter(tables.values())).sparkSession
    staged = {name: [_stage(df, path)] for name, df in tables.items()}
    while True:
        number, held = state(spark, path)
        if once and set(held) & set(tables):
            raise FileExistsError(f"{path} has {', '.join(sorted(set(held) & set(tables)))} already")
        try:
            commit(spark, path, number + 1, held | staged)
            return number + 1
        except Taken:
            continue


def vacuum(spark: SparkSession, path: str) -> int:
    """Deletes folders that the newest state doesn't have; only while no one writes or reads older states. How many went."""
    _, tables = state(spark, path)
    keep = {f.rsplit("/", 1)[-1] for folders in tables.values() for f in folders}
    data = _path(spark, path, "data")
    fs = data.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = [s.getPath() for s in fs.listStatus(data) if s.getPath().getName() not in keep] if fs.exists(data) else []
    for p in gone:
        fs.delete(p, True)
    return len(gone)
