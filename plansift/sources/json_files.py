"""Folders of JSON files, one document a file, read as a table that no bad file can stop.

Files are read by Spark's own reader, so they may lie in any store; columns that aren't asked for aren't parsed, and contents aren't read at all where only a file's name,
size or time is. What a file is comes beside it: status OK with the document, NONE for a blank file (a file of no bytes gives no row), ERROR with the reason (not_utf8, invalid_json, not_an_object,
missing:field, too_large).
"""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plansift.functions import checked

LARGEST = 64 << 20
#: Bundled documents have the columns of Spark's reader of whole files.
BUNDLE = "path string, length bigint, content binary"


def read_json_files(spark: SparkSession, path: str, fields: dict[str, tuple[str, str]] | None = None, required: tuple[str, ...] = (), pattern: str = "*", largest: int = LARGEST, bundled: bool = False) -> DataFrame:
    """source_file, file_bytes, status, reason and the document: its text, or the given fields, name -> (path in the document, type), null where the file isn't OK.

    largest: files of more bytes are errors, and aren't read. Subfolders are gone through; an empty folder gives no rows. bundled: the folder is one of write_json_bundles(), and source_file a
    document's name in it.
    """
    if bundled:
        files = spark.read.schema(BUNDLE).parquet(path).filter("length > 0")
        if pattern != "*":
            files = files.filter(F.substring_index("path", "/", -1).rlike("^" + fnmatch.translate(pattern)))
    else:
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    small = F.when(F.col("length") <= largest, F.col("content")).cast("string")
    rows = files.select(F.col("path").alias("source_file"), F.col("length").alias("file_bytes"), small.alias("raw"))
    rows = rows.withColumn("text", F.when(F.is_valid_utf8("raw"), F.regexp_replace("raw", "^\\ufeff", ""))).withColumn("doc", checked.json(F.col("text"), required))
    reason = F.when(F.col("file_bytes") > largest, "too_large").when(~F.is_valid_utf8("raw"), "not_utf8").otherwise(F.col("doc.reason"))
    status = F.when(reason.isNotNull(), checked.ERROR).otherwise(F.col("doc.status"))
    ok = F.when(reason.isNull(), F.col("doc.value"))
    if fields is None:
        out: list[Column] = [F.when(status == checked.OK, F.col("text")).alias("text")]
    else:
        out = [F.try_variant_get(ok, at, kind).alias(name) for name, (at, kind) in fields.items()]
    return rows.select("source_file", "file_bytes", status.alias("status"), reason.alias("reason"), *out)


def write_json_files(texts: DataFrame, path: str, text_col: str = "value") -> None:
    """One file a row; the folder must not be there yet."""
    texts.select(F.col(text_col).alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def write_json_bundles(texts: DataFrame, path: str, name_col: str, text_col: str = "value") -> None:
    """The documents under their names, many a file, for read_json_files(bundled=True): the driver lists few files, however many documents there are. The folder must not be there yet."""
    content = F.col(text_col).cast("binary")
    texts.select(F.col(name_col).alias("path"), F.length(content).cast("bigint").alias("length"), content.alias("content")).write.parquet(path)
