"""Chunk sources: files or text columns cut into fixed-size pieces, one row each.

A chunk never spans two inputs and the last one of an input may be shorter. Cutting is a generator over a sequence
with a binary substring, so it streams and needs no shuffle. An empty or null input has no chunks.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 512 * 1024


def cut(df: DataFrame, key: str, content: Column, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(key, chunk, raw_len, raw) of a binary column."""
    if chunk_bytes < 1:
        raise ValueError("chunk_bytes must be positive")
    rows = df.select(F.col(key).alias("key"), content.cast("binary").alias("content")).where(F.octet_length("content") > 0)
    last = F.expr(f"cast((octet_length(content) - 1) div {chunk_bytes} as int)")
    rows = rows.select("key", "content", F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    raw = F.substring(F.col("content"), F.col("chunk") * chunk_bytes + 1, F.lit(chunk_bytes))
    return rows.select("key", "chunk", F.octet_length(raw).cast("long").alias("raw_len"), raw.alias("raw"))


def from_text(df: DataFrame, key: str, text: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunks of a text column's UTF-8 bytes."""
    return cut(df, key, F.encode(F.col(text), "UTF-8"), chunk_bytes)


def files(spark: SparkSession, path: str, glob: str | None = None, keep_empty: bool = False) -> DataFrame:
    """(rel, raw, content, path) of one file, or of every file under a directory; empty files only if asked for, since
    they take another look at the listing."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    found = reader.load(path)
    found = _with_empty_files(spark, found) if keep_empty else found
    root = path.split("://")[-1].strip("/") + "/"
    plain = F.regexp_replace("path", "^[a-z0-9]+:/*", "")
    # below a directory the name is what follows it; a single file goes by its own name
    below = F.when(F.startswith(plain, F.lit(root)), F.substring(plain, F.lit(len(root) + 1), F.length(plain)))
    name = F.element_at(F.split("path", "/"), -1)
    return found.select(F.coalesce(below, name).alias("rel"), F.col("length").alias("raw"), "content", "path")


def _with_empty_files(spark: SparkSession, found: DataFrame) -> DataFrame:
    """Spark's scans leave empty files out; the listing that Spark made for the scan has them."""
    names = [(re.sub("^file:/+", "file:/", unquote(n)),) for n in found.inputFiles()]
    listed = spark.createDataFrame(names, "path string").join(found.select("path"), "path", "left_anti")
    return found.select("path", "length", "content").unionByName(
        listed.select("path", F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content"))
    )


def from_files(
    spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES, glob: str | None = None, keep_empty: bool = False
) -> DataFrame:
    """Chunks of files, keyed by the name relative to `path`; with keep_empty an empty file is one empty chunk."""
    found = files(spark, path, glob, keep_empty)
    made = cut(found, "rel", F.col("content"), chunk_bytes)
    if keep_empty:
        empty = found.where("raw = 0").select(F.col("rel").alias("key"), F.lit(0).alias("chunk"), "raw", "content")
        made = made.unionByName(empty.toDF(*made.columns))
    return made


def listing(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(rel, raw), sorted by name: what an archive of `path` holds. Contents are not read."""
    return files(spark, path, glob, keep_empty=True).select("rel", "raw").orderBy("rel")


SMALL_BYTES = 256 << 20


def balance(df: DataFrame) -> DataFrame:
    """Deal a small table that lies in fewer files than there are cores out over all of them, so that a kernel does not
    run in one task. Larger tables stay as they are: a shuffle would cost more than idle cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= SMALL_BYTES and 0 < len(df.inputFiles()) < cores else df


def spread(chunks: DataFrame, partitions: int | None = None) -> DataFrame:
    """Deal chunks out evenly before an expensive kernel, so that one large file does not sit in one task."""
    n = partitions or chunks.sparkSession.sparkContext.defaultParallelism * 3
    return chunks.repartition(n, "key", "chunk")
