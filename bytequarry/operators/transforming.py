"""Byte transforms of chunks, as bytes (Arrow and NumPy) and as rows of single bytes (DataFrame functions)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bytequarry.functions import transforms
from bytequarry.operators.kernel_map import map_arrays, map_chunks

_OUT = T.StructType([T.StructField("mode", T.StringType()), T.StructField("payload", T.BinaryType())])


def transformed(chunks: DataFrame, *names: str) -> DataFrame:
    """(key, chunk, raw_len, mode, payload): one row for each chunk and transform."""
    for name in names:
        transforms.steps(name)
    return map_chunks(chunks, _OUT, lambda raw: [(n, transforms.apply(bytes(raw), n)) for n in names], ["raw"], ["key", "chunk", "raw_len"])


def restored(payloads: DataFrame) -> DataFrame:
    """(key, chunk, raw_len, mode, raw) of (key, chunk, raw_len, mode, payload)."""
    fields = T.StructType([T.StructField("raw", T.BinaryType())])
    work = lambda mode, payload, n: [(transforms.undo(bytes(payload), mode, n),)]
    return map_chunks(payloads, fields, work, ["mode", "payload", "raw_len"], ["key", "chunk", "raw_len", "mode"])


# --- rows of bytes: (key, chunk, pos, v) -------------------------------------------------------------


def byte_rows(chunks: DataFrame) -> DataFrame:
    """(key, chunk, pos, v): for inspection and small inputs; it makes a row of every byte."""
    work = lambda raw: (np.arange(len(raw), dtype=np.int32), np.frombuffer(raw, np.uint8))
    return map_arrays(chunks, T._parse_datatype_string("pos int, v int"), work, ["key", "chunk"])


def _ordered(*more: Column):
    return Window.partitionBy("key", "chunk", *more).orderBy("pos")


def rows_delta(rows: DataFrame, lag: int) -> DataFrame:
    before = F.lag("v", lag).over(_ordered())
    return rows.withColumn("v", F.when(before.isNull(), F.col("v")).otherwise(F.pmod(F.col("v") - before, F.lit(256))))


def rows_undo_delta(rows: DataFrame, lag: int) -> DataFrame:
    return rows.withColumn("v", (F.sum("v").over(_ordered(F.col("pos") % lag)) % 256).cast("int"))


def rows_xor(rows: DataFrame, lag: int) -> DataFrame:
    before = F.lag("v", lag).over(_ordered())
    return rows.withColumn("v", F.when(before.isNull(), F.col("v")).otherwise(F.col("v").bitwiseXOR(before)))


def rows_undo_xor(rows: DataFrame, lag: int) -> DataFrame:
    return rows.withColumn("v", F.bit_xor("v").over(_ordered(F.col("pos") % lag)))


def rows_transpose(rows: DataFrame, width: int, undo: bool = False) -> DataFrame:
    n = F.count(F.lit(1)).over(Window.partitionBy("key", "chunk"))
    return _moved(rows.withColumn("n", n), width, undo)


def _moved(rows: DataFrame, width: int, undo: bool) -> DataFrame:
    height = F.expr(f"n div {width}")
    if undo:
        to = F.expr(f"(pos % (n div {width})) * {width} + pos div (n div {width})")
    else:
        to = F.expr(f"(pos % {width}) * (n div {width}) + pos div {width}")
    pos = F.when(F.col("pos") < height * width, to).otherwise(F.col("pos")).cast("int")
    return rows.withColumn("pos", pos).drop("n")


def from_rows(rows: DataFrame) -> DataFrame:
    """(key, chunk, raw) of rows of bytes."""
    one = F.struct("pos", F.lpad(F.hex("v"), 2, "0").alias("h"))
    joined = F.array_join(F.col("sorted.h"), "")
    return rows.groupBy("key", "chunk").agg(F.sort_array(F.collect_list(one)).alias("sorted")).select("key", "chunk", F.unhex(joined).alias("raw"))
