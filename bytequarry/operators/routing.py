"""Choice of the smallest candidate for every chunk, and what the choices add up to."""

from __future__ import annotations

import math
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bytequarry.functions import profile, transforms
from bytequarry.operators.kernel_map import map_chunks
from bytequarry.sources import codecs

FLAG_BYTES = 1  # that a choice among candidates takes in an archive

_SIZES = T.StructType([T.StructField("mode", T.IntegerType()), T.StructField("tag", T.StringType()), T.StructField("size", T.LongType())])


def _size_by(codec: str) -> Callable[[bytes], int]:
    """What a codec makes of a buffer, in bytes; "order0" stands for an ideal coder of single bytes."""
    if codec == "order0":
        return lambda data: math.ceil(round(profile.entropy(data), 6) * len(data) / 8)
    pack = codecs.get(codec)[0]
    return lambda data: len(pack(data))


def candidates(chunks: DataFrame, tags: list[str], codec: str = "zlib-6", flag_bytes: int = FLAG_BYTES) -> DataFrame:
    """(key, chunk, raw_len, mode, tag, size): every chunk in every transform, packed. A chunk's candidates are made in
    one pass over its bytes; only sizes leave the task. mode is the tag's place in `tags`."""
    for tag in tags:
        transforms.steps(tag)

    def work(raw):
        size, data = _size_by(codec), bytes(raw)
        return [(i, t, size(transforms.apply(data, t)) + flag_bytes) for i, t in enumerate(tags)]

    return map_chunks(chunks, _SIZES, work, ["raw"], ["key", "chunk", "raw_len"])


def top_lag_candidates(chunks: DataFrame, lags: list[int] = transforms.LAGS, k: int = 3, codec: str = "zlib-6") -> DataFrame:
    """candidates() of BASE and, for each chunk's k best lags, a delta and transpose at that lag."""
    def work(raw):
        data, size = bytes(raw), _size_by(codec)
        tags = ["BASE"] + [f"D{lag}T{lag}" for _, lag in profile.top_lags(data, lags, k)]
        return [(i, t, size(transforms.apply(data, t)) + FLAG_BYTES) for i, t in enumerate(tags)]

    return map_chunks(chunks, _SIZES, work, ["raw"], ["key", "chunk", "raw_len"])


def best(sizes: DataFrame, tie: str = "mode") -> DataFrame:
    """(key, chunk, raw_len, base, best_size, best_mode, best_tag, saved); of equal sizes the least `tie`: mode (the
    place in the list) or tag (by the alphabet). One aggregation, combined before its shuffle."""
    order = F.struct("size", tie)
    return (
        sizes.groupBy("key", "chunk", "raw_len")
        .agg(
            F.max(F.when(F.col("tag") == "BASE", F.col("size"))).alias("base"),
            F.min("size").alias("best_size"),
            F.min_by("mode", order).alias("best_mode"),
            F.min_by("tag", order).alias("best_tag"),
        )
        .withColumn("saved", F.col("base") - F.col("best_size"))
    )


def size_map(sizes: DataFrame) -> DataFrame:
    """(key, chunk, all): each chunk's sizes by tag."""
    return sizes.groupBy("key", "chunk").agg(F.map_from_entries(F.collect_list(F.struct("tag", "size"))).alias("all"))


def mode_histogram(chosen: DataFrame, tags: list[str], by: list[str] | None = None) -> DataFrame:
    """(by..., mode, tag, n): how often each mode won, modes that never did included."""
    spark, by = chosen.sparkSession, by or []
    modes = spark.createDataFrame(list(enumerate(tags)), "mode int, tag string")  # as many rows as there are tags
    counts = chosen.groupBy(*by, F.col("best_mode").alias("mode")).agg(F.count(F.lit(1)).alias("n"))
    every = chosen.select(*by).distinct().crossJoin(F.broadcast(modes)) if by else modes
    return every.join(counts, [*by, "mode"], "left").fillna(0, ["n"])


def rollup_by_key(chosen: DataFrame) -> DataFrame:
    """(key, raw, base, best, saved, ratio), with a last row of totals whose key is null."""
    return chosen.rollup("key").agg(
        F.sum("raw_len").alias("raw"),
        F.sum("base").alias("base"),
        F.sum("best_size").alias("best"),
        F.sum("saved").alias("saved"),
        (F.sum("best_size") / F.sum("raw_len")).alias("ratio"),
    )


def entropy_size(bits: Column, raw_len: Column) -> Column:
    """What an ideal order-0 coder would need, in bytes."""
    return F.ceil(bits * raw_len / 8)


def codec_runs(chunks: DataFrame, names: list[str], repeats: int = 1) -> DataFrame:
    """(key, chunk, raw_len, codec, run, size, comp_s, dec_s, sha_ok): timed round trips of every chunk."""
    fields = T._parse_datatype_string("codec string, run int, size long, comp_s double, dec_s double, sha_ok boolean")

    def work(raw):
        data, out = bytes(raw), []
        for name in names:
            pack, unpack = codecs.get(name)
            for run in range(repeats):
                t0 = time.perf_counter()
                packed = pack(data)
                t1 = time.perf_counter()
                same = unpack(packed) == data
                out.append((name, run, len(packed), t1 - t0, time.perf_counter() - t1, same))
        return out

    return map_chunks(chunks, fields, work, ["raw"], ["key", "chunk", "raw_len"])
