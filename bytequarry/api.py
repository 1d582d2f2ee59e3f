"""Archive, restore, profile and route: the engine's front door.

    python -m bytequarry.api archive DIR ARCHIVE [LITERAL MATCH DISTANCE] | restore ARCHIVE DIR | profile DIR | route DIR

With the three costs (bits of a literal, of a match, and for each doubling of its distance) chunks are packed by the
engine's own kernel.
"""

from __future__ import annotations

import os
import sys
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytequarry.functions.lz import ParseOptions
from bytequarry.operators import profiles, routing
from bytequarry.sources import archive as archives
from bytequarry.sources import chunks as source


def archive(
    spark: SparkSession, path: str, out: str, tags: list[str] | None = None, codec: str = "zlib-6", chunk_bytes: int = source.CHUNK_BYTES,
    options: ParseOptions = ParseOptions(),
) -> None:
    """Pack a file or directory into an archive directory; options are those of codec "kernel"."""
    spark.dataSource.register(archives.ArchiveSource)
    chunks = source.spread(source.from_files(spark, path, chunk_bytes, keep_empty=True))
    archives.pack(chunks, tags, codec, options).write.format("bytequarry").option("path", out).mode("overwrite").save()


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(rel, chunk, raw_len, transform, codec, mode, crc, payload)."""
    spark.dataSource.register(archives.ArchiveSource)
    return spark.read.format("bytequarry").option("path", path).load()


def restore(spark: SparkSession, path: str, out: str) -> int:
    """Write an archive's files below `out`, a folder that all workers share; the number of chunks. A file is written by one
    task, chunk by chunk, under another name until it is whole, so that a task can run again."""
    rows = archives.restore(read_archive(spark, path)).select("key", "chunk", "raw").repartition("key").sortWithinPartitions("key", "chunk")

    def write(batches):
        target, draft, f, written = None, None, None, 0

        def close():
            if f:
                f.close()
                os.replace(draft, target)

        for batch in batches:
            for key, chunk, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if chunk == 0:
                    close()
                    target = os.path.join(out, archives.check_name(key))
                    os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
                    draft = f"{target}.{uuid.uuid4().hex}.part"
                    f = open(draft, "wb")
                f.write(raw)
                written += 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], names=["written"])

    return rows.mapInArrow(write, "written long").agg(F.coalesce(F.sum("written"), F.lit(0))).first()[0]


def profile(spark: SparkSession, path: str, chunk_bytes: int = source.CHUNK_BYTES) -> DataFrame:
    """Measures and class of every chunk."""
    found = profiles.profile(source.spread(source.from_files(spark, path, chunk_bytes)))
    return found.withColumn("class", profiles.chunk_class())


def route(spark: SparkSession, path: str, tags: list[str], codec: str = "zlib-6", chunk_bytes: int = source.CHUNK_BYTES) -> DataFrame:
    """Every chunk's smallest candidate."""
    return routing.best(routing.candidates(source.spread(source.from_files(spark, path, chunk_bytes)), tags, codec))


def main(args: list[str]) -> int:
    spark = SparkSession.builder.appName("bytequarry").getOrCreate()
    if args[:1] == ["archive"] and len(args) == 3:
        archive(spark, args[1], args[2])
    elif args[:1] == ["archive"] and len(args) == 6:
        archive(spark, args[1], args[2], codec="kernel", options=ParseOptions(*map(float, args[3:])))
    elif args[:1] == ["restore"] and len(args) == 3:
        print(restore(spark, args[1], args[2]))
    elif args[:1] == ["profile"] and len(args) == 2:
        profile(spark, args[1]).orderBy("key", "chunk").show(100, False)
    elif args[:1] == ["route"] and len(args) == 2:
        routing.rollup_by_key(route(spark, args[1], ["BASE", "D4T4", "D16T16"])).orderBy(F.col("key").asc_nulls_last()).show(100, False)
    else:
        print(__doc__)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
