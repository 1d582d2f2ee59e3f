"""Files that arrive in a directory, chunked and profiled as a stream.

The same chunk and profile operators as for tables; state is kept only by windowed(), one row for each open window and
class, and bounded by the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bytequarry.operators import profiles
from bytequarry.sources import chunks as source

SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)


def arriving(spark: SparkSession, path: str, files_per_trigger: int = 1000, glob: str | None = None) -> DataFrame:
    """A stream of (path, modificationTime, length, content)."""
    reader = spark.readStream.format("binaryFile").schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
    reader = reader.option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def chunk_classes(files: DataFrame, chunk_bytes: int = source.CHUNK_BYTES) -> DataFrame:
    """(path, arrived, chunk, raw_len, class) of a stream or table of files."""
    keyed = files.select(F.struct("path", F.col("modificationTime").alias("arrived")).alias("file"), "content")
    found = profiles.profile(source.cut(keyed, "file", F.col("content"), chunk_bytes), "entropy", "res_entropy", "printable", "eq1", "eq16", "eq256")
    return found.select("key.path", "key.arrived", "chunk", "raw_len", profiles.chunk_class().alias("class"))


def windowed(classes: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(start, class, chunks, raw): totals for each window of arrival; files later than `late` are not counted."""
    grouped = classes.withWatermark("arrived", late).groupBy(F.window("arrived", window), "class")
    made = grouped.agg(F.count(F.lit(1)).alias("chunks"), F.sum("raw_len").alias("raw"))
    return made.select(F.col("window.start").alias("start"), "class", "chunks", "raw")


def write(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Start a query that writes Parquet and ends when all present files are done; exactly once by its checkpoint."""
    return stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
