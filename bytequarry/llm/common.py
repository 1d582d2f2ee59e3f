"""Helpers shared by the text operators: shared-folder tables, joins on hot keys and Arrow batch plumbing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

#: Rows of an Arrow batch that are turned into Python objects at once.
SLICE_ROWS = 1024
_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, one of its own if all workers
    are threads of the driver (a local master), and an error on a cluster, whose machines share no temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = "file://" + tempfile.mkdtemp(prefix="bytequarry-")
    return _fallback[app]


def _hadoop_path(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back.

    Unlike checkpoint(), which evaluates an uncached plan twice, this computes every row once. The
    files outlive any executor and are removed when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/bytequarry/{label}-{uuid.uuid4().hex}"
    fs, jpath = _hadoop_path(spark, path)
    df.write.parquet(path)
    fs.deleteOnExit(jpath)
    out = spark.read.schema(df.schema).parquet(path)
    out._bq_path = path
    _written.append(out)
    return out


#: Materialized tables in the order in which they were written.
_written: list[DataFrame] = []


def tables_written() -> int:
    return len(_written)


def drop_before(keep: DataFrame, since: int) -> None:
    """Removes the tables written after the first `since`, except `keep`, which must not read any of them."""
    for table in _written[since:]:
        if table is not keep:
            drop_table(table)
    _written[since:] = [keep]


def drop_table(df: DataFrame) -> None:
    """Remove the files of a materialized table that nothing reads any more."""
    path = getattr(df, "_bq_path", None)
    if path:
        fs, jpath = _hadoop_path(df.sparkSession, path)
        fs.delete(jpath, True)


#: Rows of one key that a task should have at most.
HOT_ROWS = 100_000


def join_hot(rows: DataFrame, table: DataFrame, key: str, n: str, how: str = "inner") -> DataFrame:
    """rows joined with table, which has each key once and the number n of its rows. The rows of a key of many are dealt
    out over as many tasks, each with a copy of the key's row of table; keys of few go the usual way.

    What is broadcast are the keys of more than HOT_ROWS rows: at most one for each HOT_ROWS rows there are.
    """
    salts = F.ceil(F.col(n) / HOT_ROWS).cast("int")
    hot = F.broadcast(table.where(F.col(n) > HOT_ROWS).select(key, salts.alias("bq_salts")))
    salt = F.pmod(F.xxhash64(*rows.columns), F.coalesce("bq_salts", F.lit(1)).cast("long")).cast("int")
    left = rows.join(hot, key, "left").withColumn("bq_salt", salt).drop("bq_salts")
    right = table.withColumn("bq_salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)))
    return left.join(right, [key, "bq_salt"], how).drop("bq_salt")


def fresh_name(df: DataFrame, base: str) -> str:
    """base, with underscores added until df has no such column (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def column_bytes(column: pa.Array) -> list[bytes | None]:
    """A string column's UTF-8 values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def append_columns(
    df: DataFrame,
    text_col: str,
    fields: list[tuple[str, DataType]],
    make: Callable[[], Callable[[list[bytes | None]], list[pa.Array]]],
    finish: Callable[[], None] | None = None,
) -> DataFrame:
    """df with columns computed from one string column, batch by batch and without a shuffle.

    make() runs once per task and returns a function from UTF-8 values to one Arrow array per field; finish() runs when
    the task ends, to free what an idle worker should not hold.
    Every column of df passes through. The new names must not occur in df (see fresh_name).
    """
    schema = StructType([*df.schema.fields, *(StructField(n, t) for n, t in fields)])
    at = df.columns.index(text_col)
    names = [n for n, _ in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        try:
            for batch in batches:
                for start in range(0, batch.num_rows, SLICE_ROWS):
                    part = batch.slice(start, SLICE_ROWS)
                    made = work(column_bytes(part.column(at)))
                    yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *names])
        finally:
            if finish:
                finish()

    return df.mapInArrow(run, schema)
