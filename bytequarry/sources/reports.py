"""Report sinks and the source that reads a report back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Columns in this order, with a header."""
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def to_json(rows: DataFrame, summary: DataFrame, path: str) -> None:
    """path/rows and path/summary as JSON lines."""
    rows.write.mode("overwrite").json(f"{path}/rows")
    summary.write.mode("overwrite").json(f"{path}/summary")


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Another run's rows or summary; the schema is declared, never guessed."""
    return spark.read.schema(schema).option("multiLine", path.endswith(".json")).json(path)


def markdown_lines(df: DataFrame, columns: dict[str, Column], order: list[str]) -> DataFrame:
    """(line_no, line): a Markdown table, `columns` giving each heading's text. For reports of a few rows: the body is
    sorted as one list."""
    body = df.select(F.struct(*[F.col(c) for c in order]).alias("o"), F.concat(F.lit("| "), F.concat_ws(" | ", *columns.values()), F.lit(" |")).alias("line"))
    lines = body.agg(F.sort_array(F.collect_list(F.struct("o", "line"))).alias("rows")).select(F.col("rows.line").alias("rows"))
    head = F.array(F.lit("| " + " | ".join(columns) + " |"), F.lit("|" + "---|" * len(columns)))
    return lines.select(F.posexplode(F.concat(head, "rows")).alias("line_no", "line"))


def to_markdown(df: DataFrame, path: str, columns: dict[str, Column], order: list[str]) -> None:
    markdown_lines(df, columns, order).orderBy("line_no").select("line").coalesce(1).write.mode("overwrite").text(path)


def text_lines(df: DataFrame) -> DataFrame:
    """(line): name=value for every column of every row."""
    pairs = F.array(*[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df.columns])
    return df.select(F.explode(pairs).alias("line"))


def to_text(df: DataFrame, path: str) -> None:
    text_lines(df).write.mode("overwrite").text(path)
