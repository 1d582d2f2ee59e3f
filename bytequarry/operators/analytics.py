"""Rollups of measurement rows (file, profile or codec, raw, size, seconds)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MB = 1e6


def ratio_pct(size: Column, raw: Column) -> Column:
    return 100.0 * size / raw


def mbps(raw: Column, seconds: Column) -> Column:
    return raw / MB / seconds


def with_metrics(runs: DataFrame) -> DataFrame:
    """runs with ratio_pct, comp_mbps and dec_mbps (null without dec_seconds)."""
    return runs.withColumns(
        {
            "ratio_pct": ratio_pct(F.col("size"), F.col("raw")),
            "comp_mbps": mbps(F.col("raw"), F.col("seconds")),
            "dec_mbps": mbps(F.col("raw"), F.col("dec_seconds")),
        }
    )


def summary(runs: DataFrame, *by: str) -> DataFrame:
    """Totals by mode or profile; all_ok if every row's check passed."""
    return runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("raw").alias("raw"),
        F.sum("size").alias("size"),
        ratio_pct(F.sum("size"), F.sum("raw")).alias("ratio_pct"),
        F.sum("seconds").alias("seconds"),
        F.bool_and("sha_ok").alias("all_ok"),
    )


def harmonic_throughput(runs: DataFrame, *by: str) -> DataFrame:
    """Throughput of the whole as SUM(raw) / SUM(raw / rate): rows weigh by their size."""
    return runs.groupBy(*by).agg(
        F.sum("raw").alias("raw"),
        F.sum("size").alias("size"),
        ratio_pct(F.sum("size"), F.sum("raw")).alias("ratio_pct"),
        (F.sum("raw") / F.sum(F.col("raw") / F.col("comp_mbps"))).alias("comp_mbps"),
        (F.sum("raw") / F.sum(F.col("raw") / F.col("dec_mbps"))).alias("dec_mbps"),
    )


def median_of_runs(runs: DataFrame, *by: str) -> DataFrame:
    return runs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.median("seconds").alias("med_seconds"))


def summed_median_throughput(medians: DataFrame, *by: str) -> DataFrame:
    """Throughput from summed medians: not that of the rows' rates."""
    return medians.groupBy(*by).agg((F.sum("raw") / MB / F.sum("med_seconds")).alias("mbps"))


def baseline_delta(runs: DataFrame, baseline: str, by: str = "profile", file: str = "file") -> DataFrame:
    """Every profile's size against the baseline's of the same file. The baseline has one row for each file."""
    base = runs.where(F.col(by) == baseline).select(F.col(file), F.col("size").alias("base_size"))
    return runs.join(base, file).withColumn("delta", F.col("size") - F.col("base_size"))


def set_deltas(deltas: DataFrame, weak: list, guard: list, by: str = "profile", file: str = "file") -> DataFrame:
    pick = lambda names: F.sum(F.when(F.col(file).isin(names), F.col("delta")).otherwise(0))
    return deltas.groupBy(by).agg(F.sum("delta").alias("delta"), pick(weak).alias("weak_delta"), pick(guard).alias("guard_delta"))


def totals(runs: DataFrame) -> DataFrame:
    return runs.agg(F.sum("raw").alias("raw"), F.sum("size").alias("size"), (F.sum("size") / F.sum("raw")).alias("ratio"))


def ranked(summary_rows: DataFrame, order: Column, tie: str) -> DataFrame:
    """With a rank by `order`; ties by the named column. Few rows: one for each profile."""
    return summary_rows.withColumn("rank", F.row_number().over(Window.orderBy(order, tie)))


def with_lookup(runs: DataFrame, table: dict[str, str], column: str, name: str) -> DataFrame:
    """runs with the table's value for a column, or the empty string."""
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv]) if table else F.create_map().cast("map<string,string>")
    return runs.withColumn(name, F.coalesce(F.try_element_at(known, F.col(column).cast("string")), F.lit("")))


def share_of_total(rows: DataFrame, value: str, name: str) -> DataFrame:
    total = rows.agg(F.sum(value).alias("total"))
    return rows.crossJoin(F.broadcast(total)).withColumn(name, F.when(F.col("total") != 0, F.col(value) / F.col("total")).otherwise(0.0)).drop("total")


def same_sizes(a: DataFrame, b: DataFrame) -> DataFrame:
    """(same_rows, same_total) of two tables (file, size)."""
    odd = a.select("file", "size").exceptAll(b.select("file", "size")).unionByName(b.select("file", "size").exceptAll(a.select("file", "size")))
    count = odd.agg((F.count(F.lit(1)) == 0).alias("same_rows"))
    sums = a.agg(F.sum("size").alias("x")).crossJoin(b.agg(F.sum("size").alias("y"))).select(F.col("x").eqNullSafe(F.col("y")).alias("same_total"))
    return count.crossJoin(sums)


def digest_check(original: DataFrame, restored: DataFrame, key: list[str], content: str = "raw") -> DataFrame:
    """(key..., same): whether the restored content has the original's SHA-256; missing content is not the same."""
    digest = lambda df, name: df.select(*key, F.sha2(F.col(content), 256).alias(name))
    joined = digest(original, "a").join(digest(restored, "b"), key, "full")
    return joined.select(*key, F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("same"))
