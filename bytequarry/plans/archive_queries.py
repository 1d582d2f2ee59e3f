"""Queries that pack, restore and report."""

from __future__ import annotations

from pyspark.sql import functions as F

from bytequarry.functions import scalar
from bytequarry.operators import analytics
from bytequarry.plans import analytics_queries
from bytequarry.plans.chunk_queries import CHUNK, _chunk_cte, chunks
from bytequarry.sources import archive, layouts, reports
from bytequarry.sources.scratch import scratch


def sha256_roundtrip(spark, sf_dir):
    """Documents packed in chunks, restored, joined again and compared by digest."""
    cut = chunks(spark, sf_dir, CHUNK)
    back = archive.joined(archive.restore(archive.pack(cut, ["BASE", "D4T4", "T4"])))
    return back.select(F.col("key").cast("long").alias("doc_id"), "n_chunks", "raw_len", F.sha2("content", 256).alias("sha256"))


def archive_roundtrip(spark, sf_dir):
    cut = chunks(spark, sf_dir, CHUNK)
    back = archive.restore(archive.pack(cut, ["BASE", "BIT", "NIB", "X4BIT"]))
    checked = analytics.digest_check(cut.withColumn("key", F.col("key").cast("string")), back, ["key", "chunk"])
    return checked.groupBy("same").agg(F.count(F.lit(1)).alias("n"))


def archive_sink_roundtrip(spark, sf_dir):
    """Packed chunks written through the sink, read through the source and restored."""
    spark.dataSource.register(archive.ArchiveSource)
    path = scratch(spark, "archive")
    archive.pack(chunks(spark, sf_dir, CHUNK), ["BASE", "D4T4"]).write.format("bytequarry").option("path", path).mode("overwrite").save()
    back = archive.restore(spark.read.format("bytequarry").option("path", path).load())
    return back.select(F.col("key").cast("long").alias("doc_id"), "chunk", "raw_len", F.sha2("raw", 256).alias("raw_sha256"))


def plain_layout_roundtrip(spark, sf_dir):
    """Every document as an archive of the plain layout, written and read."""
    made = layouts.archives(chunks(spark, sf_dir, CHUNK))
    back = layouts.opened(made)
    return back.select(F.col("rel").cast("long").alias("doc_id"), "chunk", "raw_len", F.sha2("raw", 256).alias("raw_sha256"))


def routed_layout_roundtrip(spark, sf_dir):
    """The same of the routed layout, chunks going through all six transforms in turn."""
    made = layouts.archives(chunks(spark, sf_dir, CHUNK).withColumn("mode", F.pmod(F.col("key") + F.col("chunk"), F.lit(6)).cast("int")), routed=True)
    back = layouts.opened(made)
    return back.select(F.col("archive").cast("long").alias("doc_id"), "chunk", "mode", "raw_len", F.sha2("raw", 256).alias("raw_sha256"))


def csv_report(spark, sf_dir):
    """A summary written as CSV and read back."""
    path, made = scratch(spark, "csv"), analytics_queries.sweep_summary(spark, sf_dir)
    reports.to_csv(made, path, made.columns)
    return spark.read.schema(made.schema).option("header", True).csv(path)


def json_report(spark, sf_dir):
    """Rows and summary written as JSON and read back."""
    path, rows = scratch(spark, "json"), analytics_queries.per_file(spark, sf_dir)
    reports.to_json(rows, analytics_queries.sweep_summary(spark, sf_dir), path)
    read = reports.read_json(spark, f"{path}/rows", rows.schema)
    summary = reports.read_json(spark, f"{path}/summary", "profile string, raw long, size long").withColumnsRenamed({"raw": "all_raw", "size": "all_size"})
    return read.join(F.broadcast(summary), "profile")  # a summary has a row for each profile


def listed_files(spark, sf_dir):
    """The tables below a folder, each a file or a folder of part files: their names, in order, and that they are not empty."""
    from bytequarry.sources.chunks import listing

    found = listing(spark, sf_dir).select(F.element_at(F.split("rel", "/"), 1).alias("rel"), "raw")
    found = found.where(F.col("rel").isin("documents.parquet", "labels.parquet", "region.parquet"))
    return found.groupBy("rel").agg((F.sum("raw") > 0).alias("has_bytes")).orderBy("rel")


def markdown_report(spark, sf_dir):
    made = analytics.summary(analytics_queries.runs(spark, sf_dir), "profile")
    columns = {"profile": F.col("profile"), "size": scalar.grouped(F.col("size")), "ratio": F.concat(scalar.fixed(F.round("ratio_pct", 2), 2), F.lit("%"))}
    return reports.markdown_lines(made, columns, ["profile"])


def text_report(spark, sf_dir):
    return reports.text_lines(analytics_queries.per_file(spark, sf_dir).where("profile = 'A'"))


QUERIES = {f.__name__: f for f in (sha256_roundtrip, archive_roundtrip, archive_sink_roundtrip, plain_layout_roundtrip, routed_layout_roundtrip, csv_report, json_report, listed_files, markdown_report, text_report)}
_CHUNKS = f"WITH {_chunk_cte()} SELECT doc_id, chunk, CAST(n AS BIGINT) AS raw_len, sha256(unhex(h)) AS raw_sha256{{more}} FROM chunks"
ORACLES = {
    "archive_sink_roundtrip": _CHUNKS.format(more=""),
    "plain_layout_roundtrip": _CHUNKS.format(more=""),
    "routed_layout_roundtrip": _CHUNKS.format(more=", CAST((doc_id + chunk) % 6 AS INTEGER) AS mode"),
    "csv_report": analytics_queries.ORACLES["sweep_summary"],
    "json_report": f"""WITH {analytics_queries.RUNS}, f AS (SELECT profile, file, CAST(sum(raw) AS BIGINT) AS raw, CAST(sum(size) AS BIGINT) AS size FROM runs GROUP BY profile, file)
  SELECT profile, file, raw, size, CAST(sum(raw) OVER (PARTITION BY profile) AS BIGINT) AS all_raw, CAST(sum(size) OVER (PARTITION BY profile) AS BIGINT) AS all_size FROM f""",
    "listed_files": "SELECT unnest(['documents.parquet', 'labels.parquet', 'region.parquet']) AS rel, true AS has_bytes",
    "sha256_roundtrip": f"""SELECT doc_id, CAST((octet_length(encode(text)) - 1) // {CHUNK} + 1 AS INTEGER) AS n_chunks, CAST(octet_length(encode(text)) AS BIGINT) AS raw_len, sha256(text) AS sha256
  FROM documents WHERE text <> ''""",
    "archive_roundtrip": f"SELECT true AS same, CAST(sum((octet_length(encode(text)) - 1) // {CHUNK} + 1) AS BIGINT) AS n FROM documents WHERE text <> ''",
    "markdown_report": f"""WITH {analytics_queries.RUNS}, s AS (SELECT profile, sum(size) AS size, sum(raw) AS raw FROM runs GROUP BY profile)
  SELECT 0 AS line_no, '| profile | size | ratio |' AS line UNION ALL SELECT 1, '|---|---|---|'
  UNION ALL SELECT CAST(row_number() OVER (ORDER BY profile) + 1 AS INTEGER), '| ' || profile || ' | ' || format('{{:,}}', CAST(size AS BIGINT)) || ' | ' || printf('%.2f', round(100.0 * size / raw, 2)) || '% |' FROM s""",
    "text_report": f"""WITH {analytics_queries.RUNS}, f AS (SELECT profile, file, sum(raw) AS raw, sum(size) AS size FROM runs WHERE profile = 'A' GROUP BY profile, file)
  SELECT unnest(['profile=' || profile, 'file=' || file, 'raw=' || raw, 'size=' || size]) AS line FROM f""",
}
