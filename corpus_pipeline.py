"""The document pipeline: quality rules, line dedup, near-dedup, decontamination, piece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of docs. Once a stage is written, run() removes what it read and
what it wrote in between.

Defined cases: a null or empty text fails the quality rules, as does any text under 50 words; a text that loses lines keeps
its row, also if no line is left; a row without an id is kept or dropped by its text, and of a group of near duplicates the
row with the least id stays, null ids last, of rows that share the id the first; rows that repeat are near duplicates of each
other; ties in the estimates and in segmentations are settled as the operators say; texts are read whole, whatever their
length; an empty table passes through every stage as an empty table; columns other than doc_id, text, lang, source and
n_chars (which follows the text where the table has it) pass through unread, and new columns of the last stage get other
names where the table has theirs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytequarry.llm import decontamination, line_dedup, piece_codec, quality_rules, simhash, unigram
from bytequarry.llm.common import drop_before, fresh_name, materialize, tables_written
from bytequarry.shipping import ship


def _shipped(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, after the workers have been given the package."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that the base rules or the outlier rule reject."""
    return quality_rules.reject_outliers(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes frequent lines out of the texts; n_chars follows the text that is left."""
    found, names, _ = line_dedup.dedup_lines(docs)
    kept = F.col(f"`{names['kept']}`")
    now = {"text": F.when(F.col("text").isNotNull(), kept)}
    if "n_chars" in docs.columns:
        now["n_chars"] = F.length(kept).cast(docs.schema["n_chars"].dataType)
    return found.select([now[c].alias(c) if c in now else F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group."""
    return simhash.keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that are contaminated by the benchmark."""
    return decontamination.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of docs without the text, its ids, n_tokens, and whether decoding the ids gives the text back."""
    check = fresh_name(docs, "round_trip")
    encoded, ids = piece_codec.encode(docs, unigram.Vocabulary.load(), check=check)
    return encoded.select(
        *[F.col(f"`{c}`") for c in docs.columns if c != "text"],
        ids,
        F.size(ids).cast("long").alias(fresh_name(docs, "n_tokens")),
        check,
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", _shipped(quality)),
    ("line_dedup", _shipped(lines)),
    ("simhash_near_dedup", _shipped(near_duplicates)),
    ("benchmark_decontamination", _shipped(decontaminate)),
    ("sentencepiece", _shipped(pieces)),
]

#: The fingerprints' hash and the estimates of the quality rules are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, since = spark.read.parquet(f"{sf_dir}/documents.parquet"), tables_written()
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_before(docs, since)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
