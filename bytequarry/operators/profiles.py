"""Chunk profiles, rule classes, and settings chosen from profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bytequarry.functions import profile as P
from bytequarry.functions.scalar import clamp
from bytequarry.functions.transforms import LAGS
from bytequarry.operators.kernel_map import map_chunks

#: Measures by name: Spark type and function of a chunk's bytes.
MEASURES = {
    "entropy": ("double", P.entropy),
    "res_entropy": ("double", P.residual_entropy),
    "printable": ("double", P.printable_share),
    "eq1": ("double", lambda b: P.match_rate(b, 1)),
    "eq16": ("double", lambda b: P.match_rate(b, 16)),
    "eq256": ("double", lambda b: P.match_rate(b, 256)),
    "repeats": ("long", lambda b: P.repeat_rate(b)[0]),
    "samples": ("long", lambda b: P.repeat_rate(b)[1]),
    "gate_repeats": ("long", lambda b: P.repeat_rate(b, max(64, len(b) // 4096))[0]),
    "gate_samples": ("long", lambda b: P.repeat_rate(b, max(64, len(b) // 4096))[1]),
}


def profile(chunks: DataFrame, *names: str, keep_raw: bool = False) -> DataFrame:
    """chunks (key, chunk, raw_len, raw) with the named measures, in place of the bytes or (keep_raw) behind them."""
    names = names or tuple(MEASURES)
    fields = T.StructType([T.StructField(n, T._parse_datatype_string(MEASURES[n][0])) for n in names])
    measures = list(names)

    def work(raw):
        data = bytes(raw)
        return [tuple(MEASURES[n][1](data) for n in measures)]

    return map_chunks(chunks, fields, work, ["raw"], ["key", "chunk", "raw_len", *(["raw"] if keep_raw else [])])


def match_rates(chunks: DataFrame, lags: list[int], sampled: bool = False) -> DataFrame:
    """(key, chunk, raw_len, lag, rate): one row for each lag."""
    rate = P.sampled_match_rate if sampled else P.match_rate
    fields = T.StructType([T.StructField("lag", T.IntegerType()), T.StructField("rate", T.DoubleType())])
    return map_chunks(chunks, fields, lambda raw: [(lag, rate(bytes(raw), lag)) for lag in lags], ["raw"], ["key", "chunk", "raw_len"])


def top_lags(chunks: DataFrame, lags: list[int] = LAGS, k: int = 3) -> DataFrame:
    """(key, chunk, raw_len, rank, lag, rate): the k best sampled lags; of equal rates the larger lag."""
    fields = T.StructType([T.StructField("rank", T.IntegerType()), T.StructField("lag", T.IntegerType()), T.StructField("rate", T.DoubleType())])

    def work(raw):
        return [(i + 1, lag, rate) for i, (rate, lag) in enumerate(P.top_lags(bytes(raw), lags, k))]

    return map_chunks(chunks, fields, work, ["raw"], ["key", "chunk", "raw_len"])


# --- classes -----------------------------------------------------------------------------------------

TARGET = 0.26  # the share of the raw size that a chunk is held against


def excess(raw: Column, size: Column, target: float = TARGET) -> Column:
    return F.greatest(F.lit(0.0), size - target * raw)


def chunk_class(ratio: Column | None = None) -> Column:
    """The first rule that fits; without a ratio the rule on sizes is left out. Names and thresholds are fixed values."""
    structured = (F.col("res_entropy") <= 5.2) & ((F.col("eq16") > 0.10) | (F.col("eq256") > 0.08))
    hard = (F.col("entropy") >= 7.4) & (F.col("res_entropy") >= 7.1)
    repeats = (F.col("eq1") > 0.12) | (F.col("eq16") > 0.08) | (F.col("eq256") > 0.06)
    small = ratio <= TARGET if ratio is not None else F.lit(False)
    return (
        F.when(small, "already_at_or_below_26").when(structured, "structured_residual").when(hard, "high_entropy_hard")
        .when(F.col("printable") >= 0.75, "textual").when(repeats, "repeat_structured").otherwise("mixed")
    )


def class_stats(rows: DataFrame) -> DataFrame:
    """Totals, means and share of all excess by class, of rows with a class, raw, size and the measures."""
    by_class = rows.withColumn("excess", excess(F.col("raw"), F.col("size"))).groupBy("class").agg(
        F.count(F.lit(1)).alias("chunks"),
        F.sum("raw").alias("raw"),
        F.sum("size").alias("size"),
        (F.sum("size") / F.sum("raw")).alias("ratio"),
        F.sum("excess").alias("excess"),
        F.avg("entropy").alias("avg_entropy"),
        F.avg("res_entropy").alias("avg_res_entropy"),
        F.avg("eq16").alias("avg_eq16"),
        F.avg("eq256").alias("avg_eq256"),
    )
    # there are as many rows as classes: one task sums them, and the profiles are not computed again for the total
    total = F.sum("excess").over(Window.partitionBy())
    return by_class.withColumn("excess_share", F.when(total > 0, F.col("excess") / total).otherwise(0.0))


def worst(rows: DataFrame, order: list[str], k: int = 30) -> DataFrame:
    """The k chunks of most excess; ties in the order of `order`."""
    return rows.withColumn("excess", excess(F.col("raw"), F.col("size"))).orderBy(F.col("excess").desc(), *order).limit(k)


# --- settings ----------------------------------------------------------------------------------------


def _bands(share: Column, bands: tuple[float, float, float, float, float]) -> Column:
    high, low, at_high, at_low, between = bands
    return F.when(share >= high, at_high).when(share <= low, at_low).otherwise(between)


#: Text share from which, up to which, and the penalty above, below and between.
TEXT_BANDS = {2: (0.80, 0.35, 1.05, 0.98, 1.18), 7: (0.78, 0.30, 1.03, 0.94, 1.17), 8: (0.82, 0.40, 1.04, 0.96, 1.16), 9: (0.75, 0.35, 1.02, 0.95, 1.15)}


def distance_penalty(mode: int) -> Column:
    """Match distance penalty from printable, entropy and eq1. Modes: 1 entropy bands, 3 mixed rules, 2, 7, 8, 9 text
    bands, 4 linear in text, 5 and in entropy, 6 and in repetition. All thresholds and penalties are fixed values."""
    text, bits, rep = F.col("printable"), F.col("entropy"), F.col("eq1")
    if mode in TEXT_BANDS:
        return _bands(text, TEXT_BANDS[mode])
    if mode == 1:
        return F.when(bits >= 7.2, 0.95).when(bits >= 6.2, 1.05).when(bits <= 4.2, 1.32).otherwise(1.18)
    if mode == 3:
        return F.when((bits >= 7.0) & (rep < 0.03), 0.92).when((bits <= 4.5) | (rep > 0.16), 1.30).when(text >= 0.75, 1.05).otherwise(1.12)
    if mode == 4:
        return clamp(1.30 - 0.30 * text, 0.94, 1.26)
    if mode == 5:
        return clamp(1.24 - 0.22 * text - 0.045 * (bits - 5.5), 0.90, 1.27)
    if mode == 6:
        return clamp(1.22 - 0.18 * text - 0.050 * (bits - 5.5) + 0.32 * rep, 0.88, 1.28)
    raise ValueError(f"no penalty mode {mode}")


def lazy_depth(mode: int) -> Column:
    """Search depth by text share; thresholds and depths are fixed values."""
    text = F.col("printable")
    if mode == 1:
        return F.when(text >= 0.75, 28).otherwise(19)
    if mode == 2:
        return F.when(text <= 0.35, 28).otherwise(19)
    return F.when(text >= 0.75, 24).when(text <= 0.35, 30).otherwise(22)


#: Fixed values: (chain, lazy) depth for a repeat rate under 0.025, under 0.08, and above.
CHAIN_BANDS = {"H": ((6, 6), (12, 12), (24, 24)), "K": ((2, 2), (8, 8), (24, 24)), "L": ((2, 2), (8, 4), (24, 12))}
SHORT = 4096


def chain_depth(kind: str) -> tuple[Column, Column]:
    """(chain, lazy) depth from repeats, samples and raw_len; short chunks get the largest."""
    rate = F.when(F.col("samples") > 0, F.col("repeats") / F.col("samples")).otherwise(0.0)
    rare, some, often = CHAIN_BANDS[kind]
    pick = lambda i: F.when(F.col("raw_len") < SHORT, often[i]).when(rate < 0.025, rare[i]).when(rate < 0.080, some[i]).otherwise(often[i])
    return pick(0), pick(1)


def raw_gate() -> Column:
    """Chunks that are not worth parsing: enough samples and hardly any repeat."""
    return (F.col("raw_len") >= 8192) & (F.col("gate_samples") >= 256) & (F.col("gate_repeats") * 1000 <= F.col("gate_samples"))
