"""Queries over chunks of the documents' UTF-8 bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytequarry.operators import profiles, routing, transforming
from bytequarry.sources import archive
from bytequarry.sources import chunks as source

CHUNK = 4096
TAGS3, TAGS6 = ["BASE", "D4T4", "D1024T1024"], ["BASE", "D4T4", "D1024T1024", "WX2T2", "D2T2", "D16T16"]


def chunks(spark: SparkSession, sf_dir: str, chunk_bytes: int = CHUNK) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return source.from_text(source.balance(docs), "doc_id", "text", chunk_bytes)


def benchmark_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.from_text(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id", "text", CHUNK)


def _ids(df: DataFrame, *more) -> DataFrame:
    return df.select(F.col("key").alias("doc_id"), "chunk", *more)


def _r6(c: str):
    return F.round(c, 6).alias(c)


def _r12(c: str):
    """For shares of up to 2**12 or so: with fewer digits some lie halfway, and engines round those differently."""
    return F.round(c, 12).alias(c)


def chunk_scan(spark, sf_dir):
    return _ids(chunks(spark, sf_dir), "raw_len", F.sha2("raw", 256).alias("raw_sha256"))


def chunk_counts(spark, sf_dir):
    by_doc = chunks(spark, sf_dir).groupBy(F.col("key").alias("doc_id"))
    return by_doc.agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("raw_len").alias("n_bytes"), F.min("raw_len").alias("least"))


def byte_entropy(spark, sf_dir):
    return _ids(profiles.profile(chunks(spark, sf_dir), "entropy"), "raw_len", _r6("entropy"))


def printable_share(spark, sf_dir):
    return _ids(profiles.profile(chunks(spark, sf_dir), "printable"), _r12("printable"))


def eq_rate(spark, sf_dir):
    return _ids(profiles.profile(chunks(spark, sf_dir), "eq1", "eq16", "eq256"), _r12("eq1"), _r12("eq16"), _r12("eq256"))


def sampled_lag_score(spark, sf_dir):
    return _ids(profiles.match_rates(chunks(spark, sf_dir, 16384), [1, 4, 64], sampled=True), "lag", _r12("rate"))


def top3_lags(spark, sf_dir):
    return _ids(profiles.top_lags(chunks(spark, sf_dir)), "rank", "lag", _r12("rate"))


def neighbour_residual_entropy(spark, sf_dir):
    return _ids(profiles.profile(chunks(spark, sf_dir), "res_entropy"), _r6("res_entropy"))


def repeat_rate_4gram(spark, sf_dir):
    return _ids(profiles.profile(chunks(spark, sf_dir), "repeats", "samples"), "repeats", "samples")


def chain_depth_band(spark, sf_dir):
    found = profiles.profile(chunks(spark, sf_dir), "repeats", "samples")
    columns = [c.alias(f"{n}_{k.lower()}") for k in ("H", "K", "L") for c, n in zip(profiles.chain_depth(k), ("chain", "lazy"))]
    return _ids(found, *columns)


def raw_gate(spark, sf_dir):
    found = profiles.profile(chunks(spark, sf_dir, 32768), "gate_repeats", "gate_samples")
    return _ids(found, "raw_len", "gate_repeats", "gate_samples", profiles.raw_gate().alias("skip_parse"))


def _penalties(modes: tuple[int, ...]):
    def query(spark, sf_dir):
        found = profiles.profile(chunks(spark, sf_dir), "entropy", "printable", "eq1")
        return _ids(found, *[F.round(profiles.distance_penalty(m), 6).alias(f"penalty_{m}") for m in modes])

    return query


def lazy_depth_band(spark, sf_dir):
    found = profiles.profile(chunks(spark, sf_dir), "printable")
    return _ids(found, *[profiles.lazy_depth(m).alias(f"lazy_{m}") for m in (1, 2, 3)])


def _classified(spark, sf_dir):
    found = profiles.profile(chunks(spark, sf_dir), "entropy", "res_entropy", "printable", "eq1", "eq16", "eq256")
    sized = found.withColumnRenamed("raw_len", "raw").withColumn("size", routing.entropy_size(F.round("entropy", 6), F.col("raw")))
    return sized.withColumn("class", profiles.chunk_class(F.col("size") / F.col("raw")))


def chunk_class(spark, sf_dir):
    return _ids(_classified(spark, sf_dir), "class")


def class_stats(spark, sf_dir):
    stats = profiles.class_stats(_classified(spark, sf_dir))
    rounded = ["ratio", "excess", "avg_entropy", "avg_res_entropy", "avg_eq16", "avg_eq256", "excess_share"]
    return stats.select("class", "chunks", "raw", "size", *[F.round(c, 4).alias(c) for c in rounded])


def worst_chunks(spark, sf_dir):
    rows = _classified(spark, sf_dir).select("key", "chunk", "raw", "size")
    return _ids(profiles.worst(rows, ["key", "chunk"]), "raw", "size", F.round("excess", 4).alias("excess"))


# --- transforms --------------------------------------------------------------------------------------


def _transform(name: str):
    def query(spark, sf_dir):
        out = transforming.transformed(chunks(spark, sf_dir), name)
        return _ids(out, F.octet_length("payload").alias("n"), F.sha2(F.hex("payload"), 256).alias("out_sha256"))

    return query


def _undone(name: str):
    """The inverse transform, taken of the transformed chunk: it must give the chunk back."""

    def query(spark, sf_dir):
        out = transforming.restored(transforming.transformed(chunks(spark, sf_dir), name))
        return _ids(out, F.octet_length("raw").alias("n"), F.sha2(F.hex("raw"), 256).alias("out_sha256"))

    return query


def byte_rows_delta(spark, sf_dir):
    """The relational forms against each other: delta, transpose and back, on rows of single bytes."""
    return _byte_rows_delta(benchmark_chunks(spark, sf_dir))


def documents_byte_rows_delta(spark, sf_dir):
    return _byte_rows_delta(source.spread(chunks(spark, sf_dir))).withColumnRenamed("item_id", "doc_id")


def _byte_rows_delta(given):
    rows = transforming.byte_rows(given)
    there = transforming.rows_transpose(transforming.rows_xor(transforming.rows_delta(rows, 4), 3), 4)
    back = transforming.rows_undo_delta(transforming.rows_undo_xor(transforming.rows_transpose(there, 4, undo=True), 3), 4)
    same = transforming.from_rows(back).withColumnRenamed("raw", "back")
    moved = transforming.from_rows(there)
    return moved.join(same, ["key", "chunk"]).select(
        F.col("key").alias("item_id"), "chunk", F.sha2(F.hex("raw"), 256).alias("out_sha256"), F.sha2(F.hex("back"), 256).alias("raw_sha256")
    )


# --- routing -----------------------------------------------------------------------------------------


def _entropy_candidates(spark, sf_dir, tags=TAGS3):
    """Candidates whose size is that of an ideal order-0 coder, which SQL can compute too."""
    from pyspark.sql import types as T

    from bytequarry.functions import profile, transforms
    from bytequarry.operators.kernel_map import map_chunks

    def work(raw):
        data = bytes(raw)
        return [(i, t, profile.residual_entropy(transforms.apply(data, t))) for i, t in enumerate(tags)]

    fields = T._parse_datatype_string("mode int, tag string, bits double")
    made = map_chunks(chunks(spark, sf_dir), fields, work, ["raw"], ["key", "chunk", "raw_len"])
    return made.withColumn("size", routing.entropy_size(F.round("bits", 6), F.col("raw_len")))


def best_mode_by_size(spark, sf_dir):
    chosen = routing.best(_entropy_candidates(spark, sf_dir), "mode")
    return _ids(chosen, "base", "best_size", "best_mode", "best_tag", "saved")


def mode_histogram(spark, sf_dir):
    return routing.mode_histogram(routing.best(_entropy_candidates(spark, sf_dir), "mode"), TAGS3)


def oracle_rollup(spark, sf_dir):
    rolled = routing.rollup_by_key(routing.best(_entropy_candidates(spark, sf_dir), "tag"))
    return rolled.select(F.col("key").alias("doc_id"), "raw", "base", "best", "saved", F.round("ratio", 6).alias("ratio"))


def routed_zlib(spark, sf_dir):
    """Every chunk in the smallest of six candidates by a real codec, and restored from it."""
    records = archive.pack(chunks(spark, sf_dir, 65536), TAGS6)
    fits = records.agg(F.bool_and(F.octet_length("payload") <= F.col("raw_len")).alias("never_larger"), F.bool_and(F.col("transform").isin(TAGS6)).alias("known"))
    back = archive.restore(records).select(F.col("key").cast("long").alias("doc_id"), "chunk", "raw_len", F.sha2("raw", 256).alias("raw_sha256"))
    return back.crossJoin(F.broadcast(fits))  # one row


def codec_round_trips(spark, sf_dir):
    """General codecs: a check of each round trip, and that they save."""
    from bytequarry.sources import codecs

    names = [n for n in ("zlib-6", "bzip2-9", "zstd-3") if n in codecs.names()]
    runs = routing.codec_runs(chunks(spark, sf_dir, 65536), names)
    return runs.groupBy("codec").agg(F.sum("raw_len").alias("raw"), (F.sum("size") < F.sum("raw_len") * 0.7).alias("saves"), F.bool_and("sha_ok").alias("all_ok"))


_TRANSFORMS = {
    "delta_lag": "D16", "xor_lag": "X4", "double_delta": "DD4", "transpose4": "T4", "word_xor2": "WX2", "word_delta4": "WD4",
    "delta_transpose": "D4T4", "bitplanes": "BIT", "nibbles": "NIB", "neighbour_residuals": "RES",
}
_INVERSES = {"inv_delta": "D16", "inv_transpose4": "T4", "inv_word_xor2": "WX2", "inv_xor_lag": "X4"}

QUERIES = {
    f.__name__: f
    for f in (
        chunk_scan, chunk_counts, byte_entropy, printable_share, eq_rate, sampled_lag_score, top3_lags, neighbour_residual_entropy,
        repeat_rate_4gram, chain_depth_band, raw_gate, lazy_depth_band, chunk_class, class_stats, worst_chunks, byte_rows_delta, documents_byte_rows_delta,
        best_mode_by_size, mode_histogram, oracle_rollup, routed_zlib, codec_round_trips,
    )
}
QUERIES |= {"text_band_penalty": _penalties((1, 2, 3, 7, 8, 9)), "continuous_penalty": _penalties((4, 5, 6))}
QUERIES |= {n: _transform(t) for n, t in _TRANSFORMS.items()} | {n: _undone(t) for n, t in _INVERSES.items()}

# --- SQL ---------------------------------------------------------------------------------------------


def _chunk_cte(size: int = CHUNK, table: str = "documents", key: str = "doc_id") -> str:
    return f"""raw AS (SELECT {key}, hex(encode(text)) AS h FROM {table} WHERE text <> ''),
chunks AS (SELECT {key}, CAST(c AS INTEGER) AS chunk, substr(h, c * {2 * size} + 1, {2 * size}) AS h, least({size}, length(h) // 2 - c * {size}) AS n
  FROM (SELECT {key}, h, unnest(range(0, (length(h) // 2 - 1) // {size} + 1)) AS c FROM raw)),
b AS MATERIALIZED (SELECT {key}, chunk, n, pos, CAST('0x' || substr(h, 2 * pos + 1, 2) AS INTEGER) AS v
  FROM (SELECT {key}, chunk, n, h, unnest(range(0, n)) AS pos FROM chunks))"""


_W = "PARTITION BY doc_id, chunk ORDER BY pos"
_PRINTABLE = "(v BETWEEN 32 AND 126 OR v IN (9, 10, 13))"


def _entropy(rows: str, name: str) -> str:
    """CTE: entropy of the bytes v of a table (doc_id, chunk, v)."""
    return f"""{name} AS (SELECT doc_id, chunk, round(-sum(c / t * log2(c / t)), 6) + 0.0 AS bits FROM (
  SELECT doc_id, chunk, CAST(count(*) AS DOUBLE) AS c, sum(count(*)) OVER (PARTITION BY doc_id, chunk) AS t
  FROM {rows} GROUP BY doc_id, chunk, v) GROUP BY doc_id, chunk)"""


def _equal(lag: int) -> str:
    return f"coalesce(avg(CASE WHEN pos >= {lag} THEN CAST(v = p{lag} AS INTEGER) END), 0)"


_LAGGED = "l AS (SELECT *, " + ", ".join(f"lag(v, {k}) OVER ({_W}) AS p{k}" for k in (1, 15, 16, 17, 256)) + " FROM b)"
_RES = """r AS (SELECT doc_id, chunk, pos, (v - CASE WHEN w = 0 THEN 0 ELSE (s + w // 2) // w END) & 255 AS v FROM (
  SELECT *, 3 * coalesce(p1, 0) + 2 * coalesce(p16, 0) + 2 * coalesce(p256, 0) + coalesce(p17, 0) + coalesce(p15, 0) AS s,
    3 * CAST(p1 IS NOT NULL AS INTEGER) + 2 * CAST(p16 IS NOT NULL AS INTEGER) + 2 * CAST(p256 IS NOT NULL AS INTEGER)
    + CAST(p17 IS NOT NULL AS INTEGER) + CAST(p15 IS NOT NULL AS INTEGER) AS w FROM l))"""
_MEASURES = f"""{_entropy('b', 'e')}, {_entropy('r', 're')},
q AS (SELECT doc_id, chunk, any_value(n) AS n, avg(CAST({_PRINTABLE} AS INTEGER)) AS printable, {_equal(1)} AS eq1, {_equal(16)} AS eq16, {_equal(256)} AS eq256
  FROM l GROUP BY doc_id, chunk),
m AS (SELECT q.*, e.bits AS entropy, re.bits AS res_entropy, CAST(ceil(e.bits * n / 8) AS BIGINT) AS size FROM q JOIN e USING (doc_id, chunk) JOIN re USING (doc_id, chunk)),
k AS (SELECT *, greatest(0.0, size - CAST(0.26 AS DOUBLE) * n) AS excess, CASE WHEN size / n <= 0.26 THEN 'already_at_or_below_26'
  WHEN res_entropy <= 5.2 AND (eq16 > 0.10 OR eq256 > 0.08) THEN 'structured_residual'
  WHEN entropy >= 7.4 AND res_entropy >= 7.1 THEN 'high_entropy_hard' WHEN printable >= 0.75 THEN 'textual'
  WHEN eq1 > 0.12 OR eq16 > 0.08 OR eq256 > 0.06 THEN 'repeat_structured' ELSE 'mixed' END AS class FROM m)"""
_ALL = f"WITH {_chunk_cte()}, {_LAGGED}, {_RES}, {_MEASURES}"


def _grams(step: str, size: int = CHUNK) -> str:
    return f"""WITH {_chunk_cte(size)},
s AS (SELECT doc_id, chunk, n, pos, v + 256 * lead(v, 1) OVER ({_W}) + 65536 * lead(v, 2) OVER ({_W}) + CAST(16777216 AS BIGINT) * lead(v, 3) OVER ({_W}) AS key
  FROM b),
g AS (SELECT doc_id, chunk, n, pos, key, ((CAST(key AS BIGINT) * 2654435761) & 4294967295) >> 20 AS slot FROM s WHERE pos % {step} = 0 AND pos + 4 <= n),
t AS (SELECT doc_id, chunk, n, key = lag(key) OVER (PARTITION BY doc_id, chunk, slot ORDER BY pos) AS again FROM g),
c AS (SELECT doc_id, chunk, any_value(n) AS n, count(*) AS samples, count(*) FILTER (WHERE again) AS repeats FROM t GROUP BY doc_id, chunk),
a AS (SELECT doc_id, chunk, chunks.n, coalesce(samples, 0) AS samples, coalesce(repeats, 0) AS repeats, coalesce(repeats / samples, 0) AS rate
  FROM chunks LEFT JOIN c USING (doc_id, chunk))"""


def _hashed(rows: str, key: str = "doc_id", n: str = "count(*)") -> str:
    return f"SELECT {key}, chunk, CAST({n} AS INTEGER) AS n, sha256(string_agg(printf('%02X', v), '' ORDER BY pos)) AS out_sha256 FROM ({rows}) GROUP BY {key}, chunk"


def _delta(rows: str, lag: int, op: str = "-", key: str = "doc_id") -> str:
    before = f"lag(v, {lag}) OVER (PARTITION BY {key}, chunk ORDER BY pos)"
    changed = f"xor(v, {before})" if op == "^" else f"(v - {before}) & 255"
    return f"SELECT {key}, chunk, n, pos, CASE WHEN pos < {lag} THEN v ELSE {changed} END AS v FROM ({rows})"


def _transposed(rows: str, w: int, key: str = "doc_id") -> str:
    return f"SELECT {key}, chunk, n, CASE WHEN pos < n // {w} * {w} THEN (pos % {w}) * (n // {w}) + pos // {w} ELSE pos END AS pos, v FROM ({rows})"


_B = "SELECT * FROM b"
_WORD_XOR = f"SELECT doc_id, chunk, n, pos, CASE WHEN pos < 2 OR pos >= n // 2 * 2 THEN v ELSE xor(v, lag(v, 2) OVER ({_W})) END AS v FROM b"
_WORD_DELTA = f"""SELECT doc_id, chunk, n, 4 * word + k AS pos, (d >> (8 * k)) & 255 AS v FROM (
  SELECT doc_id, chunk, n, word, (x - coalesce(lag(x) OVER (PARTITION BY doc_id, chunk ORDER BY word), 0)) & 4294967295 AS d FROM (
    SELECT doc_id, chunk, n, pos // 4 AS word, CAST(sum(CAST(v AS BIGINT) << CAST(8 * (pos % 4) AS INTEGER)) AS BIGINT) AS x FROM b WHERE pos < n // 4 * 4 GROUP BY ALL)),
  (SELECT unnest([0, 1, 2, 3]) AS k) UNION ALL SELECT doc_id, chunk, n, pos, v FROM b WHERE pos >= n // 4 * 4"""
_BITS = """SELECT doc_id, chunk, k * ((n + 7) // 8) + pos // 8 AS pos, CAST(sum(((v >> k) & 1) << CAST(pos % 8 AS INTEGER)) AS INTEGER) AS v
  FROM b, (SELECT unnest(range(0, 8))::INTEGER AS k) GROUP BY doc_id, chunk, k, n, pos // 8"""
_NIBBLES = """SELECT doc_id, chunk, k * ((n + 1) // 2) + pos // 2 AS pos,
    CAST(sum((CASE WHEN k = 0 THEN v >> 4 ELSE v & 15 END) << CAST(4 * (pos % 2) AS INTEGER)) AS INTEGER) AS v
  FROM b, (SELECT unnest([0, 1]) AS k) GROUP BY doc_id, chunk, k, n, pos // 2"""


def _bits_of(rows: str, i: int, tag: str) -> str:
    """Ideal size of a candidate: the entropy of its neighbourhood residuals."""
    return f"SELECT {i} AS mode, '{tag}' AS tag, doc_id, chunk, pos, n, v FROM ({rows})"


_CANDIDATES = f"""WITH {_chunk_cte()}, cand AS ({_bits_of(_B, 0, 'BASE')} UNION ALL {_bits_of(_transposed(_delta(_B, 4), 4), 1, 'D4T4')}
  UNION ALL {_bits_of(_transposed(_delta(_B, 1024), 1024), 2, 'D1024T1024')}),
l AS (SELECT *, {', '.join(f'lag(v, {k}) OVER (PARTITION BY mode, doc_id, chunk ORDER BY pos) AS p{k}' for k in (1, 15, 16, 17, 256))} FROM cand),
{_RES.replace('SELECT doc_id, chunk, pos,', 'SELECT mode, tag, doc_id, chunk, n, pos,', 1)},
sized AS (SELECT mode, tag, doc_id, chunk, n, CAST(ceil((round(-sum(c / t * log2(c / t)), 6) + 0.0) * n / 8) AS BIGINT) AS size FROM (
  SELECT mode, tag, doc_id, chunk, n, CAST(count(*) AS DOUBLE) AS c, sum(count(*)) OVER (PARTITION BY mode, doc_id, chunk) AS t
  FROM r GROUP BY mode, tag, doc_id, chunk, n, v) GROUP BY mode, tag, doc_id, chunk, n),
best AS (SELECT doc_id, chunk, any_value(n) AS n, max(size) FILTER (WHERE mode = 0) AS base, min(size) AS best_size,
  arg_min(mode, size * 10 + mode) AS best_mode, arg_min(tag, size * 10 + mode) AS best_tag FROM sized GROUP BY doc_id, chunk)"""
_LAG_LIST = [1, 2, 3, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096]


def _sampled(lags: list[int], size: int = CHUNK) -> str:
    parts = [
        f"""SELECT doc_id, chunk, n, {k} AS lag, coalesce(avg(CASE WHEN pos >= {k} AND (pos - {k}) % greatest(1, (n - {k}) // 8192) = 0 THEN CAST(v = p AS INTEGER) END), 0) AS rate
  FROM (SELECT *, lag(v, {k}) OVER ({_W}) AS p FROM b) GROUP BY doc_id, chunk, n"""
        for k in lags
    ]
    return f"WITH {_chunk_cte(size)}, s AS ({' UNION ALL '.join(parts)})"


def _bands(col: str, high, low, at_high, at_low, mid) -> str:
    return f"CASE WHEN {col} >= {high} THEN {at_high} WHEN {col} <= {low} THEN {at_low} ELSE {mid} END"


_TEXT = {m: _bands("printable", *profiles.TEXT_BANDS[m]) for m in profiles.TEXT_BANDS}
_TEXT[1] = "CASE WHEN entropy >= 7.2 THEN 0.95 WHEN entropy >= 6.2 THEN 1.05 WHEN entropy <= 4.2 THEN 1.32 ELSE 1.18 END"
_TEXT[3] = "CASE WHEN entropy >= 7.0 AND eq1 < 0.03 THEN 0.92 WHEN entropy <= 4.5 OR eq1 > 0.16 THEN 1.30 WHEN printable >= 0.75 THEN 1.05 ELSE 1.12 END"

ORACLES = {
    "chunk_scan": f"""WITH {_chunk_cte()} SELECT doc_id, chunk, CAST(n AS BIGINT) AS raw_len, sha256(unhex(h)) AS raw_sha256 FROM chunks""",
    "chunk_counts": f"WITH {_chunk_cte()} SELECT doc_id, count(*) AS n_chunks, CAST(sum(n) AS BIGINT) AS n_bytes, min(n) AS least FROM chunks GROUP BY doc_id",
    "byte_entropy": f"WITH {_chunk_cte()}, {_entropy('b', 'e')} SELECT doc_id, chunk, CAST(n AS BIGINT) AS raw_len, bits AS entropy FROM chunks JOIN e USING (doc_id, chunk)",
    "printable_share": f"WITH {_chunk_cte()} SELECT doc_id, chunk, round(avg(CAST({_PRINTABLE} AS INTEGER)), 12) AS printable FROM b GROUP BY doc_id, chunk",
    "eq_rate": f"WITH {_chunk_cte()}, {_LAGGED} SELECT doc_id, chunk, " + ", ".join(f"round({_equal(k)}, 12) AS eq{k}" for k in (1, 16, 256)) + " FROM l GROUP BY doc_id, chunk",
    "sampled_lag_score": f"{_sampled([1, 4, 64], 16384)} SELECT doc_id, chunk, lag, round(rate, 12) AS rate FROM s",
    "top3_lags": f"""{_sampled(_LAG_LIST)} SELECT doc_id, chunk, CAST(rank AS INTEGER) AS rank, lag, round(rate, 12) AS rate FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, chunk ORDER BY rate DESC, lag DESC) AS rank FROM s) WHERE rank <= 3""",
    "neighbour_residual_entropy": f"WITH {_chunk_cte()}, {_LAGGED}, {_RES}, {_entropy('r', 're')} SELECT doc_id, chunk, bits AS res_entropy FROM re",
    "repeat_rate_4gram": f"{_grams('64')} SELECT doc_id, chunk, repeats, samples FROM a",
    "chain_depth_band": f"{_grams('64')} SELECT doc_id, chunk, "
    + ", ".join(
        f"CASE WHEN n < 4096 THEN {often[i]} WHEN rate < 0.025 THEN {rare[i]} WHEN rate < 0.080 THEN {some[i]} ELSE {often[i]} END AS {name}_{k.lower()}"
        for k, (rare, some, often) in profiles.CHAIN_BANDS.items()
        for i, name in enumerate(("chain", "lazy"))
    )
    + " FROM a",
    "raw_gate": f"""{_grams('greatest(64, n // 4096)', 32768)} SELECT doc_id, chunk, CAST(n AS BIGINT) AS raw_len, repeats AS gate_repeats, samples AS gate_samples,
  n >= 8192 AND samples >= 256 AND repeats * 1000 <= samples AS skip_parse FROM a""",
    "text_band_penalty": f"{_ALL} SELECT doc_id, chunk, " + ", ".join(f"CAST({_TEXT[m]} AS DOUBLE) AS penalty_{m}" for m in (1, 2, 3, 7, 8, 9)) + " FROM m",
    "continuous_penalty": f"""{_ALL}, x AS (SELECT q.*, h.bits AS entropy FROM q JOIN (
    SELECT doc_id, chunk, -sum(c / t * log2(c / t)) AS bits FROM (SELECT doc_id, chunk, CAST(count(*) AS DOUBLE) AS c, sum(count(*)) OVER (PARTITION BY doc_id, chunk) AS t
      FROM b GROUP BY doc_id, chunk, v) GROUP BY doc_id, chunk) h USING (doc_id, chunk))
  SELECT doc_id, chunk, round(least(greatest(1.30 - 0.30 * printable, 0.94), 1.26), 6) AS penalty_4,
    round(least(greatest(CAST(1.24 AS DOUBLE) - 0.22 * printable - 0.045 * (entropy - 5.5), 0.90), 1.27), 6) AS penalty_5,
    round(least(greatest(CAST(1.22 AS DOUBLE) - 0.18 * printable - 0.050 * (entropy - 5.5) + 0.32 * eq1, 0.88), 1.28), 6) AS penalty_6 FROM x""",
    "lazy_depth_band": f"""WITH {_chunk_cte()}, m AS (SELECT doc_id, chunk, avg(CAST({_PRINTABLE} AS INTEGER)) AS printable FROM b GROUP BY doc_id, chunk)
  SELECT doc_id, chunk, CASE WHEN printable >= 0.75 THEN 28 ELSE 19 END AS lazy_1, CASE WHEN printable <= 0.35 THEN 28 ELSE 19 END AS lazy_2,
    CASE WHEN printable >= 0.75 THEN 24 WHEN printable <= 0.35 THEN 30 ELSE 22 END AS lazy_3 FROM m""",
    "chunk_class": f"{_ALL} SELECT doc_id, chunk, class FROM k",
    "class_stats": f"""{_ALL} SELECT class, count(*) AS chunks, CAST(sum(n) AS BIGINT) AS raw, CAST(sum(size) AS BIGINT) AS size, round(sum(size) / sum(n), 4) AS ratio,
    round(sum(excess), 4) AS excess, round(avg(entropy), 4) AS avg_entropy, round(avg(res_entropy), 4) AS avg_res_entropy,
    round(avg(eq16), 4) AS avg_eq16, round(avg(eq256), 4) AS avg_eq256, round(sum(excess) / (SELECT sum(excess) FROM k), 4) AS excess_share FROM k GROUP BY class""",
    "worst_chunks": f"""{_ALL} SELECT doc_id, chunk, CAST(n AS BIGINT) AS raw, size, round(excess, 4) AS excess FROM (
  SELECT *, row_number() OVER (ORDER BY excess DESC, doc_id, chunk) AS i FROM k) WHERE i <= 30""",
    "best_mode_by_size": f"{_CANDIDATES} SELECT doc_id, chunk, base, best_size, best_mode, best_tag, base - best_size AS saved FROM best",
    "mode_histogram": f"""{_CANDIDATES} SELECT m.mode, m.tag, count(best.best_mode) AS n FROM (VALUES (0, 'BASE'), (1, 'D4T4'), (2, 'D1024T1024')) m(mode, tag)
  LEFT JOIN best ON best.best_mode = m.mode GROUP BY m.mode, m.tag""",
    "oracle_rollup": f"""{_CANDIDATES} SELECT doc_id, CAST(sum(n) AS BIGINT) AS raw, CAST(sum(base) AS BIGINT) AS base, CAST(sum(best_size) AS BIGINT) AS best,
  CAST(sum(base - best_size) AS BIGINT) AS saved, round(sum(best_size) / sum(n), 6) AS ratio FROM best GROUP BY ROLLUP (doc_id)""",
    "routed_zlib": f"WITH {_chunk_cte(65536)} SELECT doc_id, chunk, CAST(n AS BIGINT) AS raw_len, sha256(unhex(h)) AS raw_sha256, true AS never_larger, true AS known FROM chunks",
    "codec_round_trips": """SELECT codec, CAST(sum(octet_length(encode(text))) AS BIGINT) AS raw, true AS saves, true AS all_ok FROM documents, (SELECT unnest(['zlib-6', 'bzip2-9', 'zstd-3']) AS codec)
  WHERE text <> '' GROUP BY codec""",
    "byte_rows_delta": f"""WITH {_chunk_cte(CHUNK, 'benchmark', 'item_id')},
  o AS ({_hashed(_transposed(_delta(_delta('SELECT * FROM b', 4, key='item_id'), 3, '^', key='item_id'), 4, 'item_id'), 'item_id')}), i AS ({_hashed('SELECT * FROM b', 'item_id')})
  SELECT item_id, chunk, o.out_sha256, i.out_sha256 AS raw_sha256 FROM o JOIN i USING (item_id, chunk)""",
}
for _name, _rows in {
    "delta_lag": _delta(_B, 16), "xor_lag": _delta(_B, 4, "^"), "double_delta": _delta(_delta(_B, 4), 4), "transpose4": _transposed(_B, 4),
    "word_xor2": _WORD_XOR, "word_delta4": _WORD_DELTA, "delta_transpose": _transposed(_delta(_B, 4), 4), "bitplanes": _BITS, "nibbles": _NIBBLES,
    **dict.fromkeys(_INVERSES, _B),
}.items():
    ORACLES[_name] = f"WITH {_chunk_cte()} {_hashed(_rows)}"
ORACLES["neighbour_residuals"] = f"WITH {_chunk_cte()}, {_LAGGED}, {_RES} {_hashed('SELECT * FROM r')}"
