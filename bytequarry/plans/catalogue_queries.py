"""Queries over catalogues of transforms, over chunks of the full size, and over numeric bytes.

Candidates are measured by what an ideal order-0 coder needs, which SQL can compute as well; ties go to the tag that comes
first in the alphabet. Full-size chunks are cut from the texts of PART documents joined in order of their ids; numeric bytes
are embeddings as little-endian 32-bit floats.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bytequarry.functions.transforms import CATALOGUES, steps
from bytequarry.operators import profiles, routing, transforming
from bytequarry.operators.kernel_map import map_chunks
from bytequarry.plans.chunk_queries import _LAG_LIST, CHUNK, _chunk_cte, _delta, _entropy, _ids, _r6, _r12, _transposed, chunks
from bytequarry.sources import chunks as source

PART, VECTORS = 256, 512


def gathered(spark, sf_dir):
    """Chunks of 512 KiB from the joined texts of every PART documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.expr(f"doc_id div {PART}").alias("part"), F.struct("doc_id", "text").alias("t"))
    joined = docs.groupBy("part").agg(F.array_join(F.transform(F.sort_array(F.collect_list("t")), lambda x: x["text"]), "").alias("text"))
    return source.from_text(joined, "part", "text")


def vector_chunks(spark, sf_dir):
    """Chunks of the embeddings' bytes, VECTORS of them to a key."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.expr(f"vec_id div {VECTORS}").alias("key"), F.struct("vec_id", "embedding").alias("e"))
    rows = vectors.groupBy("key").agg(F.flatten(F.transform(F.sort_array(F.collect_list("e")), lambda x: x["embedding"])).alias("values"))
    packed = map_chunks(rows, T._parse_datatype_string("content binary"), lambda v: [(np.array(v, "<f4").tobytes(),)], ["values"], ["key"])
    return source.cut(packed, "key", F.col("content"), 65536)


def gathered_scan(spark, sf_dir):
    return _ids(gathered(spark, sf_dir), "raw_len", F.sha2("raw", 256).alias("raw_sha256"))


def gathered_profile(spark, sf_dir):
    found = profiles.profile(gathered(spark, sf_dir), "entropy", "res_entropy", "printable", "eq16")
    return _ids(found, "raw_len", _r6("entropy"), _r6("res_entropy"), _r12("printable"), _r12("eq16"))


def gathered_lag_score(spark, sf_dir):
    """Sampled rates, with the step that the chunk's length asks for."""
    step = F.greatest(F.lit(1), F.expr("(raw_len - lag) div 8192")).alias("step")
    return _ids(profiles.match_rates(gathered(spark, sf_dir), _LAG_LIST, sampled=True), "lag", step, _r12("rate"))


def gathered_top3_lags(spark, sf_dir):
    return _ids(profiles.top_lags(gathered(spark, sf_dir)), "rank", "lag", _r12("rate"))


def gathered_raw_gate(spark, sf_dir):
    """The gate, with the stride of its samples."""
    found = profiles.profile(gathered(spark, sf_dir), "gate_repeats", "gate_samples")
    stride = F.greatest(F.lit(64), F.expr("raw_len div 4096")).alias("stride")
    return _ids(found, "raw_len", stride, "gate_repeats", "gate_samples", profiles.raw_gate().alias("skip_parse"))


def _catalogue(name: str):
    def query(spark, sf_dir):
        chosen = routing.best(routing.candidates(chunks(spark, sf_dir), CATALOGUES[name], "order0"), "tag")
        return _ids(chosen, "base", "best_size", "best_tag", "saved")

    return query


def vector_catalogue(spark, sf_dir):
    """Word transforms over numeric bytes."""
    chosen = routing.best(routing.candidates(vector_chunks(spark, sf_dir), CATALOGUES["words"], "order0"), "tag")
    return _ids(chosen, "raw_len", "base", "best_size", "best_tag", "saved")


def _vector_transform(name: str):
    def query(spark, sf_dir):
        out = transforming.transformed(vector_chunks(spark, sf_dir), name)
        return _ids(out, F.octet_length("payload").alias("n"), F.sha2(F.hex("payload"), 256).alias("out_sha256"))

    return query


def candidate_map(spark, sf_dir):
    """Every chunk's sizes by tag."""
    sizes = routing.size_map(routing.candidates(chunks(spark, sf_dir), CATALOGUES["records28"], "order0"))
    told = F.array_join(F.transform(F.array_sort(F.map_entries("all")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return _ids(sizes, told.alias("sizes"))


def top_lag_oracle(spark, sf_dir):
    """BASE against delta and transpose at each chunk's three best lags."""
    return _ids(routing.best(routing.top_lag_candidates(chunks(spark, sf_dir), codec="order0"), "tag"), "base", "best_size", "best_tag", "saved")


_VECTOR_TRANSFORMS = {"vector_word_delta2": "WD2", "vector_word_delta8": "WD8", "vector_word_xor4": "WX4", "vector_word_xor8_transposed": "WX8T8"}
QUERIES = {
    f.__name__: f
    for f in (gathered_scan, gathered_profile, gathered_lag_score, gathered_top3_lags, gathered_raw_gate, vector_catalogue, candidate_map, top_lag_oracle)
}
QUERIES |= {f"catalogue_{name}": _catalogue(name) for name in CATALOGUES} | {n: _vector_transform(t) for n, t in _VECTOR_TRANSFORMS.items()}

# --- SQL ---------------------------------------------------------------------------------------------

_W = "PARTITION BY doc_id, chunk ORDER BY pos"


def _whole_cte(table: str, size: int) -> str:
    """chunks and b as _chunk_cte() makes them, from (doc_id, h) of long inputs: bytes are split off together."""
    return f"""raw AS ({table}), chunks AS (SELECT doc_id, CAST(c AS INTEGER) AS chunk, substr(h, c * {2 * size} + 1, {2 * size}) AS h, least({size}, length(h) // 2 - c * {size}) AS n
  FROM (SELECT doc_id, h, unnest(range(0, (length(h) // 2 - 1) // {size} + 1)) AS c FROM raw WHERE h <> '')),
b AS MATERIALIZED (SELECT doc_id, chunk, n, pos, CAST('0x' || x AS INTEGER) AS v FROM (SELECT doc_id, chunk, n, unnest(range(0, n)) AS pos, unnest(regexp_extract_all(h, '..')) AS x FROM chunks))"""


_FULL = _whole_cte(f"SELECT doc_id // {PART} AS doc_id, hex(encode(string_agg(text, '' ORDER BY doc_id))) AS h FROM documents GROUP BY 1", source.CHUNK_BYTES)
_FLOATS = _whole_cte(
    f"""SELECT vec_id // {VECTORS} AS doc_id, string_agg(substr(x, 7, 2) || substr(x, 5, 2) || substr(x, 3, 2) || substr(x, 1, 2), '' ORDER BY vec_id, i) AS h
  FROM (SELECT vec_id, i, hex(CAST(CAST(e AS BIT) AS BLOB)) AS x FROM (SELECT vec_id, unnest(embedding) AS e, unnest(range(0, len(embedding))) AS i FROM embeddings)) GROUP BY 1""",
    65536,
)


def _words(rows: str, w: int, op: str) -> str:
    """Little-endian words of w bytes, less or xor the word before."""
    if op == "X":
        return f"SELECT doc_id, chunk, n, pos, CASE WHEN pos < {w} OR pos >= n // {w} * {w} THEN v ELSE xor(v, lag(v, {w}) OVER ({_W})) END AS v FROM ({rows})"
    whole = f"CAST({1 << 8 * w} AS HUGEINT)"
    return f"""SELECT doc_id, chunk, n, {w} * word + k AS pos, CAST((d // p) % 256 AS INTEGER) AS v FROM (
  SELECT doc_id, chunk, n, word, (x - coalesce(lag(x) OVER (PARTITION BY doc_id, chunk ORDER BY word), 0) + {whole}) % {whole} AS d FROM (
    SELECT doc_id, chunk, n, pos // {w} AS word, sum(v * p) AS x FROM (SELECT * FROM ({rows}) WHERE pos < n // {w} * {w}) JOIN powers ON k = pos % {w} GROUP BY ALL)),
  (SELECT k, p FROM powers WHERE k < {w}) UNION ALL SELECT doc_id, chunk, n, pos, v FROM ({rows}) WHERE pos >= n // {w} * {w}"""


_POWERS = "powers AS (SELECT k, CAST(p AS HUGEINT) AS p FROM (VALUES " + ", ".join(f"({k}, {256**k})" for k in range(8)) + ") t(k, p))"


def _bits(rows: str) -> str:
    return f"""SELECT doc_id, chunk, n, k * ((n + 7) // 8) + pos // 8 AS pos, CAST(sum(((v >> k) & 1) << CAST(pos % 8 AS INTEGER)) AS INTEGER) AS v
  FROM ({rows}), (SELECT unnest(range(0, 8))::INTEGER AS k) GROUP BY doc_id, chunk, k, n, pos // 8"""


def _nibbles(rows: str) -> str:
    return f"""SELECT doc_id, chunk, n, k * ((n + 1) // 2) + pos // 2 AS pos, CAST(sum((CASE WHEN k = 0 THEN v >> 4 ELSE v & 15 END) << CAST(4 * (pos % 2) AS INTEGER)) AS INTEGER) AS v
  FROM ({rows}), (SELECT unnest([0, 1]) AS k) GROUP BY doc_id, chunk, k, n, pos // 2"""


def _tagged(tag: str) -> str:
    """SQL of a chunk's bytes in a transform."""
    rows = "SELECT doc_id, chunk, n, pos, v FROM b"
    for kind, k in steps(tag):
        rows = {
            "D": lambda r: _delta(r, k), "X": lambda r: _delta(r, k, "^"), "DD": lambda r: _delta(_delta(r, k), k), "T": lambda r: _transposed(r, k),
            "WD": lambda r: _words(r, k, "D"), "WX": lambda r: _words(r, k, "X"), "BIT": _bits, "NIB": _nibbles,
        }[kind](rows)
    return rows


def _sized(tags: list[str]) -> str:
    """CTE sized: (tag, doc_id, chunk, n, size) of every candidate."""
    every = " UNION ALL ".join(f"SELECT '{t}' AS tag, doc_id, chunk, n, v FROM ({_tagged(t)})" for t in tags)
    return f"""{_POWERS}, cand AS MATERIALIZED ({every}), sized AS (SELECT tag, doc_id, chunk, n, CAST(ceil((round(-sum(c / t * log2(c / t)), 6) + 0.0) * any_value(t) / 8) AS BIGINT) + 1 AS size FROM (
  SELECT tag, doc_id, chunk, n, CAST(count(*) AS DOUBLE) AS c, sum(count(*)) OVER (PARTITION BY tag, doc_id, chunk) AS t FROM cand GROUP BY tag, doc_id, chunk, n, v) GROUP BY tag, doc_id, chunk, n)"""


_BEST = """SELECT doc_id, chunk, {more}max(size) FILTER (WHERE tag = 'BASE') AS base, min(size) AS best_size, arg_min(tag, (size, tag)) AS best_tag,
  max(size) FILTER (WHERE tag = 'BASE') - min(size) AS saved FROM sized GROUP BY doc_id, chunk, n"""


def _lag_rates(cte: str) -> str:
    parts = [
        f"""SELECT doc_id, chunk, n, {k} AS lag, greatest(1, (n - {k}) // 8192) AS step, coalesce(avg(CASE WHEN pos >= {k} AND (pos - {k}) % greatest(1, (n - {k}) // 8192) = 0 THEN CAST(v = p AS INTEGER) END), 0) AS rate
  FROM (SELECT *, lag(v, {k}) OVER ({_W}) AS p FROM b) GROUP BY doc_id, chunk, n"""
        for k in _LAG_LIST
    ]
    return f"WITH {cte}, s AS ({' UNION ALL '.join(parts)})"


_TOP = "top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk ORDER BY rate DESC, lag DESC) AS rank FROM s) WHERE rank <= 3)"
_GATE = f"""WITH {_FULL}, s AS (SELECT doc_id, chunk, n, greatest(64, n // 4096) AS stride, pos, v + 256 * lead(v, 1) OVER ({_W}) + 65536 * lead(v, 2) OVER ({_W}) + CAST(16777216 AS BIGINT) * lead(v, 3) OVER ({_W}) AS key FROM b),
g AS (SELECT *, ((CAST(key AS BIGINT) * 2654435761) & 4294967295) >> 20 AS slot FROM s WHERE pos % stride = 0 AND pos + 4 <= n),
t AS (SELECT *, key = lag(key) OVER (PARTITION BY doc_id, chunk, slot ORDER BY pos) AS again FROM g)"""
_NEAR = "l AS (SELECT *, " + ", ".join(f"lag(v, {k}) OVER ({_W}) AS p{k}" for k in (1, 15, 16, 17, 256)) + " FROM b)"
_RESIDUALS = """r AS (SELECT doc_id, chunk, pos, (v - CASE WHEN w = 0 THEN 0 ELSE (s + w // 2) // w END) & 255 AS v FROM (SELECT *,
  3 * coalesce(p1, 0) + 2 * coalesce(p16, 0) + 2 * coalesce(p256, 0) + coalesce(p17, 0) + coalesce(p15, 0) AS s,
  3 * CAST(p1 IS NOT NULL AS INTEGER) + 2 * CAST(p16 IS NOT NULL AS INTEGER) + 2 * CAST(p256 IS NOT NULL AS INTEGER) + CAST(p17 IS NOT NULL AS INTEGER) + CAST(p15 IS NOT NULL AS INTEGER) AS w FROM l))"""
ORACLES = {
    "gathered_scan": f"WITH {_FULL} SELECT doc_id, chunk, CAST(n AS BIGINT) AS raw_len, sha256(unhex(h)) AS raw_sha256 FROM chunks",
    "gathered_profile": f"""WITH {_FULL}, {_NEAR}, {_RESIDUALS}, {_entropy('b', 'e')}, {_entropy('r', 're')}, q AS (SELECT doc_id, chunk, n,
    round(avg(CAST((v BETWEEN 32 AND 126 OR v IN (9, 10, 13)) AS INTEGER)), 12) AS printable, round(avg(CASE WHEN pos >= 16 THEN CAST(v = p16 AS INTEGER) END), 12) AS eq16 FROM l GROUP BY doc_id, chunk, n)
  SELECT doc_id, chunk, CAST(n AS BIGINT) AS raw_len, e.bits AS entropy, re.bits AS res_entropy, printable, eq16 FROM q JOIN e USING (doc_id, chunk) JOIN re USING (doc_id, chunk)""",
    "gathered_lag_score": f"{_lag_rates(_FULL)} SELECT doc_id, chunk, lag, CAST(step AS BIGINT) AS step, round(rate, 12) AS rate FROM s",
    "gathered_top3_lags": f"{_lag_rates(_FULL)}, {_TOP} SELECT doc_id, chunk, CAST(rank AS INTEGER) AS rank, lag, round(rate, 12) AS rate FROM top",
    "gathered_raw_gate": f"""{_GATE} SELECT doc_id, chunk, CAST(any_value(n) AS BIGINT) AS raw_len, CAST(any_value(stride) AS BIGINT) AS stride, count(*) FILTER (WHERE again) AS gate_repeats, count(*) AS gate_samples,
  any_value(n) >= 8192 AND count(*) >= 256 AND count(*) FILTER (WHERE again) * 1000 <= count(*) AS skip_parse FROM t GROUP BY doc_id, chunk""",
    "vector_catalogue": f"WITH {_FLOATS}, {_sized(CATALOGUES['words'])} {_BEST.format(more='CAST(n AS BIGINT) AS raw_len, ')}",
    "candidate_map": f"WITH {_chunk_cte()}, {_sized(CATALOGUES['records28'])} SELECT doc_id, chunk, string_agg(tag || '=' || size, ',' ORDER BY tag) AS sizes FROM sized GROUP BY doc_id, chunk",
    "top_lag_oracle": f"""{_lag_rates(_chunk_cte())}, {_TOP}, cand AS MATERIALIZED (SELECT 'BASE' AS tag, doc_id, chunk, n, v FROM b UNION ALL
    SELECT 'D' || lag || 'T' || lag, x.doc_id, x.chunk, x.n, CASE WHEN y.v IS NULL THEN x.v ELSE (x.v - y.v) & 255 END FROM top JOIN b x ON x.doc_id = top.doc_id AND x.chunk = top.chunk
      LEFT JOIN b y ON y.doc_id = x.doc_id AND y.chunk = x.chunk AND y.pos = x.pos - lag),
  sized AS (SELECT tag, doc_id, chunk, n, CAST(ceil((round(-sum(c / t * log2(c / t)), 6) + 0.0) * n / 8) AS BIGINT) + 1 AS size FROM (
    SELECT tag, doc_id, chunk, n, CAST(count(*) AS DOUBLE) AS c, sum(count(*)) OVER (PARTITION BY tag, doc_id, chunk) AS t FROM cand GROUP BY tag, doc_id, chunk, n, v) GROUP BY tag, doc_id, chunk, n)
  {_BEST.format(more='')}""",
}
ORACLES |= {f"catalogue_{name}": f"WITH {_chunk_cte()}, {_sized(tags)} {_BEST.format(more='')}" for name, tags in CATALOGUES.items()}
ORACLES |= {
    name: f"""WITH {_FLOATS}, {_POWERS} SELECT doc_id, chunk, CAST(count(*) AS INTEGER) AS n, sha256(string_agg(printf('%02X', v), '' ORDER BY pos)) AS out_sha256 FROM ({_tagged(tag)}) GROUP BY doc_id, chunk"""
    for name, tag in _VECTOR_TRANSFORMS.items()
}
