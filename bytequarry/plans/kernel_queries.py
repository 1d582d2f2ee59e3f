"""Queries over parsed and packed chunks. What SQL can follow only on short texts (it keeps a list of costs for every byte)
reads the benchmark and, as documents_..., all chunks of documents; the others read documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bytequarry.functions import batches, lz, scalar
from bytequarry.operators import matching, profiles
from bytequarry.operators.kernel_map import map_chunks, map_groups
from bytequarry.plans.chunk_queries import _PRINTABLE, CHUNK, _chunk_cte
from bytequarry.plans.chunk_queries import chunks as document_chunks
from bytequarry.sources import chunks as source


def items(spark, sf_dir):
    return source.from_text(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id", "text", CHUNK)


def documents(spark, sf_dir):
    """The chunks of documents, dealt out evenly."""
    return source.spread(document_chunks(spark, sf_dir))


def _ids(df, *more):
    return df.select(F.col("key").alias("item_id"), "chunk", *more)


def lz_tokens(spark, sf_dir, read=items):
    return _ids(matching.tokens(read(spark, sf_dir)), "tok_no", "at", "len", "dist")


def lz_tokens_of_short_chains(spark, sf_dir, read=items):
    """The parse that looks at one earlier place."""
    return _ids(matching.tokens(read(spark, sf_dir), lz.ParseOptions(depth=1)), "tok_no", "at", "len", "dist")


def token_totals(spark, sf_dir, read=items):
    """Of each chunk's parse: tokens, bytes in matches, longest match, largest distance."""
    found = matching.tokens(read(spark, sf_dir)).groupBy(F.col("key").alias("item_id"), "chunk")
    inside = F.sum(F.when(F.col("dist") > 0, F.col("len")).otherwise(0))
    return found.agg(F.count(F.lit(1)).alias("tokens"), inside.alias("matched"), F.max("len").alias("longest"), F.max("dist").alias("farthest"))


def literal_count(spark, sf_dir, read=items):
    return _ids(matching.literal_counts(read(spark, sf_dir)), "raw_len", "tokens", "literals")


def kernel_round_trip(spark, sf_dir):
    """Every chunk packed and unpacked."""
    back = matching.unpacked(matching.packed(documents(spark, sf_dir), verify=False))
    return back.select(F.col("key").alias("doc_id"), "chunk", "raw_len", F.sha2("raw", 256).alias("raw_sha256"))


def kernel_sizes(spark, sf_dir):
    """Packing never makes a chunk larger: totals by whether it pays."""
    made = matching.packed(documents(spark, sf_dir))
    size = F.octet_length("payload")
    return made.agg(
        F.count(F.lit(1)).alias("chunks"), F.sum("raw_len").alias("raw"), F.bool_and(size <= F.col("raw_len")).alias("never_larger"),
        F.bool_and((F.col("mode") == lz.RAW) == (size == F.col("raw_len"))).alias("mode_tells"), (F.sum(size) < F.sum("raw_len") * 0.7).alias("pays"),
    )


def adaptive_kernel_sizes(spark, sf_dir):
    """Packed with the distance penalty that each chunk's text share asks for, and unpacked."""
    given = profiles.profile(documents(spark, sf_dir), "printable", keep_raw=True)
    made = matching.packed_with_penalty(given, profiles.distance_penalty(9), verify=False)  # it is unpacked below
    fields = T._parse_datatype_string("raw_sha256 string")
    import hashlib

    def work(modes, payloads, sizes):
        return range(len(modes)), [hashlib.sha256(raw).hexdigest() for raw in batches.unpack(modes, payloads, sizes)]

    back = map_groups(made, fields, work, ["mode", "payload", "raw_len"], ["key", "chunk", "raw_len", "penalty"], matching.PACKED_BYTES, "raw_len")
    return back.select(F.col("key").alias("doc_id"), "chunk", "raw_len", "penalty", "raw_sha256")


def match_candidates_4gram(spark, sf_dir, read=items):
    return _ids(matching.match_candidates(read(spark, sf_dir), depth=4), "pos", "dist", "rank")


def top2_candidates(spark, sf_dir, read=items):
    """The two candidates whose distance saves most: lattice bonus less the cost of the distance."""
    score = lambda dist: np.round(scalar.lattice_bits(8, dist) - 1.2 * np.log2(dist + 1.0), 6)
    top = matching.best_candidates(read(spark, sf_dir), 8, score, 2)
    return _ids(top, "pos", "dist", "score", "place")


def longest_match(spark, sf_dir, read=items):
    return _ids(matching.longest_matches(read(spark, sf_dir)), "pos", "len", "dist")


def prefix_cost(spark, sf_dir, read=items):
    return _ids(matching.prefix_costs(read(spark, sf_dir), 6.5, 0.0), "pos", F.round("cost", 4).alias("cost"))


def predicted_prefix_cost(spark, sf_dir, read=items):
    costs = matching.prefix_costs(read(spark, sf_dir), 6.5, 0.5)
    return costs.groupBy(F.col("key").alias("item_id"), "chunk").agg(F.round(F.max("cost"), 4).alias("cost"))


def sampled_prefix_cost(spark, sf_dir, read=items):
    """Costs that are predicted at every fourth byte, with more weight on costly ones."""
    costs = matching.prefix_costs(read(spark, sf_dir), 6.5, "zones", stride=4)
    return costs.groupBy(F.col("key").alias("item_id"), "chunk").agg(F.round(F.max("cost"), 4).alias("cost"))


#: Variants of the kernel: search and costs, and how the parse is coded.
VARIANTS = {
    "deep": {}, "fast": {"depth": 8}, "single": {"depth": 1}, "hash19": {"hash_bits": 19}, "hash21": {"hash_bits": 21}, "hash22": {"hash_bits": 22},
    "lattice": {"lattice": 8}, "recent": {"lattice": 3}, "predicted": {"predicted": 0.5}, "asymmetric": {"predicted": "asymmetric"}, "smooth": {"predicted": "smooth"},
    "zones": {"predicted": "zones"}, "stride4": {"predicted": 0.5, "stride": 4}, "dual": {"second": "nearest"}, "fused": {"second": "cheapest", "lattice": 8},
    "length_knows": {"couple": 2}, "distance_knows": {"couple": 1}, "both_know": {"couple": 3}, "columns": {"contexts": ("column",)}, "rows": {"contexts": ("row",)}, "cells": {"contexts": ("cell",)},
    "raw_literals": {"means": ("none",)}, "byte_before": {"means": (((1, 1),),)}, "two_before": {"means": (((1, 1), (16, 1)),)}, "competing": {"compete_from": 0.35},
}


def parse_variants(spark, sf_dir, read=items):
    """Every variant over the short texts: whether it saves and whether all chunks come back, in one pass over the chunks."""
    fields = T._parse_datatype_string("variant string, size long, restored boolean")

    def work(raw):
        data, out = bytes(raw), []
        for name, given in VARIANTS.items():
            coding = {k: v for k, v in given.items() if k in ("couple", "contexts", "means")}
            search = {k: v for k, v in given.items() if k not in (*coding, "compete_from")}
            mode, payload = lz.pack(data, lz.ParseOptions(**search), False, given.get("compete_from"), lz.PackOptions(**coding))
            out.append((name, len(payload), lz.unpack(mode, payload, len(data)) == data))
        return out

    made = map_chunks(source.spread(read(spark, sf_dir)), fields, work, ["raw"], ["raw_len"]).groupBy("variant")
    return made.agg(F.sum("raw_len").alias("raw"), (F.sum("size") <= F.sum("raw_len")).alias("fits"), F.bool_and("restored").alias("restored"))


def _over_documents(query):
    def run(spark, sf_dir):
        found = query(spark, sf_dir, documents)
        return found.withColumnRenamed("item_id", "doc_id")

    return run


_ITEMS = (
    lz_tokens, lz_tokens_of_short_chains, token_totals, literal_count, match_candidates_4gram, top2_candidates, longest_match, prefix_cost, predicted_prefix_cost,
    sampled_prefix_cost, parse_variants,
)
QUERIES = {f.__name__: f for f in (*_ITEMS, kernel_round_trip, kernel_sizes, adaptive_kernel_sizes)}
QUERIES |= {f"documents_{f.__name__}": _over_documents(f) for f in _ITEMS if f is not parse_variants}

# --- SQL ---------------------------------------------------------------------------------------------

_CTE = _chunk_cte(CHUNK, "benchmark", "item_id")
_BY = "PARTITION BY item_id, chunk ORDER BY pos"
_SLOTS = f"""{_CTE}, g4 AS (SELECT item_id, chunk, n, pos, v + 256 * lead(v, 1) OVER ({_BY}) + 65536 * lead(v, 2) OVER ({_BY}) + CAST(16777216 AS BIGINT) * lead(v, 3) OVER ({_BY}) AS gram FROM b),
g AS (SELECT item_id, chunk, pos, gram, (CAST(gram AS HUGEINT) * 2654435761) % 1048576 AS slot FROM g4 WHERE pos + 4 <= n),
s AS (SELECT *, row_number() OVER (PARTITION BY item_id, chunk, slot ORDER BY pos) AS nth FROM g)"""


def _longest(depth: int) -> str:
    """CTE m: the longest match at every place. How far two places agree is where, at their distance, the next pair of
    bytes differs."""
    return f"""pairs AS (SELECT a.item_id, a.chunk, a.pos, a.pos - p.pos AS dist FROM s a JOIN s p ON a.item_id = p.item_id AND a.chunk = p.chunk AND a.gram = p.gram AND a.nth - p.nth BETWEEN 1 AND {depth}),
far AS (SELECT DISTINCT item_id, chunk, dist FROM pairs),
agree AS (SELECT x.item_id, x.chunk, f.dist, x.pos, x.n, min(CASE WHEN x.v <> y.v THEN x.pos END) OVER (PARTITION BY x.item_id, x.chunk, f.dist ORDER BY x.pos DESC) AS stop
  FROM far f JOIN b x ON x.item_id = f.item_id AND x.chunk = f.chunk JOIN b y ON y.item_id = x.item_id AND y.chunk = x.chunk AND y.pos = x.pos - f.dist),
m AS (SELECT item_id, chunk, pos, dist, size FROM (SELECT pairs.*, coalesce(stop, n) - pos AS size,
    row_number() OVER (PARTITION BY item_id, chunk, pos ORDER BY least(255, coalesce(stop, n) - pos) DESC, dist) AS place FROM pairs JOIN agree USING (item_id, chunk, pos, dist)) WHERE place = 1)"""


def _tokens(depth: int) -> str:
    """CTE t: the tokens of the cheapest parse. A list holds what the rest costs from each place on, nearest place first."""
    return f"""WITH RECURSIVE {_SLOTS}, {_longest(depth)},
p AS (SELECT chunks.item_id, chunks.chunk, pos, any_value(size) AS size, any_value(dist) AS dist, any_value(CAST(round(256 * (9.42 + CASE WHEN size <= 7 THEN 1.0 ELSE log2(size + 1.0) END + CAST(1.88 AS DOUBLE) * log2(dist + 1.0))) AS BIGINT)) AS bits
  FROM chunks JOIN b USING (item_id, chunk) LEFT JOIN m USING (item_id, chunk, pos) GROUP BY chunks.item_id, chunks.chunk, pos),
e AS (SELECT item_id, chunk, CAST(n AS BIGINT) AS pos, [CAST(0 AS BIGINT)] AS costs, false AS taken FROM chunks
  UNION ALL SELECT e.item_id, e.chunk, e.pos - 1, list_prepend(least(costs[1] + 1659, coalesce(costs[p.size] + p.bits, costs[1] + 1659)), costs), coalesce(costs[p.size] + p.bits < costs[1] + 1659, false)
  FROM e JOIN p ON p.item_id = e.item_id AND p.chunk = e.chunk AND p.pos = e.pos - 1),
c AS (SELECT e.item_id, e.chunk, e.pos, CASE WHEN taken THEN size ELSE 1 END AS len, CASE WHEN taken THEN dist ELSE 0 END AS dist FROM e JOIN p USING (item_id, chunk, pos)),
t AS (SELECT item_id, chunk, 0 AS tok_no, pos, len, dist FROM c WHERE pos = 0
  UNION ALL SELECT c.item_id, c.chunk, tok_no + 1, c.pos, c.len, c.dist FROM t JOIN c ON c.item_id = t.item_id AND c.chunk = t.chunk AND c.pos = t.pos + t.len)"""


_TOKEN_ROWS = "SELECT item_id, chunk, tok_no, CAST(pos AS INTEGER) AS at, CAST(len AS INTEGER) AS len, CAST(dist AS INTEGER) AS dist FROM t"
_NEAR = [(1, 3), (16, 2), (256, 2), (17, 1), (15, 1)]
_PREDICTED = f"""{_CTE}, l AS (SELECT item_id, chunk, pos, v, {', '.join(f'lag(v, {k}) OVER ({_BY}) AS p{k}' for k, _ in _NEAR)} FROM b),
w AS (SELECT *, {' + '.join(f'{x} * coalesce(p{k}, 0)' for k, x in _NEAR)} AS s, {' + '.join(f'{x} * CAST(p{k} IS NOT NULL AS INTEGER)' for k, x in _NEAR)} AS x FROM l),
r AS (SELECT item_id, chunk, pos, pos // 64 AS block, (v - CASE WHEN x = 0 THEN 0 ELSE (s + x // 2) // x END) & 255 AS r FROM w),
q AS (SELECT item_id, chunk, pos, log2((256.0 + 64 * block) / (1.0 + coalesce(count(*) OVER (PARTITION BY item_id, chunk, r ORDER BY block RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS bits FROM r)"""
_DOCUMENT_CHUNKS = _chunk_cte()
ORACLES = {
    "lz_tokens": f"{_tokens(42)} {_TOKEN_ROWS}",
    "lz_tokens_of_short_chains": f"{_tokens(1)} {_TOKEN_ROWS}",
    "token_totals": f"""{_tokens(42)} SELECT item_id, chunk, count(*) AS tokens, CAST(sum(CASE WHEN dist > 0 THEN len ELSE 0 END) AS BIGINT) AS matched, CAST(max(len) AS INTEGER) AS longest,
  CAST(max(dist) AS INTEGER) AS farthest FROM t GROUP BY item_id, chunk""",
    "literal_count": f"{_tokens(42)} SELECT item_id, chunk, CAST(sum(len) AS BIGINT) AS raw_len, count(*) AS tokens, count(*) FILTER (WHERE dist = 0) AS literals FROM t GROUP BY item_id, chunk",
    "longest_match": f"WITH {_SLOTS}, {_longest(42)} SELECT item_id, chunk, CAST(pos AS INTEGER) AS pos, CAST(least(255, size) AS INTEGER) AS len, CAST(dist AS INTEGER) AS dist FROM m",
    "kernel_round_trip": f"WITH {_DOCUMENT_CHUNKS} SELECT doc_id, chunk, CAST(n AS BIGINT) AS raw_len, sha256(unhex(h)) AS raw_sha256 FROM chunks",
    "kernel_sizes": f"WITH {_DOCUMENT_CHUNKS} SELECT count(*) AS chunks, CAST(sum(n) AS BIGINT) AS raw, true AS never_larger, true AS mode_tells, true AS pays FROM chunks",
    "adaptive_kernel_sizes": f"""WITH {_DOCUMENT_CHUNKS}, x AS (SELECT doc_id, chunk, avg(CAST({_PRINTABLE} AS INTEGER)) AS printable FROM b GROUP BY doc_id, chunk)
  SELECT doc_id, chunk, CAST(n AS BIGINT) AS raw_len, CAST(CASE WHEN printable >= 0.75 THEN 1.02 WHEN printable <= 0.35 THEN 0.95 ELSE 1.15 END AS DOUBLE) AS penalty, sha256(unhex(h)) AS raw_sha256
  FROM chunks JOIN x USING (doc_id, chunk)""",
    "match_candidates_4gram": f"""WITH {_SLOTS} SELECT a.item_id, a.chunk, CAST(a.pos AS INTEGER) AS pos, CAST(a.pos - p.pos AS INTEGER) AS dist, CAST(a.nth - p.nth AS INTEGER) AS rank
  FROM s a JOIN s p ON a.item_id = p.item_id AND a.chunk = p.chunk AND a.gram = p.gram AND a.nth - p.nth BETWEEN 1 AND 4""",
    "top2_candidates": f"""WITH {_SLOTS}, c AS (SELECT a.item_id, a.chunk, CAST(a.pos AS INTEGER) AS pos, CAST(a.pos - p.pos AS INTEGER) AS dist
    FROM s a JOIN s p ON a.item_id = p.item_id AND a.chunk = p.chunk AND a.gram = p.gram AND a.nth - p.nth BETWEEN 1 AND 8),
  q AS (SELECT *, round(CASE WHEN dist IN (15, 16, 17) THEN CAST(0.80 AS DOUBLE) ELSE 0 END + CASE WHEN dist IN (255, 256, 257) THEN CAST(1.30 AS DOUBLE) WHEN dist % 256 = 0 THEN 0.90
    WHEN dist % 16 = 0 THEN 0.45 ELSE 0 END - CAST(1.2 AS DOUBLE) * log2(dist + 1.0), 6) AS score FROM c)
  SELECT item_id, chunk, pos, dist, score, CAST(place AS INTEGER) AS place FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id, chunk, pos ORDER BY score DESC, dist) AS place FROM q) WHERE place <= 2""",
    "prefix_cost": f"WITH {_CTE} SELECT item_id, chunk, CAST(pos AS INTEGER) AS pos, round(6.5 * CAST(row_number() OVER ({_BY}) AS DOUBLE), 4) AS cost FROM b",
    "predicted_prefix_cost": f"WITH {_PREDICTED} SELECT item_id, chunk, round(sum(least(10.0, greatest(1.5, CAST(0.5 AS DOUBLE) * 6.5 + CAST(0.5 AS DOUBLE) * bits))), 4) AS cost FROM q GROUP BY item_id, chunk",
    "sampled_prefix_cost": f"""WITH {_PREDICTED}, z AS (SELECT *, CASE WHEN bits >= 7.0 THEN CAST(0.68 AS DOUBLE) WHEN bits <= 4.5 THEN 0.38 ELSE 0.50 END AS share FROM q),
  k AS (SELECT item_id, chunk, pos, least(10.0, greatest(1.5, (1 - share) * 6.5 + share * bits)) AS cost FROM z),
  a AS (SELECT x.item_id, x.chunk, 6.5 + (k.cost - 6.5) * pow(0.92, x.pos % 4) AS cost FROM b x JOIN k ON k.item_id = x.item_id AND k.chunk = x.chunk AND k.pos = x.pos - x.pos % 4)
  SELECT item_id, chunk, round(sum(cost), 4) AS cost FROM a GROUP BY item_id, chunk""",
    "parse_variants": f"WITH {_CTE}, t AS (SELECT CAST(sum(n) AS BIGINT) AS raw FROM chunks) SELECT variant, raw, true AS fits, true AS restored FROM t, (SELECT unnest({list(VARIANTS)}) AS variant)",
}
