"""Queries over measurement rows. `runs` reads line items as measurements: see runs()."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bytequarry.functions import scalar
from bytequarry.operators import analytics as A

WEAK, GUARD = [1, 2], [3, 4, 5]
#: A grid has a row for every profile and file, so it is refused beyond so many files.
MAX_GRID_FILES = 10_000
CODEC_NAMES = {"A": "order-0", "N": "dictionary"}


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as measurements: profile, class, file, raw, size, seconds, dec_seconds, sha_ok."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return items.select(
        F.col("l_returnflag").alias("profile"),
        F.col("l_linestatus").alias("class"),
        F.col("l_linenumber").alias("file"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("raw"),
        F.round(F.col("l_extendedprice") * 100 * (1 - F.col("l_discount"))).cast("long").alias("size"),
        F.col("l_quantity").alias("seconds"),
        (F.col("l_quantity") * (1 + F.col("l_tax"))).alias("dec_seconds"),
        (F.col("l_discount") < 0.1).alias("sha_ok"),
    )


RUNS = """runs AS (SELECT l_returnflag AS profile, l_linestatus AS class, l_linenumber AS file, CAST(round(l_extendedprice * 100) AS BIGINT) AS raw,
  CAST(round(l_extendedprice * 100 * (1 - l_discount)) AS BIGINT) AS size, l_quantity AS seconds, l_quantity * (1 + l_tax) AS dec_seconds,
  l_discount < 0.1 AS sha_ok FROM lineitem)"""


def _r(c: str, n: int = 4):
    return F.round(c, n).alias(c)


def per_file(spark, sf_dir):
    """One row for each profile and file, as a sweep has."""
    return runs(spark, sf_dir).groupBy("profile", "file").agg(F.sum("raw").alias("raw"), F.sum("size").alias("size"))


def derived_metrics(spark, sf_dir):
    made = A.with_metrics(runs(spark, sf_dir)).groupBy("profile", "class")
    return made.agg(*[F.round(F.avg(c), 4).alias(c) for c in ("ratio_pct", "comp_mbps", "dec_mbps")])


def sweep_summary(spark, sf_dir):
    return A.summary(runs(spark, sf_dir), "profile").select("profile", "n", "raw", "size", _r("ratio_pct"), _r("seconds"), "all_ok")


def harmonic_throughput(spark, sf_dir):
    made = A.harmonic_throughput(A.with_metrics(runs(spark, sf_dir)), "profile")
    return made.select("profile", "raw", "size", *[_r(c, 6) for c in ("ratio_pct", "comp_mbps", "dec_mbps")])


def median3(spark, sf_dir):
    return A.median_of_runs(runs(spark, sf_dir), "profile", "file")


def summed_median_throughput(spark, sf_dir):
    medians = runs(spark, sf_dir).groupBy("profile", "file").agg(F.sum("raw").alias("raw"), F.median("seconds").alias("med_seconds"))
    return A.summed_median_throughput(medians, "profile").select("profile", _r("mbps", 6))


def baseline_delta(spark, sf_dir):
    return A.baseline_delta(per_file(spark, sf_dir), "N")


def weak_guard_sums(spark, sf_dir):
    return A.set_deltas(A.baseline_delta(per_file(spark, sf_dir), "N"), WEAK, GUARD)


def ratio_rank(spark, sf_dir):
    ranked = A.ranked(A.summary(runs(spark, sf_dir), "profile", "class"), F.col("ratio_pct"), "profile")
    return ranked.select("profile", "class", _r("ratio_pct"), "rank")


def global_totals(spark, sf_dir):
    return A.totals(runs(spark, sf_dir)).select("raw", "size", _r("ratio", 6))


def class_lookup(spark, sf_dir):
    looked = A.with_lookup(runs(spark, sf_dir), CODEC_NAMES, "profile", "architecture")
    return looked.groupBy("architecture").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))


def share_of_total(spark, sf_dir):
    sizes = runs(spark, sf_dir).groupBy("profile", "class").agg(F.sum("size").alias("size"))
    return A.share_of_total(sizes, "size", "share").select("profile", "class", "size", _r("share", 6))


def filtered_runs(spark, sf_dir):
    rows = runs(spark, sf_dir).where((F.col("profile") == "R") & F.col("file").isin(GUARD))
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.sum("raw").alias("raw"), F.sum("seconds").alias("seconds")).drop("seconds")


def distinct_profiles(spark, sf_dir):
    return runs(spark, sf_dir).select("profile").distinct().orderBy("profile")


def profile_grid(spark, sf_dir):
    """Every profile with every file, measured or not."""
    rows = runs(spark, sf_dir)
    profiles, files = rows.select("profile").distinct(), rows.select("file").distinct()
    n_files = files.count()
    if n_files > MAX_GRID_FILES:
        raise ValueError(f"a grid over {n_files} files would have as many rows for every profile")
    grid = profiles.crossJoin(F.broadcast(files))
    counts = rows.groupBy("profile", "file").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["profile", "file"], "left").fillna(0, ["n"])


def size_equality(spark, sf_dir):
    rows = per_file(spark, sf_dir)
    pick = lambda p: rows.where(F.col("profile") == p).select("file", "size")
    same = A.same_sizes(pick("A"), pick("A")).withColumn("pair", F.lit("A-A"))
    return same.unionByName(A.same_sizes(pick("A"), pick("R")).withColumn("pair", F.lit("A-R")))


def union_runs(spark, sf_dir):
    rows = per_file(spark, sf_dir)
    more = rows.where("profile = 'A'").select(F.lit("copy").alias("profile"), "file", "raw")
    both = rows.unionByName(more, allowMissingColumns=True)
    return both.groupBy("profile").agg(F.count(F.lit(1)).alias("n"), F.count("size").alias("sized"), F.sum("raw").alias("raw"))


def customer_nation_lookup(spark, sf_dir):
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey", "c_acctbal")
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    joined = customers.join(F.broadcast(nations), "c_nationkey", "left")  # a nation is one of 25
    name = F.coalesce("n_name", F.lit("")).alias("n_name")
    return joined.groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


def formatted_report(spark, sf_dir):
    made = A.summary(runs(spark, sf_dir), "profile")
    return made.select("profile", scalar.grouped(F.col("size")).alias("size"), scalar.fixed(F.round("ratio_pct", 3), 3).alias("ratio_pct"))


def _distances(spark, sf_dir) -> DataFrame:
    """Distances with those before them, from order keys."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_custkey") % 5000 + 1).alias("dist"), "o_orderkey", "o_custkey")
    rows = rows.withColumn("dist", F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderkey") % 40 * 16 + 1 - F.col("o_orderkey") % 2).otherwise(F.col("dist")))
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return rows.withColumns({"last": F.lag("dist", 1).over(order), "older": F.lag("dist", 2).over(order)})


def distance_lattice_bonus(spark, sf_dir):
    rows = _distances(spark, sf_dir)
    return rows.select("o_orderkey", "dist", *[F.round(scalar.lattice_bonus(m, F.col("dist"), F.col("last"), F.col("older")), 4).alias(f"bonus_{m}") for m in range(1, 10)])


def distance_lattice_code(spark, sf_dir):
    out = _distances(spark, sf_dir).select("o_orderkey", "dist")
    for m in (1, 2, 3):
        code, quotient = scalar.lattice_code(m, F.col("dist"))
        out = out.withColumns({f"code_{m}": code, f"quotient_{m}": quotient})
    return out


def zigzag_delta(spark, sf_dir):
    rows = _distances(spark, sf_dir).where("last is not null")
    d = F.col("dist") - F.col("last")
    return rows.select("o_orderkey", scalar.zigzag(d).alias("z"), scalar.unzigzag(scalar.zigzag(d)).alias("d"))


def dist_byte_class(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_orderkey") * 7 % 70000).alias("dist"), (F.col("o_custkey") % 300).alias("len"))
    return rows.groupBy(scalar.distance_bytes(F.col("dist")).alias("bytes"), scalar.length_class(F.col("len")).alias("length_class")).agg(F.count(F.lit(1)).alias("n"))


def distance_classes(spark, sf_dir):
    """Classes of distances, those among the last two of the customer apart, and file-safe names for them."""
    rows = _distances(spark, sf_dir)
    cached = (F.col("dist") == F.col("last")) | (F.col("dist") == F.col("older"))
    kind = scalar.distance_class(F.col("dist"), F.coalesce(cached, F.lit(False)))
    named = rows.select(kind.alias("kind"), scalar.safe_name(F.concat(F.lit("dist "), kind.cast("string"), F.lit("/x"))).alias("name"))
    return named.groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"))


def match_cost(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (F.col("o_orderkey") * 7 % 70000).alias("dist"), (F.col("o_custkey") % 300 + 4).alias("len"))
    return rows.select("o_orderkey", F.round(scalar.match_cost(F.col("len"), F.col("dist"), 9.42, 1.2), 6).alias("cost"))


def key_hashes(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (F.col("o_orderkey") * 1103515245 % 4294967296).alias("v"))
    return rows.select("o_orderkey", scalar.low_bits_hash(F.col("v")).alias("low20"), scalar.top_bits_hash(F.col("v")).alias("top12"))


def scalar_clamps(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (F.col("o_orderkey") % 400 - 70).alias("v"))
    v = F.col("v")
    return rows.select(
        "o_orderkey", F.least(F.greatest(v, F.lit(0)), F.lit(255)).alias("clipped"), F.round(scalar.clamp(v / 100, 0.9, 1.27), 6).alias("clamped"),
        scalar.signed_residual(F.pmod(v, F.lit(256))).alias("signed"), F.round(scalar.clamped_log2(v * 1000), 6).alias("log2"),
    )


def raw_escape(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_orderkey") % 97).alias("literals"), (F.col("o_custkey") % 100 + 1).alias("size"))
    return rows.groupBy(scalar.raw_escape(F.col("literals"), F.col("size")).alias("escaped")).agg(F.count(F.lit(1)).alias("n"))


def ewma_error(spark, sf_dir):
    """Exponentially weighted error of each customer's orders, in order of their keys."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("h"))
    step = lambda acc, x: acc * 0.92 + x["o_totalprice"] * 0.08
    return rows.select("o_custkey", F.round(F.aggregate("h", F.lit(32.0), step), 3).alias("err"))


QUERIES = {
    f.__name__: f
    for f in (
        derived_metrics, sweep_summary, harmonic_throughput, median3, summed_median_throughput, baseline_delta, weak_guard_sums, ratio_rank,
        global_totals, class_lookup, share_of_total, filtered_runs, distinct_profiles, profile_grid, size_equality, union_runs,
        customer_nation_lookup, formatted_report, distance_lattice_bonus, distance_lattice_code, zigzag_delta, dist_byte_class, distance_classes, match_cost,
        key_hashes, scalar_clamps, raw_escape, ewma_error,
    )
}

_PER_FILE = f"WITH {RUNS}, f AS (SELECT profile, file, CAST(sum(raw) AS BIGINT) AS raw, CAST(sum(size) AS BIGINT) AS size FROM runs GROUP BY profile, file)"
_DIST = """WITH d AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 40 * 16 + 1 - o_orderkey % 2 ELSE o_custkey % 5000 + 1 END AS dist FROM orders),
x AS (SELECT *, lag(dist, 1) OVER w AS last, lag(dist, 2) OVER w AS older FROM d WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))"""


def _bonus(mode: int) -> str:
    line, plane, planes, lines = scalar.LATTICE.get(mode, (0, 0, 0, 0))
    lattice = f"(CASE WHEN dist IN (15, 16, 17) THEN {line} ELSE 0 END + CASE WHEN dist IN (255, 256, 257) THEN {plane} WHEN dist % 256 = 0 THEN {planes} WHEN dist % 16 = 0 THEN {lines} ELSE 0 END)"
    last, older = "coalesce(last, 0)", "coalesce(older, 0)"
    if mode == 1:
        slack = f"greatest(2, {last} >> 5)"
        return f"""CASE WHEN {last} <= 0 THEN 0 WHEN dist = {last} THEN 1.05 ELSE CASE WHEN abs(dist - {last}) <= {slack} THEN 0.38 ELSE 0 END
    + CASE WHEN abs(dist - 2 * {last}) <= 2 * {slack} OR abs(2 * dist - {last}) <= 2 * {slack} THEN 0.20 ELSE 0 END END"""
    if mode == 3:
        return f"""{lattice} + CASE WHEN {last} <= 0 THEN 0 WHEN dist = {last} THEN 0.70 WHEN abs(dist - {last}) <= greatest(2, {last} >> 6) THEN 0.24 ELSE 0 END
    + CASE WHEN {older} > 0 AND dist = {older} THEN 0.18 ELSE 0 END"""
    return lattice


_ANCHOR = "CASE " + " ".join(f"WHEN dist = {at} THEN {i + 1}" for i, at in enumerate((15, 16, 17, 255, 256, 257))) + " END"


def _coded(first: int, anchors: str) -> tuple[str, str]:
    code = f"coalesce({anchors}, CASE WHEN dist % 256 = 0 AND dist // 256 <= 255 THEN {first} WHEN dist % 16 = 0 AND dist // 16 <= 65535 THEN {first + 1} END, 0)"
    return code, f"CASE {code} WHEN {first} THEN dist // 256 WHEN {first + 1} THEN dist // 16 ELSE 0 END"


_C2, _Q2 = _coded(1, "NULL")
_C3, _Q3 = _coded(7, _ANCHOR)
ORACLES = {
    "derived_metrics": f"""WITH {RUNS} SELECT profile, class, round(avg(100.0 * size / raw), 4) AS ratio_pct, round(avg(raw / 1e6 / seconds), 4) AS comp_mbps,
  round(avg(raw / 1e6 / dec_seconds), 4) AS dec_mbps FROM runs GROUP BY profile, class""",
    "sweep_summary": f"""WITH {RUNS} SELECT profile, count(*) AS n, CAST(sum(raw) AS BIGINT) AS raw, CAST(sum(size) AS BIGINT) AS size,
  round(100.0 * sum(size) / sum(raw), 4) AS ratio_pct, round(sum(seconds), 4) AS seconds, bool_and(sha_ok) AS all_ok FROM runs GROUP BY profile""",
    "harmonic_throughput": f"""WITH {RUNS} SELECT profile, CAST(sum(raw) AS BIGINT) AS raw, CAST(sum(size) AS BIGINT) AS size, round(100.0 * sum(size) / sum(raw), 6) AS ratio_pct,
  round(sum(raw) / sum(raw / (raw / 1e6 / seconds)), 6) AS comp_mbps, round(sum(raw) / sum(raw / (raw / 1e6 / dec_seconds)), 6) AS dec_mbps FROM runs GROUP BY profile""",
    "median3": f"WITH {RUNS} SELECT profile, file, count(*) AS n, median(seconds) AS med_seconds FROM runs GROUP BY profile, file",
    "summed_median_throughput": f"""WITH {RUNS} SELECT profile, round(sum(raw) / 1e6 / sum(med), 6) AS mbps FROM (
  SELECT profile, file, sum(raw) AS raw, median(seconds) AS med FROM runs GROUP BY profile, file) GROUP BY profile""",
    "baseline_delta": f"""{_PER_FILE} SELECT f.file, f.profile, f.raw, f.size, b.size AS base_size, f.size - b.size AS delta FROM f JOIN f b ON f.file = b.file AND b.profile = 'N'""",
    "weak_guard_sums": f"""{_PER_FILE} SELECT f.profile, CAST(sum(f.size - b.size) AS BIGINT) AS delta, CAST(coalesce(sum(f.size - b.size) FILTER (WHERE f.file IN (1, 2)), 0) AS BIGINT) AS weak_delta,
  CAST(coalesce(sum(f.size - b.size) FILTER (WHERE f.file IN (3, 4, 5)), 0) AS BIGINT) AS guard_delta FROM f JOIN f b ON f.file = b.file AND b.profile = 'N' GROUP BY f.profile""",
    "ratio_rank": f"""WITH {RUNS} SELECT profile, class, round(q, 4) AS ratio_pct, CAST(row_number() OVER (ORDER BY q, profile) AS INTEGER) AS rank FROM (
  SELECT profile, class, 100.0 * sum(size) / sum(raw) AS q FROM runs GROUP BY profile, class)""",
    "global_totals": f"WITH {RUNS} SELECT CAST(sum(raw) AS BIGINT) AS raw, CAST(sum(size) AS BIGINT) AS size, round(sum(size) / sum(raw), 6) AS ratio FROM runs",
    "class_lookup": f"""WITH {RUNS} SELECT CASE profile WHEN 'A' THEN 'order-0' WHEN 'N' THEN 'dictionary' ELSE '' END AS architecture, count(*) AS n, CAST(sum(size) AS BIGINT) AS size
  FROM runs GROUP BY 1""",
    "share_of_total": f"""WITH {RUNS} SELECT profile, class, CAST(sum(size) AS BIGINT) AS size, round(sum(size) / (SELECT sum(size) FROM runs), 6) AS share FROM runs GROUP BY profile, class""",
    "filtered_runs": f"WITH {RUNS} SELECT file, count(*) AS n, CAST(sum(raw) AS BIGINT) AS raw FROM runs WHERE profile = 'R' AND file IN (3, 4, 5) GROUP BY file",
    "distinct_profiles": f"WITH {RUNS} SELECT DISTINCT profile FROM runs ORDER BY profile",
    "profile_grid": f"""WITH {RUNS} SELECT p.profile, g.file, count(r.raw) AS n FROM (SELECT DISTINCT profile FROM runs) p CROSS JOIN (SELECT DISTINCT file FROM runs) g
  LEFT JOIN runs r ON r.profile = p.profile AND r.file = g.file GROUP BY p.profile, g.file""",
    "size_equality": f"""{_PER_FILE}, p AS (SELECT 'A-A' AS pair, 'A' AS x, 'A' AS y UNION ALL SELECT 'A-R', 'A', 'R'), j AS (
  SELECT pair, a.file AS fa, b.file AS fb, a.size AS sa, b.size AS sb FROM p JOIN f a ON a.profile = p.x JOIN f b ON b.profile = p.y AND a.file = b.file)
  SELECT p.pair, (SELECT bool_and(sa = sb) FROM j WHERE j.pair = p.pair) AND (SELECT count(*) FROM f WHERE profile = p.x) = (SELECT count(*) FROM f WHERE profile = p.y) AS same_rows,
    (SELECT sum(size) FROM f WHERE profile = p.x) = (SELECT sum(size) FROM f WHERE profile = p.y) AS same_total FROM p""",
    "union_runs": f"""{_PER_FILE} SELECT profile, count(*) AS n, count(size) AS sized, CAST(sum(raw) AS BIGINT) AS raw FROM (
  SELECT profile, file, raw, size FROM f UNION ALL SELECT 'copy', file, raw, NULL FROM f WHERE profile = 'A') GROUP BY profile""",
    "customer_nation_lookup": """SELECT coalesce(n_name, '') AS n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer
  LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""",
    "formatted_report": f"""WITH {RUNS} SELECT profile, format('{{:,}}', CAST(sum(size) AS BIGINT)) AS size, printf('%.3f', round(100.0 * sum(size) / sum(raw), 3)) AS ratio_pct FROM runs GROUP BY profile""",
    "distance_lattice_bonus": f"{_DIST} SELECT o_orderkey, dist, " + ", ".join(f"round(CAST({_bonus(m)} AS DOUBLE), 4) AS bonus_{m}" for m in range(1, 10)) + " FROM x",
    "distance_lattice_code": f"""{_DIST} SELECT o_orderkey, dist, coalesce({_ANCHOR}, 0) AS code_1, CAST(0 AS BIGINT) AS quotient_1, {_C2} AS code_2, {_Q2} AS quotient_2,
  {_C3} AS code_3, {_Q3} AS quotient_3 FROM x""",
    "zigzag_delta": f"{_DIST} SELECT o_orderkey, abs(dist - last) * 2 - CAST(dist < last AS INTEGER) AS z, dist - last AS d FROM x WHERE last IS NOT NULL",
    "dist_byte_class": """SELECT CASE WHEN d < 256 THEN 1 WHEN d < 65536 THEN 2 ELSE 3 END AS bytes, CASE WHEN l <= 7 THEN 0 WHEN l <= 31 THEN 1 WHEN l <= 255 THEN 2 ELSE 3 END AS length_class,
  count(*) AS n FROM (SELECT o_orderkey * 7 % 70000 AS d, o_custkey % 300 AS l FROM orders) GROUP BY ALL""",
    "distance_classes": f"""{_DIST}, k AS (SELECT CASE WHEN coalesce(dist = last, false) OR coalesce(dist = older, false) THEN 0 WHEN dist < 256 THEN 1 WHEN dist < 65536 THEN 2 ELSE 3 END AS kind FROM x)
  SELECT kind, 'dist_' || kind || '_x' AS name, count(*) AS n FROM k GROUP BY kind""",
    "match_cost": """SELECT o_orderkey, round(9.42 + CASE WHEN l <= 7 THEN 1.0 ELSE log2(l + 1.0) END + CAST(1.2 AS DOUBLE) * log2(d + 1.0), 6) AS cost
  FROM (SELECT o_orderkey, o_orderkey * 7 % 70000 AS d, o_custkey % 300 + 4 AS l FROM orders)""",
    "key_hashes": """SELECT o_orderkey, CAST((CAST(v AS HUGEINT) * 2654435761) % 1048576 AS BIGINT) AS low20, CAST(((CAST(v AS HUGEINT) * 2654435761) % 4294967296) // 1048576 AS BIGINT) AS top12
  FROM (SELECT o_orderkey, o_orderkey * 1103515245 % 4294967296 AS v FROM orders)""",
    "scalar_clamps": """SELECT o_orderkey, least(greatest(v, 0), 255) AS clipped, round(least(greatest(v / 100, 0.9), 1.27), 6) AS clamped,
  CASE WHEN (v + 256) % 256 < 128 THEN (v + 256) % 256 ELSE (v + 256) % 256 - 256 END AS signed,
  round(CASE WHEN v <= 0 THEN 0 ELSE log2(least(v * 1000, 65536)) END, 6) AS log2 FROM (SELECT o_orderkey, o_orderkey % 400 - 70 AS v FROM orders)""",
    "raw_escape": "SELECT o_orderkey % 97 > (o_custkey % 100 + 1) * 9 // 10 AS escaped, count(*) AS n FROM orders GROUP BY 1",
    "ewma_error": """WITH RECURSIVE o AS (SELECT o_custkey, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, o_totalprice) AS i,
    count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
  e(o_custkey, i, err) AS (SELECT DISTINCT o_custkey, CAST(0 AS BIGINT), CAST(32.0 AS DOUBLE) FROM o
    UNION ALL SELECT o.o_custkey, o.i, e.err * CAST(0.92 AS DOUBLE) + o.v * CAST(0.08 AS DOUBLE) FROM e JOIN o ON o.o_custkey = e.o_custkey AND o.i = e.i + 1)
  SELECT e.o_custkey, round(err, 3) AS err FROM e JOIN (SELECT o_custkey, max(i) AS i FROM o GROUP BY o_custkey) m ON m.o_custkey = e.o_custkey AND m.i = e.i""",
}
