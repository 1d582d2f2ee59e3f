"""Quality rules with robust multivariate outliers, in DataFrame functions only.

Every text gets counts of words, word characters, symbols, repeated lines and words inside repeated three-word
windows. Two base rules reject short texts and texts made of repeated windows. The others are judged against
texts of their own language and source: the counts become a vector of transformed shares, a minimum covariance
determinant (MCD) estimate is made for each group, and texts whose Mahalanobis distance passes a chi-square
quantile are rejected.

MCD: three starts for each group: its coordinate-wise medians and quartile ranges; its mean and covariance; its medians
and the covariance of the directions from there. A concentration step takes the distances of all rows, the share H of
rows that are nearest, and their mean and covariance. All starts make START_STEPS steps; the start with the least
determinant goes on, until a step lowers its determinant by less than LOWER. Groups that are through drop out of the next step.
Vectors are fixed-point integers, so that sums are exact and do not depend on how rows are dealt out. A step is one
aggregation by group and level of distance (LOG_UNIT levels for each doubling), combined before its shuffle; the core is
every level up to the one that completes the share H. The covariance is multiplied by CONSISTENCY, which makes it
that of all rows if they are normal, and its diagonal is raised by FLOORS squared, which keeps constant columns from
making every other value an outlier.

Small groups: estimates are made in the same way for each language and for the whole table, and every group's centre and
covariance are weighed against those of its language (itself weighed against the whole) as n rows against POOL_ROWS; the
whole table's covariance is weighed against PRIORS as n rows against PRIOR_ROWS. There is no size below which a group is
treated otherwise.

Defined cases: a null text has no words; a text without words fails the base rules; null languages and sources
are groups of their own; repeated rows are judged alike; ties at the core's edge belong to it; texts are read whole,
whatever their length; an empty table gives an empty table; new columns get other names where the table has them already.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytequarry.llm.common import drop_table, fresh_name, materialize

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
H, START_STEPS = 0.6, 2
#: By how much a step must lower the logarithm of a determinant for a group to go on.
LOWER = 1e-3
#: Chance that a row of a normal group is rejected. Groups of texts have longer tails than normal ones.
TAIL = 1e-9
#: A group's language counts as so many rows of the group; PRIORS as so many rows of the table.
POOL_ROWS, PRIOR_ROWS = 100.0, 10.0
#: Transformed shares: name, standard deviation that any group has at least.
FLOORS = {"word_length": 0.06, "symbols": 0.025, "dup_lines": 0.15, "repeat_words": 0.15, "upper": 0.04}
#: Standard deviations of texts of any kind.
PRIORS = {"word_length": 0.4, "symbols": 0.25, "dup_lines": 0.6, "repeat_words": 0.6, "upper": 0.3}
#: Fixed-point units of a vector entry, and of the binary logarithm of a squared distance.
UNIT, LOG_UNIT = 1024, 32
#: Models of up to so many groups and starts (some 600 bytes each) are broadcast; more are joined by a shuffle, in which
#: every group is dealt out over SALTS keys.
MAX_BROADCAST_GROUPS, SALTS = 20_000, 64

_SPACES = "[ \\t-\\r]+"


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column) -> Column:
    """How many words lie in three-word windows that occur twice or more in the array."""
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(
        _let(
            F.transform(
                F.sequence(F.lit(0), F.size(words) - 3),
                lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
            ),
            lambda hashes: F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(
                _covered(hashes)
            ),
        )
    )


def _covered(hashes: Column) -> Column:
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(rows: Column) -> Column:
        same = lambda x, k: F.get(rows, k)["h"].eqNullSafe(x["h"])
        return F.sort_array(F.transform(F.filter(rows, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

    def union(starts: Column) -> Column:
        step = lambda at, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - at, F.lit(3)))
        return F.aggregate(F.transform(starts, step), F.lit(0).cast("long"), lambda a, x: a + x)

    return _let(ordered, lambda rows: _let(repeated(rows), union))


def with_statistics(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """docs with the counts; also the names they got: n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_chars, n_lines (lines with a word), n_upper (A-Z)."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    wanted = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "text_chars", "n_lines", "n_upper")
    names = {n: fresh_name(docs, n) for n in wanted}
    words, lines = fresh_name(docs, "bq_words"), fresh_name(docs, "bq_lines")
    out = docs.withColumns(
        {
            words: F.array_remove(F.split(text, _SPACES), ""),
            lines: F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]")),
        }
    )
    size = lambda c: F.size(c).cast("long")
    length = lambda c: F.length(c).cast("long")
    out = out.withColumns(
        {
            names["n_words"]: size(words),
            names["word_chars"]: length(F.array_join(words, "")),
            names["n_symbols"]: length(text) - length(F.regexp_replace(text, "[#*$%&|<>]+", "")),
            names["n_dup_lines"]: size(lines) - F.size(F.array_distinct(lines)),
            names["n_repeat_words"]: repeat_words(F.col(words)),
            names["text_chars"]: length(text),
            names["n_lines"]: size(lines),
            names["n_upper"]: length(text) - length(F.regexp_replace(text, "[A-Z]+", "")),
        }
    )
    return out.drop(words, lines), names


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


# --- minimum covariance determinant ------------------------------------------------------------------

DIM = len(FLOORS)
_PAIRS = [(i, j) for i in range(DIM) for j in range(i, DIM)]


def _chi2_cdf(x: float, k: int) -> float:
    """Series of the regularised lower incomplete gamma function."""
    a, x = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= x / n
        total += term
    return min(1.0, total * math.exp(a * math.log(x) - x - math.lgamma(a)))


def chi2_quantile(q: float, k: int) -> float:
    low, high = 0.0, 10.0 * k + 400
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_cdf(mid, k) < q else (low, mid)
    return high


#: Makes the covariance of the nearest H of normal rows an estimate of that of all.
CONSISTENCY = H / _chi2_cdf(chi2_quantile(H, DIM), DIM + 2)
CUTOFF = chi2_quantile(1 - TAIL, DIM)


def vector(names: dict[str, str]) -> list[str]:
    """The transformed shares as SQL of fixed-point integers: a logarithm, and arcsines of square roots."""
    col = lambda n: f"double(`{names[n]}`)"
    share = lambda a, b: f"asin(sqrt(least(1D, {col(a)} / greatest({col(b)}, 1D))))"
    made = [
        f"ln(greatest(1D, {col('word_chars')} / greatest({col('n_words')}, 1D)))", share("n_symbols", "text_chars"), share("n_dup_lines", "n_lines"),
        share("n_repeat_words", "n_words"), share("n_upper", "text_chars"),
    ]
    return [f"bigint(round({UNIT} * {m}))" for m in made]


# Long expressions are written as SQL: made column by column they would take the driver longer than their evaluation.

_X = [f"x{i}" for i in range(DIM)]
_SUMS = [*(f"s{i}" for i in range(DIM)), *(f"p{i}_{j}" for i, j in _PAIRS)]


def _cell(i: int, j: int) -> int:
    return i * DIM + j


def _swept(matrix: str) -> str:
    """Of a symmetric positive matrix, the inverse by rows and the logarithm of the determinant: a sweep over each pivot."""
    n, last = DIM, DIM * DIM
    row, column, pivot = f"int(i / {n})", f"i % {n}", f"m[k * {n + 1}]"
    entry = f"""CASE WHEN i = {last} THEN m[i] + ln({pivot}) WHEN {row} = k AND {column} = k THEN -1D / {pivot} WHEN {row} = k OR {column} = k THEN m[i] / {pivot}
      ELSE m[i] - m[{row} * {n} + k] * m[k * {n} + {column}] / {pivot} END"""
    swept = f"aggregate(sequence(0, {n - 1}), concat({matrix}, array(0D)), (m, k) -> transform(sequence(0, {last}), i -> {entry}))"
    return f"transform({swept}, (x, i) -> CASE WHEN i = {last} THEN x ELSE -x END)"


def _matrix(entry) -> str:
    """The symmetric matrix of entry(i, j), i <= j, its diagonal raised by the floors."""
    floors = list(FLOORS.values())
    cells = [f"{entry(min(i, j), max(i, j))} + {(floors[i] ** 2 if i == j else 0.0)!r}D" for i in range(DIM) for j in range(DIM)]
    return f"array({', '.join(cells)})"


def _distance(values: list[str], center: str, inverse: str) -> str:
    """Squared Mahalanobis distance, as an exact function of the row."""
    d = [f"({x} / {UNIT}D - {center}[{i}])" for i, x in enumerate(values)]
    return " + ".join(f"{1.0 if i == j else 2.0}D * {d[i]} * {d[j]} * {inverse}[{_cell(i, j)}]" for i, j in _PAIRS)


def _level(d2: str) -> str:
    return f"int(floor({LOG_UNIT} * log2(greatest({d2}, {2.0**-20!r}D))))"


def _with_model(rows: DataFrame, model: DataFrame, few: bool) -> DataFrame:
    if few:
        return rows.join(F.broadcast(model), "gid")
    salted = model.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(*_X), F.lit(SALTS)).cast("int")).join(salted, ["gid", "salt"]).drop("salt")


def _totals(rows: DataFrame, *by: str, more: str = "") -> DataFrame:
    """(by..., n and the sums of the entries and their products)."""
    told = ["count(1) AS n", *(f"sum({x}) AS s{i}" for i, x in enumerate(_X)), *(f"sum(x{i} * x{j}) AS p{i}_{j}" for i, j in _PAIRS)]
    return rows.groupBy(*by).agg(F.expr(f"struct({more}{', '.join(told)}) AS t")).select(*by, "t.*")


def _moments(scale: float) -> tuple[str, str]:
    """(center, covariance) from n and the sums."""
    center = ", ".join(f"s{i} / double(n) / {UNIT}D" for i in range(DIM))
    return f"array({center})", _matrix(lambda i, j: f"{scale!r}D * (p{i}_{j} - s{i} * (s{j} / double(n))) / double(n) / {UNIT**2}D")


def _model(start: int, center: str, spread: str) -> list[str]:
    return ["gid", f"{start} AS start", f"{center} AS center", f"{spread} AS spread", f"{_swept(spread)} AS inverse"]


def _starts(rows: DataFrame, few: bool) -> DataFrame:
    """(gid, start, center, spread, inverse) of three starts for each group of (gid, x0, x1, ...)."""
    quartiles = "".join(f"percentile({x}, array(0.25, 0.5, 0.75)) AS q{i}, " for i, x in enumerate(_X))
    middle = _totals(rows, "gid", more=quartiles)
    box = _matrix(lambda i, j: f"pow((q{i}[2] - q{i}[0]) / {1.349 * UNIT}D, 2)" if i == j else "0D")
    center, whole = _moments(1.0)
    median = f"array({', '.join(f'q{i}[1] / {UNIT}D' for i in range(DIM))})"
    made = materialize(middle.selectExpr("gid", f"{median} AS median", f"{box} AS box", f"{center} AS mean", f"{whole} AS whole"), "mcd-starts")
    # directions from the medians, in units of the box
    scale = [f"sqrt(box[{_cell(i, i)}])" for i in range(DIM)]
    steps = ", ".join(f"({x} / {UNIT}D - median[{i}]) / {scale[i]}" for i, x in enumerate(_X))
    norm = "sqrt(aggregate(z, 0D, (acc, x) -> acc + x * x))"
    unit = f"transform(array(array({steps})), z -> transform(array({norm}), v -> transform(z, x -> bigint(round({UNIT}D * x / greatest(v, 1e-9D)))))[0])[0]"
    signs = _with_model(rows, made.select("gid", "median", "box"), few).selectExpr("gid", f"{unit} AS k")
    signs = _totals(signs.selectExpr("gid", *[f"k[{i}] AS {x}" for i, x in enumerate(_X)]), "gid")
    toward = _matrix(lambda i, j: f"p{i}_{j} / double(n) / {UNIT**2}D * {scale[i]} * {scale[j]}")
    third = signs.join(made, "gid").selectExpr(*_model(2, "median", toward))
    first, second = made.selectExpr(*_model(0, "median", "box")), made.selectExpr(*_model(1, "mean", "whole"))
    return materialize(first.unionByName(second).unionByName(third), "mcd-model")


def _step(rows: DataFrame, model: DataFrame, few: bool) -> DataFrame:
    """A concentration step: (gid, start, rows, center, spread, inverse)."""
    level = _level(_distance(_X, "center", "inverse"))
    near = _with_model(rows, model.select("gid", "start", "center", "inverse"), few).selectExpr("gid", "start", f"{level} AS level", *_X)
    cells = _totals(near, "gid", "start", "level")
    every = "OVER (PARTITION BY gid, start"
    upto = f"{every} ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    so_far = cells.selectExpr("gid", "start", "n AS last", f"sum(n) {every}) AS rows", *[f"sum({c}) {upto} AS {c}" for c in ["n", *_SUMS]])
    core = so_far.where(f"n >= ceil({H} * rows) AND n - last < ceil({H} * rows)")
    center, spread = _moments(CONSISTENCY)
    return core.selectExpr("gid", "rows", "start", f"{center} AS center", f"{spread} AS spread").selectExpr("*", f"{_swept('spread')} AS inverse")


def fit(rows: DataFrame) -> DataFrame:
    """(gid, rows, center, spread) of each group of (gid, x0, x1, ...), a table that is cheap to read again."""
    n_groups = rows.select("gid").distinct().count()
    few, det = 3 * n_groups <= MAX_BROADCAST_GROUPS, f"inverse[{DIM * DIM}]"
    model = _starts(rows, few)
    for _ in range(START_STEPS):
        new = materialize(_step(rows, model, few), "mcd-model")
        drop_table(model)
        model = new
    fields = ["rows", "start", "center", "spread", "inverse"]
    least = model.groupBy("gid").agg(F.expr(f"min_by(struct({', '.join(fields)}), struct({det}, start)) AS m"))
    going = materialize(least.select("gid", "m.*"), "mcd-model")
    done, n_going = [], n_groups
    while n_going:
        # this ends: each step takes LOWER at least off a determinant that the floors bound from below
        new = _step(rows, going, few)
        both = going.toDF("gid", *[f"old_{c}" for c in fields]).join(new, "gid", "left")
        both = both.selectExpr("*", f"coalesce({det} < old_{det} - {LOWER}D, false) AS lower")
        stepped = materialize(both.selectExpr("gid", *[f"if(lower, {c}, old_{c}) AS {c}" for c in fields], "lower"), "mcd-model")
        done.append(stepped.where("NOT lower").select("gid", "rows", "center", "spread"))
        going = stepped.where("lower").drop("lower")
        n_going = going.count()
    out = done[0] if done else going.select("gid", "rows", "center", "spread")
    for more in done[1:]:
        out = out.unionByName(more)
    return out


# --- groups ------------------------------------------------------------------------------------------


def _weighed(k: int, pool: str, spread: str, rows: float) -> list[str]:
    """Centre and spread of group k, as n rows of its own, against a pool's as `rows` rows."""
    mixed = lambda a, b: f"zip_with({a}, {b}, (x, y) -> (n{k} * x + {rows}D * y) / (n{k} + {rows}D))"
    return [f"{mixed(f'c{k}', pool)} AS c{k}", f"{mixed(f's{k}', spread)} AS s{k}"]


def _name(*parts: Column) -> Column:
    return F.to_json(F.struct(*[F.coalesce(p, F.lit("")).alias(f"p{i}") for i, p in enumerate(parts)], *[p.isNull().alias(f"n{i}") for i, p in enumerate(parts)]))


ALL = "all"


def estimates(rows: DataFrame) -> DataFrame:
    """(lang, source, center, inverse) for each group of rows (lang, source, x0, x1, ...), weighed against its pools."""
    gids = F.array(_name(F.col("lang"), F.col("source")), _name(F.col("lang")), F.lit(ALL))
    vectors = materialize(rows.select(gids.alias("gids"), *_X), "quality-vectors")
    fitted = materialize(fit(vectors.select(F.explode("gids").alias("gid"), *_X)), "mcd-fitted")
    groups = rows.select("lang", "source").distinct()
    level = lambda k: fitted.select(F.col("gid").alias(f"gid{k}"), F.col("rows").cast("double").alias(f"n{k}"), F.col("center").alias(f"c{k}"), F.col("spread").alias(f"s{k}"))
    joined = groups.withColumns({"gid0": _name(F.col("lang"), F.col("source")), "gid1": _name(F.col("lang")), "gid2": F.lit(ALL)})
    for k in range(3):
        joined = joined.join(level(k), f"gid{k}")
    priors = list(PRIORS.values())
    widest = _matrix(lambda i, j: f"{(priors[i] ** 2 if i == j else 0.0)!r}D")
    for k, center, spread, against in ((2, "c2", widest, PRIOR_ROWS), (1, "c2", "s2", POOL_ROWS), (0, "c1", "s1", POOL_ROWS)):
        others = [c for c in joined.columns if c not in (f"c{k}", f"s{k}")]
        joined = joined.selectExpr(*others, *_weighed(k, center, spread, against))
    return materialize(joined.selectExpr("lang", "source", "c0 AS center", f"{_swept('s0')} AS inverse"), "quality-models")


def judge(stats: DataFrame, names: dict[str, str], lang_col: str = "lang", source_col: str = "source") -> tuple[DataFrame, dict[str, str]]:
    """stats, a table that is cheap to read again, with base_failed, distance (squared; null if the base rules
    failed) and kept; also the names these got."""
    out = {n: fresh_name(stats, n) for n in ("base_failed", "distance", "kept")}
    failed = base_failed(F.col(f"`{names['n_words']}`"), F.col(f"`{names['n_repeat_words']}`"))
    lang, source = F.col(f"`{lang_col}`").cast("string"), F.col(f"`{source_col}`").cast("string")
    values = vector(names)
    rows = stats.where(~failed).select(lang.alias("lang"), source.alias("source"), *[F.expr(v).alias(x) for v, x in zip(values, _X)])
    model = estimates(rows)
    m = {c: fresh_name(stats, f"bq_{c}") for c in (*model.columns, "salt")}
    model = model.select([F.col(c).alias(m[c]) for c in model.columns])
    same = lang.eqNullSafe(F.col(m["lang"])) & source.eqNullSafe(F.col(m["source"]))
    if model.count() <= MAX_BROADCAST_GROUPS:
        joined = stats.join(F.broadcast(model), same, "left")
    else:
        salt = F.expr(f"int(pmod(xxhash64({', '.join(values)}), {SALTS}))")
        model = model.withColumn(m["salt"], F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = stats.join(model, same & (salt == F.col(m["salt"])), "left")
    x = [fresh_name(joined, f"bq_x{i}") for i in range(DIM)]
    joined = joined.withColumns({a: F.expr(v) for a, v in zip(x, values)})
    distance = F.when(~failed, F.expr(_distance(x, m["center"], m["inverse"])))
    judged = joined.withColumns({out["base_failed"]: failed, out["distance"]: distance}).drop(*m.values(), *x)
    kept = ~F.col(out["base_failed"]) & (F.coalesce(F.col(out["distance"]), F.lit(0.0)) <= CUTOFF)
    return judged.withColumn(out["kept"], kept), out


def reject_outliers(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """docs that pass the base rules and the outlier rule, with the columns of docs."""
    counted, names = with_statistics(docs, text_col)
    stats = materialize(counted, "quality-texts")  # the counts cost more than a second copy of the texts
    judged, out = judge(stats, names, lang_col, source_col)
    return judged.where(F.col(out["kept"])).select([F.col(f"`{c}`") for c in docs.columns])
