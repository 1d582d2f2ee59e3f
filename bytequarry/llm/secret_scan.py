"""Secret scan: candidates by pattern, false positives removed by a random forest, in DataFrame and SQL functions only.

Candidates are runs of `A-Za-z0-9+/_.-`: of 16 or more with a digit, of 8 or more with a digit after `name=`, and
quoted ones of 8 or more; besides, any 6 or more visible characters (but quotes, commas, semicolons, angle brackets) after
a name that announces a secret and `:` or `=`. `=` belongs to a run only as base64 padding at its end, so that the name of an
assignment stays in the text before. The CONTEXT characters around a candidate give it its neighbouring words.

Features: the length; character transitions (the mean log probability of its letter pairs, changes of character class,
longest runs, distinct characters); coverage by dictionary words; the path's words; words and signs before and after.
Dictionary and transitions come from the corpus itself: language() counts the words of all texts, takes the DICTIONARY_WORDS
most frequent ones of four letters or more, and the frequencies of all letter pairs.

The forest is trained from labelled findings: rows (before, candidate, after, path, label), of which at most MAX_FINDINGS
(those with the smallest hashes) are learnt from. Where no findings have been labelled, example_findings() makes some by a
rule. A forest is a list of plain lists: it can be kept as JSON and used again.

Scoring: the trained trees become arrays of nodes in one expression, which walks them for every candidate. Only
candidates leave the scan of the texts, and nothing is shuffled: offsets are summed inside a text's row.

Defined cases: a null or empty text has no candidates; a null path is the empty string; repeated rows give repeated
findings; an empty table gives an empty table, and a language without words; texts of any length are scanned whole; kept
columns whose names clash with those of the result are kept, and the result's columns get other names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytequarry.llm.common import fresh_name, materialize

_RUN = "A-Za-z0-9+/_.-"
_DIGIT = "(?=[A-Za-z+/_.-]*+[0-9])"
_PADDED = f"(?:[{_RUN}]{{4}}){{%d,}}+(?:[{_RUN}]{{3}}=|[{_RUN}]{{2}}==)(?![={_RUN}])"
_TOLD = "(?<=(?i:passwd|password|pwd|secret|token|api_key|apikey|access_key)[\"']{0,1} {0,1}[:=] {0,1}[\"']{0,1})"
PATTERN = (
    f"(?<![{_RUN}])(?:{_DIGIT}(?:{_PADDED % 3}|[{_RUN}]{{16,}}+)|(?<=[{_RUN}]=){_DIGIT}(?:{_PADDED % 1}|[{_RUN}]{{8,}}+(?![!@#$%^&*?~]))"
    f"|(?<=[\"'])(?=[^\"']{{8}})[{_RUN}]++={{0,2}}(?=[\"'])|{_TOLD}(?![\"' :=])[!#-&(-+\\--:=?-_a-~]{{6,}}+)"
)
CONTEXT = 48  # characters kept before and after a candidate
TREES, DEPTH, SEED = 24, 7, 11
MAX_FINDINGS = 20_000
DICTIONARY_WORDS = 2_000
THRESHOLD = 0.5

# Words that announce a secret, words that announce something else, words of paths without real ones, and
# words that findings made by a rule use where the corpus has none.
ANNOUNCING = "token secret passw pwd apikey api_key api-key access_key accesskey auth bearer credential private signing".split()
INNOCENT = "commit sha1 sha256 md5 checksum digest hash revision integrity uuid guid etag example sample placeholder dummy".split()
TEST_PATHS = "test example sample fixture mock demo doc readme".split()
WORDS = "account address backup buffer cache channel client config content device document domain element field filter handler message network object option package request resource service session source status storage system table template thread update window".split()

FEATURES = [
    "length", "transitions", "class_changes", "digit_share", "upper_share", "lower_share", "longest_same", "longest_letters",
    "distinct_share", "dictionary_share", "hex", "separators", "symbols", "path_test", "path_source", "announced", "announced_near",
    "innocent", "assigned", "quoted", "url",
]


# --- language ----------------------------------------------------------------------------------------

LETTERS = "abcdefghijklmnopqrstuvwxyz"
_SIZE = len(LETTERS) + 1  # 0 stands for whatever is no letter


@dataclass(frozen=True)
class Language:
    """The most frequent words of a corpus, and the log probability of each letter after another (27 by 27)."""

    words: tuple[str, ...]
    transitions: tuple[float, ...]


def language(docs: DataFrame, text_col: str = "text", words: int = DICTIONARY_WORDS) -> Language:
    """Counted over all texts. What reaches the driver are `words` words and 729 pairs at most."""
    split = F.split(F.lower(F.col(f"`{text_col}`")), "[^a-z]+")
    counts = docs.select(F.explode(split).alias("word")).where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts, "secret-words")
    top = counts.where("length(word) >= 4").orderBy(F.col("n").desc(), "word").limit(words).collect()
    padded = counts.selectExpr("concat('.', word, '.') AS w", "n").selectExpr("explode(transform(sequence(1, length(w) - 1), i -> substr(w, i, 2))) AS pair", "n")
    pairs = {r["pair"]: r["total"] for r in padded.groupBy("pair").agg(F.sum("n").alias("total")).collect()}
    letters = "." + LETTERS
    made = []
    for a in letters:
        row = [pairs.get(a + b, 0) + 1 for b in letters]
        made += [math.log(x / sum(row)) for x in row]
    return Language(tuple(r["word"] for r in top), tuple(made))


def features(before: Column, candidate: Column, after: Column, path: Column, spoken: Language) -> list[Column]:
    """One double per name in FEATURES."""
    size = F.greatest(F.length(candidate), F.lit(1)).cast("double")
    near = F.lower(before)
    gone = lambda pattern: (F.length(candidate) - F.length(F.regexp_replace(candidate, pattern, ""))) / size
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(candidate, "[a-z]+", "a"), "[B-Z]+|A+", "A"), "[0-9]+", "0"), "[^aA0]+", ".")
    has = lambda words, text: text.rlike("|".join(words)).cast("double")
    runs = lambda pattern: F.coalesce(F.array_max(F.transform(F.regexp_extract_all(candidate, F.lit(pattern), F.lit(0)), F.length)), F.lit(0))
    # constants, folded once: the words and the table of transitions
    words = F.expr(f"split('{' '.join(spoken.words)}', ' ')")
    table = F.expr(f"array({', '.join(f'{x!r}D' for x in spoken.transitions)})")
    parts = F.transform(F.regexp_extract_all(candidate, F.lit("[A-Z]?[a-z]{3,}|[A-Z]{4,}"), F.lit(0)), F.lower)
    known = F.aggregate(F.filter(parts, lambda x: F.array_contains(words, x)), F.lit(0), lambda acc, x: acc + F.length(x))
    codes = F.transform(F.split(F.concat(F.lit("."), F.lower(candidate), F.lit(".")), ""), lambda x: F.when(x == "", 0).otherwise(F.instr(F.lit(LETTERS), x)))
    steps = F.aggregate(
        codes, F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")),
        lambda acc, x: F.struct(x.alias("last"), F.when(acc["last"] < 0, F.lit(0.0)).otherwise(acc["sum"] + F.get(table, acc["last"] * _SIZE + x)).alias("sum")),
        lambda acc: acc["sum"],
    )
    return [
        F.log(size),
        steps / (size + 1.0),
        (F.length(classes) - 1) / size,
        gone("[0-9]+"),
        gone("[A-Z]+"),
        gone("[a-z]+"),
        runs(r"(.)\1*+") / size,
        runs("[A-Za-z]+") / size,
        F.size(F.array_distinct(F.split(candidate, ""))) / size,
        known / size,
        candidate.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$").cast("double"),
        gone("[^A-Za-z0-9]+"),
        gone(f"[={_RUN}]+") * -1.0 + 1.0,
        has(TEST_PATHS, F.lower(path)),
        path.rlike(r"\.(?:py|js|ts|java|go|rb|env|cfg|ini|ya?ml|json|sh)$").cast("double"),
        has(ANNOUNCING, near),
        has([f"(?:{w})[a-z0-9_-]*[\"']?\\s*(?:[:=]|\\s)\\s*[\"']?$" for w in ANNOUNCING], near),
        has(INNOCENT, near),
        near.rlike("[:=]\\s*[\"']?$").cast("double"),
        (F.right(before, F.lit(1)).isin('"', "'") & F.left(after, F.lit(1)).isin('"', "'")).cast("double"),
        near.rlike("(?:https?://|www\\.|@|/)[^\\s]*$").cast("double"),
    ]


# --- findings ----------------------------------------------------------------------------------------


def _any(key: Column, salt: int) -> Column:
    """64 hexadecimal digits that depend on the key and the salt."""
    return F.sha2(F.concat_ws(":", key.cast("string"), F.lit(str(salt))), 256)


def _pick(key: Column, salt: int, values: Column, n: int) -> Column:
    return F.get(values, F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(n)).cast("int"))


def example_findings(spark: SparkSession, spoken: Language | None = None, n: int = 8000) -> DataFrame:
    """(before, candidate, after, path, label): labelled findings that a rule makes of the language's words and of hashes,
    the same on every run."""
    k = F.col("id")
    mixed = F.regexp_replace(F.base64(F.unhex(_any(k, 1))), "[+/=]", "")
    size = (F.pmod(F.xxhash64(k, F.lit(2)), F.lit(25)) + 16).cast("int")
    random = F.when(k % 7 < 2, F.left(_any(k, 3), size)).when(k % 7 < 4, F.left(mixed, F.least(size, F.lit(40))))
    random = random.when(k % 7 == 4, _any(k, 4)).when(k % 7 == 5, F.left(_any(k, 3), F.lit(40))).otherwise(F.upper(F.left(_any(k, 5), F.lit(40))))
    # token formats with separators, and base64 as it stands
    letters = lambda salt, n: F.left(F.regexp_replace(F.base64(F.unhex(_any(k, salt))), "[+/=]", "9"), F.lit(n))
    digits = lambda salt, n: F.left(F.translate(_any(k, salt), "abcdef", "123456"), F.lit(n))
    plain, safe = F.base64(F.unhex(_any(k, 41))), F.translate(F.base64(F.unhex(_any(k, 42))), "+/=", "-_")
    formats = [
        plain, F.base64(F.unhex(F.left(_any(k, 43), F.lit(32)))), safe, F.concat(F.lit("ghp_"), letters(44, 36)), F.concat(F.lit("sk-proj-"), letters(45, 32)),
        F.concat_ws("-", F.lit("xoxb"), digits(46, 12), digits(47, 12), letters(48, 24)), F.concat_ws(".", F.concat(F.lit("eyJ"), letters(49, 17)), letters(50, 40), safe),
        F.concat_ws("_", F.lit("sk"), F.lit("live"), letters(51, 24)),
        # passwords: short, and with signs
        F.concat(letters(52, 3), F.translate(F.left(_any(k, 53), F.lit(1)), "0123456789abcdef", "@!#$%^&*?~@!#$%&"), letters(54, 4), F.translate(F.left(_any(k, 55), F.lit(1)), "0123456789abcdef", "!@#$%*?!@#$%*?!@"), digits(56, 2)),
        F.concat(letters(57, 6), digits(58, 2)),
    ]
    form = F.pmod(F.xxhash64(k, F.lit(40)), F.lit(2 * len(formats))).cast("int")
    random = reduce(lambda acc, x: acc.when(form == x[0], x[1]), list(enumerate(formats))[1:], F.when(form == 0, formats[0])).otherwise(random)
    vocabulary = [w for w in (spoken.words if spoken else ()) if len(w) <= 12] or WORDS
    lexicon = F.expr(f"split('{' '.join(vocabulary)}', ' ')")
    word = lambda salt: _pick(k, salt, lexicon, len(vocabulary))
    one_of = lambda salt, values: _pick(k, salt, F.array(*[F.lit(v) for v in values]), len(values))
    lead = F.concat(word(6), F.lit(" "), word(7), F.lit(" "))
    told = one_of(8, ['token = "', "TOKEN = \"", 'api_key: "', "secret='", "password=", "Authorization: Bearer ", 'auth_token": "', "export ACCESS_KEY=", "client_secret = '", 'private_key="', "apikey=", "credential: "])
    other = one_of(9, ["commit ", 'integrity="sha256-', "md5: ", "sha1=", 'etag: "', "revision = ", "checksum ", "uuid: ", "https://cdn.example.com/a/", "the ", "and then ", 'id: "', "build/", "see ", "is ", "of the "])
    camel = F.concat(word(10), F.initcap(word(11)), F.initcap(word(12)), F.pmod(k, F.lit(10)).cast("string"))
    dashed = F.concat_ws("-", F.left(_any(k, 13), F.lit(8)), F.left(_any(k, 14), F.lit(4)), F.left(_any(k, 15), F.lit(4)), F.left(_any(k, 16), F.lit(4)), F.left(_any(k, 17), F.lit(12)))
    paths = F.concat_ws("/", word(18), word(19), F.concat(word(20), F.lit("2.java")))
    sham = F.concat_ws("_", F.lit("your"), word(21), word(22), F.lit("here1"))
    same = F.repeat(one_of(23, ["x", "0", "a", "1", "ab", "123"]), 12)
    number = F.concat(F.lit("4"), F.regexp_replace(F.left(_any(k, 24), F.lit(19)), "[a-f]", "7"))
    mail = F.concat(word(25), F.lit("."), word(26), F.lit("9.example.com"))
    prose = F.concat(word(27), F.lit("."), F.initcap(word(28)), F.initcap(word(29)), F.lit("34"))
    stamp = F.concat(F.lit("2024-0"), (F.pmod(k, F.lit(9)) + 1).cast("string"), F.lit("-11T10:22:33.000Z"))
    empty = one_of(33, ["changeme", "required", "undefined", "${TOKEN}", "${DB_PASSWORD}", "os.environ", "<redacted>", "********", "xxxxxxxx", "optional", "getenv()", "not-set"])
    plain_word = F.concat(word(34), F.lit("-"), word(35))
    kinds = [random, dashed, camel, paths, number, mail, prose, stamp, sham, same, camel, random, empty, plain_word]
    kind = F.pmod(F.xxhash64(k, F.lit(30)), F.lit(len(kinds))).cast("int")
    bad = reduce(lambda acc, x: acc.when(kind == x[0], x[1]), list(enumerate(kinds))[1:], F.when(kind == 0, kinds[0])).otherwise(camel)
    # shams are announced like secrets
    bad_before = F.when(kind.isin(8, 9, 12, 13), told).when(kind.isin(2, 10) & (k % 3 == 0), told).otherwise(other)
    good = k % 2 == 0
    end = lambda b: F.when(F.right(b, F.lit(1)).isin('"', "'"), F.right(b, F.lit(1))).otherwise(F.lit(" "))
    before = F.concat(lead, F.when(good, told).otherwise(bad_before))
    rows = spark.range(n).select(
        before.alias("before"),
        F.when(good, random).otherwise(bad).alias("candidate"),
        F.concat(end(before), F.lit(" "), word(31)).alias("after"),
        one_of(32, ["src/app/settings.py", "config/prod.yml", "web/index.js", "src3", "notes.txt", "tests/fixtures/data.json", "docs/readme.md", "", "src0", "deploy.sh"]).alias("path"),
        good.cast("int").alias("label"),
    )
    return rows.where(F.length("candidate") >= 6)


def train(findings: DataFrame, spoken: Language, trees: int = TREES, depth: int = DEPTH, max_findings: int = MAX_FINDINGS) -> list[dict[str, list]]:
    """The forest as node arrays. Rows with a null label are left out; other nulls are empty strings."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    col = lambda c: F.coalesce(F.col(c), F.lit(""))
    key = F.xxhash64("before", "candidate", "after", "path", "label")
    sample = findings.where("label IS NOT NULL").withColumn("turn", key).orderBy("turn", "before", "candidate", "after", "path", "label").limit(max_findings)
    made = features(col("before"), col("candidate"), col("after"), col("path"), spoken)
    table = materialize(sample.select(F.col("label").cast("double").alias("label"), *[v.cast("double").alias(n) for v, n in zip(made, FEATURES)]), "secret-findings")
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(table)
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED, subsamplingRate=0.8, maxBins=64).fit(vectors.coalesce(1))
    return [_nodes(t._java_obj.rootNode()) for t in model.trees]


def _nodes(root) -> dict[str, list]:
    """feature (-1 in a leaf), threshold, left, right, value (share of secrets) of a tree's nodes, the root first."""
    out: dict[str, list] = {"feature": [], "threshold": [], "left": [], "right": [], "value": []}

    def add(node) -> int:
        at = len(out["feature"])
        stats = list(node.impurityStats().stats())
        total = sum(stats)
        row = (-1, 0.0, at, at, stats[-1] / total if total and len(stats) > 1 else 0.0)
        for name, value in zip(out, row):
            out[name].append(value)
        if not node.getClass().getSimpleName().startswith("Leaf"):
            out["feature"][at], out["threshold"][at] = node.split().featureIndex(), float(node.split().threshold())
            out["left"][at] = add(node.leftChild())
            out["right"][at] = add(node.rightChild())
        return at

    add(root)
    return out


def _leaf_value(tree: dict[str, list], values: Column, depth: int) -> Column:
    of = lambda name, kind: F.array(*[F.lit(x) for x in tree[name]]).cast(f"array<{kind}>")
    feature, threshold, left, right = of("feature", "int"), of("threshold", "double"), of("left", "int"), of("right", "int")

    def step(node: Column, _: Column) -> Column:
        at = F.get(feature, node)
        return F.when(at < 0, node).when(F.get(values, at) <= F.get(threshold, node), F.get(left, node)).otherwise(F.get(right, node))

    return F.get(of("value", "double"), F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step))


def forest_score(forest: list[dict[str, list]], values: Column, depth: int = DEPTH) -> Column:
    """Mean over the trees of the share of secrets in the leaf that `values` (an array by FEATURES) falls into."""
    total = F.lit(0.0)
    for tree in forest:
        total = total + _leaf_value(tree, values, depth)
    return total / F.lit(float(max(1, len(forest))))


#: Candidates whose advances are summed in one array; sums of blocks are summed in another.
_BLOCK = 256


def candidates(docs: DataFrame, text_col: str = "text", path_col: str | None = None, keep: list[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """(keep..., start, length, before, candidate, after, path): every candidate, start in code points from 0; also the names
    that the columns after keep got."""
    keep = keep or []
    kept_names = docs.select([F.col(f"`{c}`") for c in keep])
    names = {n: fresh_name(kept_names, n) for n in ("start", "length", "before", "candidate", "after", "path")}
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    path = F.coalesce(F.col(f"`{path_col}`").cast("string"), F.lit("")) if path_col else F.lit("")
    kept = [F.col(f"`{c}`").alias(f"bq_keep{i}") for i, c in enumerate(keep)]
    found = docs.select(*kept, path.alias("bq_path"), text.alias("bq_text")).where(F.col("bq_text").rlike(PATTERN))
    found = found.withColumns({"hits": F.regexp_extract_all("bq_text", F.lit(PATTERN), F.lit(0)), "pieces": F.split("bq_text", PATTERN, -1)}).drop("bq_text")
    # every candidate starts where the one before ended, plus the piece between them
    slices = f"transform(sequence(0, int((size(hits) - 1) / {_BLOCK})), b -> slice(steps, b * {_BLOCK} + 1, {_BLOCK}))"
    running = "aggregate({0}, struct({1} AS at, cast(array() AS array<bigint>) AS out), (a, x) -> struct(a.at + x AS at, concat(a.out, array(a.at)) AS out), a -> a.out)"
    found = found.withColumn("steps", F.expr("transform(hits, (h, i) -> bigint(length(pieces[i]) + length(h)))")).withColumn("blocks", F.expr(slices))
    found = found.withColumn("bases", F.expr(running.format("transform(blocks, s -> aggregate(s, 0L, (a, x) -> a + x))", "0L")))
    found = found.withColumn("ends", F.expr(f"flatten(transform(blocks, (s, b) -> {running.format('s', 'bases[b]')}))"))
    at = F.transform(
        "hits",
        lambda h, i: F.struct(
            (F.get("ends", i) + F.length(F.get("pieces", i))).alias("start"),
            h.alias("candidate"),
            # across the candidate before it, which may be the name of an assignment
            F.right(
                F.concat(F.right(F.coalesce(F.get("pieces", i - 1), F.lit("")), F.lit(CONTEXT)), F.coalesce(F.get("hits", i - 1), F.lit("")), F.get("pieces", i)),
                F.lit(CONTEXT),
            ).alias("before"),
            F.left(F.get("pieces", i + 1), F.lit(CONTEXT)).alias("after"),
        ),
    )
    rows = found.select(*[f"bq_keep{i}" for i in range(len(keep))], "bq_path", F.explode(at).alias("c"))
    made = {"start": F.col("c.start"), "length": F.length("c.candidate").cast("long"), "before": F.col("c.before"), "candidate": F.col("c.candidate"), "after": F.col("c.after"), "path": F.col("bq_path")}
    return rows.select(*[F.col(f"bq_keep{i}").alias(c) for i, c in enumerate(keep)], *[v.alias(names[n]) for n, v in made.items()]), names


def scan(
    docs: DataFrame, forest: list[dict[str, list]], spoken: Language, text_col: str = "text", path_col: str | None = None,
    keep: list[str] | None = None, threshold: float = THRESHOLD,
) -> tuple[DataFrame, dict[str, str]]:
    """candidates() with score (0 to 1) and is_secret; also the names that the columns after keep got."""
    found, names = candidates(docs, text_col, path_col, keep)
    names = names | {n: fresh_name(found, n) for n in ("score", "is_secret")}
    of, values = lambda n: F.col(f"`{names[n]}`"), fresh_name(found, "bq_features")
    made = features(of("before"), of("candidate"), of("after"), of("path"), spoken)
    scored = found.withColumn(values, F.array(*[m.cast("double") for m in made]))
    scored = scored.withColumn(names["score"], forest_score(forest, F.col(values))).drop(values)
    return scored.withColumn(names["is_secret"], of("score") >= threshold), names
