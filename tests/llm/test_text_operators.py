"""Operators against plain implementations, with odd rows: nulls, empty and long texts, ties, repeats, empty tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import SF, same_rows
from pyspark.sql import functions as F

from bytequarry.llm import chat_format, common, decontamination, entries, line_dedup, quality_classifier, quality_rules, simhash

random.seed(5)
WORDS = "alpha Beta gamma delta eps zeta 7x été n° foo-bar".split()


def prose(n, rng=random):
    return " ".join(rng.choice(WORDS) for _ in range(n))


BASE = [prose(60) for _ in range(6)]
TEXTS = [
    *BASE, BASE[0], BASE[0].upper(), BASE[1] + " end", None, "", "   \n\t ", "one", "one two", "one two three", "\n".join(["same line"] * 5 + ["other"]),
    prose(5000), "x" * 20000, "a b c d\x1fe", "no\rbreak\x0bhere\x0cnow",
]


@pytest.fixture(scope="module")
def docs(spark):
    """Columns that clash with the names of results, a repeated row, null ids."""
    rows = [(i, t, "en" if i % 2 else None, "s", 1, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "en", "s", 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int, kept string")


@pytest.mark.parametrize("name", sorted(entries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    assert same_rows(spark, entries.queries()[name], entries.oracle_sql()[name]) > 0


def test_materialized_tables_lie_in_the_shared_folder(spark):
    out = common.materialize(spark.range(3), "probe")
    assert out.count() == 3 and out._bq_path.startswith(spark.conf.get("spark.checkpoint.dir"))
    common.drop_table(out)


# --- decontamination ---------------------------------------------------------------------------------


def words6(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)


def brute_hits(text, items):
    w, hit, found = words6(text), set(), set()
    for item, t in items:
        p = words6(t)
        k = min(13, len(p))
        for i in range(len(p) - k + 1 if k else 0):
            for j in range(len(w) - k + 1):
                if w[j : j + k] == p[i : i + k]:
                    hit |= set(range(j, j + k))
                    found |= {item} if item is not None else set()
    return len(w), len(hit), sorted(found)


ITEMS = [("10", " ".join(BASE[0].split()[5:40])), ("9", "one two"), ("9", "été"), (None, BASE[1]), ("4", None), ("5", "!!!"), ("6", "one-two-three")]


@pytest.mark.parametrize("per_block", [200_000, 7])
def test_decontamination(spark, docs, per_block):
    bench = spark.createDataFrame(ITEMS, "item_id string, text string")
    found, names = decontamination.contamination(docs, bench, windows_per_block=per_block)
    assert names["n_words"] == "n_words_"
    for r in found.collect():
        assert (r.n_words_, r.n_hit, r["items"]) == brute_hits(r.text, ITEMS)
        assert sum(s["last"] - s["first"] + 1 for s in r.hit_spans) == r.n_hit


def test_decontamination_keeps_columns_and_clean_rows(spark, docs):
    bench = spark.createDataFrame(ITEMS[:1], "item_id string, text string")
    out = decontamination.remove_contaminated(docs, bench)
    assert out.columns == docs.columns
    gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in out.collect()}
    assert gone == {0, 6, 7}
    assert decontamination.remove_contaminated(docs, bench.limit(0)).count() == docs.count()
    assert decontamination.contamination(docs.limit(0), bench)[0].count() == 0


def test_wu_manber_against_scan():
    rng = random.Random(1)
    for size in (1, 2, 3, 6):
        patterns = {tuple(rng.choice([b"a", b"b"]) for _ in range(size)): ("i",) for _ in range(3)}
        text = [rng.choice([b"a", b"b", b"c"]) for _ in range(300)]
        got = [s for s, _ in decontamination.WuManber(size, patterns).search(text)]
        assert got == [i for i in range(300 - size + 1) if tuple(text[i : i + size]) in patterns]


# --- line dedup --------------------------------------------------------------------------------------


def brute_lines(texts, min_docs, min_chars=1):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    counts = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if len(k) >= min_chars)
    return [
        ("\n".join(kept), len(all_), len(all_) - len(kept))
        for all_, kept in (((t or "").split("\n"), [x for x in (t or "").split("\n") if counts[key(x)] < min_docs]) for t in texts)
    ]


LINES = ["shared\nown1\n", " SHARED \nown2", "\tshared\r\nown2", None, "", "\n\n", "é\nshared", "own1", "é", "shared", "aa\n" * 50]


def _rows(df, kept, n="n_lines", d="n_dropped"):
    return sorted((r.doc_id, r[kept], r[n], r[d]) for r in df.collect())


@pytest.mark.parametrize("limit", [64 << 20, 0], ids=["broadcast", "shards"])
@pytest.mark.parametrize("min_docs,min_chars", [(3, 1), (2, 2), (1, 1), (4, 0)])
def test_line_dedup(spark, limit, min_docs, min_chars):
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(LINES)], "doc_id long, text string, kept string")
    index = line_dedup.LineIndex(spark, min_docs, min_chars).insert(rows)
    out, names = index.drop_lines(rows, max_broadcast_bytes=limit)
    assert names["kept"] == "kept_"
    assert _rows(out, "kept_") == [(i, *r) for i, r in enumerate(brute_lines(LINES, min_docs, min_chars))]


def test_line_index_is_reversible(spark):
    frame = lambda ts: spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string")
    first, more = LINES[:5], LINES[5:]
    index = line_dedup.LineIndex(spark, 3).insert(frame(first))
    before = sorted(map(tuple, index.references.collect()))
    index.insert(frame(more))
    assert _rows(index.drop_lines(frame(LINES))[0], "kept") == [(i, *r) for i, r in enumerate(brute_lines(LINES, 3))]
    index.delete(frame(more))
    assert sorted(map(tuple, index.references.collect())) == before
    assert _rows(index.drop_lines(frame(first))[0], "kept") == [(i, *r) for i, r in enumerate(brute_lines(first, 3))]
    index.delete(frame(first))
    assert index.references.count() == 0


def test_line_index_refuses_what_it_does_not_hold(spark):
    frame = lambda ts: spark.createDataFrame([(t,) for t in ts], "text string")
    held = ["a\nb", "a\nc", "a\nb"]
    index = line_dedup.LineIndex(spark, 2).insert(frame(held))
    state = lambda: (sorted(map(tuple, index.references.collect())), len(index.tables), sorted((r.shard, bytes(r.slots)) for r in index.filters.collect()))
    before = state()
    for strange in (["zz"], ["a"], ["a\nb"] * 3, ["a\nc", "a\nc"], ["b\na"], [None]):  # known lines alone do not make a known text
        with pytest.raises(ValueError):
            index.delete(frame(strange))
        assert state() == before
    index.delete(frame(["a\nb"]))
    assert _rows(index.drop_lines(frame(held[:2]).withColumn("doc_id", F.lit(0)))[0], "kept") == sorted([(0, "b", 2, 1), (0, "c", 2, 1)])
    with pytest.raises(ValueError):
        line_dedup.LineIndex(spark).delete(frame(["a"]))


@pytest.mark.parametrize("limit", [64 << 20, 0], ids=["broadcast", "shards"])
def test_many_updates_keep_the_index_exact(spark, monkeypatch, limit):
    """Small shards, few tables and tiny groups: filters fill up, shards multiply, tables are summed."""
    for name, value in {"KEYS_PER_SHARD": 8, "MAX_TABLES": 2, "FEW_KEYS": 6, "GROUP_ROWS": 20}.items():
        monkeypatch.setattr(line_dedup, name, value)
    frame = lambda ts: spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string")
    rng = random.Random(11)
    texts = ["\n".join(rng.choice([f"line {rng.randrange(60)}", "hot", ""]) for _ in range(rng.randint(0, 12))) for _ in range(90)]
    index = line_dedup.LineIndex(spark, 3)
    for step, rows in ((1, texts[:30]), (1, texts[30:]), (-1, texts[:45]), (1, texts[:10])):
        (index.insert if step > 0 else index.delete)(frame(rows))
    left = texts[45:] + texts[:10]
    assert _rows(index.drop_lines(frame(left), max_broadcast_bytes=limit)[0], "kept") == [(i, *r) for i, r in enumerate(brute_lines(left, 3))]
    assert index.n_shards > 1 and index.n_frequent == index.references.where("refs >= 3").count()


def test_line_dedup_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.dedup_lines(empty)[0].count() == 0


def test_cuckoo_filter():
    rng = np.random.default_rng(2)
    keys = rng.integers(-(2**63), 2**63, (5000, 2))
    made = line_dedup.build_filter(keys)
    assert made.contains(keys).all()
    assert made.contains(rng.integers(-(2**63), 2**63, (20000, 2))).sum() == 0
    made.delete(keys[:2500])
    assert not made.contains(keys[:2500]).any() and made.contains(keys[2500:]).all()
    assert not line_dedup.CuckooFilter(1).insert(keys[:50])
    sharded = line_dedup.ShardedFilter([(s, f.buckets, f.slots.tobytes()) for s in (0, 2) for f in [line_dedup.build_filter(keys[keys[:, 0] % 4 == s])]], 4)
    assert (sharded.contains(keys) == np.isin(keys[:, 0] % 4, (0, 2))).all()


# --- near duplicates ---------------------------------------------------------------------------------


def brute_components(prints, radius):
    ids = list(range(len(prints)))

    def top(i):
        while ids[i] != i:
            i = ids[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = top(i), top(j)
                ids[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(prints))]


def plain_fingerprint(text):
    """The fingerprint from its definition, bit by bit."""
    import xxhash

    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_against_their_definition():
    for t in TEXTS:
        assert simhash.fingerprint(t.encode() if t else None) == plain_fingerprint(t)


def test_hot_keys_are_dealt_out(spark, monkeypatch, docs):
    """With every key of over two rows taken for a hot one, groups are the same."""
    plain = sorted((r.id, r.component_id) for r in simhash.near_duplicates(docs).collect())
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    rows, table = spark.range(50).selectExpr("id % 3 AS k", "id AS v"), spark.createDataFrame([(0, 17, "a"), (1, 17, "b"), (5, 0, "c")], "k long, n long, t string")
    assert sorted(map(tuple, common.join_hot(rows, table, "k", "n").select("k", "v", "t").collect())) == sorted((i % 3, i, "ab"[i % 3]) for i in range(50) if i % 3 < 2)
    assert sorted((r.id, r.component_id) for r in simhash.near_duplicates(docs).collect()) == plain
    edges = spark.createDataFrame([(0, i) for i in range(1, 40)] + [(50, i) for i in range(30, 45)], "u long, v long")
    assert {r.root for r in simhash.components(edges).collect()} == {0}


def test_near_duplicates_of_odd_texts(spark, docs):
    found = {r.id: r for r in simhash.near_duplicates(docs).collect()}
    prints = [plain_fingerprint(t) for t in TEXTS]
    want = brute_components(prints, 3)
    for i in range(len(TEXTS)):
        assert found[i].fp % 2**64 == prints[i] and found[i].component_id == want[i]
    assert prints[9] == prints[10] == prints[11] == 0
    out = simhash.keep_one_of_each(docs)
    assert sorted(r.doc_id for r in out.collect()) == sorted(set(want)) and out.columns == docs.columns
    assert simhash.keep_one_of_each(docs.limit(0)).count() == 0


@pytest.mark.parametrize("split", [8192, 5])
def test_links_lose_nothing(spark, split):
    rng = random.Random(3)
    prints = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(160):  # chains and dense groups
        f = rng.choice(prints)
        for b in rng.sample(range(64), rng.randint(0, 4)):
            f ^= 1 << b
        prints.append(f)
    prints = sorted(set(prints))
    rows = spark.createDataFrame([(p - 2**64 if p >> 63 else p,) for p in prints], "fp long")
    nodes = {r.node % 2**64: r.root % 2**64 for r in simhash.components(simhash.links(rows, 3, split)).collect()}
    want = brute_components(prints, 3)
    groups = {}
    for p, w in zip(prints, want):
        groups.setdefault(w, set()).add(nodes.get(p, p))
    assert all(len(g) == 1 for g in groups.values()) and len({g.pop() for g in groups.values()}) == len(groups)


def test_bit_planes():
    rng = random.Random(4)
    for n in (1, 5, 130, 400):
        fps = [rng.getrandbits(64) & rng.getrandbits(64) for _ in range(n)]
        planes = simhash.BitPlanes(fps, list(range(64)))
        for radius in (0, 1, 2, 3, 5, 12, 20):
            q = fps[0] ^ 0b101
            mask = planes.within(q, (1 << n) - 1, radius)
            assert mask == sum(1 << i for i, f in enumerate(fps) if (f ^ q).bit_count() <= radius)


def test_fingerprint_hash_is_that_of_spark(spark):
    text = spark.range(20).select(F.concat(F.lit("w é "), F.col("id")).alias("t"))
    for r in text.select("t", F.xxhash64("t").alias("h")).collect():
        assert simhash.xxhash.xxh64_intdigest(r.t.encode(), 42) == r.h % 2**64


def test_long_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "u long, v long")
    assert {r.node: r.root for r in simhash.components(edges).collect()} == {**{i: 0 for i in range(1, 61)}, 101: 100}


def test_rows_without_ids(spark):
    rows = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (None, "other words here now")], "doc_id long, text string")
    got = sorted((r.id or -1, r.component_id or -1) for r in simhash.near_duplicates(rows).collect())
    assert got == [(-1, -1), (-1, 5), (5, 5)]


A, B, C = "a b c d", "other words here now", "quite another third text"


@pytest.mark.parametrize(
    "rows,texts",
    [
        ([(None, A), (None, B), (None, C), (None, B)], [A, B, C]),  # no ids: every group keeps a row
        ([(1, A), (2, A), (2, B), (3, B)], [A, B]),  # an id on two texts
        ([(7, A), (7, B), (7, C), (7, C)], [A, B, C]),
        ([(None, A), (4, A), (None, B)], [A, B]),
    ],
)
def test_one_row_of_every_group_whatever_the_ids(spark, rows, texts):
    table = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, simhash_row int")
    got = simhash.keep_one_of_each(table)
    assert got.columns == table.columns
    kept = got.collect()
    assert sorted(r.text for r in kept) == sorted(texts)
    for r in kept:
        ids = [i for i, t in rows if t == r.text and i is not None]
        assert r.doc_id == min(ids, default=None) and rows[r.simhash_row] == (r.doc_id, r.text)


# --- quality rules -----------------------------------------------------------------------------------


def brute_counts(text):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", text)
    grams = Counter(zip(w, w[1:], w[2:]))
    hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


EXTRA = ["a b c a b c", "a b c d a b c", "x x x x x", "a a a", "# | $ <b>", " \n \n", "q w e r " * 40, "1 2 3 4 5 2 3 4 9 1 2 3"]


def test_counts(spark, docs):
    rows = docs.select("doc_id", "text", "n_words").unionByName(spark.createDataFrame([(100 + i, t, 0) for i, t in enumerate(EXTRA)], "doc_id long, text string, n_words int"))
    found, names = quality_rules.with_statistics(rows)
    assert names["n_words"] == "n_words_"
    for r in found.collect():
        assert tuple(r[names[n]] for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute_counts(r.text), r.text


def _quality_docs(spark, n=1200):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k)).capitalize() + "."
    rows = [(i, text(rng.randint(60, 300)), rng.choice(["en", "de", None]), rng.choice(["big", "big", "big", "small", None])) for i in range(n)]
    rows += [(n + i, " ".join(w + "***" for w in text(80).split()), "en", "big") for i in range(30)]
    rows += [(n + 30 + i, text(100).upper(), "en", "small") for i in range(30)]
    rows += [(n + 60, None, "en", "big"), (n + 61, "few words", "en", "big"), (n + 62, "again and again " * 40, "en", "big")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), n


def test_outliers(spark):
    docs, n = _quality_docs(spark)
    kept = {r.doc_id for r in quality_rules.reject_outliers(docs).collect()}
    assert len(kept & set(range(n))) == n and not kept & set(range(n, n + 63))


def test_few_rows_and_odd_ones(spark, docs):
    """A handful of texts: the priors keep those that no rule rejects."""
    kept = {r.doc_id for r in quality_rules.reject_outliers(docs.drop("n_words")).collect()}
    want = set()
    for i, t in enumerate(TEXTS):
        n, *_, repeated = brute_counts(t)
        if n >= 50 and 100 * repeated <= 50 * n:
            want.add(i)
    assert kept == want
    assert quality_rules.reject_outliers(docs.limit(0)).count() == 0


def plain_vector(text):
    n, chars, symbols, dup, repeated = brute_counts(text)
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    share = lambda a, b: np.arcsin(np.sqrt(min(1.0, a / max(b, 1))))
    made = [np.log(max(1.0, chars / max(n, 1))), share(symbols, len(text)), share(dup, len(lines)), share(repeated, n), share(sum("A" <= c <= "Z" for c in text), len(text))]
    return [np.floor(1024 * m + 0.5) for m in made]


FLOOR = np.diag(np.array(list(quality_rules.FLOORS.values())) ** 2)


def plain_mcd(x):
    """(center, spread) by plain concentration steps from three starts; x in fixed-point units."""
    x = np.array(x) / 1024
    distances = lambda m: ((x - m[0]) @ np.linalg.inv(m[1]) * (x - m[0])).sum(axis=1)

    def step(m):
        level = np.floor(32 * np.log2(np.maximum(distances(m), 2.0**-20)))
        core = x[level <= np.sort(level)[int(np.ceil(quality_rules.H * len(x))) - 1]]
        return core.mean(axis=0), quality_rules.CONSISTENCY * np.cov(core.T, bias=True) + FLOOR

    q = np.percentile(x, [25, 50, 75], axis=0)
    box = np.diag(((q[2] - q[0]) / 1.349) ** 2) + FLOOR
    k = (x - q[1]) / np.sqrt(np.diag(box))
    k = np.round(1024 * k / np.maximum(np.linalg.norm(k, axis=1, keepdims=True), 1e-9)) / 1024
    toward = k.T @ k / len(k) * np.sqrt(np.outer(np.diag(box), np.diag(box))) + FLOOR
    starts = [(q[1], box), (x.mean(axis=0), np.cov(x.T, bias=True) + FLOOR), (q[1], toward)]
    best = min((step(step(m)) for m in starts), key=lambda m: np.linalg.slogdet(m[1])[1])
    while np.linalg.slogdet((new := step(best))[1])[1] < np.linalg.slogdet(best[1])[1] - quality_rules.LOWER:
        best = new
    return best


def test_distances_against_plain_estimates(spark):
    """Groups of 1 to some 80 rows, with outliers, against estimates and weights made by plain code."""
    docs, _ = _quality_docs(spark, 400)
    judged, names = quality_rules.judge(*quality_rules.with_statistics(docs))
    rows = {r.doc_id: r for r in judged.collect()}
    good = {i: (r.lang, r.source, plain_vector(r.text)) for i, r in rows.items() if not r.base_failed}
    of = lambda keep: [v for *_, v in filter(keep, good.values())]
    weigh = lambda n, own, pool, k: tuple((n * a + k * b) / (n + k) for a, b in zip(own, pool))
    everyone = of(lambda g: True)
    whole = plain_mcd(everyone)
    whole = weigh(len(everyone), whole, (whole[0], np.diag(np.array(list(quality_rules.PRIORS.values())) ** 2) + FLOOR), quality_rules.PRIOR_ROWS)
    sizes = set()
    for lang in {g[0] for g in good.values()}:
        mine = of(lambda g: g[0] == lang)
        pool = weigh(len(mine), plain_mcd(mine), whole, quality_rules.POOL_ROWS)
        for source in {g[1] for g in good.values() if g[0] == lang}:
            own = of(lambda g: g[:2] == (lang, source))
            sizes.add(len(own))
            center, spread = weigh(len(own), plain_mcd(own), pool, quality_rules.POOL_ROWS)
            for i, g in good.items():
                if g[:2] == (lang, source):
                    d = np.array(g[2]) / 1024 - center
                    d2 = d @ np.linalg.inv(spread) @ d
                    assert rows[i].distance == pytest.approx(d2, rel=1e-6) and rows[i].kept == (d2 <= quality_rules.CUTOFF)
    assert len(sizes) > 4 and min(sizes) < 40 < max(sizes)
    assert all(rows[i].distance is None and not rows[i].kept for i in rows if i not in good)


def test_shuffled_models_give_the_same(spark, monkeypatch):
    docs, _ = _quality_docs(spark, 120)
    stats, names = quality_rules.with_statistics(docs)
    one = sorted((r.doc_id, r.distance or -1.0) for r in quality_rules.judge(stats, names)[0].collect())
    monkeypatch.setattr(quality_rules, "MAX_BROADCAST_GROUPS", 0)
    two = sorted((r.doc_id, r.distance or -1.0) for r in quality_rules.judge(stats, names)[0].collect())
    assert one == two


def test_mcd_withstands_a_fifth_of_outliers(spark):
    rng = np.random.default_rng(7)
    good, bad = rng.normal(0, 100, (800, 5)), rng.normal(1500, 12, (200, 5))
    rows = spark.createDataFrame([("g", *map(int, r)) for r in np.concatenate([good, bad])], "gid string, x0 long, x1 long, x2 long, x3 long, x4 long")
    model = quality_rules.fit(rows).first()
    assert model.rows == 1000 and np.abs(np.array(model.center)).max() < 0.05
    precision = np.linalg.inv(np.array(model.spread).reshape(5, 5))
    d2 = lambda x: float((x / 1024 - model.center) @ precision @ (x / 1024 - model.center))
    assert np.mean([d2(x) < quality_rules.CUTOFF for x in good]) == 1.0 and all(d2(x) > quality_rules.CUTOFF for x in bad)


def test_chi_square():
    assert quality_rules.chi2_quantile(0.5, 2) == pytest.approx(1.3862943611, abs=1e-8)
    assert quality_rules.chi2_quantile(0.95, 5) == pytest.approx(11.0704976935, abs=1e-7)


def test_inverse(spark):
    rng = np.random.default_rng(8)
    a = rng.normal(size=(5, 9))
    m = a @ a.T
    got = np.array(spark.createDataFrame([(m.reshape(-1).tolist(),)], "m array<double>").selectExpr(f"{quality_rules._swept('m')} AS i").first().i)
    assert np.allclose(got[:25].reshape(5, 5) @ m, np.eye(5)) and got[25] == pytest.approx(np.linalg.slogdet(m)[1])


# --- classifier --------------------------------------------------------------------------------------


def test_classifier_held_out_accuracy(spark):
    import duckdb

    rows = entries.op4_quality_classifier(spark, "/root/testdata/sf0.01").toPandas()
    labels = duckdb.sql("SELECT * FROM '/root/testdata/sf0.01/labels.parquet'").df()
    both = rows.merge(labels, on="doc_id")
    held = both[both.held_out]
    assert len(rows) == 1000 and rows.score.between(0, 1).all()
    assert ((rows.score >= 0.3).astype(int) == rows.predicted).all()
    assert (held.predicted == held.quality).mean() > 0.95
    assert (held[held.quality == 1].predicted == 1).all()


def test_classifier_edges(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)] + [(1, 1, 0), (None, 1, 0), (2, None, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    weights = quality_classifier.train(docs, labels, train_rows=50)
    scored = {r.doc_id: r.s for r in quality_classifier.score(docs, weights)[0].withColumnRenamed("score", "s").collect()}
    assert len(scored) == len(TEXTS) and all(0 <= s <= 1 for s in scored.values())
    assert scored[9] == scored[10] == scored[11]
    again = quality_classifier.train(docs.repartition(7), labels.repartition(3), train_rows=50)
    assert (weights == again).all()
    none = quality_classifier.train(docs, labels.limit(0))
    assert {r.s for r in quality_classifier.score(docs, none)[0].withColumnRenamed("score", "s").collect()} == {0.5}
    assert quality_classifier.score(docs.limit(0), weights)[0].count() == 0
    clashing, name = quality_classifier.score(docs.withColumn("Score", F.lit(1)), weights)
    assert name == "score_" and len(set(map(str.lower, clashing.columns))) == len(clashing.columns) and clashing.where("score_ BETWEEN 0 AND 1").count() == len(scored) + 1


def plain_model(rows, bits, epochs, with_shapes):
    """Logistic regression by FTRL-proximal updates, one weight at a time; rows are (text, label) in order."""
    import xxhash

    alpha, beta, l1, l2 = quality_classifier.ALPHA, quality_classifier.BETA, quality_classifier.L1, quality_classifier.L2
    z, n = Counter(), Counter()

    def vector(text):
        words = (text or "").encode().split()
        h = [xxhash.xxh3_64_intdigest(w) for w in words]
        pairs = [(a * 0x9E3779B97F4A7C15 + b) * 0x9E3779B97F4A7C15 % 2**64 for a, b in zip(h, h[1:])]
        kinds = [h, pairs]
        if with_shapes:
            kind = lambda b: "0" if 48 <= b <= 57 else "A" if 65 <= b <= 90 else "a" if 97 <= b <= 122 or b >= 128 else chr(b)
            told = ["".join(map(kind, w)) for w in words]
            shapes = [xxhash.xxh3_64_intdigest((t[:1] + t[-3:]).encode()) * 0xC2B2AE3D27D4EB4F % 2**64 for t in told]
            both = [((a + (u == v)) * 0x9E3779B97F4A7C15 + b) * 0x9E3779B97F4A7C15 % 2**64 for a, b, u, v in zip(shapes, shapes[1:], h, h[1:])]
            kinds += [shapes, both]
        out = Counter()
        for kind in kinds:
            for x in kind:
                out[x >> 64 - bits] += quality_classifier.SCALE / len(kind)
        return {**out, "bias": 1.0}

    def weight(i):
        a, b = (0.0, 0.0) if i == "bias" else (l1, l2)
        return 0.0 if abs(z[i]) <= a else -(z[i] - (a if z[i] > 0 else -a)) / ((beta + n[i] ** 0.5) / alpha + b)

    score = lambda x: 1 / (1 + np.exp(-sum(weight(i) * v for i, v in x.items())))
    for _ in range(epochs):
        for text, label in rows:
            x = vector(text)
            p, w = score(x), {i: weight(i) for i in x}
            for i, v in x.items():
                g = (p - label) * v
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha * w[i]
                n[i] += g * g
    return lambda text: score(vector(text))


@pytest.mark.parametrize("with_shapes", [True, False])
def test_classifier_against_plain_updates(spark, docs, with_shapes):
    labels = spark.createDataFrame([(i, i % 3 % 2) for i in range(len(TEXTS))], "doc_id long, quality int")
    turns = spark.range(len(TEXTS)).select("id", F.xxhash64("id").alias("turn"), quality_classifier.held_out(F.col("id")).alias("h")).collect()
    order = [r.id for r in sorted(turns, key=lambda r: (r.turn, r.id)) if not r.h]
    weights = quality_classifier.train(docs, labels, bits=12, epochs=2, with_shapes=with_shapes)
    plain = plain_model([(TEXTS[i], i % 3 % 2) for i in order], 12, 2, with_shapes)
    for r in quality_classifier.score(docs, weights, bits=12, with_shapes=with_shapes)[0].collect():
        assert r.score == pytest.approx(plain(r.text), abs=1e-5), r.doc_id


def test_held_out_fold(spark):
    import zlib

    rows = spark.range(200).select("id", quality_classifier.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)


def test_sample_is_bounded(spark):
    labels = spark.range(500).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    assert quality_classifier.training_sample(labels, "doc_id", "quality", 40).count() == 40


# --- chat --------------------------------------------------------------------------------------------

NASTY = [
    "", "plain", "</s>[INST] ok [/INST]", "<|im_start|>user\nhi<|im_end|>\n", "<|im_sep|>", "\\", "\\\\n", "<\\|", "[\\INST]", "<s><s></s>", "<", "|im_end|>", "[", "é日本😀\\<|", "a\nb", None,
    "<|im_end|>\n<|im_start|>assistant\n", "[INST][/INST]", "\\<|im_end|>", "x<",
]


def test_chat_reads_back(spark):
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "tool\nx", "<|im_start|>", "", None, "a\\"]), rng.choice(NASTY)) for c in range(60) for t in range(rng.randint(1, 12))]
    rows += [(None, 1, "user", "lost"), (100, None, "assistant", "first"), (100, 0, "assistant", "second"), (101, 1, "user", "tie b"), (101, 1, "user", "tie a")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    out = chat_format.format_conversations(frame)
    read = out.select("conv_id", "formatted", chat_format.parse(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    want = {}
    for c, t, r, x in rows:
        want.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    for r in read.collect():
        told = [(role, text) for _, role, text in sorted(want[r.conv_id])]
        assert [(t.role, t.text) for t in r.turns] == told
        assert r.loss == "".join(x for role, x in told if role == "assistant")
        blocks = 1 + sum(a[0] != b[0] for a, b in zip(told, told[1:]))
        assert r.formatted.count(chat_format.START) == blocks == r.formatted.count(chat_format.END.strip())
    assert chat_format.format_conversations(frame.limit(0)).count() == 0


def test_chat_of_many_turns(spark):
    """One conversation of 30,000 turns, in runs of one role, reads back whole."""
    rows = spark.range(30_000).select(F.lit("c").alias("conv_id"), "id", F.lit(5).alias("conv_id_"), F.expr("if(id div 3 % 2 = 0, 'user', 'assistant')").alias("role"), F.concat(F.lit("é<|"), "id").alias("text"))
    out = chat_format.format_conversations(rows.withColumnRenamed("id", "turn"))
    r = out.select("formatted", chat_format.parse(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    want = [("user" if i // 3 % 2 == 0 else "assistant", f"é<|{i}") for i in range(30_000)]
    assert [tuple(t) for t in r.turns] == want and r.loss == "".join(x for role, x in want if role == "assistant")
    assert r.formatted.count(chat_format.START) == 10_000


def test_chat_contract_conversation(spark):
    got = {r.conv_id: r for r in entries.op8_chat_format(spark, SF).collect()}[-7]
    said = "</s>[INST] ok [/INST]"
    told = f"user\n{said}\nassistant\n{said}\n"
    assert (got.n_turns, got.loss_chars) == (2, len(said))
    assert got.turns_sha256 == hashlib.sha256(told.encode()).hexdigest() and got.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
