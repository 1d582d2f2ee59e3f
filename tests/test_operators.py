import pytest
from pyspark.sql import functions as F

from bytequarry.functions import scalar
from bytequarry.operators import analytics, matching, profiles, routing, transforming
from bytequarry.sources import chunks
from bytequarry.streaming import arrivals


def _chunks(spark, values, size=16):
    return chunks.from_text(spark.createDataFrame(list(enumerate(values)), "id int, text string"), "id", "text", size)


def test_chunk_edges(spark):
    rows = _chunks(spark, ["", None, "a", "x" * 16, "x" * 17, "é" * 9]).collect()
    assert sorted((r.key, r.chunk, r.raw_len) for r in rows) == [(2, 0, 1), (3, 0, 16), (4, 0, 16), (4, 1, 1), (5, 0, 16), (5, 1, 2)]
    with pytest.raises(ValueError):
        _chunks(spark, ["a"], 0)


SIZES = "key int, chunk int, raw_len long, mode int, tag string, size long"


def test_ties(spark):
    rows = spark.createDataFrame([(1, 0, 9, i, t, 5) for i, t in enumerate(["BASE", "D16", "D1024"])], SIZES)
    assert routing.best(rows, "mode").first().best_tag == "BASE"
    some = rows.where("tag <> 'BASE'")
    assert routing.best(some, "mode").first().best_tag == "D16"
    assert routing.best(some, "tag").first().best_tag == "D1024"


def test_routed_size_is_never_above_base(spark):
    found = routing.best(routing.candidates(_chunks(spark, ["abcd" * 30, "q", "a1b2" * 9], 64), ["BASE", "D4T4", "T4"]))
    assert found.where("best_size > base OR saved < 0").count() == 0


def test_histogram_has_all_modes(spark):
    chosen = spark.createDataFrame([("f", 1), ("f", 1), ("g", 0)], "key string, best_mode int")
    got = routing.mode_histogram(chosen, ["BASE", "D1", "D4"], ["key"]).collect()
    assert {(r.key, r.mode): r.n for r in got} == {("f", 0): 0, ("f", 1): 2, ("f", 2): 0, ("g", 0): 1, ("g", 1): 0, ("g", 2): 0}


def test_first_rule_wins(spark):
    cols = "ratio double, res_entropy double, entropy double, printable double, eq1 double, eq16 double, eq256 double"
    rows = spark.createDataFrame(
        [(0.2, 1.0, 8.0, 1.0, 1.0, 1.0, 1.0), (0.9, 5.2, 8.0, 1.0, 1.0, 0.11, 0.0), (0.9, 7.1, 7.4, 1.0, 0.0, 0.0, 0.0), (0.9, 6.0, 7.0, 0.75, 1.0, 0.0, 0.0), (0.9, 6.0, 7.0, 0.1, 0.13, 0.0, 0.0), (0.9, 6.0, 7.0, 0.1, 0.12, 0.08, 0.06)],
        cols,
    )
    assert [r[0] for r in rows.select(profiles.chunk_class(F.col("ratio"))).collect()] == [
        "already_at_or_below_26", "structured_residual", "high_entropy_hard", "textual", "repeat_structured", "mixed"
    ]


def test_rows_and_bytes_agree(spark):
    cut = _chunks(spark, ["hello world, hello", "a", "abcabcabcabc"], 8)
    rows = transforming.byte_rows(cut)
    pairs = [
        (transforming.rows_delta(rows, 3), "D3"), (transforming.rows_xor(rows, 2), "X2"), (transforming.rows_transpose(rows, 3), "T3"),
        (transforming.rows_transpose(transforming.rows_delta(rows, 4), 4), "D4T4"),
    ]
    for by_rows, name in pairs:
        left = {(r.key, r.chunk): bytes(r.raw) for r in transforming.from_rows(by_rows).collect()}
        right = {(r.key, r.chunk): bytes(r.payload) for r in transforming.transformed(cut, name).collect()}
        assert left == right


def test_share_of_nothing(spark):
    rows = spark.createDataFrame([("a", 0), ("b", 0)], "k string, v long")
    assert [r.share for r in analytics.share_of_total(rows, "v", "share").collect()] == [0.0, 0.0]


def test_missing_decode_time(spark):
    rows = spark.createDataFrame([(10, 5, 2.0, None)], "raw long, size long, seconds double, dec_seconds double")
    got = analytics.with_metrics(rows).first()
    assert got.dec_mbps is None and got.ratio_pct == 50.0


def test_kernel_rows_round_trip(spark):
    cut = _chunks(spark, ["abcd" * 40, "x", "no match"], 64)
    back = matching.unpacked(matching.packed(cut))
    assert {(r.key, r.chunk): bytes(r.raw) for r in back.collect()} == {(r.key, r.chunk): bytes(r.raw) for r in cut.collect()}


def test_zigzag(spark):
    rows = spark.range(-5, 6).select("id", scalar.zigzag(F.col("id")).alias("z"))
    got = {r.id: r.z for r in rows.collect()}
    assert [got[i] for i in (0, -1, 1, -2, 2)] == [0, 1, 2, 3, 4]


def test_stream(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a").write_bytes(b"plain text, plain text " * 20)
    stream = arrivals.chunk_classes(arrivals.arriving(spark, str(inbox)), 256)
    for name in ("a", "b"):
        if name == "b":
            (inbox / "b").write_bytes(bytes(range(256)))
        arrivals.write(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.path[-1], r.chunk, r.raw_len) for r in rows) == [("a", 0, 256), ("a", 1, 204), ("b", 0, 256)]
    table = spark.createDataFrame([(r.path, r.arrived, r.chunk, r.raw_len, r["class"]) for r in rows], "path string, arrived timestamp, chunk int, raw_len long, class string")
    assert sum(r.chunks for r in arrivals.windowed(table).collect()) == 3


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_match_candidates_stay_in_their_task(spark):
    text = "abcabcabcd" * 30 + "wxyz" * 5
    cut = _chunks(spark, [text, "abc", "é" * 100, text[7:]], 256)
    found = matching.match_candidates(cut, 4)
    assert _exchanges(found) == _exchanges(cut)
    want = set()
    for r in cut.collect():
        raw, slots = bytes(r.raw), {}
        for at in range(len(raw) - 3):
            gram = raw[at : at + 4]
            earlier = slots.setdefault(int.from_bytes(gram, "little") * scalar.FACTOR % (1 << 20), [])
            want |= {(r.key, r.chunk, at, at - p, k) for k, p in enumerate(earlier[:-5:-1], 1) if raw[p : p + 4] == gram}
            earlier.append(at)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_best_candidates_stay_in_their_task(spark):
    import numpy as np

    cut = _chunks(spark, ["abcabcabcd" * 30 + "wxyz" * 5, "abc", "é" * 100], 256)
    # steps of 4 tie, so that the nearer has to win
    found = matching.best_candidates(cut, 8, lambda d: (d // 4 % 7).astype(float), 3)
    assert _exchanges(found) == _exchanges(cut)
    scored = matching.match_candidates(cut, 8).withColumn("score", (F.floor(F.col("dist") / 4) % 7).cast("double"))
    want = matching.top_candidates(scored, F.col("score"), 3).drop("rank").select(*found.columns)
    got = [tuple(r) for r in found.collect()]
    assert len(got) > 500 and sorted(got) == sorted(tuple(r) for r in want.collect())
    rows = spark.range(1, 5000).withColumnRenamed("id", "d")
    score = F.round(scalar.lattice_bonus(8, F.col("d")) - 1.2 * F.log2(F.col("d") + 1.0), 6)
    d = np.arange(1, 5000)
    assert [r.s for r in rows.select(score.alias("s")).collect()] == np.round(scalar.lattice_bits(8, d) - 1.2 * np.log2(d + 1.0), 6).tolist()


def test_packed_and_plain_chunks_come_back_together(spark):
    cut = _chunks(spark, ["abcd" * 300, "x", "no match", "é" * 700 + "q", None, ""], 1024)
    rows = matching.packed(cut)
    assert {r["mode"] for r in rows.collect()} == {0, 1}
    back = matching.unpacked(rows)
    assert {(r.key, r.chunk, r.raw_len): bytes(r.raw) for r in back.collect()} == {(r.key, r.chunk, r.raw_len): bytes(r.raw) for r in cut.collect()}


def test_penalties_of_chunks_packed_together(spark):
    from dataclasses import replace

    from bytequarry.functions import lz

    cut = _chunks(spark, ["the cat sat on the mat, the cat sat on the hat " * 9 + str(i) * i for i in range(6)], 300)
    rows = matching.packed_with_penalty(cut, F.when(F.col("key") % 2 == 0, 0.95).otherwise(3.5), verify=False).collect()
    raw = {(r.key, r.chunk): bytes(r.raw) for r in cut.collect()}
    assert len(rows) == len(raw) and {r.penalty for r in rows} == {0.95, 3.5}
    for r in rows:
        assert (r["mode"], bytes(r.payload)) == lz.pack(raw[r.key, r.chunk], replace(lz.ParseOptions(), distance=r.penalty))
