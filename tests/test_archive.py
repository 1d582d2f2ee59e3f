import glob
import os

import pytest
from pyspark.sql import functions as F

from bytequarry import api
from bytequarry.operators import analytics
from bytequarry.sources import archive, chunks, codecs, reports


@pytest.fixture
def files(tmp_path):
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_bytes(b"hello " * 500)
    (root / "sub" / "b.bin").write_bytes(bytes(range(256)) * 9 + b"x")
    (root / "one").write_bytes(b"1")
    (root / "empty").write_bytes(b"")
    return root


def test_listing_is_sorted_and_relative(spark, files):
    assert [r.rel for r in chunks.listing(spark, str(files)).collect()] == ["a.txt", "empty", "one", "sub/b.bin"]
    assert [r.rel for r in chunks.listing(spark, str(files / "a.txt")).collect()] == ["a.txt"]


def test_tables_of_part_files_are_listed_by_name(spark, tmp_path):
    from bytequarry.plans import archive_queries

    spark.range(9).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(2).coalesce(1).write.parquet(f"{tmp_path}/other.parquet")
    for name in ("labels", "region"):
        spark.range(2).toPandas().to_parquet(f"{tmp_path}/{name}.parquet")
    got = [tuple(r) for r in archive_queries.listed_files(spark, str(tmp_path)).collect()]
    assert got == [("documents.parquet", True), ("labels.parquet", True), ("region.parquet", True)]


@pytest.mark.parametrize("codec", ["zlib-6", "kernel", "store"])
def test_files_come_back(spark, files, tmp_path, codec):
    api.archive(spark, str(files), str(tmp_path / "out"), ["BASE", "D4T4", "NIB"], codec, chunk_bytes=1000)
    n = api.restore(spark, str(tmp_path / "out"), str(tmp_path / "back"))
    assert n == 3 + 3 + 1 + 1
    for name in ("a.txt", "sub/b.bin", "one", "empty"):
        assert (tmp_path / "back" / name).read_bytes() == (files / name).read_bytes()


def test_append_and_overwrite(spark, files, tmp_path):
    out = str(tmp_path / "arc")
    api.archive(spark, str(files / "a.txt"), out)
    rows = archive.pack(chunks.from_files(spark, str(files / "one")))
    rows.write.format("bytequarry").option("path", out).mode("append").save()
    assert {r.rel for r in api.read_archive(spark, out).collect()} == {"a.txt", "one"}
    api.archive(spark, str(files / "one"), out)
    assert {r.rel for r in api.read_archive(spark, out).collect()} == {"one"}


def _damage(path, change):
    part = max(glob.glob(os.path.join(path, "part-*")), key=os.path.getsize)
    data = bytearray(open(part, "rb").read())
    with open(part, "wb") as f:
        f.write(change(data))


@pytest.mark.parametrize(
    "change",
    [lambda d: b"NOPE" + d[4:], lambda d: d[:4] + b"\x05" + d[5:], lambda d: d[:4] + b"\x00" + d[5:], lambda d: d[:-3], lambda d: d[:-1] + bytes([d[-1] ^ 255]), lambda d: d[:12]],
    ids=["magic", "version5", "version0", "truncated", "payload", "records"],
)
def test_damage_is_noticed(spark, files, tmp_path, change):
    out = str(tmp_path / "arc")
    api.archive(spark, str(files / "a.txt"), out)
    _damage(out, change)
    with pytest.raises(Exception, match="(?i)archive|records|checksum|unpacked"):
        archive.restore(api.read_archive(spark, out)).count()


@pytest.mark.parametrize("name", ["../x", "/etc/x", "a/../../b", "", "c:/x"])
def test_unsafe_names(name):
    with pytest.raises(archive.CorruptArchive):
        archive.check_name(name)


def test_integers():
    assert archive.get_u32(archive.put_u32(4_000_000_000), 0) == 4_000_000_000
    assert archive.get_u64(b"x" + archive.put_u64(2**63 + 5), 1) == 2**63 + 5
    with pytest.raises(archive.CorruptArchive):
        archive.get_u64(b"1234567", 0)


def test_digest_check(spark):
    a = spark.createDataFrame([(1, b"x"), (2, b"y"), (3, b"z")], "key int, raw binary")
    b = spark.createDataFrame([(1, b"x"), (2, b"Y")], "key int, raw binary")
    assert {r.key: r.same for r in analytics.digest_check(a, b, ["key"]).collect()} == {1: True, 2: False, 3: False}


def test_codecs():
    for name in codecs.names():
        pack, unpack = codecs.get(name)
        assert unpack(pack(b"abc" * 99)) == b"abc" * 99 and unpack(pack(b"")) == b""
    with pytest.raises(KeyError):
        codecs.get("none")


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("b", 1234567, 0.5), ("a", 7, None)], "mode string, size long, ratio double")
    reports.to_csv(rows, str(tmp_path / "csv"), ["size", "mode"])
    assert "size,mode" in "".join(open(f).read() for f in glob.glob(str(tmp_path / "csv" / "*.csv")))
    reports.to_json(rows, rows.agg(F.sum("size").alias("size")), str(tmp_path / "json"))
    back = reports.read_json(spark, str(tmp_path / "json" / "rows"), "mode string, size long, ratio double")
    assert {(r.mode, r.size, r.ratio) for r in back.collect()} == {("b", 1234567, 0.5), ("a", 7, None)}
    reports.to_markdown(rows, str(tmp_path / "md"), {"mode": F.col("mode"), "size": F.format_number("size", 0)}, ["mode"])
    text = "".join(open(f).read() for f in glob.glob(str(tmp_path / "md" / "*.txt")))
    assert text.splitlines() == ["| mode | size |", "|---|---|", "| a | 7 |", "| b | 1,234,567 |"]
    reports.to_text(rows, str(tmp_path / "txt"))
    assert "ratio=" in "".join(open(f).read() for f in glob.glob(str(tmp_path / "txt" / "*.txt"))).splitlines()
