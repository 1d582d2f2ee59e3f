"""Archive source and sink: chunks with their transform and packing, as Spark data sources.

A directory holds part files (one for each writing task) and a manifest that is put in place when all tasks have ended,
so that a failed or repeated task leaves no trace: readers use the parts that the manifest names. A part is a sequence
of records; each carries its file's name, the chunk's number, raw length, transform, mode, checksum and payload.
All integers are little-endian.

    spark.dataSource.register(ArchiveSource); df.write.format("bytequarry").save(path); spark.read.format("bytequarry").load(path)

The rows of write() and read() are those of RECORD; pack() and restore() turn chunks into them and back. Part files go
through the file system of the workers, so `path` must be one that all of them share.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from bytequarry.functions import lz, transforms
from bytequarry.operators.kernel_map import map_chunks
from bytequarry.sources import codecs

MAGIC, VERSION = b"BQAR", 1
RECORD = T.StructType(
    [
        T.StructField("rel", T.StringType()),
        T.StructField("chunk", T.IntegerType()),
        T.StructField("raw_len", T.LongType()),
        T.StructField("transform", T.StringType()),
        T.StructField("codec", T.StringType()),
        T.StructField("mode", T.IntegerType()),
        T.StructField("crc", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)
_HEAD = struct.Struct("<4sII")  # magic, version, 0
_FIXED = struct.Struct("<IIQIQ")  # chunk, mode, raw length, checksum of the raw bytes, payload length


class CorruptArchive(ValueError):
    """An archive that is not what its writer left."""


def put_u32(x: int) -> bytes:
    return x.to_bytes(4, "little")


def get_u32(data: bytes, at: int) -> int:
    if at + 4 > len(data):
        raise CorruptArchive("the archive ends early")
    return int.from_bytes(data[at : at + 4], "little")


def put_u64(x: int) -> bytes:
    return x.to_bytes(8, "little")


def get_u64(data: bytes, at: int) -> int:
    return get_u32(data, at) | get_u32(data, at + 4) << 32


def _text(x: str) -> bytes:
    raw = x.encode("utf-8")
    return put_u32(len(raw)) + raw


def check_name(rel: str) -> str:
    """Names must stay below the directory that an archive is restored to."""
    parts = rel.replace("\\", "/").split("/")
    if not rel or rel.startswith(("/", "\\")) or ".." in parts or (len(parts[0]) == 2 and parts[0][1] == ":"):
        raise CorruptArchive(f"unsafe name {rel!r}")
    return rel


def write_record(row) -> bytes:
    payload = bytes(row["payload"])
    head = _text(check_name(row["rel"])) + _text(row["transform"]) + _text(row["codec"])
    return head + _FIXED.pack(row["chunk"], row["mode"], row["raw_len"], row["crc"], len(payload)) + payload


def read_part(stream) -> Iterator[tuple]:
    """Records of an open part, one at a time."""

    def take(n: int) -> bytes:
        got = stream.read(n)
        if len(got) != n:
            raise CorruptArchive("the archive ends early")
        return got

    magic, version, _ = _HEAD.unpack(take(_HEAD.size))
    if magic != MAGIC:
        raise CorruptArchive("this is no archive part")
    if version != VERSION:
        raise CorruptArchive(f"version {version} is not known")
    while first := stream.read(4):
        if len(first) != 4:
            raise CorruptArchive("the archive ends early")
        rel = take(int.from_bytes(first, "little")).decode("utf-8")
        transform, codec = (take(int.from_bytes(take(4), "little")).decode("utf-8") for _ in range(2))
        chunk, mode, raw_len, crc, size = _FIXED.unpack(take(_FIXED.size))
        yield check_name(rel), chunk, raw_len, transform, codec, mode, crc, take(size)


def _local(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")


@dataclass
class _Part(InputPartition):
    path: str
    records: int


@dataclass
class _Written(WriterCommitMessage):
    name: str
    records: int
    raw: int


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = _local(path)

    def partitions(self):
        try:
            with open(os.path.join(self.path, "manifest.json")) as f:
                manifest = json.load(f)
        except FileNotFoundError:
            raise CorruptArchive(f"{self.path} has no manifest") from None
        if manifest.get("magic") != MAGIC.decode() or manifest.get("version") != VERSION:
            raise CorruptArchive("the manifest is not of this version")
        return [_Part(os.path.join(self.path, p["name"]), p["records"]) for p in manifest["parts"]]

    def read(self, partition):
        seen = 0
        with open(partition.path, "rb") as f:
            for record in read_part(f):
                seen += 1
                yield record
        if seen != partition.records:
            raise CorruptArchive(f"{seen} records instead of {partition.records} in {partition.path}")


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = _local(path), overwrite

    def write(self, iterator):
        os.makedirs(self.path, exist_ok=True)
        name, records, raw = f"part-{uuid.uuid4().hex}.bqar", 0, 0
        with open(os.path.join(self.path, name), "wb") as f:
            f.write(_HEAD.pack(MAGIC, VERSION, 0))
            for row in iterator:
                f.write(write_record(row))
                records, raw = records + 1, raw + row["raw_len"]
        return _Written(name, records, raw)

    def _manifest(self) -> str:
        return os.path.join(self.path, "manifest.json")

    def commit(self, messages):
        kept, old = [], []
        if os.path.exists(self._manifest()):
            with open(self._manifest()) as f:
                old = json.load(f)["parts"]
            kept = [] if self.overwrite else old
        parts = kept + [{"name": m.name, "records": m.records, "raw": m.raw} for m in messages if m]
        os.makedirs(self.path, exist_ok=True)
        draft = self._manifest() + ".new"
        with open(draft, "w") as f:
            json.dump({"magic": MAGIC.decode(), "version": VERSION, "parts": parts}, f)
        os.replace(draft, self._manifest())
        for p in old if self.overwrite else []:
            os.unlink(os.path.join(self.path, p["name"]))

    def abort(self, messages):
        for m in messages:
            if m and os.path.exists(os.path.join(self.path, m.name)):
                os.unlink(os.path.join(self.path, m.name))


class ArchiveSource(DataSource):
    """format("bytequarry") over a directory of archive parts."""

    @classmethod
    def name(cls):
        return "bytequarry"

    def schema(self):
        return RECORD

    def reader(self, schema):
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], overwrite)


def pack(chunks: DataFrame, tags: list[str] | None = None, codec: str = "zlib-6", options: lz.ParseOptions = lz.ParseOptions()) -> DataFrame:
    """RECORD rows of chunks (key, chunk, raw_len, raw): every chunk in the transform that packs smallest (of equal ones
    the first in `tags`). codec "kernel" is the engine's own, with these options; raw bytes are kept where packing does not
    pay."""
    tags = tags or ["BASE"]
    for tag in tags:
        transforms.steps(tag)

    def one(data: bytes) -> tuple[int, bytes]:
        if codec == "kernel":
            return lz.pack(data, options)
        made = codecs.get(codec)[0](data)
        return (lz.PACKED, made) if len(made) < len(data) else (lz.RAW, data)

    def work(raw):
        data = bytes(raw)
        made = [(tag, *one(transforms.apply(data, tag))) for tag in tags]
        tag, mode, payload = min(made, key=lambda x: len(x[2]))
        return [(tag, codec, mode, zlib.crc32(data), payload)]

    fields = T.StructType(RECORD.fields[3:])
    packed = map_chunks(chunks, fields, work, ["raw"], ["key", "chunk", "raw_len"])
    return packed.select(F.col("key").cast("string").alias("rel"), *RECORD.names[1:])


def restore(records: DataFrame) -> DataFrame:
    """(key, chunk, raw_len, raw) of RECORD rows; raises CorruptArchive for a chunk that fails its checksum."""

    def work(payload, tag, codec, mode, n, crc):
        data = bytes(payload)
        try:
            if codec == "kernel":
                data = lz.unpack(mode, data, n if tag not in ("BIT", "NIB") else len(transforms.apply(bytes(n), tag)))
            elif mode != lz.RAW:
                data = codecs.get(codec)[1](data)
            data = transforms.undo(data, tag, n)
        except (ValueError, KeyError, zlib.error, OSError, EOFError) as e:
            raise CorruptArchive(f"a chunk cannot be unpacked: {e}") from e
        if len(data) != n or zlib.crc32(data) != crc:
            raise CorruptArchive("a chunk fails its checksum")
        return [(data,)]

    fields = T._parse_datatype_string("raw binary")
    inputs = ["payload", "transform", "codec", "mode", "raw_len", "crc"]
    renamed = records.withColumnRenamed("rel", "key")
    return map_chunks(renamed, fields, work, inputs, ["key", "chunk", "raw_len"])


def joined(chunks: DataFrame) -> DataFrame:
    """(key, n_chunks, raw_len, content): whole inputs, for those that fit in a row."""
    rows = chunks.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("chunk", "raw"))).alias("parts"), F.sum("raw_len").alias("raw_len"))
    hexed = F.array_join(F.transform("parts", lambda p: F.hex(p["raw"])), "")
    return rows.select("key", F.size("parts").alias("n_chunks"), "raw_len", F.unhex(hexed).alias("content"))
