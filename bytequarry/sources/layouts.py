"""Two archive layouts of other tools, read and written.

A plain archive (magic AUR2) is a head, a list of files (name, length) and the chunks of all files, in order: raw length,
payload length, payload. A routed archive (magic K44R) holds one file: its length, the number of chunks, and for each chunk
a transform's number, raw length, payload length and a plain archive of the transformed bytes. All integers are
little-endian. A payload that is one byte longer than its chunk and ends in a zero byte is the chunk as it is; other payloads
were made by some kernel, which is given as a function. Names, lengths and counts are checked before they are used.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytequarry.functions import transforms
from bytequarry.sources.archive import CorruptArchive, check_name

#: Magic numbers, version that is written, versions that are read, transforms by their number.
PLAIN, ROUTED = b"AUR2", b"K44R"
VERSION, VERSIONS = 4, (2, 3, 4)
MODES = ["BASE", "D4T4", "D1024T1024", "WX2T2", "D2T2", "D16T16"]

_HEAD, _ROUTED_HEAD, _RECORD, _ROUTED_RECORD = struct.Struct("<4sIIQI"), struct.Struct("<4sQI"), struct.Struct("<II"), struct.Struct("<BII")
Encode, Decode = Callable[[bytes], bytes | None], Callable[[bytes, int], bytes]


def stored(data: bytes) -> None:
    """An encoder that leaves every chunk as it is."""


def unknown(payload: bytes, size: int) -> bytes:
    raise CorruptArchive("a chunk was packed by a kernel that is not given")


def _take(data: bytes, at: int, form: struct.Struct) -> tuple:
    if at + form.size > len(data):
        raise CorruptArchive("the archive ends early")
    return form.unpack_from(data, at)


def write_plain(files: list[tuple[str, list[bytes]]], encode: Encode = stored) -> bytes:
    """An archive of files, each a list of chunks. encode gives a chunk's payload, or None to keep it as it is."""
    lengths = [sum(map(len, chunks)) for _, chunks in files]
    out = [_HEAD.pack(PLAIN, VERSION, len(files), sum(lengths), sum(len(chunks) for _, chunks in files))]
    for (name, _), length in zip(files, lengths):
        raw = check_name(name).encode("utf-8")
        out.append(struct.pack("<I", len(raw)) + raw + struct.pack("<Q", length))
    for data in (c for _, chunks in files for c in chunks):
        payload = encode(data)
        if payload is None or (len(payload) == len(data) + 1 and payload[-1:] == b"\0"):  # the latter would be read as it is
            payload = data + b"\0"
        out.append(_RECORD.pack(len(data), len(payload)) + payload)
    return b"".join(out)


def read_plain(data: bytes, decode: Decode = unknown) -> Iterator[tuple[str, int, bytes]]:
    """(name, chunk, bytes) of an archive."""
    magic, version, n_files, total, n_chunks = _take(data, 0, _HEAD)
    if magic != PLAIN or version not in VERSIONS:
        raise CorruptArchive("this is no plain archive of a known version")
    at, files = _HEAD.size, []
    for _ in range(n_files):
        (size,) = _take(data, at, struct.Struct("<I"))
        name = data[at + 4 : at + 4 + size]
        (length,) = _take(data, at + 4 + size, struct.Struct("<Q"))
        files.append((check_name(name.decode("utf-8", "strict")), length))
        at += 12 + size
    if sum(length for _, length in files) != total:
        raise CorruptArchive("the files do not add up to the archive")
    left, number = list(reversed(files)), 0
    name, rest = left.pop() if left else ("", 0)
    for _ in range(n_chunks):
        raw_len, size = _take(data, at, _RECORD)
        payload = data[at + _RECORD.size : at + _RECORD.size + size]
        at += _RECORD.size + size
        if len(payload) != size:
            raise CorruptArchive("the archive ends early")
        raw = payload[:-1] if size == raw_len + 1 and payload[-1] == 0 else decode(payload, raw_len)
        if len(raw) != raw_len:
            raise CorruptArchive("a chunk has another length than its record says")
        while not rest and left:
            (name, rest), number = left.pop(), 0
        if raw_len > rest:
            raise CorruptArchive("a chunk reaches past its file")
        yield name, number, raw
        rest, number = rest - raw_len, number + 1
    if rest or any(length for _, length in left) or at != len(data):
        raise CorruptArchive("the chunks do not add up to the files")


def write_routed(chunks: list[tuple[int, bytes]], encode: Encode = stored) -> bytes:
    """An archive of one file's chunks, each with its transform's number."""
    out = [_ROUTED_HEAD.pack(ROUTED, sum(len(c) for _, c in chunks), len(chunks))]
    for mode, data in chunks:
        inner = write_plain([("chunk", [transforms.apply(data, MODES[mode])])], encode)
        out.append(_ROUTED_RECORD.pack(mode, len(data), len(inner)) + inner)
    return b"".join(out)


def read_routed(data: bytes, decode: Decode = unknown) -> Iterator[tuple[int, int, bytes]]:
    """(chunk, mode, bytes) of an archive."""
    magic, total, n = _take(data, 0, _ROUTED_HEAD)
    if magic != ROUTED:
        raise CorruptArchive("this is no routed archive")
    at, seen = _ROUTED_HEAD.size, 0
    for number in range(n):
        mode, raw_len, size = _take(data, at, _ROUTED_RECORD)
        inner = data[at + _ROUTED_RECORD.size : at + _ROUTED_RECORD.size + size]
        at += _ROUTED_RECORD.size + size
        if len(inner) != size or mode >= len(MODES):
            raise CorruptArchive("the archive ends early or has an unknown transform")
        made = b"".join(raw for _, _, raw in read_plain(inner, decode))
        if len(made) != raw_len:
            raise CorruptArchive("a chunk has another length than its record says")
        yield number, mode, transforms.undo(made, MODES[mode], raw_len)
        seen += raw_len
    if seen != total or at != len(data):
        raise CorruptArchive("the chunks do not add up to the archive")


# --- as DataFrames -----------------------------------------------------------------------------------

CHUNKS = "archive string, rel string, chunk int, mode int, raw_len long, raw binary"


def archives(chunks: DataFrame, routed: bool = False, encode: Encode = stored) -> DataFrame:
    """(key, archive): one archive for each key of (key, chunk, raw), routed with the chunk's `mode`. A key's chunks meet in
    one row, so this is for inputs that fit in one."""
    mode = F.col("mode") if routed else F.lit(0)
    rows = chunks.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("chunk", mode.alias("mode"), "raw"))).alias("parts"))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                key, parts = str(batch.column(0)[i].as_py()), batch.column(1)[i].as_py()
                made = write_routed([(p["mode"], p["raw"]) for p in parts], encode) if routed else write_plain([(key, [p["raw"] for p in parts])], encode)
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([made], pa.binary())], names=["key", "archive"])

    return rows.select("key", "parts").mapInArrow(run, "key string, archive binary")


def opened(rows: DataFrame, decode: Decode = unknown) -> DataFrame:
    """CHUNKS of (name, content): archives of either layout, told apart by their magic numbers."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                name, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if data[:4] == ROUTED:
                    found = ((name, number, mode, raw) for number, mode, raw in read_routed(data, decode))
                else:
                    found = ((rel, number, 0, raw) for rel, number, raw in read_plain(data, decode))
                for rel, number, mode, raw in found:
                    cells = [pa.array([name]), pa.array([rel]), pa.array([number], pa.int32()), pa.array([mode], pa.int32()), pa.array([len(raw)], pa.int64()), pa.array([raw], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cells, names=["archive", "rel", "chunk", "mode", "raw_len", "raw"])

    return rows.toDF("name", "content").mapInArrow(run, CHUNKS)


def read(spark: SparkSession, path: str, decode: Decode = unknown) -> DataFrame:
    """CHUNKS of the archive files at a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return opened(files.select(F.element_at(F.split("path", "/"), -1), "content"), decode)

