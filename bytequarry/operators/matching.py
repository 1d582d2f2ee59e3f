"""Tokens and match candidates of chunks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bytequarry.functions import batches, lz, matches
from bytequarry.functions.scalar import low_bits_hash
from bytequarry.operators.kernel_map import map_arrays, map_chunks, map_groups


#: Bytes of chunks that are packed together; the tables of a batch take some fifty times as much memory.
PACKED_BYTES = 3 << 19


def tokens(chunks: DataFrame, options: lz.ParseOptions = lz.ParseOptions()) -> DataFrame:
    """(key, chunk, tok_no, at, len, dist): the parsed tokens; dist 0 is a literal."""
    fields = T._parse_datatype_string("tok_no int, at int, len int, dist int")

    def work(raw):
        at, out = 0, []
        for i, (length, distance) in enumerate(lz.parse(bytes(raw), options)):
            out.append((i, at, length, distance))
            at += length
        return out

    return map_chunks(chunks, fields, work, ["raw"], ["key", "chunk"])


def literal_counts(chunks: DataFrame, options: lz.ParseOptions = lz.ParseOptions()) -> DataFrame:
    """(key, chunk, raw_len, tokens, literals)."""
    fields = T._parse_datatype_string("tokens long, literals long")

    def work(raw):
        found = matches.parsed(bytes(raw), options)
        return [(len(found.start) + found.literals, found.literals)]

    return map_chunks(chunks, fields, work, ["raw"], ["key", "chunk", "raw_len"])


def packed(
    chunks: DataFrame, options: lz.ParseOptions = lz.ParseOptions(), verify: bool = True, coding: lz.PackOptions = lz.PackOptions(),
    compete_from: float | None = None,
) -> DataFrame:
    """(key, chunk, raw_len, mode, payload): mode 1 is packed, 0 the bytes as they are."""
    fields = T._parse_datatype_string("mode int, payload binary")

    def work(raws):
        made = batches.pack(raws, options, verify, compete_from, coding)
        return range(len(made)), [m for m, _ in made], [p for _, p in made]

    return map_groups(chunks, fields, work, ["raw"], ["key", "chunk", "raw_len"], PACKED_BYTES)


def unpacked(rows: DataFrame) -> DataFrame:
    """(key, chunk, raw_len, raw) of packed()."""
    work = lambda modes, payloads, sizes: (range(len(modes)), batches.unpack(modes, payloads, sizes))
    return map_groups(rows, T._parse_datatype_string("raw binary"), work, ["mode", "payload", "raw_len"], ["key", "chunk", "raw_len"], PACKED_BYTES, "raw_len")


def packed_with_penalty(chunks: DataFrame, penalty: Column, options: lz.ParseOptions = lz.ParseOptions(), verify: bool = True) -> DataFrame:
    """packed(), each chunk with its own distance penalty (an expression over the columns of chunks), which is kept."""
    fields = T._parse_datatype_string("mode int, payload binary")
    given = chunks.withColumn("penalty", penalty.cast("double"))

    def work(raws, penalties):
        made = batches.pack(raws, options, verify, penalties=penalties)
        return range(len(made)), [m for m, _ in made], [p for _, p in made]

    return map_groups(given, fields, work, ["raw", "penalty"], ["key", "chunk", "raw_len", "penalty"], PACKED_BYTES)


def grams(chunks: DataFrame) -> DataFrame:
    """(key, chunk, pos, gram, slot): the 4-byte little-endian value at every place, and its slot of 2**20. A view for
    analysis: it makes a row of every byte, in time that grows with the bytes."""

    def work(raw):
        found = matches._words(bytes(raw), 4)
        return np.arange(len(found), dtype=np.int32), found.astype(np.int64)

    rows = map_arrays(chunks, T._parse_datatype_string("pos int, gram long"), work, ["key", "chunk"])
    return rows.withColumn("slot", low_bits_hash(F.col("gram")))


def _searched(raws: list[bytes], window: int) -> tuple[matches.Search, np.ndarray, np.ndarray]:
    """The search over chunks together; of every byte its chunk's number, and where each chunk starts."""
    sizes = np.array([len(raw) for raw in raws], np.int64)
    return matches.Search(b"".join(raws), window=window, sizes=sizes), np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes


def match_candidates(chunks: DataFrame, depth: int = 42, window: int = matches.ParseOptions.window) -> DataFrame:
    """(key, chunk, pos, dist, rank): earlier places with the same 4 bytes among the `depth` last ones of the slot.

    A hash chain holds its slot's places in order, so the candidates of a place are those whose number in the slot is at
    most `depth` lower. They lie in the place's own chunk, so nothing is shuffled.
    """

    def work(raws):
        search, chunk, starts = _searched(raws, window)
        at, dist, rank = search.candidates(depth)
        of = chunk[at]
        return of, at - starts[of], dist, rank

    return map_groups(chunks, T._parse_datatype_string("pos int, dist int, rank int"), work, ["raw"], ["key", "chunk"])


def best_candidates(chunks: DataFrame, depth: int, score: Callable[[np.ndarray], np.ndarray], k: int = 2, window: int = matches.ParseOptions.window) -> DataFrame:
    """(key, chunk, pos, dist, score, place): of match_candidates() the k of the highest score at every place, of equal
    scores the nearer. score gives those of an array of distances."""

    def work(raws):
        search, chunk, starts = _searched(raws, window)
        table = score(np.arange(1, max(map(len, raws), default=0) + 1))  # of all distances there can be
        at, dist, place = search.best(depth, k, lambda d: table[d - 1])
        of = chunk[at]
        return of, at - starts[of], dist, table[dist - 1], place

    return map_groups(chunks, T._parse_datatype_string("pos int, dist int, score double, place int"), work, ["raw"], ["key", "chunk"])


def longest_matches(chunks: DataFrame, options: lz.ParseOptions = lz.ParseOptions()) -> DataFrame:
    """(key, chunk, pos, len, dist): at every place the longest match; of equal ones the nearest."""
    def work(raw):
        data = bytes(raw)
        found = matches.Search(data, options.hash_bits, options.window).longest(options.depth)
        at = np.flatnonzero(found.length)
        return at, found.length[at], found.distance[at]

    return map_arrays(chunks, T._parse_datatype_string("pos int, len int, dist int"), work, ["key", "chunk"])


def top_candidates(candidates: DataFrame, score: Column, k: int = 2) -> DataFrame:
    """The k candidates of the highest score at every place; of equal scores the nearer."""
    order = Window.partitionBy("key", "chunk", "pos").orderBy(score.desc(), "dist")
    return candidates.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def prefix_costs(chunks: DataFrame, literal: float, predicted: float | str, stride: int = 1) -> DataFrame:
    """(key, chunk, pos, cost): bits of the first pos + 1 bytes as literals; a range costs the difference of two."""

    def work(raw):
        costs = lz.prefix_costs(bytes(raw), literal, predicted, stride)[1:]
        return np.arange(len(costs)), costs

    return map_arrays(chunks, T._parse_datatype_string("pos int, cost double"), work, ["key", "chunk"])
