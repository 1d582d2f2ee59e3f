"""Benchmark decontamination by Wu-Manber search over words.

Texts and benchmark items are lower-cased (A-Z only) and cut into words of letters, digits and any
non-ASCII character. Every run of 13 consecutive item words is a pattern; an item with fewer words is one
pattern of its own length. Patterns of one length share a searcher: the shift table is keyed by blocks of
two words, so a text position is looked at about once in twelve words; blocks that end a pattern lead to a
bucket, split by the pattern's first block, whose members are compared directly.

The benchmark reaches the executors in blocks of at most WINDOWS_PER_BLOCK patterns, so what is broadcast
has a fixed bound however large the benchmark is. One block is one pass over the texts. Of several, each reads the texts
and gives the spans and items of those that have any; these are sent to the texts' rows once, when all blocks are through.

Defined cases: a null text or item has no words; a text without words is never contaminated; items without
words never occur; an item that is repeated counts once by its id; items without an id mark words but are
not reported; texts are searched whole, whatever their length; empty tables give empty tables, or texts without hits; new
columns get other names where the table has them already.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bytequarry.llm.common import column_bytes, fresh_name, materialize

WINDOW = 13
WINDOWS_PER_BLOCK = 200_000

_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def split_words(text: bytes | None) -> list[bytes]:
    return text.translate(_WORD_BYTES).split() if text else []


class WuManber:
    """Finds all occurrences of word patterns that have the same length."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], tuple[str, ...]]):
        self.length, self.block = length, min(2, length)
        self.default = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list[tuple[tuple[bytes, ...], tuple[str, ...]]]]] = {}
        b = self.block
        for words, items in patterns.items():
            for end in range(b, length + 1):
                key = words[end - b : end]
                self.shift[key] = min(length - end, self.shift.get(key, self.default))
            self.buckets.setdefault(words[-b:], {}).setdefault(words[:b], []).append((words, items))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, tuple[str, ...]]]:
        """(first word, items) of each occurrence, from left to right."""
        length, b, n, default = self.length, self.block, len(words), self.default
        shift, at = self.shift.get, length - 1
        while at < n:
            step = shift((words[at - 1], words[at]) if b == 2 else (words[at],), default)
            if step:
                at += step
                continue
            start = at - length + 1
            for pattern, items in self.buckets[tuple(words[at - b + 1 : at + 1])].get(tuple(words[start : start + b]), ()):
                if pattern == tuple(words[start : at + 1]):
                    yield start, items
            at += 1


def searchers(items: list[tuple[str | None, list[bytes]]], window: int = WINDOW) -> list[WuManber]:
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
    for item, words in items:
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            found = by_length.setdefault(size, {}).setdefault(tuple(words[i : i + size]), set())
            if item is not None:
                found.add(item)
    return [WuManber(n, {w: tuple(sorted(s)) for w, s in found.items()}) for n, found in sorted(by_length.items())]


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, most: int) -> Iterator[list]:
    """The benchmark's items in blocks of at most `most` windows; an item of more windows is cut into
    overlapping parts that have the same windows together."""
    block, held = [], 0
    rows = benchmark.select(F.col(id_col).cast("string"), F.col(text_col).cast("string"))
    for item, text in rows.toLocalIterator():
        words = split_words(text.encode() if text else None)
        for start in range(0, max(1, len(words) - window + 1), most):
            part = words[start : start + most + window - 1]
            count = max(1, len(part) - window + 1)
            if block and held + count > most:
                yield block
                block, held = [], 0
            if part:
                block.append((item, part))
                held += count
    if block:
        yield block


#: The searchers of the block that this worker process has built, by pass.
_built: dict[str, list[WuManber]] = {}


def built_searchers(key: str, items: list, window: int) -> list[WuManber]:
    if key not in _built:
        _built.clear()
        _built[key] = searchers(items, window)
    return _built[key]


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    windows_per_block: int = WINDOWS_PER_BLOCK,
) -> tuple[DataFrame, dict[str, str]]:
    """docs with four more columns; also the names they got, as docs may already have such names.

    n_words long; n_hit long (words inside an occurrence); hit_spans array of (first, last) word numbers;
    items array of the ids, as strings, sorted, whose windows occur.
    """
    spark = docs.sparkSession
    names = {n: fresh_name(docs, n) for n in ("n_words", "n_hit", "hit_spans", "items")}
    span = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))
    out = T.StructType(
        [
            *docs.schema.fields, T.StructField(names["n_words"], T.LongType()), T.StructField(names["n_hit"], T.LongType()),
            T.StructField(names["hit_spans"], span), T.StructField(names["items"], T.ArrayType(T.StringType())),
        ]
    )
    at = docs.columns.index(text_col)
    blocks = item_blocks(benchmark, item_id_col, item_text_col, window, windows_per_block)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        sent, key = spark.sparkContext.broadcast(first), uuid.uuid4().hex

        def whole(batches):
            using = built_searchers(key, sent.value, window)
            for part, texts in _slices(batches, at):
                words = [split_words(t) for t in texts]
                yield _with_hits(part.columns, out.names, words, [occurrences(w, using) for w in words])

        return docs.mapInArrow(whole, out), names
    row = fresh_name(docs, "decontamination_row")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "decontamination")
    some = numbered.select(row, F.col(f"`{text_col}`"))
    found = None
    for block in (b for group in ([first, second], blocks) for b in group):
        part = _hits_of(some, spark.sparkContext.broadcast(block), window)
        found = part if found is None else found.unionByName(part)
    merged = found.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    taken = [fresh_name(numbered, f"bq_{c}") for c in ("spans", "items")]
    joined = numbered.join(merged.toDF(row, *taken), row, "left").drop(row)

    def told(batches):
        for part, texts in _slices(batches, at):
            spans, items = (part.column(part.num_columns - k).to_pylist() for k in (2, 1))
            hits = [([(s["first"], s["last"]) for s in a or ()], set(b or ())) for a, b in zip(spans, items)]
            yield _with_hits(part.columns[:-2], out.names, [split_words(t) for t in texts], hits)

    return joined.mapInArrow(told, out), names


def _slices(batches, at: int):
    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            part = batch.slice(start, 1024)
            yield part, column_bytes(part.column(at))


def occurrences(words: list[bytes], using: list[WuManber]) -> tuple[list[tuple[int, int]], set[str]]:
    """(first, last) words of the occurrences, and the items that occur."""
    spans, items = [], set()
    for searcher in using:
        for start, ids in searcher.search(words):
            spans.append((start, start + searcher.length - 1))
            items.update(ids)
    return spans, items


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _with_hits(columns, names, words: list[list[bytes]], hits: list[tuple[list[tuple[int, int]], set[str]]]) -> pa.RecordBatch:
    """The columns with n_words, n_hit, hit_spans (merged) and items."""
    sizes, spans, items = [], [], []
    for own, (found, ids) in zip(words, hits):
        mask = np.zeros(len(own) + 1 if found else 0, np.int64)
        for first, last in found:
            mask[first] += 1
            mask[last + 1] -= 1
        inside = np.concatenate([[0], np.cumsum(mask) > 0, [0]]).astype(np.int8)
        edges = np.flatnonzero(np.diff(inside))
        sizes.append(int(inside.sum()))
        spans.append([{"first": int(a), "last": int(b) - 1} for a, b in zip(edges[::2], edges[1::2])])
        items.append(sorted(ids))
    made = [pa.array([len(w) for w in words], pa.int64()), pa.array(sizes, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays([*columns, *made], names=names)


def _hits_of(rows: DataFrame, sent, window: int) -> DataFrame:
    """(row, spans, items) of the rows (number, text) in which a window of the block occurs."""
    key, names = uuid.uuid4().hex, ["row", "spans", "items"]

    def run(batches):
        using = built_searchers(key, sent.value, window)
        for part, texts in _slices(batches, 1):
            numbers, spans, items = [], [], []
            for number, text in zip(part.column(0).to_pylist(), texts):
                found, ids = occurrences(split_words(text), using)
                if found:
                    numbers.append(number), spans.append([{"first": a, "last": b} for a, b in found]), items.append(sorted(ids))
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))], names=names)

    return rows.mapInArrow(run, "row long, spans array<struct<first: long, last: long>>, items array<string>")


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least a twentieth of the words lie inside occurrences."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs without the contaminated ones, with the columns of docs."""
    found, names = contamination(docs, benchmark, text_col, **options)
    clean = found.where(~is_contaminated(F.col(f"`{names['n_hit']}`"), F.col(f"`{names['n_words']}`")))
    return clean.select([F.col(f"`{c}`") for c in docs.columns])
