"""Near-duplicate groups by SimHash with bit-sliced distance search.

Fingerprint: A-Z are lower-cased, words are runs other than spaces and \\x09-\\x0D, shingles are the runs of
SHINGLE words joined by one space (repeats count; fewer words: the whole sequence). Each shingle is hashed by
XXH64 with seed 42; a bit is 1 if it is set in over half of the hashes.

Candidates: rows with equal fingerprints fold into one before anything else. The 64 bits are cut into RADIUS + 2
blocks; two fingerprints within the radius agree in two blocks at least, so every pair of blocks gives one key of
25 or 26 bits and no pair is lost. A key's fingerprints are compared within one task in vertical layout: one
integer for each bit plane, one lane for each fingerprint; carry-save counters add the differing planes to all
distances at once, and a comparison stops when every lane has passed the radius. A fingerprint that is linked
leaves the set of those still to be reached, so a bucket costs no more than its links need and gives a spanning
forest, not all pairs. Buckets with over SPLIT_ROWS fingerprints are cut into groups, and every pair of groups
is a bucket of its own.

Components: alternating large-star and small-star steps over the forest's edges, as joins and aggregations; each
round's edges are written to the shared folder. A fingerprint of many rows (empty texts, mass copies), a group of many
fingerprints and the centre of a large star are dealt out over tasks when they are joined.

Defined cases: a null or empty text and one without words has fingerprint zero and is linked like any other; a
row without an id takes part in its group but never names it; a group whose rows all lack ids has a null
component id; repeated rows share a component; texts are read whole, whatever their length; an empty table gives an empty
table; the result has its own columns, so names of other columns cannot clash, and keep_one_of_each has those of the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bytequarry.llm.common import append_columns, drop_table, fresh_name, join_hot, materialize

SHINGLE, RADIUS, SEED, BITS = 3, 3, 42, 64
SPLIT_ROWS = 8192

_WEIGHTS = (np.uint64(1) << np.arange(BITS, dtype=np.uint64))


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    words = text.lower().split() if text else []
    n = len(words)
    if not n:
        return 0
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        return digest(b" ".join(words), SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n)) + np.arange(n)
    joined = b" ".join(words)
    starts = [0, *(ends[: n - shingle] + 1).tolist()]
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())], "<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(_WEIGHTS[2 * ones > len(hashes)].sum())


def with_fingerprint(docs: DataFrame, text_col: str, name: str, shingle: int = SHINGLE) -> DataFrame:
    """docs with the fingerprint as a long (the 64 bits, signed)."""

    def make():
        return lambda texts: [pa.array(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))]

    return append_columns(docs, text_col, [(name, T.LongType())], make)


def fingerprint_hex(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# --- bit-sliced comparison ---------------------------------------------------------------------------


class BitPlanes:
    """Fingerprints in vertical layout: plane b holds bit b of lane i at its bit i."""

    def __init__(self, fps: list[int], bits: list[int]):
        self.n, self.bits = len(fps), bits
        if self.n < 128:
            self.planes = [sum(((fp >> b) & 1) << i for i, fp in enumerate(fps)) for b in bits]
        else:
            unpacked = np.unpackbits(np.array(fps, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            columns = np.packbits(unpacked.T, axis=1, bitorder="little")
            self.planes = [int.from_bytes(columns[b].tobytes(), "little") for b in bits]

    def within(self, fp: int, lanes: int, radius: int) -> int:
        """Of the lanes, those at a distance of at most `radius` from fp, as a bit mask."""
        width = radius.bit_length()
        full, counters, alive = (1 << self.n) - 1, [0] * width, lanes
        for plane, b in zip(self.planes, self.bits):
            carry = (plane ^ full if fp >> b & 1 else plane) & alive
            for k in range(width):
                if not carry:
                    break
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            if carry:  # past the counters' range
                alive &= ~carry
                if not alive:
                    return 0
        if radius + 1 != 1 << width:
            over, equal = 0, alive
            for k in reversed(range(width)):
                if radius >> k & 1:
                    equal &= counters[k]
                else:
                    over |= equal & counters[k]
                    equal &= ~counters[k]
            alive &= ~over
        return alive


def forest(fps: list[int], bits: list[int], radius: int, other: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that connect whatever distances within the radius connect: at most one per fingerprint.

    With `other`, only distances between the two lists count.
    """
    if other is not None:
        return _bipartite(fps, other, bits, radius)
    planes, todo, links = BitPlanes(fps, bits), (1 << len(fps)) - 1, []
    while todo:
        lead = todo & -todo
        todo ^= lead
        first = lead.bit_length() - 1
        queue = [first]
        while queue and todo:
            hits = planes.within(fps[queue.pop()], todo, radius)
            todo ^= hits
            while hits:
                low = hits & -hits
                hits ^= low
                at = low.bit_length() - 1
                links.append((fps[first], fps[at]))
                queue.append(at)
    return links


def _bipartite(left: list[int], right: list[int], bits: list[int], radius: int) -> list[tuple[int, int]]:
    planes = {0: BitPlanes(left, bits), 1: BitPlanes(right, bits)}
    lists, todo, links = {0: left, 1: right}, {0: (1 << len(left)) - 1, 1: (1 << len(right)) - 1}, []
    while todo[0]:
        lead = todo[0] & -todo[0]
        todo[0] ^= lead
        first = lead.bit_length() - 1
        queue = [(0, first)]
        while queue:
            side, at = queue.pop()
            hits = planes[1 - side].within(lists[side][at], todo[1 - side], radius)
            todo[1 - side] ^= hits
            while hits:
                low = hits & -hits
                hits ^= low
                to = low.bit_length() - 1
                links.append((left[first], lists[1 - side][to]))
                queue.append((1 - side, to))
    return links


def block_keys(radius: int) -> list[tuple[int, int]]:
    """(mask, blocks' number) of each key: all bits of two of radius + 2 blocks."""
    edges = np.linspace(0, BITS, radius + 3).astype(int).tolist()
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [(a | b, i) for i, (a, b) in enumerate(combinations(blocks, 2))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[int], list[int]]]:
    """(key, sides, fingerprints) of each run of equal keys, across batches sorted by key."""
    key, sides, fps = None, [], []
    for batch in batches:
        cols = [c.to_numpy() for c in batch.columns]
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for c in cols[:n_keys]:
            change[1:] |= c[1:] != c[:-1]
        starts = [*np.flatnonzero(change).tolist(), batch.num_rows]
        side, values = cols[n_keys].tolist(), cols[n_keys + 1].view(np.uint64).tolist()
        heads = list(zip(*(c[starts[:-1]].tolist() for c in cols[:n_keys])))
        for head, a, b in zip(heads, starts, starts[1:]):
            if head != key:
                if len(fps) > 1:
                    yield key, sides, fps
                key, sides, fps = head, [], []
            sides += side[a:b]
            fps += values[a:b]
    if len(fps) > 1:
        yield key, sides, fps


def _links_of(keyed: DataFrame, radius: int) -> DataFrame:
    """Links of each bucket of (which, key, a, b, side, fp): rows of one bucket meet in one task, sorted."""
    masks = [m for m, _ in block_keys(radius)]

    def run(batches):
        u, v = [], []
        for (which, *_), sides, fps in _runs(batches, 4):
            free = [b for b in range(BITS) if not masks[which] >> b & 1]  # the key's own bits are equal
            if any(sides):
                left = [f for s, f in zip(sides, fps) if not s]
                links = forest(left, free, radius, [f for s, f in zip(sides, fps) if s])
            else:
                links = forest(fps, free, radius)
            for a, b in links:
                u.append(_signed(a)), v.append(_signed(b))
            if len(u) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
                u, v = [], []
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    bucket = ["which", "key", "a", "b"]
    return (
        keyed.repartition(*bucket).sortWithinPartitions(*bucket).select(*bucket, "side", "fp").mapInArrow(run, "u long, v long")
    )


def links(distinct: DataFrame, radius: int = RADIUS, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """(u, v): links between the fingerprints of `distinct` (one column, fp) that span each group."""
    keys = block_keys(radius)
    keyed = distinct.select(
        "fp",
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("which"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for m, i in keys])
        ).alias("k"),
    ).select("k.which", "k.key", "fp")
    # only buckets that are split need to be told: at most one for each split_rows keys there are
    split = keyed.groupBy("which", "key").agg(F.ceil(F.count(F.lit(1)) / split_rows).cast("int").alias("groups")).where("groups > 1")
    keyed = keyed.join(F.broadcast(split), ["which", "key"], "left").withColumn("groups", F.coalesce("groups", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("groups").cast("long")).cast("int")
    paired = F.transform(
        F.sequence(F.lit(0), F.col("groups") - 1),
        lambda other: F.struct(
            F.least(F.col("own"), other).alias("a"),
            F.greatest(F.col("own"), other).alias("b"),
            (F.col("own") > other).cast("int").alias("side"),
        ),
    )
    keyed = keyed.withColumn("own", own).withColumn("p", F.explode(paired)).select("which", "key", "p.a", "p.b", "p.side", "fp")
    return _links_of(keyed, radius)


# --- components --------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (u, v), root being the component's least node. Rounds go on until the edges
    stay the same; their number grows with the logarithm of the nodes."""
    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_hot(both, least, "u", "n").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # after the large star, every edge goes from a node to a smaller one
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_hot(large, low, "u", "n")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        new = materialize(small.distinct(), "edges")
        drop_table(edges)
        edges = new
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def _grouped(prints: DataFrame, least: F.Column, radius: int, split_rows: int) -> DataFrame:
    """(fp, n, least, root) of every fingerprint of prints: its rows, an aggregate of them, and the name of its group."""
    distinct = prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), least.alias("least"))
    nodes = components(links(distinct.select("fp"), radius, split_rows))
    return distinct.join(nodes, distinct["fp"] == nodes["node"], "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", radius: int = RADIUS, shingle: int = SHINGLE,
    split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """(id, fp long, component_id) for every row; component_id is the least id of the row's group.

    `id` has the type of id_col.
    """
    text = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    prints = materialize(with_fingerprint(text, "text", "fp", shingle).select("id", "fp"), "fingerprints")
    grouped = materialize(_grouped(prints, F.min("id"), radius, split_rows), "groups")
    named = grouped.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("fps"))
    labelled = join_hot(grouped.select("fp", "n", "root"), named, "root", "fps").select("fp", "n", "component_id")
    return join_hot(prints, labelled, "fp", "n").select("id", "fp", "component_id")


def keep_one_of_each(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", radius: int = RADIUS, shingle: int = SHINGLE,
    split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """docs with one row of every group: the one with the least id, null ids last; of rows that share it, the first.

    Groups and rows count, not ids: rows are numbered in a written table, so that null ids and ids of several texts
    neither merge groups nor keep a group twice.
    """
    row = fresh_name(docs, "simhash_row")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered-texts")
    text = numbered.select(F.col(f"`{id_col}`").alias("id"), F.col(row).alias("row"), F.col(f"`{text_col}`").alias("text"))
    prints = materialize(with_fingerprint(text, "text", "fp", shingle).select("id", "row", "fp"), "fingerprints")
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "row"))
    grouped = _grouped(prints, first, radius, split_rows)
    lead = grouped.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.row").alias(row))
    # the texts are shuffled once, by their row's number; the leads grow with the texts, so they are not broadcast at any size
    return numbered.join(lead.hint("merge"), row, "left_semi").select([F.col(f"`{c}`") for c in docs.columns])
