r"""Reversible line deduplication: sharded cuckoo filters backed by exact reference counts.

A text is split at \n. A line's key is the line without spaces and \x09-\x0D at both ends, A-Z lower-cased.
The index holds, as 128-bit hashes:

* references: for every key the exact number of documents that have it, and for every text how often it was inserted;
* filters: for every shard a cuckoo filter with the keys that reached the threshold.

References are a list of tables whose counts add up. Inserting or deleting documents writes one more table, of the size of
the change (after MAX_TABLES they are summed into one); the tables before are read for the changed keys' counts, but neither
written nor shuffled, as long as the change has at most FEW_KEYS keys. Keys that cross the threshold enter or leave their
shard's filter; other shards' filters stay as they are. So a deletion undoes an insertion. Texts that the index does not hold
(or not so often) cannot be deleted: ValueError, and the index is as before.

Dropping lines probes the filters. A filter can also hit a key below the threshold; the references tell exactly which
indexed keys those are (about one in 5e8), and these exceptions go along. While filters stay under MAX_BROADCAST_BYTES and
exceptions under MAX_EXCEPTIONS they are broadcast and the texts are never shuffled; beyond it, the lines' keys are sent to
the filters' shards, each shard's lines in groups of GROUP_ROWS or so however hot a line is, and the numbers of the lines
that are dropped are sent back to the texts. Both probe the same filters and give the same rows.

Defined cases: a null or empty text is one empty line; empty keys are never dropped unless min_chars is 0;
a document counts once for a key however often it has the line; rows that repeat count as documents of
their own; a text that loses all lines becomes the empty string; texts are read whole, whatever their length; an empty table
gives empty tables; new columns get other names where the table has them already. Results that are not yet written when the
index changes follow the index before or after the change; write them first.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bytequarry.llm.common import append_columns, column_bytes, drop_table, fresh_name, materialize

MIN_DOCS, MIN_CHARS = 10, 1
KEYS_PER_SHARD = 1 << 16
MAX_BROADCAST_BYTES, MAX_EXCEPTIONS = 64 << 20, 100_000
MAX_TABLES, FEW_KEYS, GROUP_ROWS = 8, 200_000, 500_000

_SPACE = b" \t\n\x0b\x0c\r"
KEYS = T.StructType([T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType())])
LINE, TEXT = 0, 1
KINDS = T.StructType([T.StructField("kind", T.IntegerType()), *KEYS.fields])
FILTERS = T.StructType(
    [T.StructField("shard", T.LongType()), T.StructField("buckets", T.LongType()), T.StructField("slots", T.BinaryType())]
)


def split_lines(text: bytes | None) -> list[bytes]:
    return text.split(b"\n") if text else [b""]


def line_keys(lines: list[bytes], min_chars: int = MIN_CHARS) -> list[bytes | None]:
    """128-bit keys; None for a line whose key is too short."""
    digest = xxhash.xxh3_128_digest
    out = []
    for line in lines:
        key = line.strip(_SPACE).lower()
        # UTF-8 needs decoding only if the byte count leaves the number of code points open
        short = len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars)
        out.append(None if short else digest(key))
    return out


def as_longs(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)


# --- cuckoo filter -----------------------------------------------------------------------------------

SLOTS = 4
MAX_KICKS = 500


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def fingerprints(k2: np.ndarray) -> np.ndarray:
    """32-bit fingerprints; 0 marks a free slot."""
    fp = (_mixed(k2.astype(np.int64).view(np.uint64)) >> np.uint64(32)).astype(np.uint32)
    return np.where(fp == 0, np.uint32(1), fp)


def places(k1: np.ndarray, fp: np.ndarray, buckets) -> tuple[np.ndarray, np.ndarray]:
    """The two buckets of each key; either is the other xor a hash of the fingerprint."""
    mask = np.asarray(buckets, np.uint64) - np.uint64(1)
    first = _mixed(k1.astype(np.int64).view(np.uint64)) & mask
    return first.astype(np.int64), (first ^ (_mixed(fp) & mask)).astype(np.int64)


class CuckooFilter:
    """Four slots a bucket; supports deletion. It doubles, from the exact keys, when an insertion fails."""

    def __init__(self, buckets: int, slots: np.ndarray | None = None):
        self.buckets = buckets
        self.slots = np.zeros((buckets, SLOTS), np.uint32) if slots is None else slots

    @classmethod
    def sized(cls, n: int) -> CuckooFilter:
        return cls(1 << max(2, int(np.ceil(np.log2(max(1, n / (SLOTS * 0.84)))))))

    def _put(self, at: int, fp: int) -> bool:
        row = self.slots[at]
        for s in range(SLOTS):
            if row[s] == 0:
                row[s] = fp
                return True
        return False

    def insert(self, keys: np.ndarray) -> bool:
        """False if some key found no place; the filter must then be built anew, larger."""
        fps = fingerprints(keys[:, 1])
        first, second = places(keys[:, 0], fps, self.buckets)
        mask = self.buckets - 1
        for a, b, fp in zip(first.tolist(), second.tolist(), fps.tolist()):
            if self._put(a, fp) or self._put(b, fp):
                continue
            at = b
            for kick in range(MAX_KICKS):
                out = int(self.slots[at, kick % SLOTS])
                self.slots[at, kick % SLOTS] = fp
                fp = out
                at ^= int(_mixed(np.array([fp], np.uint32))[0]) & mask
                if self._put(at, fp):
                    break
            else:
                return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        """Takes one copy of each key's fingerprint out; the keys must be in the filter."""
        fps = fingerprints(keys[:, 1])
        for a, b, fp in zip(*(x.tolist() for x in (*places(keys[:, 0], fps, self.buckets), fps))):
            for at in (a, b):
                found = np.flatnonzero(self.slots[at] == fp)
                if len(found):
                    self.slots[at, found[0]] = 0
                    break

    def contains(self, keys: np.ndarray) -> np.ndarray:
        fps = fingerprints(keys[:, 1])
        a, b = places(keys[:, 0], fps, self.buckets)
        return ((self.slots[a] == fps[:, None]) | (self.slots[b] == fps[:, None])).any(axis=1)


def build_filter(keys: np.ndarray) -> CuckooFilter:
    made = CuckooFilter.sized(len(keys))
    while not made.insert(keys):
        made = CuckooFilter(2 * made.buckets)
    return made


class ShardedFilter:
    """All shards' filters, probed together: one array, with an offset and a bucket count for each shard."""

    def __init__(self, rows: list[tuple[int, int, bytes]], n_shards: int):
        self.n_shards = n_shards
        self.buckets, self.offset = np.ones(n_shards, np.int64), np.zeros(n_shards, np.int64)
        parts, at = [np.zeros((1, SLOTS), np.uint32)], 1  # a shard without keys looks at an empty bucket
        for shard, buckets, slots in rows:
            self.buckets[shard], self.offset[shard] = buckets, at
            parts.append(np.frombuffer(slots, np.uint32).reshape(-1, SLOTS))
            at += buckets
        self.slots = np.concatenate(parts)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        shard = np.mod(keys[:, 0], self.n_shards)
        fps = fingerprints(keys[:, 1])
        a, b = places(keys[:, 0], fps, self.buckets[shard])
        off = self.offset[shard]
        return ((self.slots[a + off] == fps[:, None]) | (self.slots[b + off] == fps[:, None])).any(axis=1)


_held: dict[str, tuple] = {}


def held_filter(key: str, sent) -> tuple[ShardedFilter, set[tuple[int, int]]]:
    """The broadcast filters and exceptions, put together once for each worker process."""
    if key not in _held:
        _held.clear()
        rows, n_shards, exceptions = sent.value
        _held[key] = (ShardedFilter(rows, n_shards), set(map(tuple, exceptions)))
    return _held[key]


# --- index -------------------------------------------------------------------------------------------


def key_counts(docs: DataFrame, text_col: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """(kind, k1, k2, refs): in how many rows of docs each key occurs, and how often each whole text."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                keys: list[bytes] = []
                texts = column_bytes(batch.column(0).slice(at, 1024))
                for text in texts:
                    if text:
                        keys += {k for k in line_keys(text.split(b"\n"), min_chars) if k}
                    elif not min_chars:
                        keys += line_keys([b""], 0)
                kinds = np.repeat(np.array([LINE, TEXT], np.int32), [len(keys), len(texts)])
                k = as_longs(keys + [xxhash.xxh3_128_digest(t or b"") for t in texts])
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(k[:, 0]), pa.array(k[:, 1])], names=KINDS.names)

    text = F.col(f"`{text_col}`").alias("text")
    return docs.select(text).mapInArrow(run, KINDS).groupBy("kind", "k1", "k2").agg(F.count(F.lit(1)).alias("refs"))


class LineIndex:
    """Reference counts and filters of the lines of a set of documents."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS):
        if min_docs < 1 or min_chars < 0:
            raise ValueError("min_docs must be at least 1 and min_chars at least 0")
        self.spark, self.min_docs, self.min_chars = spark, min_docs, min_chars
        self.tables: list[DataFrame] = []
        self.filters = spark.createDataFrame([], FILTERS)
        self.n_shards = self.n_frequent = 0

    @property
    def references(self) -> DataFrame:
        """(k1, k2, refs) of every key that a document has."""
        return self._sums(self.tables).where(F.col("kind") == LINE).select("k1", "k2", "refs")

    def _sums(self, tables: list[DataFrame]) -> DataFrame:
        if not tables:
            return self.spark.createDataFrame([], KINDS.add("refs", "long"))
        if len(tables) == 1:
            return tables[0].where("refs > 0")
        every = tables[0]
        for table in tables[1:]:
            every = every.unionByName(table)
        return every.groupBy("kind", "k1", "k2").agg(F.sum("refs").alias("refs")).where("refs > 0")

    def insert(self, docs: DataFrame, text_col: str = "text") -> LineIndex:
        return self._update(docs, text_col, 1)

    def delete(self, docs: DataFrame, text_col: str = "text") -> LineIndex:
        """Undoes the insertion of rows with these texts."""
        return self._update(docs, text_col, -1)

    def _update(self, docs: DataFrame, text_col: str, sign: int) -> LineIndex:
        counts = materialize(key_counts(docs, text_col, self.min_chars), "line-references")
        by = ["kind", "k1", "k2"]
        if self.tables or sign < 0:
            n = counts.count()
            changed = F.broadcast(counts.select(by)) if n <= FEW_KEYS else counts.select(by)
            before = self._sums([t.join(changed, by, "left_semi") for t in self.tables]).withColumnRenamed("refs", "old")
            new = counts.join(before, by, "left").select(*by, (sign * F.col("refs")).alias("refs"), F.coalesce("old", F.lit(0)).alias("old"))
            new = materialize(new, "line-references")
            drop_table(counts)
            if sign < 0 and not new.where("refs + old < 0").isEmpty():
                drop_table(new)
                raise ValueError("texts that the index does not hold cannot be deleted")
        else:
            new = counts.withColumn("old", F.lit(0).cast("long"))
        self.tables.append(new.drop("old"))
        reached, was = F.col("refs") + F.col("old") >= self.min_docs, F.col("old") >= self.min_docs
        crossing = new.where((F.col("kind") == LINE) & (reached != was)).select("k1", "k2", F.when(reached, 1).otherwise(-1).alias("step"))
        self.n_frequent += crossing.agg(F.sum("step")).first()[0] or 0
        if len(self.tables) > MAX_TABLES:
            self.tables = [materialize(self._sums(self.tables), "line-references")]
        if not self.n_shards or self.n_frequent > 2 * KEYS_PER_SHARD * self.n_shards:
            self.n_shards = 1 << max(0, self.n_frequent // KEYS_PER_SHARD).bit_length()
            self.filters = materialize(self._built(None), "line-filters")
        elif not crossing.isEmpty():
            self._cross(crossing)
        return self

    def _shard(self, *more: str) -> list:
        return [F.pmod("k1", F.lit(self.n_shards)).alias("shard"), "k1", "k2", *more]

    def _built(self, shards: DataFrame | None) -> DataFrame:
        """Filters from the exact references, of all shards or of these."""

        def build(rows: pd.DataFrame) -> pd.DataFrame:
            made = build_filter(rows[["k1", "k2"]].to_numpy(np.int64))
            return pd.DataFrame([(rows["shard"].iloc[0], made.buckets, made.slots.tobytes())], columns=FILTERS.names)

        keys = self.references.where(F.col("refs") >= self.min_docs).select(*self._shard())
        if shards is not None:
            keys = keys.join(F.broadcast(shards), "shard", "left_semi")  # at most n_shards rows
        return keys.groupBy("shard").applyInPandas(build, FILTERS)

    def _cross(self, crossing: DataFrame) -> None:
        """Puts keys into their shards' filters or takes them out. A filter that is full is built anew, larger."""

        def merge(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
            number, keys = new["shard"].iloc[0], new[["k1", "k2"]].to_numpy(np.int64)
            gone, come = keys[new["step"].to_numpy() < 0], keys[new["step"].to_numpy() > 0]
            if not len(old):
                made = build_filter(come)
            else:
                slots = np.frombuffer(old["slots"].iloc[0], np.uint32).reshape(-1, SLOTS).copy()
                made = CuckooFilter(int(old["buckets"].iloc[0]), slots)
                made.delete(gone)
                if not made.insert(come):
                    return pd.DataFrame([(number, 0, None)], columns=FILTERS.names)
            return pd.DataFrame([(number, made.buckets, made.slots.tobytes())], columns=FILTERS.names)

        changes = crossing.select(*self._shard("step"))
        touched = materialize(changes.select("shard").distinct(), "line-shards")
        some = self.filters.join(F.broadcast(touched), "shard", "left_semi")  # at most n_shards rows
        made = materialize(some.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(merge, FILTERS), "line-filters")
        out = self.filters.join(F.broadcast(touched), "shard", "left_anti").unionByName(made.where("slots IS NOT NULL"))
        full = made.where("slots IS NULL").select("shard")
        if not full.isEmpty():
            out = out.unionByName(self._built(full))
        self.filters = materialize(out, "line-filters")

    def filter_bytes(self) -> int:
        return self.filters.agg(F.sum(F.length("slots"))).first()[0] or 0

    def exceptions(self, sent, key: str) -> DataFrame:
        """Indexed keys below the threshold that the filters, broadcast, hit all the same."""

        def run(batches):
            probe, _ = held_filter(key, sent)
            for batch in batches:
                k = np.column_stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
                hit = k[probe.contains(k)] if len(k) else k
                yield pa.RecordBatch.from_arrays([pa.array(hit[:, 0]), pa.array(hit[:, 1])], names=["k1", "k2"])

        return self.references.where(F.col("refs") < self.min_docs).select("k1", "k2").mapInArrow(run, KEYS)

    def _hits(self, rows: DataFrame) -> DataFrame:
        """The rows (k1, k2, ...) whose keys their shard's filter hits. A shard's rows meet its filter in groups."""
        placed = rows.withColumn("shard", F.pmod("k1", F.lit(self.n_shards)))
        sizes = placed.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / GROUP_ROWS).cast("int").alias("groups"))
        sizes = materialize(sizes, "line-groups")  # at most n_shards rows
        placed = placed.join(F.broadcast(sizes), "shard")
        others = [c for c in rows.columns if c not in ("k1", "k2")]
        salt = F.pmod(F.xxhash64(*(others or ["k1", "k2"])), F.col("groups").cast("long")).cast("int")
        placed = placed.select("shard", salt.alias("salt"), *rows.columns)
        filters = self.filters.join(F.broadcast(sizes), "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("salt"), "buckets", "slots")
        names = list(rows.columns)

        def probe(own: pd.DataFrame, lines: pd.DataFrame) -> pd.DataFrame:
            if not len(own) or not len(lines):
                return lines[names].iloc[:0]
            made = CuckooFilter(int(own["buckets"].iloc[0]), np.frombuffer(own["slots"].iloc[0], np.uint32).reshape(-1, SLOTS))
            return lines[names][made.contains(lines[["k1", "k2"]].to_numpy(np.int64))]

        return filters.groupBy("shard", "salt").cogroup(placed.groupBy("shard", "salt")).applyInPandas(probe, rows.schema)

    def drop_lines(
        self, docs: DataFrame, text_col: str = "text", max_broadcast_bytes: int = MAX_BROADCAST_BYTES
    ) -> tuple[DataFrame, dict[str, str]]:
        """docs, which must have been inserted, with n_lines, n_dropped and kept; also the names these got."""
        names = {n: fresh_name(docs, n) for n in ("n_lines", "n_dropped", "kept")}
        fields = [(names["n_lines"], T.LongType()), (names["n_dropped"], T.LongType()), (names["kept"], T.StringType())]
        if self.filter_bytes() > max_broadcast_bytes:
            return self._drop_by_shard(docs, text_col, names), names
        rows = [tuple(r) for r in self.filters.collect()]
        sc = self.spark.sparkContext
        probing = sc.broadcast((rows, self.n_shards or 1, []))
        odd = [tuple(r) for r in self.exceptions(probing, uuid.uuid4().hex).limit(MAX_EXCEPTIONS + 1).collect()]
        if len(odd) > MAX_EXCEPTIONS:
            return self._drop_by_shard(docs, text_col, names), names
        sent = sc.broadcast((rows, self.n_shards or 1, odd))
        key, min_chars = uuid.uuid4().hex, self.min_chars

        def make():
            probe, exceptions = held_filter(key, sent)

            def work(texts):
                lines = [split_lines(t) for t in texts]
                keys = [line_keys(x, min_chars) for x in lines]
                flat = [k for ks in keys for k in ks if k]
                known = as_longs(flat)
                hit = probe.contains(known) if len(known) else np.zeros(0, bool)
                if exceptions:
                    for i in np.flatnonzero(hit):
                        hit[i] = tuple(known[i].tolist()) not in exceptions
                frequent = {flat[i] for i in np.flatnonzero(hit)}
                kept = [
                    x if frequent.isdisjoint(ks) else [a for a, k in zip(x, ks) if k not in frequent]
                    for x, ks in zip(lines, keys)
                ]
                return [
                    pa.array([len(x) for x in lines], pa.int64()),
                    pa.array([len(x) - len(y) for x, y in zip(lines, kept)], pa.int64()),
                    pa.array([b"\n".join(x) for x in kept], pa.binary()).cast(pa.string()),
                ]

            return work

        return append_columns(docs, text_col, fields, make), names

    def _drop_by_shard(self, docs: DataFrame, text_col: str, names: dict[str, str]) -> DataFrame:
        """The same rows without a broadcast: numbered lines are probed where their shard's filter is."""
        row, gone_col = fresh_name(docs, "line_dedup_row"), fresh_name(docs, "gone_lines")
        numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "line-rows")
        min_chars, at = self.min_chars, docs.columns.index(text_col)
        schema = T.StructType([*KEYS.fields, T.StructField("row", T.LongType()), T.StructField("line", T.LongType())])

        def run(batches):
            for batch in batches:
                rows, numbers, keys = [], [], []
                for number, text in zip(batch.column(0).to_pylist(), column_bytes(batch.column(1))):
                    for i, k in enumerate(line_keys(split_lines(text), min_chars)):
                        if k:
                            rows.append(number), numbers.append(i), keys.append(k)
                k = as_longs(keys)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(rows, pa.int64()), pa.array(numbers, pa.int64())], names=schema.names
                )

        lines = materialize(numbered.select(row, F.col(f"`{text_col}`").alias("text")).mapInArrow(run, schema), "line-keys")
        hits = self._hits(lines)
        # an exception has few lines of its own, but hits of frequent lines are many: both are dealt out over salts
        odd = self._hits(self.references.where(F.col("refs") < self.min_docs).select("k1", "k2"))
        odd = odd.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(31))))
        hits = hits.withColumn("salt", F.pmod(F.xxhash64("row", "line"), F.lit(32)).cast("int")).join(odd, ["k1", "k2", "salt"], "left_anti")
        gone = hits.groupBy("row").agg(F.collect_list("line").alias("gone")).select(F.col("row").alias(row), F.col("gone").alias(gone_col))
        joined = numbered.join(gone, row, "left").drop(row)
        out = T.StructType([*docs.schema.fields, T.StructField(names["n_lines"], T.LongType()), T.StructField(names["n_dropped"], T.LongType()), T.StructField(names["kept"], T.StringType())])

        def drop(batches):
            for batch in batches:
                for start in range(0, batch.num_rows, 256):
                    part = batch.slice(start, 256)
                    sizes, dropped, kept = [], [], []
                    for text, gone in zip(column_bytes(part.column(at)), part.column(len(out) - 3).to_pylist()):
                        every, lost = split_lines(text), set(gone or ())
                        sizes.append(len(every)), dropped.append(len(lost))
                        kept.append(b"\n".join(x for i, x in enumerate(every) if i not in lost) if lost else text or b"")
                    made = [pa.array(sizes, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names=out.names)

        return joined.mapInArrow(drop, out)


def dedup_lines(
    docs: DataFrame, text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS
) -> tuple[DataFrame, dict[str, str], LineIndex]:
    """Index docs and drop their frequent lines; see LineIndex.drop_lines."""
    index = LineIndex(docs.sparkSession, min_docs, min_chars).insert(docs, text_col)
    return *index.drop_lines(docs, text_col), index
