"""Runs a function of one chunk over all chunks, in Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows that are held as Python objects at once: a chunk may have several MB of candidates.
ROWS = 16


def map_chunks(chunks: DataFrame, fields: T.StructType, work: Callable[..., list[tuple]], inputs: list[str], keep: list[str]) -> DataFrame:
    """keep plus fields: one row for each tuple that work(*inputs of a row) gives. Nothing is shuffled."""
    source = chunks.select(*keep, *[chunks[c].alias(f"in_{c}") for c in inputs])
    schema = T.StructType([*source.schema.fields[: len(keep)], *fields.fields])
    kinds = [f.type for f in to_arrow_schema(fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                given = [part.column(len(keep) + i).to_pylist() for i in range(len(inputs))]
                made = [work(*row) for row in zip(*given)]
                rows = [r for rs in made for r in rs]
                index = pa.array([i for i, rs in enumerate(made) for _ in rs], pa.int64())
                columns = [part.column(i).take(index) for i in range(len(keep))]
                columns += [pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(run, schema)


#: Rows of an output batch of map_arrays().
OUT_ROWS = 1 << 16


def map_arrays(chunks: DataFrame, fields: T.StructType, work: Callable[..., tuple[np.ndarray, ...]], keep: list[str]) -> DataFrame:
    """keep plus fields: work(the bytes of a chunk) gives one array for each field, all of one length; a row for each entry."""
    source = chunks.select(*keep, chunks["raw"].alias("in_raw"))
    schema = T.StructType([*source.schema.fields[: len(keep)], *fields.fields])
    kinds = [f.type for f in to_arrow_schema(fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                made = work(batch.column(len(keep))[row].as_py())
                for at in range(0, len(made[0]), OUT_ROWS):
                    part = [pa.array(m[at : at + OUT_ROWS]).cast(kind) for m, kind in zip(made, kinds)]
                    same = pa.array(np.full(len(part[0]), row), pa.int64())
                    yield pa.RecordBatch.from_arrays([*(batch.column(i).take(same) for i in range(len(keep))), *part], names=schema.names)

    return source.mapInArrow(run, schema)


#: Rows and bytes of chunks that map_groups() gives at once, if there is more than one.
GROUP_ROWS, GROUP_BYTES = 1000, 1 << 19


def map_groups(
    chunks: DataFrame, fields: T.StructType, work: Callable[..., tuple], inputs: list[str], keep: list[str],
    most: int = GROUP_BYTES, measure: str = "raw",
) -> DataFrame:
    """keep plus fields: work(a list of each input's values for neighbouring rows) gives the row number of each entry and
    one array or list for each field. Rows are taken together up to `most` bytes of `measure`, one of the inputs (bytes, or
    a number of them)."""
    source = chunks.select(*keep, *[chunks[c].alias(f"in_{c}") for c in inputs])
    schema = T.StructType([*source.schema.fields[: len(keep)], *fields.fields])
    kinds, sized = [f.type for f in to_arrow_schema(fields)], inputs.index(measure)

    def groups(part: pa.RecordBatch) -> Iterator[tuple[int, int]]:
        column = part.column(len(keep) + sized)
        sizes = (pc.binary_length(column) if pa.types.is_binary(column.type) else column).to_numpy(zero_copy_only=False)
        start = total = 0
        for at, size in enumerate(sizes.tolist()):
            if at > start and (total + size > most or at - start >= GROUP_ROWS):
                yield start, at
                start, total = at, 0
            total += size
        if start < len(sizes):
            yield start, len(sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in groups(batch):
                part = batch.slice(start, end - start)
                rows, *made = work(*(part.column(len(keep) + i).to_pylist() for i in range(len(inputs))))
                for at in range(0, len(rows), OUT_ROWS):
                    index = pa.array(np.asarray(rows[at : at + OUT_ROWS]), pa.int64())
                    columns = [part.column(i).take(index) for i in range(len(keep))]
                    columns += [pa.array(m[at : at + OUT_ROWS], None if isinstance(m, np.ndarray) else kind).cast(kind) for m, kind in zip(made, kinds)]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(run, schema)
