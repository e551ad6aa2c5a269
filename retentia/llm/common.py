"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.session import ensure_checkpoint_dir

#: Bytes of text (or rows' payload) that one step inside a Python worker handles at a time.
STEP_BYTES = 4 << 20


#: Rows of a record batch between the JVM and a Python worker.
BATCH_ROWS = 2048


def bounded_batches(spark: SparkSession) -> None:
    """Record batches of at most ``BATCH_ROWS`` rows: both sides hold a batch whole, and a row may be a long text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the shared folder of ``spark.checkpoint.dir``."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


#: Rows of a few short columns that a task may hold in memory.
SMALL_ROWS = 1_000_000


def small_side(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df``, counted; to be broadcast if it has at most ``rows`` rows, else joined as Spark sees fit."""
    return F.broadcast(df) if df.count() <= rows else df


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores in front until it clashes with none of ``taken`` (case-insensitive)."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


@contextlib.contextmanager
def no_cycle_search() -> Iterator[None]:
    """Without Python's search for reference cycles, which walks large tables of small objects again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def text_steps(batch: pa.RecordBatch, column: str, step_bytes: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose ``column`` holds about ``step_bytes`` bytes (one row at least)."""
    sizes = np.cumsum(text_bytes(batch.column(batch.schema.get_field_index(column))))
    lo = 0
    while lo < batch.num_rows:
        base = sizes[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(sizes, base + step_bytes, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def text_bytes(texts: pa.Array) -> np.ndarray:
    """UTF-8 bytes of each text, 0 for a null."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a column, a null as an empty text."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def list_array(values: np.ndarray, lengths: list[int], kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


@dataclass
class Lists:
    """A list column as flat values; ``of(i)`` is the list of row ``i``."""

    values: np.ndarray
    offsets: np.ndarray

    def of(self, i: int) -> np.ndarray:
        return self.values[self.offsets[i]:self.offsets[i + 1]]


def columns_of(batch: pa.RecordBatch | pa.Table) -> dict[str, np.ndarray | Lists]:
    """Columns as numpy arrays (lists as ``Lists``, null lists as empty ones)."""
    out: dict[str, np.ndarray | Lists] = {}
    for name in batch.schema.names:
        col = batch.column(batch.schema.get_field_index(name))
        if isinstance(col, pa.ChunkedArray):
            col = col.combine_chunks()
        if pa.types.is_list(col.type):
            lengths = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            offsets = np.zeros(len(col) + 1, np.int64)
            np.cumsum(lengths, out=offsets[1:])
            out[name] = Lists(col.flatten().to_numpy(zero_copy_only=False), offsets)
        else:
            out[name] = col.to_numpy(zero_copy_only=False)
    return out


def map_groups(df: DataFrame, keys: list[str], order: list[str],
               fn: Callable[[dict, int, int], list[tuple]], schema: str) -> DataFrame:
    """``fn(columns, lo, hi)`` for each group of ``keys``; its rows, as ``schema``.

    The rows are dealt out by ``keys`` and sorted by ``keys`` and ``order``; the worker walks the sorted
    stream, so that small groups cost no call of their own in the JVM.  A caller bounds its groups
    beforehand (tiles, pages), since one group is held in memory.
    """
    from pyspark.sql.types import _parse_datatype_string  # noqa: PLC2701
    from pyspark.sql.pandas.types import to_arrow_schema

    out_schema = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            if held and _same_key(held[0], 0, batch, batch.num_rows - 1, keys):
                held.append(batch)
                continue
            last = _last_group(batch, keys)
            whole = pa.Table.from_batches([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
            yield from _groups(whole, keys, fn, out_schema)
        if held:
            yield from _groups(pa.Table.from_batches(held), keys, fn, out_schema)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _same_key(a: pa.RecordBatch, i: int, b: pa.RecordBatch, j: int, keys: list[str]) -> bool:
    return all(a.column(a.schema.get_field_index(k))[i] == b.column(b.schema.get_field_index(k))[j] for k in keys)


def _starts(cols: dict, keys: list[str], n: int) -> np.ndarray:
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= cols[k][1:] != cols[k][:-1]
    return np.flatnonzero(new)


def _last_group(batch: pa.RecordBatch, keys: list[str]) -> int:
    return int(_starts(columns_of(batch.select(keys)), keys, batch.num_rows)[-1])


def _groups(table: pa.Table, keys: list[str], fn: Callable, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    n = table.num_rows
    if not n:
        return
    cols = columns_of(table)
    starts = [*_starts(cols, keys, n).tolist(), n]
    rows: list[tuple] = []
    for lo, hi in zip(starts, starts[1:]):
        rows += fn(cols, lo, hi)
        if len(rows) > 20_000:
            yield record_batch(rows, schema)
            rows = []
    if rows:
        yield record_batch(rows, schema)


def record_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)
