"""The stored panel as a named data source, batch and streaming (S1, S2): ``spark.read.format("retentia_panel")``.

It reads what ``scan_panel`` reads, to the same rows (declared columns only): a folder (or file) of Parquet or CSV files whose columns are
found by name, with the declared types, missing words and NaN as null.  A partition is a few row groups of a Parquet
file, or a CSV file.  A schema given to the reader names the columns that are read; others are not decoded.
Comparisons, IN lists and null tests are pushed into the reader (with ``spark.sql.python.filterPushdown.enabled``):
they drop row groups by their statistics before a task is made, and rows before they reach Spark.

The streaming reader takes files in the order of their modification times; an offset is the last file taken.  A file
must be put in its folder whole (written elsewhere and moved), and a moved file must not keep an older time.

The files are read by Arrow, in the tasks.  Where Spark's own reader does, ``scan_panel`` is the faster one; this one
gives the panel a name of its own in SQL and streams, with CSV headers read by name, which the file stream cannot do.

Options: ``path``; ``files`` = parquet or csv (by the file names, unless given); ``rows`` = rows of a partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv
import pyarrow.dataset as ds
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from retentia.sources.panel import _MISSING_TEXT
from retentia.sources.schemas import PANEL

NAME = "retentia_panel"
ROWS = 1_000_000


@dataclass(frozen=True)
class Piece(D.InputPartition):
    """Row groups ``first`` to ``last - 1`` of a Parquet file, or a whole CSV file (``last`` is 0)."""

    path: str
    first: int = 0
    last: int = 0


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system that a path names, and the path there."""
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def list_files(path: str) -> list[tuple[int, str]]:
    """(modification time in ns, path) of the data files at or below ``path``, oldest first; hidden ones are passed over."""
    fs, at = _open(path)
    info = fs.get_file_info(at)
    if info.type == pyarrow.fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else [f for f in fs.get_file_info(pyarrow.fs.FileSelector(at, recursive=True)) if f.is_file]
    below = lambda f: f.path[len(at):].split("/")
    return sorted((f.mtime_ns or 0, f.path) for f in found if not any(p[:1] in ("_", ".") for p in below(f)))


# ---------------------------------------------------------------- values as declared
def _from_text(column: pa.ChunkedArray, kind: pa.DataType, name: str) -> pa.ChunkedArray:
    """A CSV field as its declared type, by the rules of ``scan_panel``."""
    text = pc.ascii_trim_whitespace(column)
    text = pc.if_else(pc.is_in(pc.utf8_lower(text), pa.array(_MISSING_TEXT)), pa.scalar(None, pa.string()), text)
    if pa.types.is_integer(kind):
        exact = text.cast(pa.decimal128(38, 6))
        whole = pc.floor(exact)
        if pc.any(pc.not_equal(exact, whole)).as_py():
            raise ValueError(f"not a whole number in column {name}")
        return whole.cast(pa.decimal128(38, 0)).cast(kind)
    if pa.types.is_timestamp(kind):
        return pc.replace_substring(text, "T", " ").cast(pa.timestamp("us")).cast(kind)
    return text.cast(kind)


def _declared(table: pa.Table, schema: pa.Schema, text: bool) -> pa.Table:
    """The columns of ``schema`` by name; absent ones are null, NaN is null."""
    out = []
    for f in schema:
        if f.name not in table.schema.names:
            out.append(pa.nulls(table.num_rows, f.type))
            continue
        c = table.column(f.name)
        if text and f.name == "player_id":  # an id is taken as it stands
            c = pc.if_else(pc.equal(c, ""), pa.scalar(None, pa.string()), c).cast(f.type)
        else:
            c = _from_text(c, f.type, f.name) if text else c.cast(f.type)
        out.append(pc.if_else(pc.is_nan(c), pa.scalar(None, f.type), c) if pa.types.is_floating(f.type) else c)
    return pa.Table.from_arrays(out, schema=schema)


# ---------------------------------------------------------------- filters
_COMPARE = {D.EqualTo: "__eq__", D.GreaterThan: "__gt__", D.GreaterThanOrEqual: "__ge__", D.LessThan: "__lt__", D.LessThanOrEqual: "__le__"}


def as_expression(f: D.Filter, schema: pa.Schema) -> ds.Expression | None:
    """A filter as Arrow evaluates it on declared values; None for what is left to Spark."""
    name = ".".join(getattr(f, "attribute", ()))
    if name not in schema.names:
        return None
    kind = schema.field(name).type
    try:
        if type(f) in _COMPARE:
            if f.value is None or f.value != f.value:  # null and NaN compare by Spark's rules
                return None
            return getattr(ds.field(name), _COMPARE[type(f)])(pa.scalar(f.value, kind))
        if isinstance(f, D.In):
            return ds.field(name).isin(pa.array([v for v in f.value if v is not None], kind))
        if isinstance(f, D.IsNotNull):
            return ds.field(name).is_valid()
        if isinstance(f, D.IsNull):
            return ds.field(name).is_null()
    except (pa.ArrowInvalid, pa.ArrowTypeError, pa.ArrowNotImplementedError, OverflowError):
        return None
    return None


# ---------------------------------------------------------------- readers
class _Files:
    """What the two readers share: pieces of files, and the rows of a piece."""

    def __init__(self, schema: T.StructType, options: dict) -> None:
        self.schema, self.path = schema, options.get("path")
        if not self.path:
            raise ValueError(f"{NAME} needs a path")
        self.kind, self.rows = options.get("files"), int(options.get("rows", ROWS))
        if self.kind not in (None, "parquet", "csv"):
            raise ValueError(f"files must be parquet or csv, not {self.kind!r}")
        self.keep: list[tuple[str, ds.Expression]] = []

    def is_csv(self, path: str) -> bool:
        return self.kind == "csv" or (self.kind is None and path.endswith(".csv"))

    def pieces(self, paths: list[str]) -> list[Piece]:
        """Partitions; row groups whose statistics rule out a pushed filter have none."""
        out: list[Piece] = []
        fs, _ = _open(self.path)
        want = to_arrow_schema(self.schema)
        for path in paths:
            if self.is_csv(path):
                out.append(Piece(path))
                continue
            fragment = ds.ParquetFileFormat().make_fragment(path, fs)
            have = fragment.physical_schema
            # statistics are used where the stored type is the declared one; NaN has none, so nulls of numbers are not told
            known = [e for name, e in self.keep if name in have.names and have.field(name).type == want.field(name).type and not pa.types.is_floating(have.field(name).type)]
            groups = [g.id for g in fragment.row_groups]
            for e in known:
                groups = [g.id for g in fragment.subset(row_group_ids=groups).subset(filter=e, schema=have).row_groups] if groups else []
            sizes = {g.id: g.num_rows for g in fragment.row_groups}
            run: list[int] = []
            for g in groups:
                if run and (g != run[-1] + 1 or sum(sizes[i] for i in run) + sizes[g] > self.rows):
                    out.append(Piece(path, run[0], run[-1] + 1))
                    run = []
                run.append(g)
            if run:
                out.append(Piece(path, run[0], run[-1] + 1))
        return out

    def batches(self, piece: Piece | None) -> Iterator[pa.RecordBatch]:
        if piece is None:  # Spark's one partition where there is none
            return
        fs, _ = _open(self.path)
        want = to_arrow_schema(self.schema)
        if self.is_csv(piece.path):
            with fs.open_input_stream(piece.path) as f:
                head = f.read(1 << 20).split(b"\n", 1)[0].decode("utf-8-sig").rstrip("\r")
            names = [n.strip('"') for n in head.split(",")]
            read = pyarrow.csv.ConvertOptions(column_types={n: pa.string() for n in names}, include_columns=[n for n in names if n in want.names], strings_can_be_null=False)
            stream = pyarrow.csv.open_csv(fs.open_input_stream(piece.path), convert_options=read, parse_options=pyarrow.csv.ParseOptions(newlines_in_values=True))
            raw = (pa.Table.from_batches([b]) for b in stream)
        else:
            source = pq.ParquetFile(fs.open_input_file(piece.path))
            names = [n for n in source.schema_arrow.names if n in want.names]
            raw = (pa.Table.from_batches([b]) for b in source.iter_batches(row_groups=list(range(piece.first, piece.last)), columns=names))
        for table in raw:
            table = _declared(table, want, self.is_csv(piece.path))
            for _, e in self.keep:
                table = table.filter(e)
            yield from table.combine_chunks().to_batches(max_chunksize=10_000)


class PanelReader(D.DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict) -> None:
        self.files = _Files(schema, options)

    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:
        """Filters that Arrow can evaluate are taken; the others go back to Spark."""
        schema = to_arrow_schema(self.files.schema)
        for f in filters:
            e = as_expression(f, schema)
            if e is None:
                yield f
            else:
                self.files.keep.append((".".join(f.attribute), e))

    def partitions(self) -> list[Piece]:
        return self.files.pieces([p for _, p in list_files(self.files.path)])

    def read(self, partition: Piece | None) -> Iterator[pa.RecordBatch]:
        return self.files.batches(partition)


class PanelStreamReader(D.DataSourceStreamReader):
    def __init__(self, schema: T.StructType, options: dict) -> None:
        self.files = _Files(schema, options)

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        found = list_files(self.files.path)
        return dict(zip(("time", "path"), found[-1])) if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        after, last = (start["time"], start["path"]), (end["time"], end["path"])
        return self.files.pieces([f[1] for f in list_files(self.files.path) if after < f <= last])

    def read(self, partition: Piece | None) -> Iterator[pa.RecordBatch]:
        return self.files.batches(partition)

    def commit(self, end: dict) -> None:
        pass


class PanelSource(D.DataSource):
    """``spark.read.format("retentia_panel")`` and ``spark.readStream.format("retentia_panel")``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> T.StructType:
        """The declared panel; player ids of CSV files stay as text."""
        files = _Files(PANEL, self.options)
        if any(files.is_csv(p) for _, p in list_files(files.path)):
            return T.StructType([T.StructField(f.name, T.StringType()) if f.name == "player_id" else f for f in PANEL])
        return PANEL

    def reader(self, schema: T.StructType) -> PanelReader:
        return PanelReader(schema, self.options)

    def streamReader(self, schema: T.StructType) -> PanelStreamReader:
        return PanelStreamReader(schema, self.options)


def register(spark: SparkSession) -> None:
    """Make the source known to the session, with filters pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PanelSource)
