"""Tables kept in buckets of a key, of which a batch rewrites only those it touches.

A table is a folder of Parquet partitions ``_bucket=N``, N being a hash of the bucket columns.  A batch of updates
names its buckets; these alone are scanned, merged with the batch and replaced by a dynamic partition overwrite, so
that the cost follows the buckets touched and not the table.  All other files stay as they are.

A batch is first written whole beside the table (``_pending/<batch>``) and then put in place.  A driver that is lost
in between leaves the pending batch, which the next call puts in place again before anything else (overwriting with
the same rows changes nothing).  Named batches are remembered (``_applied/<batch>``): one that is repeated is
skipped.  One writer at a time; a reader that must not see a batch half-way reads between two batches.

The layout (bucket columns, number of buckets, schema) is kept in the folder, so that reading infers nothing.  A
column that a batch brings for the first time is null in the rows before it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentia.sources import files
from retentia.sources.sinks import upsert

BUCKET = "_bucket"
#: Folders that partition discovery passes over, because their names start with an underscore and hold no "=".
_LAYOUT, _PENDING, _APPLIED = "_layout", "_pending", "_applied"
_LAYOUT_ROW = "columns array<string>, buckets int, schema string"
#: Prefix of batches without a name, which are not remembered.
_UNNAMED = "unnamed-"

Fold = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class BucketedTable:
    """The table in the folder ``path``: ``buckets`` hash buckets of the columns ``by``."""

    spark: SparkSession
    path: str
    by: tuple[str, ...]
    buckets: int

    @classmethod
    def create(cls, spark: SparkSession, path: str, by: list[str], buckets: int) -> BucketedTable:
        """A new table without columns or rows; the first batch brings the columns."""
        if buckets < 1 or not by:
            raise ValueError("a bucketed table needs bucket columns and at least one bucket")
        if files.names(spark, f"{path}/{_LAYOUT}"):
            raise ValueError(f"there is a table in {path}")
        table = cls(spark, path, tuple(by), buckets)
        table._keep_layout(None)
        return table

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> BucketedTable:
        row = _layout(spark, path)
        if row is None:
            raise ValueError(f"no bucketed table in {path}")
        return cls(spark, path, tuple(row["columns"]), row["buckets"])

    def bucket_of(self) -> Column:
        """The bucket of a row, by the bucket columns (nulls are a value like any other)."""
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    def schema(self) -> T.StructType | None:
        """The columns, without the bucket; None before the first batch."""
        text = _layout(self.spark, self.path)["schema"]
        return None if text is None else T.StructType.fromJson(json.loads(text))

    def held(self) -> list[int]:
        """The buckets that have rows."""
        return sorted(int(n.split("=")[1]) for n in files.names(self.spark, self.path) if n.startswith(f"{BUCKET}="))

    def rows(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets (a partition filter: the files of others are not read)."""
        schema = self.schema()
        if schema is None:
            raise ValueError(f"the table in {self.path} has no columns yet")
        if not self.held():
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(self.path)
        return (df if buckets is None else df.filter(F.col(BUCKET).isin(buckets))).drop(BUCKET)

    def lookup(self, keys: list[tuple]) -> DataFrame:
        """The rows whose bucket columns have the given values; only their buckets are read."""
        schema = self.schema()
        wanted = self.spark.createDataFrame(keys, T.StructType([schema[c] for c in self.by]))
        buckets = [r[0] for r in wanted.select(self.bucket_of()).distinct().collect()]
        same = [F.col(f"_t.{c}").eqNullSafe(F.col(f"_k.{c}")) for c in self.by]
        return self.rows(buckets).alias("_t").join(F.broadcast(wanted.distinct().alias("_k")), same, "left_semi")

    def applied(self, batch: str) -> bool:
        return files.exists(self.spark, f"{self.path}/{_APPLIED}/{batch}/_SUCCESS")

    def merge(self, updates: DataFrame, fold: Fold, batch: str | None = None) -> list[int]:
        """Replace each bucket that ``updates`` touch by ``fold(its rows, the updates)``; the buckets replaced.

        ``fold`` gets the rows of all touched buckets at once, keeps every row in its bucket and loses no column.
        ``updates`` are computed twice (buckets, then rows): pass a table or a checkpoint.  The numbers of the buckets
        are all that the driver sees.
        """
        self.recover()
        if batch is not None and self.applied(batch):
            return []
        before = self.schema()
        if before is not None:  # the types of the table, on which the buckets depend
            updates = updates.select(*[F.col(c).cast(before[c].dataType) if c in before.names else F.col(c) for c in updates.columns])
        touched = sorted(r[0] for r in updates.select(self.bucket_of()).distinct().collect())
        old = self.rows(touched) if before is not None else self.spark.createDataFrame([], updates.schema)
        new = fold(old, updates)
        if before is not None:
            new = new.select(*[F.col(f.name).cast(f.dataType) for f in before], *[c for c in new.columns if c not in before.names])
        if before is None or new.columns != before.names:
            self._keep_layout(new.schema)
        if not touched:
            return []
        pending = f"{self.path}/{_PENDING}/{batch or _UNNAMED + uuid.uuid4().hex}"
        # by the hint a bucket goes to one task, and one of a very frequent key to several
        placed = new.withColumn(BUCKET, self.bucket_of()).hint("rebalance", BUCKET).sortWithinPartitions(BUCKET, *self.by)
        placed.write.mode("overwrite").partitionBy(BUCKET).parquet(pending)
        self._place(pending)
        return touched

    def recover(self) -> int:
        """Put pending batches in place that were written whole and remove others; how many were put in place."""
        done = 0
        for name in files.names(self.spark, f"{self.path}/{_PENDING}"):
            pending = f"{self.path}/{_PENDING}/{name}"
            if files.exists(self.spark, f"{pending}/_SUCCESS"):
                self._place(pending)
                done += 1
            else:
                files.remove(self.spark, pending)
        return done

    def _place(self, pending: str) -> None:
        """Overwrite the buckets of a pending batch, remember it and remove it."""
        schema = T.StructType([*self.schema().fields, T.StructField(BUCKET, T.IntegerType())])
        (self.spark.read.schema(schema).parquet(pending).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path))
        batch = pending.rsplit("/", 1)[1]
        if not batch.startswith(_UNNAMED):
            self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{_APPLIED}/{batch}")
        files.remove(self.spark, pending)

    def _keep_layout(self, schema: T.StructType | None) -> None:
        """The next version of the layout; the one before counts until it is written whole."""
        number = len(files.names(self.spark, f"{self.path}/{_LAYOUT}"))
        text = None if schema is None else json.dumps(schema.jsonValue())
        row = self.spark.createDataFrame([(list(self.by), self.buckets, text)], _LAYOUT_ROW)
        row.coalesce(1).write.mode("overwrite").json(f"{self.path}/{_LAYOUT}/{number:06d}")


def _layout(spark: SparkSession, path: str):
    """The newest layout that was written whole; None if there is none."""
    for name in reversed(files.names(spark, f"{path}/{_LAYOUT}")):
        if files.exists(spark, f"{path}/{_LAYOUT}/{name}/_SUCCESS"):
            return spark.read.schema(_LAYOUT_ROW).json(f"{path}/{_LAYOUT}/{name}").first()
    return None


def upsert_buckets(table: BucketedTable, updates: DataFrame, keys: list[str], order: str | None = None, batch: str | None = None) -> list[int]:
    """S5 on a bucketed table: insert, on key conflict replace; only the buckets of ``updates`` are rewritten.

    ``keys`` hold the table's bucket columns.  As with ``upsert``, the last of several updates of a key wins and
    columns that the updates lack stay.
    """
    if not set(table.by) <= set(keys):
        raise ValueError(f"the bucket columns {table.by} must be among the keys {keys}")
    return table.merge(updates, lambda old, new: upsert(old, new, keys, order), batch)
