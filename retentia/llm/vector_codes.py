"""Vector codes by product quantisation in whole numbers (operator 11).

A component x becomes floor(scale * x).  A vector is cut into equal consecutive parts; each part position has a
codebook of at most 256 entries, which starts as that part of the vectors with the smallest ids and is moved for some
rounds: every part goes to its nearest entry, every entry that has parts becomes the floor of their mean.  A code
holds the number of the nearest final entry of each part, two hex digits each.

The nearest entry is found in the Walsh-Hadamard domain.  Parts and entries are padded with zeros to a power of two P
and transformed by additions only; the sum of squared differences of two transforms is P times the squared distance.
The differences are added up in the order of sequency, slow changes first; an entry whose sum so far exceeds the whole
sum of the best guess is out.  Everything is integer arithmetic: 64 bits where the numbers allow it, Python's unbounded
integers elsewhere, so a result does not depend on rounding or on the order of rows.

A round gives back one sum an entry, position and task; the codebooks are parts x 256 x part width numbers, whatever
the number of rows.  The input is scanned once a round and once at the end: pass a table, not a costly plan.

Defined cases: a vector that is null or holds a null or non-finite component is dropped; shorter vectors (an empty one
too) are extended by zeros to the longest, and all to whole parts; ids may repeat and each row has its code; rows
without an id come last where the first entries are chosen, rows with one id by their vectors; fewer rows than entries
give fewer entries; equal distances go to the smaller index; a null label is a label of its own; an error, or a sum of
errors, that 64 bits cannot hold is null; an empty table gives an empty result; other columns are left behind.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.llm.common import SMALL_ROWS, columns_of, cut_lineage, fresh
from retentia.llm.vectors import finite, padded

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Components up to this size keep every sum of a squared distance within 64 bits (P up to 2^8).
SMALL = 1 << 22
#: Rows that are compared with the entries at a time; coordinates between two tests of the bound.
BLOCK, STEP = 128, 4
#: Sums leave a task in pieces of 40 bits, which 64 bits add up for 2^23 tasks.
LIMB = 40


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as whole numbers; ``scale`` is a power of two, so that the product is exact."""
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    if not y.size or np.abs(y).max() <= SMALL:
        return y.astype(np.int64)
    exact = [math.floor(v * scale) if abs(v) < 2.0 ** 60 else int(v) * scale for v in x.ravel().tolist()]
    out = np.empty(len(exact), object)
    out[:] = exact
    return out.reshape(x.shape)


def same_kind(a: np.ndarray, b: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Both as 64-bit integers if all sums fit, else as unbounded ones."""
    if a.dtype == object or b.dtype == object or width > 256:
        return a.astype(object), b.astype(object)
    if max((int(np.abs(v).max()) for v in (a, b) if v.size), default=0) > SMALL:
        return a.astype(object), b.astype(object)
    return a, b


def sequency_order(width: int) -> np.ndarray:
    """The natural numbers of the Walsh functions, by their number of sign changes; ``width`` is a power of two."""
    bits = width.bit_length() - 1
    gray = np.arange(width) ^ (np.arange(width) >> 1)
    out = np.zeros(width, np.int64)
    for b in range(bits):
        out |= ((gray >> b) & 1) << (bits - 1 - b)
    return out


def walsh(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, zero-padded to a power of two, in sequency order (not scaled)."""
    n, d = x.shape
    width = 1 << max(0, d - 1).bit_length()
    y = np.zeros((n, width), x.dtype)
    y[:, :d] = x
    half = 1
    while half < width:
        z = y.reshape(n, width // (2 * half), 2, half)
        y = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], axis=2).reshape(n, width)
        half *= 2
    return y[:, sequency_order(width)]


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the index of its nearest entry, ties to the smaller, and their sum of squares; both transformed."""
    index, best = np.zeros(len(rows), np.int64), np.zeros(len(rows), rows.dtype)
    width = rows.shape[1]
    for lo in range(0, len(rows), BLOCK):
        x = rows[lo:lo + BLOCK]
        part = np.zeros((len(x), len(entries)), rows.dtype)
        k, open_share = 0, 1.0
        while k < width and open_share > 0.25:  # most entries are still in: whole columns are cheaper
            for c in range(k, min(k + STEP, width)):
                d = x[:, c, None] - entries[None, :, c]
                part += d * d
            k = min(k + STEP, width)
            d = x - entries[part.argmin(axis=1)]
            bound = (d * d).sum(axis=1)
            open_share = np.count_nonzero(part <= bound[:, None]) / part.size
        i, j = np.nonzero(part <= bound[:, None])
        part = part[i, j]
        while k < width:
            d = x[i, k:k + STEP] - entries[j, k:k + STEP]
            part = part + (d * d).sum(axis=1)
            keep = part <= bound[i]
            i, j, part, k = i[keep], j[keep], part[keep], k + STEP
        first = np.flatnonzero(np.append(True, i[1:] != i[:-1]))  # every row keeps its guess at least
        least = np.minimum.reduceat(part, first)
        hit = np.flatnonzero(part == least[i])
        _, at = np.unique(i[hit], return_index=True)
        index[lo:lo + len(x)], best[lo:lo + len(x)] = j[hit[at]], least
    return index, best


@dataclass(frozen=True)
class Codebooks:
    """``entries[part][index]`` are whole numbers; ``width`` is that of a part, ``scale`` what components are taken times."""

    entries: np.ndarray
    width: int
    scale: int

    @property
    def parts(self) -> int:
        return len(self.entries)

    def sha256(self) -> str:
        """Digest of all components in decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def assign(self, lists) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each part its whole numbers, the indexes of the nearest entries and the squared distances."""
        x = whole(padded(lists, self.width * self.parts), self.scale)
        for p in range(self.parts):
            mine = x[:, p * self.width:(p + 1) * self.width]
            if not self.width:
                yield mine, np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
                continue
            a, b = same_kind(mine, self.entries[p], self.width)
            index, total = nearest(walsh(a), walsh(b))
            yield mine, index, total // (1 << (self.width - 1).bit_length())

    @classmethod
    def fit(cls, df: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES,
            rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
        """Codebooks of all rows of ``df``; None where no row can be used."""
        if not 0 < entries <= 256 or scale & (scale - 1):
            raise ValueError("at most 256 entries, and a scale that is a power of two")
        rows = _usable(df, key, vector)
        longest = rows.select(F.max(F.size("v"))).first()[0]
        if longest is None:
            return None
        width = -(-longest // parts)
        # the ids alone first, so that the vectors are read only where an id is small enough
        ids = [r.id for r in rows.filter("id IS NOT NULL").select("id").orderBy("id").limit(entries).collect()]
        low = rows.filter(F.col("id") <= F.lit(ids[-1])) if len(ids) == entries else rows
        first = [r.v for r in low.orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()]
        start = np.zeros((len(first), parts * width))
        for i, v in enumerate(first):
            start[i, :len(v)] = v
        books = cls(whole(start, scale).reshape(len(first), parts, width).transpose(1, 0, 2), width, scale)
        for _ in range(rounds):
            books = books._moved(rows)
        return books

    def _moved(self, rows: DataFrame) -> Codebooks:
        """Every entry that has parts at the floor of their mean."""
        if not self.width:
            return self
        shape = (self.parts, self.entries.shape[1], self.width)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, large, counts = np.zeros(shape, np.int64), {}, np.zeros(shape[:2], np.int64)
            for batch in batches:
                if not batch.num_rows:
                    continue
                for p, (x, index, _) in enumerate(self.assign(columns_of(batch)["v"])):
                    counts[p] += np.bincount(index, minlength=shape[1])
                    if x.dtype == object:
                        for k, row in zip(index.tolist(), x.tolist()):
                            large[p, k] = [a + b for a, b in zip(large.get((p, k), [0] * self.width), row)]
                    else:  # a batch's sums stay below 2^53, so doubles hold them
                        at = index[:, None] * self.width + np.arange(self.width)
                        sums[p] += np.bincount(at.ravel(), x.ravel(), shape[1] * self.width).astype(np.int64).reshape(shape[1:])
            out = [(p, k, -1, 0, n) for p, book in enumerate(counts.tolist()) for k, n in enumerate(book) if n]
            for p, k in {(p, k) for p, k, *_ in out}:
                for c, total in enumerate(sums[p, k].tolist()):
                    out += [(p, k, c, limb, piece) for limb, piece in enumerate(pieces(total + large[p, k][c] if (p, k) in large else total))]
            for lo in range(0, len(out), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out[lo:lo + 20_000])], names=["part", "entry", "position", "limb", "total"])

        found = rows.select("v").mapInArrow(run, "part long, entry long, position long, limb long, total long")
        totals = np.zeros(shape, object)
        counts = np.zeros(shape[:2], object)
        for r in found.groupBy("part", "entry", "position", "limb").agg(F.sum("total").alias("total")).collect():  # as large as the codebooks
            if r.position < 0:
                counts[r.part, r.entry] = r.total
            else:
                totals[r.part, r.entry, r.position] += r.total << (LIMB * r.limb)
        moved = self.entries.astype(object)
        for p, k in zip(*np.nonzero(counts)):
            moved[p, k] = [t // counts[p, k] for t in totals[p, k]]
        small = not moved.size or max(abs(v) for v in moved.ravel()) <= SMALL
        return Codebooks(moved.astype(np.int64) if small else moved, self.width, self.scale)


def pieces(total: int) -> list[int]:
    """The number in pieces of ``LIMB`` bits, the last with its sign."""
    out = []
    while not -(1 << LIMB) <= total < 1 << LIMB:
        out.append(total & ((1 << LIMB) - 1))
        total >>= LIMB
    return [*out, total]


def _usable(df: DataFrame, key: str, vector: str, *more) -> DataFrame:
    return df.filter(finite(vector)).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), *more)


def encode(df: DataFrame, books: Codebooks, vector: str = "embedding", code: str = "code", error: str = "error") -> DataFrame:
    """``df`` with the code of each vector and its squared distance from what the code stands for.

    Rows whose vector is null or holds a null or non-finite component are dropped; other columns pass unchanged.
    Components beyond the width of the codebooks are an error.
    """
    v = fresh("_v", df.columns)
    given = df.filter(finite(vector)).withColumn(v, F.col(vector).cast("array<double>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, errors = [], 0
            for _, index, square in books.assign(columns_of(batch.select([v]))[v]):
                codes.append(index)
                errors = errors + square.astype(object)
            text = [bytes(row).hex() for row in np.stack(codes, axis=1).astype(np.uint8)]
            fits = [e if e < 1 << 63 else None for e in errors.tolist()]
            kept = [c for c, name in zip(batch.columns, batch.schema.names) if name != v]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(text, pa.string()), pa.array(fits, pa.int64())],
                                             names=[*[n for n in batch.schema.names if n != v], code, error])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return given.mapInArrow(run, f"{kept}, `{code}` string, `{error}` long")


def decode(df: DataFrame, books: Codebooks, code: str = "code", vector: str = "decoded") -> DataFrame:
    """``df`` with the vector that each code stands for, on the scale of the vectors; a null code gives null."""
    table = [[[int(c) / books.scale for c in entry] for entry in book.tolist()] for book in books.entries]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(batch.schema.get_field_index(code)).to_pylist()
            back = [None if c is None else [x for book, k in zip(table, bytes.fromhex(c)) for x in book[k]] for c in codes]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.list_(pa.float64()))], names=[*batch.schema.names, vector])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{kept}, `{vector}` array<double>")


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", **fit) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of every usable row; ``fit`` goes to ``Codebooks.fit``.

    ``label_error`` is the sum of ``error`` over all rows of the same label.
    """
    books = Codebooks.fit(df, key, vector, **fit)
    rows = _usable(df, key, vector, F.col(label).alias("label"))
    if books is None:
        return rows.select(F.col("id").alias(key), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
                           F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256")).limit(0)
    coded = cut_lineage(encode(rows, books, "v").drop("v"))
    # one row a label; a sum of 64-bit numbers may need more than 64 bits
    sums = cut_lineage(coded.groupBy("label").agg(F.count("*").alias("n"), F.count("error").alias("known"), F.sum(F.col("error").cast("decimal(38,0)")).alias("total")))
    sums = sums.select(F.col("label").alias("_label"), "n", F.when(F.col("n") == F.col("known"), F.col("total").try_cast("long")).alias("label_error"))
    same = F.col("label").eqNullSafe(F.col("_label"))
    if sums.count() <= SMALL_ROWS:
        summed = coded.join(F.broadcast(sums), same)
    else:  # at most SMALL_ROWS labels are as frequent as that; the others have few rows each
        often = F.col("n") * SMALL_ROWS >= coded.count()
        hot = F.broadcast(sums.filter(often))
        summed = coded.join(hot, same).union(coded.join(hot, same, "left_anti").join(sums.filter(~often), same))
    return summed.select(F.col("id").alias(key), "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
