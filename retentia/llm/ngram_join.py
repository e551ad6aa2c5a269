"""N-gram Jaccard join by MinHash banding (operator 1).

A document's words (lower case, split at white space) give its set of five-word shingles as 64-bit hashes; fewer
than five words give one shingle of them all.  Documents with the same set form a class, and only one of each class
goes on.  A class's MinHash signature is cut into bands; classes that agree in a band meet in a bucket, and the pairs
of a bucket are verified on their full shingle sets.  Band and row counts come from the wanted recall.

A pair is verified in the first band that it shares, so that no pair is counted twice and none needs a shuffle of
pairs.  A bucket of many classes is cut into tiles and each two tiles meet in a task of their own; a task gives back
one row a class (its links there, and a root of what it is linked with), never the pairs.  Full sets are shipped
only to buckets in which a class has a pair that no earlier band has.

Defined cases: every row is a document, also where rows share an id or have none: the id only names it, and classes
are told apart by the digest of their set.  A text that is null or has no word links with nothing; copies (equal sets)
count as links; of a component the row with the smallest (id, hash of its text) is kept, a null id coming last, and
so are rows that equal it in both; an empty table gives an empty result; other columns are left behind.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentia.llm.common import columns_of, cut_lineage, list_array, map_groups, text_steps, texts_of
from retentia.llm.components import components

WORDS, THRESHOLD = 5, 0.8
#: Share of the pairs at the threshold that the bands must find, and the hashes that a signature may have.
RECALL, MAX_HASHES = 0.9999, 128
#: Classes and shingles that a tile is meant to hold.
TILE_CLASSES, TILE_SHINGLES = 512, 1 << 20


def banding(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows whose bands still find ``recall`` of the pairs at ``threshold``."""
    best = (max_hashes, 1)
    for rows in range(1, max_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows))
        if bands * rows > max_hashes:
            break
        best = (bands, rows)
    return best


_ODD = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 150_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode())
        return h


def shingles(text: str, hashes: _WordHash, words: int = WORDS) -> np.ndarray:
    """The sorted set of the text's shingle hashes."""
    tokens = text.lower().split()
    h = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
    if not len(h):
        return h
    n = min(words, len(h))
    with np.errstate(over="ignore"):
        total = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            total += h[k:len(h) - n + 1 + k] * _ODD[k]
        return np.unique(_mix(total))


class Signer:
    """MinHash bands of a shingle set."""

    def __init__(self, bands: int, rows: int) -> None:
        rng = np.random.Generator(np.random.PCG64(11))
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 1 << 31, (bands * rows, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 32, (bands * rows, 1), dtype=np.uint32)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        """One key a band, different bands' keys made different."""
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        low = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        with np.errstate(over="ignore"):
            for k in range(0, len(x), 2048):
                np.minimum(low, (self.a * x[k:k + 2048] + self.b).min(axis=1), out=low)
            parts = low.reshape(self.bands, self.rows).astype(np.uint64)
            key = np.arange(1, self.bands + 1, dtype=np.uint64)
            for r in range(self.rows):
                key = _mix(key + parts[:, r] * _ODD[r])
        return key.view(np.int64)


def signatures(df: DataFrame, key: str, text: str, bands: int, rows: int, words: int = WORDS) -> DataFrame:
    """(id, hash, class, n, bands): the hash of each row's text, the digest (null if it is empty), size and bands of its set."""
    schema = T.StructType([T.StructField("id", df.schema[key].dataType), *_fields("hash long, class binary, n int, bands array<long>")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sign = _WordHash(), Signer(bands, rows)
        for batch in batches:
            for part in text_steps(batch, "text"):
                digests, n, got = [], [], []
                for t in texts_of(part, "text"):
                    s = shingles(t, hashes, words)
                    digests.append(class_of(s))
                    n.append(len(s))
                    got.append(sign(s) if len(s) else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(digests, pa.binary()), pa.array(n, pa.int32()),
                     list_array(np.concatenate(got), list(map(len, got)), pa.int64())], names=schema.names)

    return df.select(F.col(key).alias("id"), F.xxhash64(text).alias("hash"), F.col(text).alias("text")).mapInArrow(run, schema)


def class_of(shingles: np.ndarray) -> bytes | None:
    """The digest that names the class of a shingle set."""
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def _fields(schema: str) -> list[T.StructField]:
    return T._parse_datatype_string(schema).fields  # noqa: SLF001


def _row(key: Column, text_hash: Column) -> Column:
    """What a row is ordered and found by; a struct, so that null ids equal each other and come last."""
    return F.struct(key.isNull().alias("none"), key.alias("id"), text_hash.alias("hash"))


def shingle_sets(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """(class, shingles) of each different set of the column ``text``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHash()
        for batch in batches:
            for part in text_steps(batch, "text"):
                got = [shingles(t, hashes, words) for t in texts_of(part, "text")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(map(class_of, got)), pa.binary()), list_array(np.concatenate(got).view(np.int64), list(map(len, got)), pa.int64())],
                    names=["class", "shingles"])

    sets = texts.select("text").mapInArrow(run, "class binary, shingles array<long>")
    return sets.groupBy("class").agg(F.first("shingles").alias("shingles"))


def new_pairs(bands: np.ndarray, band: int, left: np.ndarray, right: np.ndarray, same: bool) -> np.ndarray:
    """Which pairs of ``left`` and ``right`` rows share no band before ``band``; if they are the ``same``, each pair once."""
    seen = np.zeros((len(left), len(right)), bool)
    for k in range(band):
        seen |= bands[left, k][:, None] == bands[right, k][None, :]
    new = ~seen
    return np.triu(new, 1) if same else new


def common_counts(sets: list[np.ndarray], wanted: np.ndarray, left: list[int], right: list[int]) -> np.ndarray:
    """Common shingles of each wanted pair (``left`` by ``right`` rows of ``sets``)."""
    out = np.zeros(wanted.shape, np.int64)
    pairs = np.argwhere(wanted)
    if len(pairs) <= 4 * (len(left) + len(right)):
        for i, j in pairs.tolist():
            out[i, j] = len(np.intersect1d(sets[left[i]], sets[right[j]], assume_unique=True))
        return out
    # many pairs: sums of products of 0/1 columns, a block of shingles at a time
    used = sorted(set(left) | set(right))
    place = {r: k for k, r in enumerate(used)}
    values, index, counts = np.unique(np.concatenate([sets[r] for r in used]), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(used)), [len(sets[r]) for r in used])
    shared = counts[index] > 1  # a shingle of one set only is common to no pair
    column = np.cumsum(counts > 1)[index] - 1
    column, owner = column[shared], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    rows_l, rows_r = [place[r] for r in left], [place[r] for r in right]
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [lo, lo + 4096])
        block = np.zeros((len(used), 4096), np.float32)
        block[owner[a:b], column[a:b] - lo] = 1
        out += (block[rows_l] @ block[rows_r].T).astype(np.int64)
    return out


def roots_of(linked: np.ndarray) -> np.ndarray:
    """The smallest row that each row of a symmetric link matrix is connected with."""
    root = np.arange(len(linked))
    while True:
        low = np.minimum(root, np.where(linked, root[None, :], len(linked)).min(axis=1, initial=len(linked)))
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _sides(cols: dict, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows of the two tiles of a group, and whether they are one tile."""
    if cols["ta"][lo] == cols["tb"][lo]:
        rows = np.arange(lo, hi)
        return rows, rows, True
    side = cols["tile"][lo:hi]
    return lo + np.flatnonzero(side == cols["ta"][lo]), lo + np.flatnonzero(side == cols["tb"][lo]), False


def _band_rows(cols: dict, lo: int, hi: int) -> np.ndarray:
    width = cols["bands"].offsets[lo + 1] - cols["bands"].offsets[lo]
    return cols["bands"].values[cols["bands"].offsets[lo]:cols["bands"].offsets[hi]].reshape(hi - lo, width)


def _needed(cols: dict, lo: int, hi: int) -> list[tuple]:
    """The rows of a group that have a pair which no earlier band has."""
    left, right, same = _sides(cols, lo, hi)
    new = new_pairs(_band_rows(cols, lo, hi), int(cols["band"][lo]), left - lo, right - lo, same)
    rows = np.union1d(left[new.any(axis=1)], right[new.any(axis=0)]).tolist()
    return [(cols["bucket"][r], cols["ta"][r], cols["tb"][r], cols["tile"][r], cols["band"][r], cols["class"][r], cols["copies"][r],
             cols["bands"].of(r)) for r in rows]


def _verify(threshold: Fraction):
    def verify(cols: dict, lo: int, hi: int) -> list[tuple]:
        """(class, its links with others here, root) of each class of the group that has a link."""
        left, right, same = _sides(cols, lo, hi)
        wanted = new_pairs(_band_rows(cols, lo, hi), int(cols["band"][lo]), left - lo, right - lo, same)
        sets = [cols["shingles"].of(r) for r in range(lo, hi)]
        size = np.array([len(s) for s in sets], np.int64)
        sl, sr = size[left - lo][:, None], size[right - lo][None, :]
        wanted &= np.minimum(sl, sr) * threshold.denominator >= np.maximum(sl, sr) * threshold.numerator
        common = common_counts(sets, wanted, (left - lo).tolist(), (right - lo).tolist())
        linked = wanted & (common * threshold.denominator >= (sl + sr - common) * threshold.numerator)
        if not linked.any():
            return []
        full = np.zeros((hi - lo, hi - lo), bool)
        full[np.ix_(left - lo, right - lo)] = linked
        full |= full.T
        links = full @ cols["copies"][lo:hi].astype(np.int64)
        root = roots_of(full)
        name = cols["class"][lo:hi]
        return [(name[r], links[r], name[root[r]]) for r in np.flatnonzero(links).tolist()]
    return verify


def tiles(members: DataFrame, tile_rows: int, order: str, weight: str | None = None, tile_weight: int = 1) -> DataFrame:
    """Each row of (``bucket``, ``members``, ...) once for every two tiles of its bucket that its own is one of."""
    count = F.ceil(F.col("members") / tile_rows)
    if weight:
        count = F.greatest(count, F.ceil(F.col(weight) / tile_weight))
    cut = (members.withColumn("_tiles", count.cast("int"))
           .withColumn("tile", F.pmod(F.xxhash64(order), F.col("_tiles")).cast("int"))
           .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1))))
    return cut.withColumn("ta", F.least("tile", "_other")).withColumn("tb", F.greatest("tile", "_other")).drop("_tiles", "_other")


def jaccard_join(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, words: int = WORDS,
                 recall: float = RECALL, tile_classes: int = TILE_CLASSES) -> DataFrame:
    """(key, class_id, n_links, component_id, kept, class_key) of each row; of a component the smallest id is kept.

    ``class_id`` and ``component_id`` are the smallest ids there; ``class_key`` is the digest of the row's set in
    hexadecimal (null without words), which tells classes apart that share an id or have none.
    """
    bands, rows = banding(threshold, recall)
    signed = cut_lineage(signatures(df, key, text, bands, rows, words))
    classes = cut_lineage(signed.filter("n > 0").groupBy("class")
                          .agg(F.min(_row(F.col("id"), F.col("hash"))).alias("first"), F.count("*").alias("copies"),
                               F.first("n").alias("n"), F.first("bands").alias("bands")))
    spread = classes.select("class", "n", F.posexplode("bands").alias("band", "bucket"))
    shared = spread.groupBy("bucket").agg(F.count("*").alias("members"), F.sum("n").alias("weight")).filter("members > 1")
    members = spread.join(shared, "bucket").join(classes.select("class", "copies", "bands"), "class")
    met = tiles(members, tile_classes, "class", "weight", TILE_SHINGLES)
    needed = cut_lineage(map_groups(met.select("bucket", "ta", "tb", "tile", "band", "class", "copies", "bands"), ["bucket", "ta", "tb"], [], _needed,
                                    "bucket long, ta int, tb int, tile int, band int, class binary, copies long, bands array<long>"))
    wanted = classes.select("class", "first").join(needed.select("class").distinct(), "class", "left_semi").select("first")
    texts = (df.select(_row(F.col(key), F.xxhash64(text)).alias("first"), F.col(text).alias("text"))
             .join(wanted, "first", "left_semi"))
    found = cut_lineage(map_groups(needed.join(shingle_sets(texts, words), "class"), ["bucket", "ta", "tb"], [], _verify(Fraction(str(threshold))),
                                   "class binary, links long, root binary"))
    linked = found.groupBy("class").agg(F.sum("links").alias("links"))
    groups = components(found, "class", "root").withColumnRenamed("id", "class")
    lowest = (groups.join(classes.select("class", "first"), "class")
              .groupBy("component").agg(F.min("first").alias("kept_row")))
    result = (classes.select("class", "first", "copies").join(linked, "class", "left")
              .join(groups.join(lowest, "component").select("class", "kept_row"), "class", "left")
              .select("class", F.col("first.id").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                      F.coalesce("kept_row", "first").alias("kept_row")))
    placed = signed.select("id", "hash", "class").join(result, "class", "left").withColumn("row", _row(F.col("id"), F.col("hash")))
    alone = F.col("class").isNull()
    return placed.select(
        F.col("id").alias(key), F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(alone, F.col("id")).otherwise(F.col("kept_row.id")).alias("component_id"),
        (alone | (F.col("row") == F.col("kept_row"))).alias("kept"), F.lower(F.hex("class")).alias("class_key"))
