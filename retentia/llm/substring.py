"""Substring deduplication by content-defined chunking (operator 9).

A gear hash rolls over a text's bytes.  A chunk begins at a word whose preceding ``WINDOW`` bytes hash below a
threshold, so that the same words are cut in the same way wherever they stand, and an insertion moves no cut beyond
its neighbourhood.  In a run of more than ``LONG_WORD`` bytes without white space (Chinese, Japanese, Thai, encoded
text) a chunk may begin at any character: where the hash falls below the threshold and that of the character before
does not, so that one character again and again makes no cuts.  Such a run counts as a word for every ``WORD_BYTES``
bytes.  Only a stretch that is still without a cut is divided every ``MAX_CHUNK`` bytes from its start, and that counts
as the words that begin in it.

A chunk alone is a few words and may recur by chance; the digest that is compared covers a chunk and the one after
it.  Digests that occur more than once, anywhere, mark their two chunks as repeated.  A run of repeated chunks of
``MIN_WORDS`` words or more is a repeated passage.  Of each digest the occurrence with the smallest (id, place) is
the first; a run of ``MIN_WORDS`` words of chunks that are not covered by a first occurrence is taken out.

The text does not go through the digests' shuffles, only (digest, id, variant, place); the variant is the hash of the
text where an id has several texts, else 0.  Digests have 64 bits; a passage needs several in a row, so that one
collision takes nothing out.  A digest that a large part of all rows has is counted by partial sums, and its rows are
dealt over ``SALTS`` places of the join; there are at most ``FREQUENT`` such digests, by the share that makes one.

Defined cases: a null text stays null, an empty one empty, both without passages; rows that share an id but not the
text are documents of their own, rows that share both are one document that holds each passage once, and all of them
are treated alike; a null id leaves its row as it is and takes no part; repeated passages within one document are
passages too; other columns pass unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentia.llm.common import cut_lineage, fresh, small_side, text_steps

#: Bytes that the rolling hash sees, mean words of a chunk, its largest size in bytes, words of a passage.
WINDOW, CHUNK_WORDS, MAX_CHUNK, MIN_WORDS = 8, 5, 256, 18
#: Bytes above which a run without white space is cut inside, and bytes of it that count as a word.
LONG_WORD, WORD_BYTES = 48, 6
#: Mean characters of a chunk inside such a run, after a character of one byte and after a longer one.
RUN_CHARS = (CHUNK_WORDS * WORD_BYTES, CHUNK_WORDS * WORD_BYTES // 3)

#: Digests that may be called frequent (each has more than this part of all repeated places), and places that one's rows are dealt over.
FREQUENT, SALTS = 2048, 64

#: One random 32-bit number for each byte; any fixed seed will do, but it must stay the same.
GEAR = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 32, 256, dtype=np.uint32)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def gear_hash(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of the ``WINDOW`` bytes before each place: the sum of their numbers, each shifted by its distance (32 bits)."""
    h = np.zeros(len(at), np.uint32)
    for t in range(WINDOW):
        h += GEAR[data[at - 1 - t]] << np.uint32(t)
    return h


def long_runs(words: np.ndarray, space: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of more than ``LONG_WORD`` bytes without white space."""
    n = len(space)
    begin = words[np.diff(np.append(words, n)) > LONG_WORD]
    if not len(begin):
        return begin, begin
    stops = np.union1d(np.flatnonzero(space), np.append(firsts, n))
    end = stops[np.searchsorted(stops, begin, side="right")]
    return begin[end - begin > LONG_WORD], end[end - begin > LONG_WORD]


def chunk_starts(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where chunks begin in ``data``, texts one after another that begin at ``starts``; and where words begin.

    A long run that is cut by its content has a word every ``WORD_BYTES`` bytes.
    """
    n = len(data)
    firsts = starts[starts < n]
    space = _SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    begins[firsts] = ~space[firsts]
    words = np.flatnonzero(begins)
    early = np.zeros(n + WINDOW, bool)  # the window would reach into the text before
    for k in range(WINDOW):
        early[firsts + k] = True
    inner = words[~early[words]]
    cut = np.zeros(n, bool)
    cut[inner[gear_hash(data, inner) < np.uint32((1 << 32) // CHUNK_WORDS)]] = True
    run_from, run_to = long_runs(words, space, firsts)
    inside = np.concatenate([np.arange(a, b) for a, b in zip(run_from.tolist(), run_to.tolist())]) if len(run_from) else run_from
    if len(inside):
        since = inside - np.repeat(run_from, run_to - run_from)
        at = inside[((data[inside] & 0xC0) != 0x80) & (since > 0) & ~early[inside]]
        chars = np.where(data[at - 1] >= 0x80, RUN_CHARS[1], RUN_CHARS[0])
        low = gear_hash(data, at) < (1 << 32) // chars
        low[1:] &= ~low[:-1]
        cut[at[low]] = True
        inside = inside[(since > 0) & (since % WORD_BYTES == 0)]
    cut[firsts] = True
    cuts = np.flatnonzero(cut)
    ends = np.append(cuts[1:], n)
    long = np.flatnonzero(ends - cuts > MAX_CHUNK)
    if len(inside):
        words = np.union1d(words, inside[~np.isin(np.searchsorted(cuts, inside, side="right") - 1, long)])
    if len(long):
        more = np.concatenate([np.arange(cuts[k] + MAX_CHUNK, ends[k], MAX_CHUNK) for k in long])
        for _ in range(3):  # not inside a character
            more = more + ((more < n) & ((data[np.minimum(more, n - 1)] & 0xC0) == 0x80))
        cuts = np.union1d(cuts, more[more < n])
    return cuts, words


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts (a null has none), and where each text begins, with the end."""
    import pyarrow.compute as pc

    texts = pc.fill_null(texts, "").cast(pa.large_string())
    texts = pa.concat_arrays([texts])
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def digests(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every chunk that has another after it in its text: the row, its place in the text, and the pair's digest."""
    data, offsets = _flat(texts)
    cuts, _ = chunk_starts(data, offsets[:-1])
    if not len(cuts):
        none = np.zeros(0, np.int64)
        return none, none, none
    ends = np.append(cuts[1:], len(data))
    raw, digest = data.tobytes(), xxhash.xxh3_64_intdigest
    one = np.fromiter((digest(raw[a:b]) for a, b in zip(cuts.tolist(), ends.tolist())), np.uint64, len(cuts))
    row = np.searchsorted(offsets, cuts, side="right") - 1
    place = np.arange(len(cuts)) - np.searchsorted(row, row)
    pair = np.flatnonzero(row[1:] == row[:-1])
    with np.errstate(over="ignore"):
        mixed = one[pair] * np.uint64(0x9E3779B97F4A7C15) + (one[pair + 1] ^ (one[pair + 1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
    return row[pair], place[pair], mixed.view(np.int64)


def with_variant(df: DataFrame, key: str, text: str, variant: str) -> DataFrame:
    """``df`` with the column ``variant``: the hash of the text where its id has several texts, else 0."""
    several, marked = fresh("_several", df.columns), fresh("_id", df.columns)
    h = F.xxhash64(text)
    shared = cut_lineage(df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias(marked)).agg(F.min(h).alias("low"), F.max(h).alias("high"))
                         .filter("low <> high").select(marked, F.lit(True).alias(several)))
    joined = df.join(small_side(shared), F.col(key) == F.col(marked), "left")
    return joined.withColumn(variant, F.when(F.col(several), h).otherwise(F.lit(0).cast("long"))).drop(several, marked)


def pairs_of(df: DataFrame, key: str = "doc_id", text: str = "text", variant: str = "variant") -> DataFrame:
    """(digest, id, variant, place) of every two neighbouring chunks of every text."""
    schema = T.StructType([T.StructField("digest", T.LongType()), T.StructField("id", df.schema[key].dataType),
                           T.StructField("variant", T.LongType()), T.StructField("place", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_steps(batch, "text"):
                row, place, digest = digests(part.column(2))
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(digest), part.column(0).take(row), part.column(1).take(row), pa.array(place.astype(np.int32))],
                                                 names=schema.names)

    return (df.select(F.col(key).alias("id"), F.col(variant).alias("variant"), F.col(text).alias("text"))
            .filter("id IS NOT NULL").mapInArrow(run, schema))


def repeated(df: DataFrame, key: str = "doc_id", text: str = "text", variant: str = "variant") -> DataFrame:
    """Of each (id, variant) the places of its digests that occur more than once: twice the place, and one more if it is the first."""
    pairs = pairs_of(df, key, text, variant)
    where = F.struct("id", "variant", "place")
    often = cut_lineage(pairs.groupBy("digest").agg(F.count("*").alias("n"), F.min(where).alias("first")).filter("n > 1"))
    total = often.agg(F.sum("n")).first()[0] or 0
    frequent = often.filter(F.col("n") * FREQUENT > total).select("digest", F.lit(True).alias("is_frequent"))
    salts = F.when(F.col("is_frequent"), F.lit(SALTS)).otherwise(F.lit(1))
    dealt = (pairs.join(F.broadcast(frequent), "digest", "left")  # fewer than FREQUENT rows
             .withColumn("salt", F.pmod(F.xxhash64("id", "variant", "place"), salts).cast("int")).drop("is_frequent"))
    is_frequent = F.coalesce(F.col("n") * FREQUENT > total, F.lit(False))
    firsts = often.select("digest", "first", F.explode(F.sequence(F.lit(0), F.when(is_frequent, SALTS - 1).otherwise(0))).alias("salt"))
    hits = dealt.join(firsts, ["digest", "salt"]).select("id", "variant", (F.col("place") * 2 + (where == F.col("first")).cast("int")).alias("hit"))
    return hits.groupBy("id", "variant").agg(F.collect_set("hit").alias("hits"))


def runs(marked: np.ndarray, words: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    """Runs [from, to) of marked chunks that hold ``min_words`` words or more."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marked.astype(np.int8), [0]])))
    total = np.concatenate([[0], np.cumsum(words)])
    return [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) if total[b] - total[a] >= min_words]


def passages(text: str, hits: list[tuple[int, bool]], min_words: int = MIN_WORDS) -> tuple[list[tuple[int, int]], list[tuple[int, int]], int, int]:
    """Byte spans of the repeated passages and of those to take out, and the words of either."""
    raw = np.frombuffer(text.encode(), np.uint8)
    cuts, words = chunk_starts(raw, np.zeros(1, np.int64))
    ends = np.append(cuts[1:], len(raw))
    count = np.diff(np.append(np.searchsorted(words, cuts), len(words)))
    again, first = np.zeros(len(cuts), bool), np.zeros(len(cuts), bool)
    for place, is_first in hits:
        again[place:place + 2] = True
        if is_first:
            first[place:place + 2] = True
    found = []
    for marked in (again, again & ~first):
        got = runs(marked, count, min_words)
        found.append(([(int(cuts[a]), int(ends[b - 1])) for a, b in got], int(sum(count[a:b].sum() for a, b in got))))
    return found[0][0], found[1][0], found[0][1], found[1][1]


def without(text: str, spans: list[tuple[int, int]]) -> str:
    raw, at, kept = text.encode(), 0, []
    for a, b in spans:
        kept.append(raw[at:a])
        at = b
    return b"".join([*kept, raw[at:]]).decode()


_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``df`` with the repeated passages taken out of ``text``.

    New columns: ``repeated_words`` and ``removed_words``, and ``repeated_spans`` and ``removed_spans`` as bytes
    [start, end) of the text as it was.
    """
    names = [fresh(n, df.columns) for n in ("repeated_words", "removed_words", "repeated_spans", "removed_spans")]
    extra = [T.StructField(n, k) for n, k in zip(names, (T.LongType(), T.LongType(), _SPAN, _SPAN))]
    schema = T.StructType([*df.schema.fields, *extra])
    hits_name, id_name, variant, of_variant = (fresh(n, df.columns) for n in ("_hits", "_hit_id", "_variant", "_hit_variant"))
    varied = with_variant(df, key, text, variant)
    hits = repeated(varied, key, text, variant).select(F.col("id").alias(id_name), F.col("variant").alias(of_variant), F.col("hits").alias(hits_name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in batches:
            for part in text_steps(batch, text):
                at = part.schema.get_field_index(text)
                texts, found = part.column(at).to_pylist(), part.column(part.schema.get_field_index(hits_name)).to_pylist()
                rows = []
                for k, (t, h) in enumerate(zip(texts, found)):
                    if not h or not t:
                        rows.append((0, 0, [], []))
                        continue
                    again, out, n_again, n_out = passages(t, [(x >> 1, bool(x & 1)) for x in h], min_words)
                    texts[k] = without(t, out)
                    rows.append((n_again, n_out, *[[{"start": a, "end": b} for a, b in s] for s in (again, out)]))
                cols = [part.column(i) for i in range(part.num_columns - 1)]
                cols[at] = pa.array(texts, part.schema.field(at).type)
                cols += [pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(zip(*rows), extra)]
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema])

    joined = (varied.join(hits, (F.col(key) == F.col(id_name)) & (F.col(variant) == F.col(of_variant)), "left")
              .drop(id_name, variant, of_variant))
    return joined.mapInArrow(run, schema)
