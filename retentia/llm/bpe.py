"""Byte-level BPE encoding and decoding (operator 3).

A pre-token's bytes form a linked list.  Adjacent pairs that have a merge rank wait in a queue: one bucket of
positions for each rank, and a bitmap of two levels that says which buckets hold something, so that the next
rank is found by find-first-set.  A merge leaves the entries of the two neighbouring pairs behind; they are
stale, and are skipped when they come up.  A pre-token of n bytes takes O(n) queue steps, however long it is.

Defined cases: a null or empty text has no ids and decodes to no bytes; every row is kept, repeated rows are
encoded each by itself; other columns pass unchanged.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from retentia.llm.common import fresh, list_array, no_cycle_search, text_steps, texts_of

#: Bits of a word of the bitmap's lower level.
WORD = 8
#: Bytes of text that are encoded at a time; the more, the more pre-tokens share a step of the queue.
ENCODE_BYTES = 4 << 20
#: Characters of new segments whose pre-tokens are cut and merged at a time, with many small objects for each; at
#: least so many, and a fourth of a step's bytes.  The queue's steps hardly grow with them, so that more are cheaper.
LEARN_CHARS = 1 << 18
#: Two ids as one key.
PAIR = 1 << 32
#: Pre-tokens of more bytes are merged one by one, the others many at a time.
LONG_PIECE = 256
#: What stands behind a space and is remembered: about so many, of at most so many characters.
MEMO_ENTRIES, MEMO_CHARS = 300_000, 40
#: Marks that are neither letters, digits, white space nor an apostrophe.
MARKS = ".,;:!?"


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from the lines ``base64 rank`` of a rank file."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class RankQueue:
    """Positions by merge rank; ``pop`` gives the lowest rank's leftmost position."""

    def __init__(self) -> None:
        self.top, self.words, self.buckets = 0, {}, {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heapq.heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        hi = rank >> WORD
        self.words[hi] = self.words.get(hi, 0) | 1 << (rank & (1 << WORD) - 1)
        self.top |= 1 << hi

    def pop(self) -> tuple[int, int] | None:
        if not self.top:
            return None
        hi = (self.top & -self.top).bit_length() - 1
        word = self.words[hi]
        low = word & -word
        rank = hi << WORD | low.bit_length() - 1
        bucket = self.buckets[rank]
        position = heapq.heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.words[hi] = word ^ low
            if word == low:
                self.top ^= 1 << hi
        return rank, position


class PieceQueue:
    """The queue over many short pre-tokens at once: one linked list, in which no pair reaches over a border.

    A step takes the lowest waiting rank and merges, in every pre-token that has it, the leftmost pair of that
    rank; pre-tokens do not touch each other, so each one sees its own merges in their order.
    """

    def __init__(self, pairs: tuple[np.ndarray, np.ndarray], byte_ids: np.ndarray) -> None:
        (self.keys, self.ranks), self.byte_ids = pairs, byte_ids

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that two neighbours make, -1 if there is none."""
        key = left.astype(np.int64) * PAIR + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], -1)

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each pre-token."""
        flat, ends = self.merge_flat(pieces)
        return [part.tolist() for part in np.split(flat, ends[:-1])]

    def merge_flat(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pre-tokens one after another, and where each one's end."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        n = int(sizes.sum())
        token = np.full(n + 1, -1, np.int32)  # the last place stands for "none"
        token[:n] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        ends = np.cumsum(sizes) - 1
        after[ends], before[ends - sizes + 1] = n, n
        due = np.full(n + 1, -1, np.int32)
        due[:n] = self.rank_of(token[:n], token[after[:n]])
        top, words, buckets = 0, {}, {}

        def push(ranks: np.ndarray, places: np.ndarray) -> None:
            nonlocal top
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for rank, part in zip(ranks[np.r_[0, cuts]].tolist(), np.split(places, cuts)):
                if rank in buckets:
                    buckets[rank].append(part)
                    continue
                buckets[rank] = [part]
                hi = rank >> WORD
                words[hi] = words.get(hi, 0) | 1 << (rank & (1 << WORD) - 1)
                top |= 1 << hi

        if len(first := np.flatnonzero(due >= 0)):
            push(due[first], first)
        while top:
            hi = (top & -top).bit_length() - 1
            low = words[hi] & -words[hi]
            rank = hi << WORD | low.bit_length() - 1
            places = buckets.pop(rank)
            words[hi] ^= low
            if not words[hi]:
                top ^= 1 << hi
            i = np.unique(np.concatenate(places)) if len(places) > 1 else np.sort(places[0])
            i = i[due[i] == rank]  # the others are stale
            if not len(i):
                continue
            first = np.ones(len(i), bool)
            np.not_equal(owner[i[1:]], owner[i[:-1]], out=first[1:])
            later, i = i[~first], i[first]
            j = after[i]
            k = after[j]
            token[i], token[j], due[j] = rank, -1, -1
            after[i] = k
            before[k] = i
            before[n] = n
            h = before[i]
            places = np.concatenate([i, h])
            due[places] = ranks = self.rank_of(token[places], np.concatenate([token[k], token[i]]))
            due[n] = -1
            live = ranks >= 0
            if len(later):
                ranks, places, live = np.r_[ranks, np.full(len(later), rank)], np.r_[places, later], np.r_[live, np.ones(len(later), bool)]
            if live.any():
                push(ranks[live], places[live])
        kept = token[:n] >= 0
        return token[:n][kept], np.cumsum(np.bincount(owner[kept], minlength=len(pieces)))


class Bpe:
    """Encoder and decoder of one vocabulary and one splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.tokens = {r: t for t, r in ranks.items()}
        self.plain = regex.compile(r"\s\s|^\s|\s$").search  # whitespace that a split at spaces would part
        self.memo: dict[str, bytes] = {}
        byte_ids = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        self.queue = PieceQueue(_pairs(ranks), byte_ids)

    def long_piece(self, data: bytes) -> list[int]:
        """Ids of one long pre-token, merge by merge."""
        ranks, n = self.ranks, len(data)
        end = list(range(1, n + 1))  # of the part that begins here; 0: no part begins here
        before = list(range(-1, n - 1))
        due = [-1] * n  # rank of the pair that begins here
        queue = RankQueue()
        for i in range(n - 1):
            if (r := ranks.get(data[i:i + 2])) is not None:
                due[i] = r
                queue.push(r, i)
        while (got := queue.pop()) is not None:
            rank, i = got
            if due[i] != rank or not end[i]:
                continue  # stale
            j = end[i]
            end[i] = end[j]
            end[j], due[j] = 0, -1
            if end[i] < n:
                before[end[i]] = i
            for k in (before[i], i):
                if k >= 0:
                    nxt = end[k]
                    r = ranks.get(data[k:end[nxt]]) if nxt < n else None
                    due[k] = -1 if r is None else r
                    if r is not None:
                        queue.push(r, k)
        ids, i = [], 0
        while i < n:
            ids.append(ranks[data[i:end[i]]])
            i = end[i]
        return ids

    def pieces(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of each pre-token as bytes of 32-bit numbers."""
        out: dict[str, bytes] = {}
        short: list[str] = []
        coded: list[bytes] = []
        for p in pieces:
            data = p.encode()
            if (whole := self.ranks.get(data)) is not None:
                out[p] = array("i", (whole,)).tobytes()
            elif len(data) > LONG_PIECE:
                out[p] = array("i", self.long_piece(data)).tobytes()
            else:
                short.append(p)
                coded.append(data)
        if short:
            flat, ends = self.queue.merge_flat(coded)
            ids, lo = flat.tobytes(), 0
            for p, hi in zip(short, (ends * 4).tolist()):
                out[p] = ids[lo:hi]
                lo = hi
        return out

    def cut(self, segment: str) -> list[str]:
        """Pre-tokens of a segment; the usual ones, letters and perhaps one mark behind them, without the pattern."""
        bare = segment[1:] if segment[:1] == " " else segment
        if bare.isalpha():
            return [segment]
        if bare[-1:] in MARKS and bare[:-1].isalpha():
            return [segment[:-1], segment[-1]]
        return self.split(segment)

    def learn(self, unknown: set[str], before: str, memo: dict[str, bytes], at_a_time: int) -> None:
        """Adds the ids of the segments ``before + s`` to ``memo``, as bytes of 32-bit numbers."""
        some, chars = [], 0
        for s in unknown:
            some.append(s)
            chars += len(s) + 1
            if chars >= at_a_time:
                self.learn_some(some, before, memo)
                some, chars = [], 0
        if some:
            self.learn_some(some, before, memo)

    def learn_some(self, unknown: list[str], before: str, memo: dict[str, bytes]) -> None:
        """``learn`` for as many segments as are worked on at a time."""
        parts = {s: self.cut(before + s) for s in unknown}
        needed = set(chain.from_iterable(parts.values()))
        known = {}
        if before:  # a pre-token that begins with the space may have been a segment of its own before
            had = [p for p in needed if p[0] == " " and p[1:] in memo and p[1:].isalpha()]
            known = {p: memo[p[1:]] for p in had}
        known.update(self.pieces(needed.difference(known)))
        for s, p in parts.items():
            memo[s] = known[p[0]] if len(p) == 1 else b"".join(map(known.__getitem__, p))

    def encode_all(self, texts: list[str], step_bytes: int = 0) -> list[bytes]:
        """Ids of each text as bytes of 32-bit numbers; each match of the pattern is merged by itself.

        No match reaches over a single space between two non-spaces except as its first character, so a text
        whose white space is such is cut at its spaces.  What stands behind a space repeats often and is
        remembered; after a batch only what that batch had stays, if there is too much of it.
        """
        whole = [bool(self.plain(t)) for t in texts]
        heads, seen = set(), set()  # what stands before a text's first space, and what stands behind spaces
        for t, w in zip(texts, whole):
            head, *tail = [t] if w else t.split(" ")
            heads.add(head)
            seen.update(tail)
        memo, first, at_a_time = self.memo, {}, max(LEARN_CHARS, step_bytes // 4)
        self.learn(seen.difference(memo), " ", memo, at_a_time)
        self.learn(heads, "", first, at_a_time)
        behind, out = memo.__getitem__, []
        for t, w in zip(texts, whole):  # split again rather than hold all parts of all texts
            head, *tail = [t] if w else t.split(" ")
            out.append(b"".join([first[head], *map(behind, tail)]))
        if len(memo) > MEMO_ENTRIES:
            self.memo = {s: memo[s] for s in seen if len(s) <= MEMO_CHARS}
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_all([text])[0], np.int32).tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def _pairs(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Every two tokens that join to a token, as sorted keys, and the rank of what they make."""
    keys, made = [], []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
            if a is not None and b is not None:
                keys.append(a * PAIR + b)
                made.append(rank)
    order = np.argsort(np.array(keys, np.int64)) if keys else np.zeros(0, np.int64)
    if not keys:
        return np.array([-1]), np.array([-1], np.int32)
    return np.array(keys, np.int64)[order], np.array(made, np.int32)[order]


_LOADED: dict[tuple[int, str], Bpe] = {}


def _bpe(data: bytes, pattern: str) -> Bpe:
    """The worker's encoder: built once in a Python process, used by all its tasks."""
    key = (hash(data), pattern)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Bpe(load_ranks(data), pattern)
    return _LOADED[key]


def _decoded(ids: np.ndarray, lengths: list[int], tokens: dict[int, bytes]) -> list[bytes]:
    """The bytes of each list of ids; the lists stand one after another."""
    token, at, out = tokens.__getitem__, 0, []
    for n in lengths:
        out.append(b"".join(map(token, ids[at:at + n].tolist())))
        at += n
    return out


def encode(df: DataFrame, rank_file: bytes, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None,
           step_bytes: int = ENCODE_BYTES) -> DataFrame:
    """``df`` with the column ``ids`` (array of int) and, if ``decoded`` names it, what the ids decode to (binary).

    Texts are encoded ``step_bytes`` at a time; fewer need less memory and more time.  A new column whose name is taken gets underscores in front.
    """
    new = [T.StructField(fresh(ids, df.columns), T.ArrayType(T.IntegerType(), False), False)]
    if decoded:
        new.append(T.StructField(fresh(decoded, [*df.columns, new[0].name]), T.BinaryType(), False))
    data = df.sparkSession.sparkContext.broadcast(rank_file)  # a vocabulary: below 1 MB
    schema = T.StructType([*df.schema.fields, *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(data.value, pattern)
        for batch in batches:
            for part in text_steps(batch, text, step_bytes):
                with no_cycle_search():
                    got = bpe.encode_all(texts_of(part, text), step_bytes)
                flat, lengths = np.frombuffer(b"".join(got), np.int32), [len(x) // 4 for x in got]
                cols = [list_array(flat, lengths, pa.int32())]
                if decoded:
                    cols.append(pa.array(_decoded(flat, lengths, bpe.tokens), pa.binary()))
                yield pa.RecordBatch.from_arrays([*part.columns, *cols], names=[f.name for f in schema])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, rank_file: bytes, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes that ``ids`` stand for as the column ``out``; a null list decodes to no bytes."""
    out = fresh(out, df.columns)
    data = df.sparkSession.sparkContext.broadcast(rank_file)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {r: t for t, r in load_ranks(data.value).items()}
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                lists = part.column(part.schema.get_field_index(ids))
                lengths = lists.value_lengths().fill_null(0).to_pylist()
                got = _decoded(lists.flatten().to_numpy(zero_copy_only=False), lengths, tokens)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.binary())], names=[*part.schema.names, out])

    return df.mapInArrow(run, schema)
