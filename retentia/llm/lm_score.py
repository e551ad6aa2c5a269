"""Language-model scoring by cross-entropy difference (operator 2).

Two bigram models, one of the target documents and one of all documents, share one vocabulary: the words that stand
twice or more, and a class for each shape of the others.  The models are matched: same order, same vocabulary, same
pairs, same smoothing, and the background's counts are scaled to the target's number of tokens.  Pairs of that
vocabulary that stand twice or more have counts of their own; the rest of a context's mass goes to its pairs by the
words' own probabilities.  A document's score is the mean over its tokens of the loss under the target model less the
loss under the background model; the lower, the more the document is like the target.  A document's own tokens are
taken out of the counts before it is scored, so that neither model knows it by heart.

Counts cover every token of every document.  A task packs its documents into blocks: the different words, and the
tokens as numbers of them.  A block adds up its own keys (words; then pairs; then, for each word, its pairs with counts
of their own) and asks once for each: the sorted keys and their counts are dealt out by ranges of the keys, summed over
all blocks, and what the other blocks have goes back in the same order.  So every count is shuffled, as differences of
sorted numbers instead of as rows, and no table stands whole in one task.  Words and pairs are told apart by 59 and 60
bits of their hashes, texts by 64.

Words: runs of letters, digits and underscores as they stand, and every other mark by itself, so that the models also
see how a text is punctuated and spelt.  Defined cases: a text that is null or has no word has 0 tokens and null
losses and score; without target documents, or without words in them, all scores are null; rows that share an id
are counted and scored each by itself; a null flag is no target; an empty table gives an empty result; other
columns pass unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentia.llm.common import cut_lineage, fresh, text_steps, texts_of

#: No longer used: every count reaches the blocks that ask for it, whatever its share.
WORD_SHARE, PAIR_SHARE = 2e-5, 2e-6
#: Share of a word's probability that is equal for all words; counts that every context adds for words it has not seen.
UNIFORM, UNSEEN = 0.01, 5.0
#: Tokens of a block (more, if its last documents have them) and of the documents that are scored together.
BLOCK_TOKENS, STEP_TOKENS = 1_000_000, 100_000
#: Bytes of text that are cut into words together.
STEP_BYTES = 1 << 20
#: Tokens for each range of keys.
RANGE_TOKENS = 4_000_000

#: A word, or one mark.
_TOKENS = re.compile(r"\w+|[^\w\s]").findall
#: Ids of the classes of words outside the vocabulary come first, then a document's start, then the vocabulary.
_SHAPES = 2 * 6
_START, _FIRST_WORD = _SHAPES, _SHAPES + 1


def shape_of(word: str) -> int:
    """The class of a word outside the vocabulary."""
    kind = 0 if word.isdigit() else 1 if word.isupper() else 2 if word.istitle() else 3 if word.islower() else 4 if word.isalnum() else 5
    return kind + 6 * (not word.isascii())


#: What a character is; the last: upper or title case after a letter with case, or lower case after none.
_DIGIT, _ALNUM, _UPPER, _TITLE, _LOWER, _NOT_ASCII, _NOT_TITLED = (np.uint8(1 << i) for i in range(7))


class Numbers(dict):
    """Of the characters met so far the kind (1 if it belongs to a word, 2 if it is a mark, 0 if it is white space) and what it is."""

    def __missing__(self, code: int) -> tuple[int, int]:
        c = chr(code)
        kind = 0 if c.isspace() else 1 if re.match(r"\w", c) else 2
        flags = (c.isdigit(), c.isalnum(), c.isupper(), c.istitle() and not c.isupper(), c.islower(), not c.isascii())
        self[code] = out = kind, sum(x << i for i, x in enumerate(flags))
        return out

    def of(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        there = np.flatnonzero(np.bincount(chars))
        table = np.zeros((2, there[-1] + 1 if len(there) else 1), np.uint8)
        table[:, there] = np.array([self[c] for c in there.tolist()], np.uint8).reshape(-1, 2).T
        return table[0][chars], table[1][chars]


def words_of(texts: list[str], memo: Numbers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The numbers of the different words; for each token, text after text, its place among them; how many each text has.

    The tokens are those of ``_TOKENS``.  A word's hash is the sum of 64 pseudo-random bits for each of its characters
    at its place in the word.
    """
    text = "\n".join(texts)
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind, flags = memo.of(chars)
    begins = kind == 2
    begins[:1] |= kind[:1] == 1
    begins[1:] |= (kind[1:] == 1) & (kind[:-1] != 1)
    inside, starts = np.flatnonzero(kind), np.flatnonzero(begins)
    at = np.cumsum(kind > 0)[starts] - 1
    lengths = np.diff(at, append=len(inside))
    bits = chars[inside].astype(np.uint64) << np.uint64(32)
    bits += (np.arange(len(inside)) - np.repeat(at, lengths)).astype(np.uint64)
    with np.errstate(over="ignore"):
        for step, by in ((32, 0x9E3779B97F4A7C15), (30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            bits ^= bits >> np.uint64(step)
            bits *= np.uint64(by)
        bits ^= bits >> np.uint64(31)
        hashes = np.add.reduceat(bits, at) if len(at) else bits
    hashes, first, place = np.unique(hashes, return_index=True, return_inverse=True)
    cased = (flags & (_UPPER | _TITLE | _LOWER)) > 0
    after = np.zeros(len(flags), bool)
    after[1:] = cased[:-1]
    after[starts] = False
    flags |= np.where(after, (flags & (_UPPER | _TITLE)) > 0, (flags & _LOWER) > 0) * _NOT_TITLED
    flags = flags[inside]
    has, every = (f.reduceat(flags, at)[first] if len(at) else flags for f in (np.bitwise_or, np.bitwise_and))
    case = has & (_UPPER | _TITLE | _LOWER)
    shapes = np.select([every & _DIGIT > 0, case == _UPPER, (case > 0) & (has & _NOT_TITLED == 0), case == _LOWER, every & _ALNUM > 0], range(5), 5)  # as shape_of
    numbers = (hashes >> np.uint64(5) << np.uint64(4)).view(np.int64) | (shapes + 6 * (has & _NOT_ASCII > 0))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return numbers, place, np.diff(np.searchsorted(starts, ends), prepend=0)


def tokens_of(texts: list[str], memo: Numbers) -> tuple[np.ndarray, np.ndarray]:
    """The number of each token, text after text, and how many each text has."""
    numbers, places, sizes = words_of(texts, memo)
    return numbers[places], sizes


def befores(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The id before each token, the start's for a text's first one."""
    out = np.empty_like(ids)
    out[1:] = ids[:-1]
    out[(np.cumsum(sizes) - sizes)[sizes > 0]] = _START
    return out


def pair_keys(before: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """60 bits of a hash of both and, in the lowest 4 bits, 15, which no word has."""
    with np.errstate(over="ignore"):
        h = before.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h = ((h ^ (h >> np.uint64(32))) + ids.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(32))) | np.uint64(15)).view(np.int64)


def _packed(values: np.ndarray) -> bytes:
    """64-bit numbers in few bytes, if most are small: first the lowest byte of each, last the highest."""
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(values.astype(np.int64)).view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def _column(part: pa.RecordBatch, name: str) -> np.ndarray:
    return part.column(part.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _groups(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different codes (0 or more) in order, the places of all in the order of their codes, and where each code begins there."""
    n = len(codes)
    bits = n.bit_length()
    if n and int(codes.max()).bit_length() + bits < 64:  # sorting numbers is several times as fast as sorting places
        both = np.sort(codes << bits | np.arange(n))
        order, codes = both & ((1 << bits) - 1), both >> bits
    else:
        order = np.argsort(codes, kind="stable")
        codes = codes[order]
    starts = np.flatnonzero(np.concatenate([np.ones(min(n, 1), bool), codes[1:] != codes[:-1]]))
    return codes[starts], order, starts


def _group_of(order: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each place the number of its group."""
    out = np.empty_like(order)
    out[order] = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(order)))
    return out


def _added(weights: np.ndarray, index: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(index, weights, size).astype(np.int64)


BLOCK = "docs array<long>, targets array<boolean>, sizes array<long>, n_tokens long, n_target long, words binary, tokens binary"
ASKS = "part int, block long, keys binary, target binary, background binary"
ANSWERS = "block long, part int, target binary, background binary, stats array<long>"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (_doc, text, target) packed into blocks; words by falling frequency, so that most numbers are small."""
    memo, held, n = Numbers(), [], 0

    def block() -> pa.RecordBatch:
        numbers, places, sizes, docs, targets = zip(*held)
        words, of = np.unique(np.concatenate(numbers), return_inverse=True)
        ends = np.cumsum([len(x) for x in numbers])
        tokens = np.concatenate([x[p] for x, p in zip(np.split(of, ends[:-1]), places)])
        sizes, docs, targets = (np.concatenate(x) for x in (sizes, docs, targets))
        order = np.argsort(-np.bincount(tokens, minlength=len(words)), kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        row = [docs, targets.astype(bool), sizes, len(tokens), int(sizes[targets.astype(bool)].sum()), _packed(words[order]), _packed(rank[tokens])]
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=[c.split()[0] for c in BLOCK.split(", ")])

    for batch in batches:
        for part in text_steps(batch, "text", STEP_BYTES):
            held.append((*words_of(texts_of(part, "text"), memo), _column(part, "_doc"), _column(part, "target")))
            n += len(held[-1][1])
            if n >= BLOCK_TOKENS:
                yield block()
                held, n = [], 0
    if held:
        yield block()


def _asks(block: int, keys: np.ndarray, target: np.ndarray, background: np.ndarray, bits: int, parts: int) -> pa.RecordBatch:
    """A row for each range of the keys (different ones, of ``bits`` bits) that has some: what the block has of them, in the keys' order."""
    keys = keys.view(np.uint64)
    order = np.argsort(keys)
    keys, target, background = keys[order], target[order], background[order]
    part = ((keys >> np.uint64(bits - 32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    found, starts = np.unique(part, return_index=True)
    cut = [slice(lo, hi) for lo, hi in zip(starts, [*starts[1:], len(keys)])]
    return pa.RecordBatch.from_arrays([
        pa.array(found, pa.int32()), pa.array([block] * len(cut), pa.int64()), pa.array([_packed(np.diff(keys[c], prepend=np.uint64(0)).view(np.int64)) for c in cut], pa.binary()),
        *[pa.array([_packed(x[c]) for c in cut], pa.binary()) for x in (target, background)]], names=[c.split()[0] for c in ASKS.split(", ")])


def _answer(part: pa.Table) -> pa.Table:
    """Of one range for each block what the others have of its keys; as block -1, how many keys stand twice or more and, by
    the keys' lowest 4 bits, how often those that stand once do in the target and in all."""
    own = [np.cumsum(_unpacked(x).view(np.uint64)) for x in part.column("keys").to_pylist()]
    counts = [np.concatenate([_unpacked(x) for x in part.column(c).to_pylist()]) for c in ("target", "background")]
    keys, of = np.unique(np.concatenate(own), return_inverse=True)
    sums = [_added(x, of, len(keys)) for x in counts]
    once = sums[1] == 1
    stats = np.concatenate([[np.count_nonzero(~once)], *[_added(x[once], (keys[once] & np.uint64(15)).astype(np.int64), 16) for x in sums]])
    ends = np.cumsum([len(x) for x in own])
    others = [[_packed(x) for x in np.split(s[of] - c, ends[:-1])] for s, c in zip(sums, counts)]
    n, number = len(own), part.column("part")[0].as_py()
    cols = [[*part.column("block").to_pylist(), -1], [number] * (n + 1), *[[*x, None] for x in others], [*[None] * n, stats]]
    return pa.table([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())))],
                    names=[c.split()[0] for c in ANSWERS.split(", ")])


class Block:
    """A block with the answers it has got so far; ids 0 to 12 are the classes' and the start's, then come its words of the vocabulary."""

    def __init__(self, row: dict) -> None:
        self.docs, self.targets, self.sizes = (np.array(row[c], t) for c, t in (("docs", np.int64), ("targets", bool), ("sizes", np.int64)))
        self.words, self.tokens = _unpacked(row["words"]), _unpacked(row["tokens"])
        self.in_target = np.repeat(self.targets, self.sizes).astype(np.int64)
        self.row = row

    def _counts(self, keys: np.ndarray, own: list[np.ndarray], answers: str) -> list[np.ndarray]:
        """How often each key stands in all blocks, from how often in this one and what the others have."""
        given = sorted(self.row[answers] or [], key=lambda x: x["part"])
        order, out = np.argsort(keys.view(np.uint64)), []
        for c, counted in zip(("target", "background"), own):
            total = counted.copy()
            total[order] += np.concatenate([np.zeros(0, np.int64), *[_unpacked(x[c]) for x in given]])
            out.append(total)
        return out

    def own_words(self) -> list[np.ndarray]:
        n = len(self.words)
        return [_added(self.in_target, self.tokens, n), np.bincount(self.tokens, minlength=n)]

    def read_words(self) -> None:
        counts = self._counts(self.words, self.own_words(), "of_words")
        kept = counts[1] >= 2
        self.numbers = np.concatenate([np.arange(_FIRST_WORD), self.words[kept]])  # by the block's own ids
        self.word_counts = [np.concatenate([np.zeros(_FIRST_WORD, np.int64), x[kept]]) for x in counts]
        self.ids = np.where(kept, _START + np.cumsum(kept), self.words & 15)[self.tokens]
        self.before = befores(self.ids, self.sizes)
        pairs, self.order, self.starts = _groups(self.before * len(self.numbers) + self.ids)
        self.first, self.second = np.divmod(pairs, len(self.numbers))
        self.pair_keys = pair_keys(self.numbers[self.first], self.numbers[self.second])

    def own_pairs(self) -> list[np.ndarray]:
        return [np.add.reduceat(self.in_target[self.order], self.starts) if len(self.starts) else self.starts, np.diff(self.starts, append=len(self.ids))]

    def read_pairs(self) -> None:
        self.pair_counts = self._counts(self.pair_keys, self.own_pairs(), "of_pairs")
        self.known = self.pair_counts[1] >= 2

    def own_in_pairs(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """The ids that stand first in a pair, and how often in one with counts of its own."""
        firsts, of = np.unique(self.first, return_inverse=True)
        return firsts, [_added(np.where(self.known, x, 0), of, len(firsts)) for x in self.own_pairs()]

    def losses(self, model: Model) -> np.ndarray:
        """Mean negative log probability of each text's tokens under the target and the background model, without its own text."""
        firsts, own = self.own_in_pairs()
        in_pairs_of = np.zeros((2, len(self.numbers)))
        in_pairs_of[:, firsts] = self._counts(self.numbers[firsts], own, "of_firsts")
        counts = np.stack(self.word_counts).astype(np.float64)
        counts[:, :_FIRST_WORD] = model.classes
        pair_of, pair_counts = _group_of(self.order, self.starts), np.stack(self.pair_counts)
        ends, out, lo = np.cumsum(self.sizes), np.zeros((2, len(self.sizes))), 0
        while lo < len(ends):
            begin = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, begin + STEP_TOKENS, side="right")))
            part = slice(begin, ends[hi - 1])
            if begin < ends[hi - 1]:
                out[:, lo:hi] = model.losses(self.ids[part], self.before[part], self.sizes[lo:hi], self.targets[lo:hi], counts, in_pairs_of,
                                             pair_of[part], pair_counts, self.known)
            lo = hi
        return out


@dataclass(frozen=True)
class Model:
    """What all blocks share: the vocabulary's size, the tokens of each model, and how often each class and the start stand in each."""

    size: int
    totals: np.ndarray
    classes: np.ndarray

    @property
    def ids(self) -> np.ndarray:
        return np.arange(_FIRST_WORD)

    def losses(self, ids: np.ndarray, before: np.ndarray, sizes: np.ndarray, target: np.ndarray, counts: np.ndarray, in_pairs_of: np.ndarray,
               pair: np.ndarray, pair_counts: np.ndarray, is_known: np.ndarray) -> np.ndarray:
        """Of texts one after another, of ``sizes`` tokens; ``target`` tells which of them the target model has counted."""
        text = np.repeat(np.arange(len(sizes)), sizes)

        def own(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            _, order, starts = _groups(codes)
            return _group_of(order, starts), np.diff(starts, append=len(codes))

        (w, w_own), (p, p_own) = own(text * counts.shape[1] + ids), own(text * len(is_known) + pair)
        known, begins = is_known[pair], before == _START
        b = np.where(begins, len(w_own) + text, np.concatenate([[0], w[:-1]]))
        own_in_pairs = np.bincount(b, known)[b]
        own_before = np.where(begins, 1, np.concatenate([[0], w_own[w][:-1]]))  # of the start: once in a text; of a word: wherever it stands, last or not
        share = (np.repeat(target, sizes).astype(np.float64), np.ones(len(ids)))
        scale = (1.0, self.totals[0] / max(1.0, self.totals[1]))
        out = []
        for row in range(2):
            def less(counted: np.ndarray, of_text: np.ndarray) -> np.ndarray:
                return np.maximum(counted - share[row] * of_text, 0) * scale[row]  # noqa: B023

            total = np.maximum(less(self.totals[row], sizes[text]), 1.0)
            alone = (1 - UNIFORM) * less(counts[row, ids], w_own[w]) / total + UNIFORM / self.size
            of_pair = np.where(known, less(pair_counts[row, pair], p_own[p]), 0.0)
            whole, in_pairs = less(counts[row, before], own_before), less(in_pairs_of[row, before], own_in_pairs)
            loss = -np.log((of_pair + (np.maximum(whole - in_pairs, 0) + UNSEEN) * alone) / (np.maximum(whole, in_pairs) + UNSEEN))
            out.append(np.bincount(text, loss, len(sizes)) / np.maximum(sizes, 1))
        return np.stack(out)


@dataclass(frozen=True)
class Vocabulary:
    """The words that both models know, as sorted numbers."""

    words: np.ndarray

    @property
    def size(self) -> int:
        return _FIRST_WORD + len(self.words)

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        """The words' ids; for those outside the vocabulary, their shapes'."""
        if not len(self.words):
            return numbers & 15
        at = np.minimum(np.searchsorted(self.words, numbers), len(self.words) - 1)
        return np.where(self.words[at] == numbers, _FIRST_WORD + at, numbers & 15)


def _kept(df: DataFrame, tasks: int) -> DataFrame:
    """``df``, computed once and kept dealt out by block, so that joins by block move none of its rows.

    A plan that may change while it runs does not tell how its result is dealt out.
    """
    conf = df.sparkSession.conf
    was = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut_lineage(df.repartition(tasks, "block"))
    finally:
        conf.set("spark.sql.adaptive.enabled", was)


def _of_blocks(df: DataFrame, made: Callable[[Block], pa.RecordBatch], schema: str | T.StructType) -> DataFrame:
    """``made`` of each block, one after another."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield made(Block(batch.slice(i, 1).to_pylist()[0]))

    return df.mapInArrow(run, schema)


@dataclass(frozen=True)
class Models:
    """Both models: what all tasks share, and the blocks with the counts of their words and pairs."""

    frequent: Model
    blocks: DataFrame  # the packed documents with of_words, of_pairs and of_firsts, the others' counts of their keys

    @classmethod
    def fit(cls, df: DataFrame, text: str = "text", target: str = "target") -> Models:
        flag = F.coalesce(F.col(target), F.lit(False))
        rows = df.select(doc_key(text, target).alias("_doc"), F.col(text).alias("text"), flag.alias("target"))
        tasks = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        blocks = _kept(rows.mapInArrow(_blocks, BLOCK).withColumn("block", F.monotonically_increasing_id()), tasks)
        whole = lambda c: F.coalesce(F.sum(c), F.lit(0))
        n = blocks.select(whole("n_target").alias("target"), whole("n_tokens").alias("background"),
                          *[whole(F.size(F.filter(F.arrays_zip("sizes", "targets"), f))).alias(c)
                            for c, f in (("begun_target", lambda x: (x.sizes > 0) & x.targets), ("begun", lambda x: x.sizes > 0))]).first()
        parts = max(2 * tasks, n.background // RANGE_TOKENS + 1)

        def asked(known: DataFrame, name: str, keys_of: Callable[[Block], tuple], bits: int) -> DataFrame:
            made = _of_blocks(known, lambda b: _asks(b.row["block"], *keys_of(b), bits, parts), ASKS).groupBy("part").applyInArrow(_answer, ANSWERS)
            return _kept(made, tasks).groupBy("block").agg(F.collect_list(F.struct("part", "target", "background", "stats")).alias(name))

        def words(b: Block) -> tuple:
            return b.words, *b.own_words()

        def pairs(b: Block) -> tuple:
            b.read_words()
            return b.pair_keys, *b.own_pairs()

        def firsts(b: Block) -> tuple:
            b.read_words()
            b.read_pairs()
            ids, own = b.own_in_pairs()
            return b.numbers[ids], *own

        of_words = asked(blocks, "of_words", words, 63)
        stats = of_words.filter("block = -1").select(F.explode("of_words.stats").alias("s")).select(
            *[F.coalesce(F.sum(F.col("s")[i]), F.lit(0)) for i in range(33)]).first()
        known = blocks.join(of_words, "block", "left")
        known = known.join(asked(known, "of_pairs", pairs, 64), "block", "left")
        known = known.join(asked(known, "of_firsts", firsts, 63), "block", "left")
        classes = np.array([[*stats[1 + 16 * i:1 + 16 * i + _SHAPES], begun] for i, begun in enumerate((n.begun_target, n.begun))], np.float64)
        return cls(Model(_FIRST_WORD + stats[0], np.array([n.target, n.background], np.float64), classes), known)

    @property
    def totals(self) -> np.ndarray:
        """Tokens of each model."""
        return self.frequent.totals

    @cached_property
    def vocabulary(self) -> Vocabulary:
        """All words, on the driver: to look into small models."""
        def words(b: Block) -> pa.RecordBatch:
            b.read_words()
            return pa.RecordBatch.from_arrays([pa.array(b.numbers[_FIRST_WORD:])], names=["word"])

        return Vocabulary(np.sort(_of_blocks(self.blocks, words, "word long").distinct().toArrow().column("word").to_numpy()))

    @cached_property
    def pairs(self) -> np.ndarray:
        """All pairs with counts of their own as id before * ids + id, on the driver: to look into small models."""
        known = self.vocabulary

        def pairs(b: Block) -> pa.RecordBatch:
            b.read_words()
            b.read_pairs()
            ids = np.concatenate([np.arange(_FIRST_WORD), known.ids(b.numbers[_FIRST_WORD:])])
            return pa.RecordBatch.from_arrays([pa.array(ids[b.first[b.known]] * known.size + ids[b.second[b.known]])], names=["pair"])

        return np.sort(_of_blocks(self.blocks, pairs, "pair long").distinct().toArrow().column("pair").to_numpy())


def doc_key(text: str, target: str) -> Column:
    """Equal for rows of equal texts and flags, which have equal scores."""
    return F.xxhash64(F.col(text), F.coalesce(F.col(target), F.lit(False)))


def score(df: DataFrame, models: Models, text: str = "text", target: str = "target") -> DataFrame:
    """``df`` with ``n_tokens``, ``target_loss``, ``background_loss`` and ``score`` (their mean difference a token).

    ``df`` is what the models were fitted on: every row's own tokens are in the background's counts, and those of a
    row flagged by ``target`` in the target's.
    """
    names = [fresh(n, df.columns) for n in ("n_tokens", "target_loss", "background_loss", "score")]
    doc = fresh("_doc", [*df.columns, *names])
    schema = T.StructType([T.StructField(doc, T.LongType()), T.StructField(names[0], T.LongType()), *[T.StructField(n, T.DoubleType()) for n in names[1:]]])
    model = models.frequent

    def losses(b: Block) -> pa.RecordBatch:
        b.read_words()
        b.read_pairs()
        empty = (b.sizes == 0) | (not model.totals[0])
        means = b.losses(model)
        cols = [pa.array(b.docs), pa.array(b.sizes), *[pa.array(x, mask=empty) for x in (means[0], means[1], means[0] - means[1])]]
        return pa.RecordBatch.from_arrays(cols, names=[doc, *names])

    scored = _of_blocks(models.blocks, losses, schema).dropDuplicates([doc])  # equal texts have equal scores
    return df.withColumn(doc, doc_key(text, target)).join(scored, doc, "left").select(*df.columns, *names)
