"""Quality scores from preference pairs by a Bradley-Terry model (operator 13).

A document has a worth, a weighted sum of features of its whole text; a good one is preferred to a bad one with the
probability 1 / (1 + exp(-(difference of their worths))).  The weights minimise the logistic loss of the feature
differences of preference pairs, each a document of the higher label and one of the lower, plus a ridge term.  The
threshold is a quantile of the training documents' worths: the share of the lower label among all training rows, so
that as many fall below it as are labelled so.  The score is the logistic function of the worth, moved so that the
threshold scores ``CUT``.

Features: the shares of all pairs of neighbouring character classes (space, line break, small letter or any letter
beyond ASCII, capital, digit, other, and each ASCII punctuation mark), as square roots; the share of different words
in windows of 50 and 1,000 words; the mean length of words and of lines.  They are computed over whole texts in pieces
of bounded size.

Fitting reads all labelled texts (copies count once): every text of the higher label is paired with every one of the
lower.  The features of the texts stay a Spark table; each step of the minimisation is two jobs over it, one for the
distribution of the worths under either label, one for the gradient that follows from it.  In the distribution, worths
are told apart by bins, ``BINS`` of them about 0 to a unit, and a bin has its mean.  The threshold is exact and counts
all training rows.

Defined cases: a null text counts as empty, an empty one has all features 0; a null id or label teaches nothing; a
document that is labelled twice teaches twice; without rows of both labels every score is 0.5; rows are neither merged
nor lost; other columns pass unchanged; an empty table gives an empty result.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.llm.common import cut_lineage, text_steps, texts_of

RIDGE, STEPS = 1e-3, 300
CUT = 0.3
#: Steps of the minimisation over all pairs, the gradient's share of the first one at which it ends, steps it looks back.
FIT_STEPS, CLOSE, LOOK_BACK = 60, 1e-4, 10
#: Bins of worths to a unit near 0 (wider for large worths), and on either side at most.
BINS, MOST_BINS = 50, 1500
#: Texts whose features a task adds up; different worths that the driver looks at together.
TASK_TEXTS, EXACT_WORTHS = 25_000, 10_000
#: Bytes (or characters) of a text that are looked at together; words of the two windows.
PIECE, WINDOWS = 1 << 20, (50, 1000)


def _classes() -> np.ndarray:
    table = np.full(256, 5, np.int64)  # control characters
    table[128:] = 2  # bytes of letters and signs beyond ASCII
    for k, chars in enumerate((" \t\x0b\x0c\r", "\n", string.ascii_lowercase, string.ascii_uppercase, string.digits)):
        table[[ord(c) for c in chars]] = k
    for k, c in enumerate(string.punctuation):
        table[ord(c)] = 6 + k
    return table


CLASS = _classes()
KINDS = 6 + len(string.punctuation)
FEATURES = KINDS * KINDS + len(WINDOWS) + 2


def features(text: str) -> np.ndarray:
    """The features of a whole text."""
    pairs = np.zeros(KINDS * KINDS, np.int64)
    last = CLASS[:0]
    words, letters, lines = 0, 0, 1
    different, open_words = [0] * len(WINDOWS), [[] for _ in WINDOWS]
    for lo in range(0, len(text), PIECE):
        piece = text[lo:lo + PIECE]
        code = np.concatenate([last, CLASS[np.frombuffer(piece.encode("utf-8", "surrogatepass"), np.uint8)]])
        pairs += np.bincount(code[:-1] * KINDS + code[1:], minlength=KINDS * KINDS)
        last = code[-1:]
        found = piece.split()
        words += len(found)
        letters += sum(map(len, found))
        lines += piece.count("\n")
        for k, size in enumerate(WINDOWS):
            run = open_words[k] + found
            whole = len(run) - len(run) % size
            different[k] += sum(len(set(run[i:i + size])) for i in range(0, whole, size))
            open_words[k] = run[whole:]
    if not words:
        return np.zeros(FEATURES)
    shares = [(d + len(set(rest))) / words for d, rest in zip(different, open_words)]
    return np.concatenate([np.sqrt(pairs / max(1, pairs.sum())), shares, [np.log1p(letters / words), np.log1p(words / lines)]])


def bradley_terry(x: np.ndarray, better: np.ndarray, worse: np.ndarray, ridge: float = RIDGE, steps: int = STEPS) -> np.ndarray:
    """Weights that minimise the mean logistic loss of x[better] - x[worse] and ridge / 2 times their square.

    For given pairs of a matrix in memory; ``Pairs`` has all pairs of a table.
    """
    spread = x.std(axis=0)
    used = spread > 0
    z = x[:, used] / spread[used]
    # the loss is at most a quarter as curved as the mean square of the differences
    n, v = len(better), np.ones(z.shape[1]) / max(1, z.shape[1]) ** 0.5

    def spread_over(margin_part: np.ndarray) -> np.ndarray:
        """The sum over pairs of margin_part times the difference, by way of one number a document."""
        return (np.bincount(better, margin_part, len(z)) - np.bincount(worse, margin_part, len(z))) @ z

    for _ in range(20):  # power steps for the largest curvature
        v = spread_over((z @ v)[better] - (z @ v)[worse])
        top = float(np.linalg.norm(v)) or 1.0
        v /= top
    rate = 1 / (0.25 * 1.1 * top / n + ridge)
    w = ahead = np.zeros(z.shape[1])
    for k in range(steps):  # Nesterov's method
        s = z @ ahead
        grad = -spread_over(1 / (1 + np.exp(np.minimum(s[better] - s[worse], 700)))) / n + ridge * ahead
        new = ahead - rate * grad
        ahead, w = new + k / (k + 3) * (new - w), new
    out = np.zeros(x.shape[1])
    out[used] = w / spread[used]
    return out


def quantile(worth: np.ndarray, weight: np.ndarray, share: float) -> float:
    """Between the two worths where the running weight passes ``share`` of all."""
    order = np.argsort(worth, kind="stable")
    reached = np.cumsum(weight[order])
    k = int(np.searchsorted(reached, share * reached[-1] * (1 - 1e-12)))
    at = worth[order]
    return float((at[min(k, len(at) - 1)] + at[min(k + 1, len(at) - 1)]) / 2)


def minimise(loss: Callable[[np.ndarray], tuple[float, Callable[[], np.ndarray]]], size: int, steps: int, close: float) -> np.ndarray:
    """Where a smooth convex ``loss`` (its value and, on demand, gradient) is least, by the L-BFGS method from 0 on."""
    at = np.zeros(size)
    value, gradient = loss(at)
    g = gradient()
    first, past = np.linalg.norm(g), []
    for _ in range(steps):
        if np.linalg.norm(g) <= close * first:
            break
        way, factors = -g, []
        for s, y in reversed(past):
            factors.append(s @ way / (s @ y))
            way = way - factors[-1] * y
        way = way * ((past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, first))
        for (s, y), f in zip(past, reversed(factors)):
            way = way + (f - y @ way / (s @ y)) * s
        length = 1.0
        while True:
            new, gradient = loss(at + length * way)
            if new <= value + 1e-4 * length * (g @ way):
                break
            length /= 2
            if length < 1e-6:
                return at  # as near as the bins tell
        now, step = gradient(), length * way
        if step @ (now - g) > 1e-12:
            past = [*past[1 - LOOK_BACK:], (step, now - g)]
        at, value, g = at + step, new, now
    return at


def _sparse(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the features that are not 0 the text, the place and the value."""
    at, x = (b"".join(batch.column(batch.schema.get_field_index(c)).to_pylist()) for c in ("at", "x"))
    sizes = pa.compute.binary_length(batch.column(batch.schema.get_field_index("at"))).to_numpy(zero_copy_only=False) // 2
    return np.repeat(np.arange(batch.num_rows), sizes), np.frombuffer(at, np.uint16).astype(np.int64), np.frombuffer(x, np.float32).astype(np.float64)


def _worths(batch: pa.RecordBatch, weights: np.ndarray) -> np.ndarray:
    text, at, x = _sparse(batch)
    return np.bincount(text, x * weights[at], batch.num_rows)


def _bin_of(worths: np.ndarray) -> np.ndarray:
    """From 0 to 2 * MOST_BINS, MOST_BINS for a worth of 0."""
    return np.clip(np.rint(np.arcsinh(worths / 2) * (2 * BINS)), -MOST_BINS, MOST_BINS).astype(np.int64) + MOST_BINS


def _labels(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("label")).to_numpy(zero_copy_only=False).astype(np.int64)


class Pairs:
    """The mean loss over all pairs of a text labelled 1 and one labelled 0, plus the ridge term, and its gradient.

    ``texts``: label, at, x (the features that are not 0).  Weights are those of features divided by their spreads.
    """

    def __init__(self, texts: DataFrame, ridge: float = RIDGE) -> None:
        self.texts, self.ridge = texts, ridge

        def moments(batch: pa.RecordBatch) -> np.ndarray:
            _, at, x = _sparse(batch)
            return np.concatenate([np.bincount(at, x, FEATURES), np.bincount(at, x * x, FEATURES), [batch.num_rows]])

        got = self._sum(moments, 2 * FEATURES + 1)
        mean = got[:FEATURES] / got[-1]
        spread = np.sqrt(np.maximum(got[FEATURES:-1] / got[-1] - mean * mean, 0))
        # float error of the two sums: a feature that is the same everywhere does not count
        self.spread = np.where(spread > 1e-6 * np.abs(mean), spread, 0.0)
        self.inverse = np.where(self.spread > 0, 1 / np.where(self.spread > 0, self.spread, 1), 0.0)

    def _sum(self, part: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
        """The sum of ``part`` over all texts: each task adds up its own, a vector of ``size`` numbers."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in batches:
                total += part(batch)
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([used.astype(np.int32).tobytes()]), pa.array([total[used].tobytes()])], names=["at", "sum"])

        out = np.zeros(size)
        for row in self.texts.mapInArrow(run, "at binary, sum binary").collect():  # one row a task
            out[np.frombuffer(row.at, np.int32)] += np.frombuffer(row.sum, np.float64)
        return out

    def loss(self, v: np.ndarray) -> tuple[float, Callable[[], np.ndarray]]:
        weights, bins = v * self.inverse, 2 * MOST_BINS + 1

        def distribution(batch: pa.RecordBatch) -> np.ndarray:
            worths = _worths(batch, weights)
            place = _labels(batch) * bins + _bin_of(worths)
            return np.concatenate([np.bincount(place, minlength=2 * bins), np.bincount(place, worths, 2 * bins)])

        got = self._sum(distribution, 4 * bins).reshape(2, 2, bins)
        used = [np.flatnonzero(got[0, label]) for label in (0, 1)]
        n = [got[0, label, used[label]] for label in (0, 1)]
        mean = [got[1, label, used[label]] / n[label] for label in (0, 1)]
        share = [k / k.sum() for k in n]
        ahead = mean[1][:, None] - mean[0]
        value = float(share[1] @ np.logaddexp(0, -ahead) @ share[0]) + self.ridge / 2 * float(v @ v)

        def gradient() -> np.ndarray:
            wrong = 1 / (1 + np.exp(np.minimum(ahead, 700)))
            pull = np.zeros((2, bins))
            pull[0, used[0]] = share[1] @ wrong / n[0].sum()
            pull[1, used[1]] = -(wrong @ share[0]) / n[1].sum()

            def part(batch: pa.RecordBatch) -> np.ndarray:
                text, at, x = _sparse(batch)
                worths = np.bincount(text, x * weights[at], batch.num_rows)
                return np.bincount(at, x * pull[_labels(batch), _bin_of(worths)][text], FEATURES)

            return self._sum(part, FEATURES) * self.inverse + self.ridge * v
        return value, gradient

    def weights(self, steps: int = FIT_STEPS, close: float = CLOSE) -> np.ndarray:
        return minimise(self.loss, FEATURES, steps, close) * self.inverse


def threshold(worths: DataFrame, share: float) -> float:
    """``quantile`` of a table (worth, rows): the range that has it is cut to a bin of it until few worths are left."""
    points = cut_lineage(worths.groupBy("worth").agg(F.sum("rows").alias("rows")))
    whole = points.agg(F.sum("rows").alias("rows"), F.count("*").alias("n"), F.min("worth").alias("lo"), F.max("worth").alias("hi")).first()
    below, lo, hi, n = 0, whole.lo, whole.hi, whole.n
    while n > EXACT_WORTHS:
        place = F.least(F.floor((F.col("worth") - lo) / (hi - lo) * 1000), F.lit(999))
        parts = sorted(points.filter(F.col("worth").between(lo, hi)).groupBy(place.alias("place")).agg(
            F.sum("rows").alias("rows"), F.count("*").alias("n"), F.min("worth").alias("lo"), F.max("worth").alias("hi")).collect(), key=lambda r: r.place)
        reached = below + np.cumsum([r.rows for r in parts])
        k = min(int(np.searchsorted(reached, share * whole.rows * (1 - 1e-12))), len(parts) - 1)
        below, lo, hi, n = int(reached[k]) - parts[k].rows, parts[k].lo, parts[k].hi, parts[k].n
    inside = points.filter(F.col("worth").between(lo, hi)).orderBy("worth").collect()
    after = points.filter(F.col("worth") > hi).agg(F.min("worth").alias("worth"), F.sum("rows").alias("rows")).first()
    more = [] if after.worth is None else [after]
    return quantile(np.array([lo, *[r.worth for r in [*inside, *more]]]), np.array([below, *[r.rows for r in [*inside, *more]]], np.float64), share)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -500, 500)))

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
            docs_per_label: int | None = None, cut: float = CUT) -> Model:
        """``labels`` (key, label: 1 better than 0) says which of ``docs`` teach what.

        ``docs_per_label`` has no effect: it once bounded a sample, and is taken for callers that give it.
        """
        marks = labels.filter(F.col(label).isin(0, 1)).select(F.col(key).alias("_id"), F.col(label).cast("int").alias("_label"))
        texts = docs.select(F.col(key).alias("_id"), F.coalesce(text, F.lit("")).alias("_text"))
        # only digests go through the join with all labels
        marked = texts.select("_id", F.md5("_text").alias("_digest")).join(marks, "_id")
        distinct = cut_lineage(marked.groupBy("_label", "_digest").agg(F.count("*").alias("_rows"), F.min("_id").alias("_id")))
        counts = {r._label: r for r in distinct.groupBy("_label").agg(F.sum("_rows").alias("rows"), F.count("*").alias("texts")).collect()}
        if len(counts) < 2:
            return cls(np.zeros(FEATURES), 0.0)
        found = texts.join(distinct, "_id").filter(F.md5("_text") == F.col("_digest"))

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for step in text_steps(batch, "_text"):
                    x = [features(t).astype(np.float32) for t in texts_of(step, "_text")]
                    at = [np.flatnonzero(f).astype(np.uint16) for f in x]
                    yield pa.RecordBatch.from_arrays([*step.columns[1:], pa.array([k.tobytes() for k in at], pa.binary()),
                                                      pa.array([f[k].tobytes() for f, k in zip(x, at)], pa.binary())], names=["label", "digest", "rows", "at", "x"])

        measured = found.select("_text", "_label", "_digest", "_rows").mapInArrow(measure, "label int, digest string, rows long, at binary, x binary")
        # rows of one id and text are one text; the order makes the sums the same in each run
        tasks = max(8, -(-sum(c.texts for c in counts.values()) // TASK_TEXTS))
        measured = cut_lineage(measured.dropDuplicates(["label", "digest"]).repartition(tasks, "digest").sortWithinPartitions("digest", "label"))
        weights = Pairs(measured).weights()

        def worths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(_worths(batch, weights)), batch.column(batch.schema.get_field_index("rows"))], names=["worth", "rows"])

        total = {k: counts[k].rows for k in (0, 1)}
        at = threshold(measured.mapInArrow(worths, "worth double, rows long"), total[0] / (total[0] + total[1]))
        return cls(weights, float(np.log(cut / (1 - cut)) - at))


def score(df: DataFrame, model: Model, text: str = "text", output: str = "score", predicted: str = "predicted", cut: float = CUT) -> DataFrame:
    """``df`` with the score of each whole text, and 1 where it is ``cut`` or more, else 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in text_steps(batch, text):
                x = [features(t) for t in texts_of(step, text)]
                got = model.score(np.array(x, np.float64).reshape(len(x), FEATURES))
                yield pa.RecordBatch.from_arrays([*step.columns, pa.array(got), pa.array((got >= cut).astype(np.int32))], names=[*step.schema.names, output, predicted])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{kept}, `{output}` double, `{predicted}` int")
