"""Language identification by compression (operator 5).

For each language some labelled text becomes a raw-content zstandard dictionary.  A text is lower-cased, its runs
of anything but letters become one space, and it is cut into blocks; every block is compressed with each
language's dictionary.  The language with the smallest total is chosen, ties to the smaller name.  A text is
rejected when the second smallest total is less than ``min_margin`` larger (as a share of it).

Fitting reads a bounded sample: about ``docs_per_language`` labelled different texts of each language, drawn by a
hash of the text over all of them, and ``chars_per_doc`` characters of each.  Everything else covers every row.

Defined cases: a text that is null or has no letter is ``und`` with score 0 and rejected; a null label or a text
without letters teaches nothing; with no labelled row every text is ``und``; rows are neither merged nor lost; other
columns pass unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentia.llm.common import cut_lineage, fresh, small_side, text_steps, texts_of

UNDETERMINED = "und"
BLOCK_CHARS, SHORT_CHARS = 4096, 64
LEVEL = 6
#: Share by which the second smallest size must exceed the smallest.
MIN_MARGIN = 0.005

_NO_LETTERS = re.compile(r"[\W\d_]+")


def letters_of(text: str) -> str:
    """The text in lower case, runs of anything but letters as one space, trimmed."""
    found = _NO_LETTERS.sub(" ", text.lower()).strip()
    return found if any(map(str.isalpha, found)) else ""  # fractions and raised digits alone are no letters


@dataclass(frozen=True)
class Model:
    """A language's name and its dictionary, for each language in order of names."""

    dictionaries: dict[str, bytes]

    @classmethod
    def fit(cls, labelled: DataFrame, text: str = "text", lang: str = "lang",
            docs_per_language: int = 160, chars_per_doc: int = 600) -> Model:
        rows = (labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang"))
                .filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")))
        # copies count once, as the draw takes them; one row a language
        texts = rows.select("lang", F.xxhash64("text").alias("h")).distinct()
        counts = small_side(cut_lineage(texts.groupBy("lang").agg(F.count("*").alias("n"))))
        # a hash below the language's rate: as many texts on average, whatever the table's size and its copies
        span = float(1 << 31)
        draw = F.pmod(F.xxhash64("text"), F.lit(1 << 31)) / F.lit(span)
        sample = (rows.join(counts, "lang").filter(draw * F.col("n") <= docs_per_language)
                  .select("lang", "text", draw.alias("draw")).distinct())
        part = F.greatest(F.lit(1), (F.length("text") / 3).cast("int"))
        got: dict[str, list[str]] = {}
        for r in sample.select("lang", "draw", F.substring("text", part, F.lit(chars_per_doc * 2)).alias("text")).orderBy("lang", "draw", "text").collect():
            got.setdefault(r.lang, []).append(letters_of(r.text)[:chars_per_doc])
        return cls({k: "\n".join(v).encode() for k, v in sorted(got.items())})

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for data in self.dictionaries.values():
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out


def sizes(text: str, compressors: list[zstandard.ZstdCompressor]) -> list[int]:
    """Compressed bytes of a text by each compressor, block by block.

    A block of a few words is stored as it is, since it would hardly shrink, and then all languages tie; a short text
    is therefore repeated, which costs the same with every dictionary, so that its first copy tells them apart.
    """
    if len(text) < SHORT_CHARS:
        text = f"{text} " * (SHORT_CHARS // (len(text) + 1) + 1)
    blocks = [text[i:i + BLOCK_CHARS].encode() for i in range(0, len(text), BLOCK_CHARS)]
    return [sum(len(c.compress(b)) for b in blocks) for c in compressors]


def decide(found: list[int], names: list[str], min_margin: float) -> tuple[str, float, float, bool]:
    """Language, score, margin and whether it is rejected."""
    best = min(range(len(found)), key=lambda i: (found[i], names[i]))
    second = min((s for i, s in enumerate(found) if i != best), default=None)
    if second is None:
        return names[best], 1.0, 1.0, False
    margin = (second - found[best]) / second
    # sizes as code lengths: the share of the best among all, at a tenth of the bits so that it does not saturate
    score = 1 / sum(2 ** (0.8 * max(found[best] - s, -1000)) for s in found)
    return names[best], score, margin, margin < min_margin


def predict(df: DataFrame, model: Model, text: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """``df`` with ``lang_pred``, ``score`` (0 to 1), ``margin`` and ``rejected``."""
    new = [fresh(c, df.columns) for c in ("lang_pred", "score", "margin", "rejected")]
    kinds = (T.StringType(), T.DoubleType(), T.DoubleType(), T.BooleanType())
    schema = T.StructType([*df.schema.fields, *[T.StructField(c, k, False) for c, k in zip(new, kinds)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, compressors = list(model.dictionaries), model.compressors()
        for batch in batches:
            for part in text_steps(batch, text):
                rows = []
                for t in texts_of(part, text):
                    t = letters_of(t)
                    rows.append(decide(sizes(t, compressors), names, min_margin) if t and names else (UNDETERMINED, 0.0, 0.0, True))
                cols = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *cols], names=[*part.schema.names, *new])

    return df.mapInArrow(run, schema)
