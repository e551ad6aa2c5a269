"""The corpus pipeline: language ID, near-duplicates, repeated passages, source mix, tokens.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of
``documents``.  ``run`` chains them over the whole table.  Rows without a doc_id take part like others, but for
``repeated_passages``, which leaves them in place.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.llm import bpe, langid, mixing, ngram_join, substring
from retentia.llm.common import bounded_batches, cut_lineage
from retentia.llm.queries import tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Bytes of text that ``tokens`` encodes at a time: the stages before it leave it little of an executor's memory.
TOKEN_BYTES = 1 << 20

#: SQL cannot express compression, MinHash bands, gear hashes or BPE; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; a missing ``lang`` becomes the language found."""
    teach = docs.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    found = langid.predict(docs.select(COLUMNS), langid.Model.fit(teach)).filter(~F.col("rejected"))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more: that of the smallest id, a missing id last.

    A document is a text under an id: rows that share an id but not the text are decided apart, and rows that share
    both are one document.
    """
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.md5("text").alias("digest"))
    docs = docs.select(*COLUMNS, row.alias("_row"))
    kept = ngram_join.jaccard_join(docs, key="_row").filter("kept").select("_row").distinct()
    one_each = (docs.join(kept, "_row", "left_semi")
                .groupBy("_row").agg(F.min(F.struct("lang", "source", "n_chars")).alias("rest"), F.first("text").alias("text")))
    return one_each.select(F.col("_row.doc_id").alias("doc_id"), "text", "rest.*").select(COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every passage in the first document that has it only; documents of which nothing is left go."""
    done = substring.dedup(docs.select(COLUMNS)).filter("removed_words = 0 OR trim(text) <> ''")
    changed = F.col("removed_words") > 0
    return done.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, each as often as the mix takes it; the one at a source's cut goes in if half of it does."""
    sized = docs.select(*COLUMNS, mixing.word_count("text").alias("_size"))
    mixed = mixing.mix(sized, key=["doc_id", "n_chars"], size="_size")
    copies = F.floor(F.col("taken") / F.col("_size") + 0.5).cast("int")
    return (mixed.filter("taken > 0").withColumn("_copy", F.explode(F.array_repeat(F.lit(1), copies))).select(COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' BPE ids, and whether decoding gives back the text."""
    ranks, pattern = tokenizer()
    back = bpe.encode(docs.select("doc_id", "lang", "source", "text"), ranks, pattern, decoded="decoded", step_bytes=TOKEN_BYTES)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return back.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


def _bounded(stage):
    """The stage with record batches of a bounded number of rows."""
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return stage(spark, docs, sf_dir)
    return run_stage


STAGES = [(stage.__name__, _bounded(stage)) for stage in (language_id, near_duplicates, repeated_passages, source_mix, tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage is written to the shared checkpoint folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut_lineage(docs)
    return docs
