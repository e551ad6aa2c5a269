"""The subpackage's registered queries: each applies one operator to its whole table."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.llm import bpe, embed_dedup, hard_negatives, html_text, langid, licences, lm_score, mixing, ngram_join, quality_rank, substring, topk, vector_codes
from retentia.llm.common import bounded_batches, cut_lineage, read_table, small_side
from retentia.llm.vectors import finite, usable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        @functools.wraps(fn)
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            bounded_batches(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build
    return deco


def tokenizer() -> tuple[bytes, str]:
    """The rank file and the splitting pattern of the public tokenizer that the BPE query uses."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


@query("op1_ngram_jaccard_join")
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of equal shingle sets, its links at Jaccard 0.8 and its component."""
    return ngram_join.jaccard_join(read_table(spark, sf_dir, "documents"))


@query("op3_bpe_roundtrip")
def op3_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's BPE ids and the bytes they decode to, as digests."""
    ranks, pattern = tokenizer()
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, ranks, pattern, decoded="decoded").select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op5_compression_langid")
def op5_compression_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language by compression; three quarters of the documents teach, the rest is held out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = langid.Model.fit(docs.filter(~held_out))
    return langid.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


_OP8_SQL = r"""
WITH docs AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS draw
  FROM documents
), sources AS (
  SELECT source, sum(size) AS total, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM docs GROUP BY source
), weighed AS (
  SELECT source, total, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM sources
), filled AS (
  SELECT *, CAST(total AS DOUBLE) * 2.0::DOUBLE AS cap, CAST(total AS DOUBLE) * 2.0::DOUBLE / w AS fill FROM weighed
), ranked AS (
  SELECT *, row_number() OVER o AS r, coalesce(sum(cap) OVER p, 0) AS cap_before, coalesce(sum(w) OVER p, 0) AS w_before
  FROM filled
  WINDOW o AS (ORDER BY fill, source NULLS LAST),
         p AS (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
  SELECT *, ((SELECT sum(total) FROM ranked) * 1.5::DOUBLE - cap_before) / ((SELECT sum(w) FROM ranked) - w_before) AS level FROM ranked
), plan AS (
  SELECT source, total, least(cap, w * (SELECT arg_min(level, r) FROM levels WHERE fill >= level)) AS target FROM levels
), placed AS (
  SELECT d.doc_id, d.size, p.total, p.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.doc_id, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         CASE WHEN p.total > 0 THEN CAST(floor(p.target / p.total) AS BIGINT) ELSE 0 END AS epochs
  FROM docs d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, CAST(total AS BIGINT) AS source_size, target,
       CAST(epochs * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - epochs * total - before)) AS BIGINT) AS taken
FROM placed
"""


@query("op8_mix_sources", _OP8_SQL)
def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed to weights 5, 2, 1 of 150 % of their words, no source more than twice; those without an id stand last."""
    docs = read_table(spark, sf_dir, "documents")
    sized = cut_lineage(docs.select("doc_id", "source", mixing.word_count("text").alias("size")))
    draw = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 15), 16, 10).cast("long")
    return mixing.mix(sized, key=["doc_id"], draw=draw).drop("source")


@query("op7_licences")
def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and covered licence templates of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return licences.find_licences(docs).drop("text", "spans")


@query("op9_substring_dedup")
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that an earlier place has, and which passages those are."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.dedup(docs)


@query("op10_embedding_near_dedup")
def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its links at cosine 0.9 and its component."""
    return embed_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"))


@query("op4_exact_top_k")
def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors with the highest integer inner products for every hundredth vector."""
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1024).cast("double"))
    whole = vectors.select("vec_id", F.when(usable("embedding"), scaled).alias("embedding"))
    return topk.top_k(whole, F.col("vec_id") % 100 == 0)


@query("op2_lm_score")
def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's cross-entropy difference between the good documents' model and that of all documents."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels")
    good = labels.filter("quality = 1 AND toxic = 0").select("doc_id").distinct().withColumn("target", F.lit(True))
    flagged = docs.join(small_side(good), "doc_id", "left")
    return lm_score.score(flagged, lm_score.Models.fit(flagged)).drop("text", "target")


@query("op6_html_main_text")
def op6_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    got = html_text.extract(pages, html_text.fit(pages))
    return got.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def _op11_sql(rounds: int = 4) -> str:
    """The codes of operator 11 by plain distances; whole numbers stay below 2^53, so that doubles hold them."""
    steps = ["""
kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 1024.0)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT vec_id, p, v[p * (len(v) // 4) + 1:(p + 1) * (len(v) // 4)] AS x FROM kept, range(4) AS r(p)
), book0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM parts
  WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 256)
)"""]
    near = """near{k} AS MATERIALIZED (
  SELECT vec_id, p, min(256 * (list_dot_product(a.x, a.x) - 2 * list_dot_product(a.x, b.x) + list_dot_product(b.x, b.x)) + e) AS best
  FROM parts a JOIN book{k} b USING (p) GROUP BY vec_id, p
), hit{k} AS MATERIALIZED (
  SELECT vec_id, p, CAST(best % 256 AS BIGINT) AS e, CAST(floor(best / 256) AS BIGINT) AS error FROM near{k}
)"""
    move = """sums{k} AS MATERIALIZED (
  SELECT p, e, i, floor(sum(x[i]) / count(*)) AS mean FROM parts JOIN hit{k} USING (vec_id, p), range(1, 1 + len(x)) AS r(i) GROUP BY p, e, i
), moved{k} AS MATERIALIZED (
  SELECT p, e, list(mean ORDER BY i) AS x FROM sums{k} GROUP BY p, e
), book{n} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN moved{k} m USING (p, e)
)"""
    for k in range(rounds):
        steps += [near.format(k=k), move.format(k=k, n=k + 1)]
    steps.append(near.format(k=rounds))
    return f"""WITH {", ".join(steps)}, coded AS MATERIALIZED (
  SELECT vec_id, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, CAST(sum(error) AS BIGINT) AS error FROM hit{rounds} GROUP BY vec_id
), digest AS (
  SELECT sha256(string_agg(CAST(CAST(c AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS d
  FROM (SELECT p, e, unnest(x) AS c, unnest(range(len(x))) AS i FROM book{rounds})
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT d FROM digest) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)"""


@query("op11_vector_codes", _op11_sql())
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's code in four parts of eight bits, its error and its label's, after four rounds."""
    return vector_codes.compress(read_table(spark, sf_dir, "embeddings"))


_OP12_SQL = """
WITH kept AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256.0)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM kept a JOIN kept b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS MATERIALIZED (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.other_id AS negative_id,
       p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
     AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)
QUALIFY row_number() OVER w <= 10"""


@query("op12_hard_negatives", _OP12_SQL)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten hardest rows of other labels for every hundredth vector and each of its five nearest of its label."""
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double"))
    whole = vectors.select("vec_id", moved.alias("label"), F.when(finite("embedding"), scaled).alias("embedding"))
    return hard_negatives.mine(whole, F.col("vec_id") % 100 == 0)


@query("op13_quality_rank")
def op13_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality by preference pairs; four fifths of the labelled documents teach, the rest is held out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = quality_rank.Model.fit(docs, read_table(spark, sf_dir, "labels").filter(~held_out).select("doc_id", "quality"))
    return quality_rank.score(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")
