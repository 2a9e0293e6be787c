"""The registered queries of the operators and, where SQL can express them, their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, html, langid, linededup, lm, mixing, quality, resample, simhash, spelling, syncmers, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def vocabulary_path() -> str:
    """The public vocabulary of word-end BPE; TIDEMILL_BPE names another file."""
    if path := os.environ.get("TIDEMILL_BPE"):
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_vocabulary_path() -> str:
    """The public byte-level vocabulary for many languages; TIDEMILL_BYTE_BPE names another file."""
    if path := os.environ.get("TIDEMILL_BYTE_BPE"):
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_decontam_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_bpe_backtracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.round_trip(_table(spark, sf_dir, "documents"), vocabulary_path()))


def op4_html_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op5_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op8_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"), byte_vocabulary_path())


def op9_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op10_line_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(_table(spark, sf_dir, "documents"), short=True)


def op11_source_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(_table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontam_templates,
        op2_quality_nbsvm,
        op3_bpe_backtracking,
        op4_html_differencing,
        op5_simhash_anchors,
        op6_toxicity_ftrl,
        op7_language_ppm,
        op8_attention_lm,
        op9_syncmer_fingerprints,
        op10_line_minhash,
        op11_source_schedule,
        op12_spelling_variants,
        op13_importance_resampling,
    )
}

# Every block of a target is taken, so what a document gives follows from where it stands in its source's stream.
ORACLE_SQL: dict[str, str] = {
    "op11_source_schedule": r"""
WITH d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, source, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS BIGINT) AS size,
  md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][r % 3 + 1] AS w FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / w, r) AS i FROM w),
l AS (SELECT *, CAST((SELECT sum(source_size) FROM w) - coalesce(sum(3 * source_size) OVER p, 0) AS DOUBLE) / ((SELECT sum(w) FROM w) - coalesce(sum(w) OVER p, 0)) AS level
  FROM o WINDOW p AS (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT arg_min(level, i) AS level FROM l WHERE 3 * source_size > w * level),
g AS (SELECT source, source_size, CASE WHEN 3 * source_size <= w * coalesce((SELECT level FROM t), 0) THEN CAST(3 * source_size AS DOUBLE) ELSE w * (SELECT level FROM t) END AS target FROM w),
a AS (SELECT d.doc_id, d.size, g.source_size, g.target, CAST(floor(g.target + 0.5) AS BIGINT) AS take,
  CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, coalesce(target, 0) AS target, greatest(0, least(size, take - place)) + greatest(0, least(size, take - place - source_size)) + greatest(0, least(size, take - place - 2 * source_size)) AS taken FROM a
""",
}
