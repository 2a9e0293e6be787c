"""A training-corpus pipeline: language ID, line dedup, SimHash near-dedup, benchmark decontamination, BPE.

Each stage takes (spark, docs, sf_dir), works on all the stage before kept, and is written as Parquet and read again
before the next one. So when a stage begins, what the one before cached or cut is no longer needed and is freed; tables
of other calls aren't touched. A stage's Parquet copy goes when the next one is written, and the last one is the result.

Defined results: documents with a null or empty text, or without a letter, go in the first stage; rows that repeat a
document are near copies of each other and stay or go together; columns besides doc_id and text pass through unchanged
but for n_chars, which line dedup counts anew; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import bpe, decontam, langid, linededup, simhash
from tidemill.llm.queries import vocabulary_path
from tidemill.llm.shared import Scope, checkpoint_folder, delete, fold

#: A document stays when a language was found, its posterior among the learned languages is at least this ...
MIN_LANGUAGE_SCORE = 0.5
#: ... and its code is no longer than the language's own texts take (as a multiple of their limit).
MAX_CODE_LENGTH = 1.0


_scopes = [Scope()]


def _begin() -> Scope:
    """The scope of a stage; frees that of the stage before."""
    _scopes.pop().release()
    _scopes.append(Scope())
    return _scopes[-1]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a recognised language; those without a letter, undecided, or of no learned language go."""
    with _begin():
        train = docs.where(~F.coalesce(fold("doc_id", 4) == 2, F.lit(False)))
        model = langid.fit(train.select("doc_id", "text", "lang"))
        plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # names that no result column has
        scored = langid.predict(plain, model, f"c{docs.columns.index('text')}")
        fits = (F.col("score") >= MIN_LANGUAGE_SCORE) & (F.col("bits_per_byte") <= MAX_CODE_LENGTH)
        return scored.where((F.col("lang_pred") != "und") & fits).select(*plain.columns).toDF(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that repeat earlier ones."""
    with _begin():
        return linededup.dedup_lines(docs, short=True)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    with _begin():
        return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    with _begin():
        return decontam.clean(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids (little-endian unsigned 32-bit), their number, and digests of ids and decoded text."""
    with _begin():
        coded = bpe.round_trip(docs, vocabulary_path())
        return coded.select(
            "doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
        )


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontaminate", decontaminate),
    ("bpe", encode),
]

#: No stage but the fourth can be put in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    folder = f"{checkpoint_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = f"{folder}/{name}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            delete(spark, before)
        before = path
    _begin()
    return docs
