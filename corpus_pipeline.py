"""The corpus pipeline: documents in, packed training sequences out.

Stages, each over all that its predecessor kept:

1. ``language_id`` drops documents without a letter, and those of which no learned language
   has half of the letters.
2. ``near_duplicates`` keeps one document of each group linked by five-word shingles with a
   Jaccard similarity of 0.8 or more: the smallest doc_id.
3. ``repeated_passages`` cuts runs of several sentences, of 16 words or more, that occur earlier.
4. ``mixing`` draws blocks of words by source weights; a document may come back whole, in
   part, or up to three times.
5. ``packing`` fills sequences of several permitted lengths.

All but the last return the columns of documents. Documents that a stage doesn't reject
pass unchanged. Nulls, empty tables, repeated rows and extra columns behave as the
operators' modules state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestlens.llm import jaccard, language, mixing, packing, spans
from harvestlens.llm.common import stored, table

LEAST_SHARE = 0.5  # of a document's letters in its language


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; the model is fitted on rows that aren't held out."""
    model = language.train(language.training_rows(docs))
    found = language.identify(docs, model)
    good = (F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_SHARE)
    return found.filter(good).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs, shingle=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = spans.remove_repeats(docs).drop("n_sentences", "n_removed")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.sequences(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# SQL can't express language models, similarity components or best-fit packing; the tests
# compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
