"""The corpus pipeline: every stage takes the documents that its predecessor kept, as a written table.

No SQL can say the language model and the tokenizer, so ``ORACLE_SQL`` is None; ``tests/llm`` holds every stage and
the whole run against plain Python.
"""

from __future__ import annotations

from public_tokenizers import path as vocabulary
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flockpoint.llm.langid import UNKNOWN, held_out, tagged, train
from flockpoint.llm.linededup import drop_boilerplate
from flockpoint.llm.mixing import mixed_documents, plausible_words
from flockpoint.llm.neardup import near_duplicates
from flockpoint.llm.packing import pack_documents
from flockpoint.llm.textbytes import small_batches
from flockpoint.session import cut

ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known stay; a missing ``lang`` is filled in.

    Rejected are texts without a letter (or without text), and those no language explains better than all others together.
    """
    model = train(docs.filter(~held_out(F.col("doc_id"))).select("text", "lang"))
    known = tagged(docs, model).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= 0.5))
    return known.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate of their source are gone from every text."""
    return drop_boilerplate(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five-word shingles, likeness 0.8 or more."""
    gone = near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 5, 2, 1, together 150 % of all words, at most twice their own; repeats are rows."""
    return mixed_documents(docs, quality=plausible_words())


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix", mix), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with small_batches(spark):
        for _, stage in STAGES:
            docs = cut(stage(spark, docs, sf_dir))
    return docs
