"""A corpus pipeline of five operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet in shared storage and read again as the next stage's documents.
All stages but the last return the columns of documents, further ones included.

Defined results, in every stage: an empty table gives no rows; nulls, empty and
very long texts, ties and repeated rows are as the stage's operator defines
them, which its docstring says and the stage's repeats in short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import langid, line_dedup, mixing, packing, simhash_dedup
from tidewright.llm.common import stored, table

#: Documents below this mean probability of their best language are rejected.
MIN_LANGUAGE_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts among them), or without a likely language, go.

    Texts are read whole; repeated rows are judged alike.  Where no row names a language, all with a letter stay.
    """
    model = langid.train(langid.training_rows(docs, lambda i: ~langid.held_out(i)))
    found = langid.predict(docs, model, keep_columns=True, results=("__lang_pred", "__score"))
    if model[1] is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return found.where((F.col("__lang_pred") != langid.UND) & (F.col("__score") >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate of their source go; documents all stay, null and emptied ones too, and n_chars follows the text."""
    kept = line_dedup.line_dedup(docs).select(*docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else kept


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the least id; texts without words are one group, equal rows stay or go together."""
    return simhash_dedup.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its source's weight draws it, in mixed order; texts are carried along as they are, null sources are one source."""
    return mixing.mix(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences; null and empty texts are their end id alone, repeated rows are packed each."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_boilerplate_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A trained network, near-duplicate groups and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
