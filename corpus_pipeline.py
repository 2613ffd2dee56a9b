"""A corpus in four stages: language, near copies, personal data, packing.

Each stage is a function of (spark, docs, folder of tables) and works on what
the stage before kept; all but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import crf, packing, pii, simhash
from tidemark.llm.bpe import vocabulary
from tidemark.llm.rows import documents
from tidemark.session import cut_lineage

LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts whose words are mostly of one known language.

    Null texts, texts without letters and mixtures in which no language has half
    of the words go. If no row names a language, all texts with letters stay.
    """
    model = crf.learn(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    found = crf.predict(docs.select(F.struct(*columns).alias("row"), F.col("text").alias("text")), model)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group whose SimHash fingerprints, of three-word shingles, link at two bits or fewer."""
    return simhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Personal data in texts replaced by surrogates; n_chars follows the text."""
    done = pii.replace(docs)
    if "n_chars" not in docs.columns:
        return done
    return done.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))


def sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens, with their ids."""
    path = vocabulary("byte_bpe_50k.json")
    return packing.pack(docs, path, loss=packing.LOSS_TOKENS, loss_from=packing.LOSS_FROM)


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("personal_data", personal_data),
    ("packing", sequences),
]

# SimHash, trained models and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """The sequences of the whole table `documents`; every stage's result is stored."""
    docs = documents(spark, folder)
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, folder))
    return STAGES[-1][1](spark, docs, folder)
