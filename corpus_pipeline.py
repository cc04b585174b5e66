"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read again as the next one's input.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
Edge cases: every stage takes null and empty texts, repeated rows and empty tables; what it does with them is in its
docstring and in that of its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakforge.llm import decontaminate, language_id, mixing, near_dups, secret_scan
from peakforge.llm.common import fresh, materialize

#: A text goes if its best language contains less than this share of its n-grams.
LEAST_SHARE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters (null and empty texts too) and those that fit no learned language.

    Whole texts are judged row by row, so repeated rows stay or go together; an empty table stays empty.
    """
    model = language_id.fit_languages(docs.filter(~language_id.held_out(F.col("doc_id"))))
    if not model.langs:  # nothing is labelled: only texts without letters go
        return docs.filter(language_id.has_letters(F.col("text")))
    language = fresh(docs, "language")
    told = language_id.predict_languages(docs, model, "text", language)
    return told.filter((F.col(language)["lang"] != language_id.UND) & (F.col(language)["score"] >= LEAST_SHARE)).drop(language)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least doc_id of each class of near duplicates.

    Null texts all stay and are in no class, texts without words only in that of equal ones; of repeated rows one stays,
    and a null doc_id counts as last. An empty table stays empty.
    """
    return near_dups.drop_near_duplicates(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which a benchmark item appears.

    Null and empty texts and items match nothing; whole texts are searched; repeated rows stay or go together; with an
    empty benchmark every document stays.
    """
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts and count the characters anew; every document stays, repeated rows too.

    Null texts stay null, with a null n_chars; empty ones stay empty. Overlapping secrets become one replacement.
    """
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their number of copies and the words taken.

    Null and empty texts have no words and are not taken; a null source is a source of its own; ties and repeated rows are
    as in ``mixing.mix_sources``. An empty table gives an empty mix.
    """
    mixed = mixing.mix_sources(docs)
    return mixed.filter("copies > 0").select("doc_id", "text", "lang", "source", "n_chars", "size", "copies", "taken", "target")


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("secret_scan", redact_secrets),
    ("source_mixing", mix_sources),
]

#: SQL expresses neither the Bloom filters nor BagMinHash classes; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
