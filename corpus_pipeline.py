"""From raw documents to packed sequences: quality, toxicity, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``docs``, whatever their names. Documents that a stage rejects are gone for the next. ``docs`` has doc_id, text, lang and
source; each may be null. Every stage gives an empty table for an empty one, takes texts whole
however long they are, and treats repeated rows as documents of their own unless it says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm import mixing, packing, quality, text_dedup, toxicity
from tallyspark.llm.common import read, scratch_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents whose quality score is below a half go; at a half they stay.

    Null and empty texts are scored as texts without words, null sources and langs are sites of their own.
    Without labels every document is held for good.
    """
    return quality.accept(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents whose toxicity is a half or more go.

    Null and empty texts have the score of no terms, which is the share of toxic labels; without labels none goes.
    """
    return toxicity.reject(docs, toxicity.train(docs, read(spark, sf_dir, "labels"), None))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: one document of each group of near duplicates (five words, 0.8) stays, that of the least id.

    Null and empty texts link with nothing and stay; so do documents without an id, which links can't name, and
    all rows of a repeated id that is the least of its group.
    """
    return text_dedup.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents as often as the mix takes them, so none to two times.

    Null and empty texts have no words and are taken by their source's rate like others; null sources are one source.
    """
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: pieces of documents with their sequences and offsets; a null or empty text is a piece of its end id alone."""
    return packing.pack(docs)


STAGES = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learnt models and tokenizers can't be expressed in SQL; tests/llm/test_pipeline.py works run()'s rows out plainly.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
