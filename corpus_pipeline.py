"""A corpus pipeline: language, near duplicates, personal data, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as
Parquet and read again for the next one. All but the last return documents' columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atrisk.llm import jaccard, langid, packing, pii
from atrisk.llm.common import written

KEY = "surrogates"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose language stays ambiguous; where no
    document has a label, there is no model, and all with a letter stay."""
    model = langid.train(docs)
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    longest = max(docs.columns, key=len)
    names = tuple(f"{longest}_{i}" for i in range(3))  # of no column of the input
    known = langid.label(docs, model, names=names)
    return known.filter((F.col(names[0]) != langid.UND) & ~F.col(names[2])).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates the document with the smallest doc_id."""
    return jaccard.survivors(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by keyed surrogates."""
    return pii.replace(docs, KEY).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 1024 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", packed)]

#: The stages (a trained model, a similarity join, a keyed permutation, a tokenizer) are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
