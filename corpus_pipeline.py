"""A corpus pipeline of five stages; each works on all that the one before kept.

toxicity: documents scored as toxic go. near_duplicates: of each group of near copies (five-word shingles, similarity 0.8, groups by
links) the least doc_id stays. decontamination: documents that the benchmark contaminates go. personal_data: entities are replaced
by surrogates, and n_chars follows. packing: the documents' tokens are packed into sequences of 4096.

All stages but the last return the columns of documents as they were, whatever further ones are named. Null and empty texts pass every filter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import decontaminate, ngram_join, packing, pii, toxicity
from rasterloom.llm.common import apart, read, staged


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    machine = toxicity.train(docs, read(spark, sf_dir, "labels"))
    own, back = apart(docs, "text")
    return back(toxicity.scored(own, machine).where("predicted = 0"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.representatives(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, read(spark, sf_dir, "benchmark"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own, back = apart(docs, "text", "n_chars")
    out = pii.replaced(own)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_entities") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return back(out)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(staged(packing.pieces(docs)))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("packing", packing_stage),
]

#: Learned scores and token ids are not expressible in SQL; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        docs = out if name == STAGES[-1][0] else staged(out)
    return docs
