"""The corpus pipeline: toxicity, language identification, exact and near duplicates, packing.

Each stage works on all rows that the one before kept, and its decision takes effect. The models of the first two are learnt from the
whole of ``documents`` and ``labels`` in ``sf_dir`` (rows that are not held out), not from what happens to be left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shapeloom.llm import exact_dedup, language, packing, simhash, toxicity
from shapeloom.llm.common import materialise, table, tokenizer_path


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def lang(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.drop_unidentified(docs, language.learn(table(spark, sf_dir, "documents")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxic), ("language id", lang), ("exact dedup", exact), ("near dedup", near), ("packing", pack)]
#: Compression lengths, profiles and fingerprints have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's rows are written to the shared folder before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, name.replace(" ", "-"))
    return docs
