"""A corpus pipeline over ``documents``: filter, deduplicate, pack.

Each stage is ``(name, function)``; a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and reread as the next stage's ``docs``. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapstore.llm import best_fit, jaccard_forest, line_dedup, quality_rules, toxicity
from snapstore.llm.common import materialise, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and resemble a language reference."""
    return quality_rules.apply_rules(docs).where("kept").select(docs.columns)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, takes for clean."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("predicted = 0").select(docs.columns)


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier document holds; ``n_chars`` follows the text."""
    d = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return d.select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the least doc_id."""
    return jaccard_forest.keep_one(docs).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, placed in sequences."""
    return best_fit.pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("toxicity", not_toxic),
    ("line_dedup", lines_once),
    ("jaccard_join", one_of_each),
    ("best_fit", packed),
]

#: Trained models, MinHash tries and tokenisers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not packed:
            docs = materialise(docs, f"pipeline-{name}")
    return docs
