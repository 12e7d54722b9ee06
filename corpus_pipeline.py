"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing and packing of `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's documents. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from rowsmith.llm import lines, mixing, near, packing, quality
from rowsmith.operators.shared import checkpoint_dir, remove_folder, scope, written


#: Rows that go to a Python worker at once: documents are long, and buffers are held for a batch of them.
BATCH_ROWS = 250


def _batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the forest accept; the others go."""
    _batches(spark)
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are boilerplate across sources."""
    _batches(spark)
    columns = docs.columns
    cleaned = lines.dedup(docs).select(*columns)
    if "n_chars" not in columns:
        return cleaned
    kind = docs.schema["n_chars"].dataType.simpleString()
    return cleaned.selectExpr(*[f"CAST(length(text) AS {kind}) AS n_chars" if c == "n_chars" else f"`{c}`" for c in columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    _batches(spark)
    return near.one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, repeated or in part as it says."""
    _batches(spark)
    return mixing.mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document with the bin that it is in."""
    _batches(spark)
    return packing.pack(written(packing.measured(docs)))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL = None  # the forest, the sketches and the seeded mix have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table.

    What a stage leaves behind, and the table before it, go once its own is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    done = None
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        with scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if done is not None:
            remove_folder(spark, done)
        docs, done = spark.read.parquet(path), path
    return docs
