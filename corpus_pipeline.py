"""The corpus pipeline: five stages over the documents table, each written and read again.

toxicity -> n-gram Jaccard -> substring deduplication -> benchmark decontamination -> packing.
Every stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the columns
of the documents, whatever others they have (a stage's own columns never clash with them).

In all stages a null or empty text has no words: it isn't toxic, copies nothing, holds no passage and is packed as its end
id alone. Of repeated rows the second stage keeps one. An empty table goes through all stages and gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from stratagraph.llm import decontaminate, jaccard, ordinal, packing, substring
from stratagraph.llm.common import delete, prepare, scratch
from stratagraph.llm.queries import tokenizer_path


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents graded toxic; the grader learns from the labels table.

    Without labels nothing is dropped. Repeated rows get the same grade; ids may be null.
    """
    prepare(spark)
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = ordinal.fit(texts, spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic")
    return ordinal.reject(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group linked by five-word shingles at a Jaccard similarity of 0.8.

    First: the least id (null before all), then the least hash of the text. Texts without words link with nothing and stay.
    """
    prepare(spark)
    return jaccard.keep_one(docs, n=5, num=4, den=5)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the words of 20-word windows that occur earlier, in the order of ids; no document goes, null texts stay null."""
    prepare(spark)
    return substring.remove_repeats(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold ten consecutive words of a benchmark item; without items nothing is dropped."""
    prepare(spark)
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into windows of 2048 tokens: one row a piece, with its ids."""
    prepare(spark)
    return packing.pack(docs, tokenizer_path(), with_ids=True)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("benchmark_leaks", benchmark_leaks), ("packing", pack)]

#: The first stage is a trained grader and the last runs a tokenizer: SQL has no words for either.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage gives is written to the shared checkpoint folder and read by the next.

    What a stage has read goes, with its own working tables, once its rows are written; the tables of other frames of the session stay.
    """
    prepare(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        at = f"{folder}/{k}-{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            delete(spark, before)
        before = at
    return docs
