"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again before the next; all but
the last keep the columns of documents.  Text decisions are those of the single operators, at their own parameters; line dedup
also takes long single lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm.common import WRITTEN, clean_up, materialize, prepare, table
from halyard.llm.decontaminate import decontaminate
from halyard.llm.line_dedup import LONG_WORDS, line_dedup
from halyard.llm.packing import pack_documents
from halyard.llm.simhash import keep_one
from halyard.llm.toxicity import drop_toxic


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of op8, learnt from the labels of the input, scores at 0.5 or more go."""
    prepare(spark)
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines, and of single long lines, go; n_chars follows the text."""
    prepare(spark)
    out = line_dedup(docs, long_words=LONG_WORDS)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest id stays."""
    prepare(spark)
    return keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with enough words in benchmark passages go."""
    prepare(spark)
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its place in a training sequence."""
    prepare(spark)
    return pack_documents(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_repeated_lines),
    ("near dedup", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: SQL has neither the model nor the fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other.  Each result is written, and what the stage wrote on its way is deleted then."""
    docs = table(spark, sf_dir, "documents")
    first = len(WRITTEN)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        clean_up(spark, first, (WRITTEN[-1],))
    return STAGES[-1][1](spark, docs, sf_dir)
