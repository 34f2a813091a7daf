"""The training-data pipeline: stages applied one after another to the documents.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept. Between
stages the documents are written as Parquet to the shared folder and read again, so a lost
executor never reaches back over a stage. All stages but the last return the columns of ``docs``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from surety.llm import near_copies, packing, pii, quality, simhash, suffix_dedup
from surety.llm.common import tidy
from surety.llm.queries import vocabulary
from surety.session import checkpoint_dir, materialise


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality field does not reject; it learns from their labels."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group; of what is left, one of each group with Jaccard at least 0.8.

    SimHash fingerprints at most two bits apart are linked first. Near copies that lie further apart
    in bits are found among the remaining documents by five-word shingles, compared exactly.
    """
    left = materialise(simhash.keep_one(docs))
    tidy(spark)
    return near_copies.keep_one(left)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that also start elsewhere; emptied documents stay."""
    return suffix_dedup.remove_repeats(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return pii.redact(docs, pii.train(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: one row per piece with its token ids and its place."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), keep_ids=True)


STAGES = [
    ("quality_classifier", good_documents),
    ("simhash_near_dedup", one_of_each_group),
    ("suffix_array_dedup", without_repeats),
    ("pii", without_personal_data),
    ("best_fit_packing", packed),
]

#: Model scores, tokenizer ids and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
