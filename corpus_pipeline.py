"""A corpus from raw documents: filter, dedup, near-dedup, mix, pack.

Each stage is one operator of skein.llm. A stage takes (spark, docs, sf_dir)
and returns a DataFrame; run() writes what it returns to the shared folder and
reads it back as the next stage's docs. All but the last stage return the
columns of documents.

A verdict belongs to a row, not to its id: rows are named by their place in the
files that the stage reads, so ids may repeat or be null. Of equal or nearly
equal texts exactly one row stays: of those with the smallest doc_id (null ids
after all numbers) the first.

Defined cases, for every stage: a null text is an empty text; an empty table
passes through; repeated rows are copies and leave one; ties go to the smallest
doc_id; very long texts are read whole; columns beside those of documents are
dropped at the start, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm import exact_dedup, minhash, mixing, packing, quality_model
from skein.llm.common import materialize, read, release, row_keys, without

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality_model.keep(docs, read(spark, sf_dir, "labels"), COLUMNS)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays."""
    keyed = row_keys(docs.select(*COLUMNS))
    return without(keyed, exact_dedup.surplus(keyed))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) the smallest doc_id stays."""
    keyed = row_keys(docs.select(*COLUMNS))
    return without(keyed, minhash.surplus(keyed, k=5, percent=80))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled towards the raked weights."""
    return mixing.sample(docs, COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, with sequence and offset."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_duplicates),
    ("minhash_near_dedup", near_duplicates),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Learned weights, hashes and a tokenizer decide; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        release(before)
    return docs
