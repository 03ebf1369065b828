"""A training corpus in five stages.

Toxic documents go, repeated lines go, near-duplicates (five words, a similarity of 0.8) go, personal data is replaced,
and what is left is packed into sequences.

Defined results, of every stage but the last: the columns of docs stay as they are, whatever their names, with null,
empty and very long texts among them; an empty table stays empty. A null or empty text is not toxic, has one empty line,
no near-duplicate and no personal data, and is packed as the closing id alone. A null doc_id is a document like others.
Rows that repeat a doc_id and text stay or go together and get equal texts; of rows that repeat a text under several ids
the least id stays. Without toxic or clean labels nothing is toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkwright.llm import line_dedup, minhash, packing, pii, toxicity
from linkwright.llm.common import drop_since, mark, materialise, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, toxicity.train(spark, docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(spark, docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.first_of_each(spark, docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.with_surrogates(spark, docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(spark, docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_repeated_lines),
    ("near dedup", drop_near_duplicates),
    ("pii", replace_personal_data),
    ("packing", pack_sequences),
]

#: SQL can express neither the fitted model nor the tokenizer: the tests hold run() against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over all that the one before kept; each result is written as Parquet and read again.

    When a stage's result is written, what the stage has written on its way goes, and so does the result before.
    """
    docs, since = table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES[:-1]:
        docs = materialise(spark, stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        drop_since(spark, since, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
