"""A corpus made ready for training: toxic texts out, exact and near copies out, repeated passages out, packed.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a DataFrame that is
written as Parquet and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import exact_dedup, jaccard_join, packing, substring_dedup, toxicity
from lodestone.llm.common import discard, staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learnt from the labels, does not reject; a null text counts as empty, repeats stay."""
    labels = table(spark, sf_dir, "labels").filter(~toxicity.held_out())
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.filter("predicted = 0").select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id; of rows that repeat it, all. A null id stays if no other has its text."""
    return exact_dedup.exact_dedup(docs).filter("kept").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, Jaccard of 0.75 or more) the document with the smallest id.

    Documents without words or with a null id, and rows that repeat the smallest id, stay.
    """
    return jaccard_join.keep_one(docs)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words or more that a document of smaller id has.

    Texts that lose nothing stay as they are, null ones too; a document that loses every word goes.
    """
    cut = substring_dedup.substring_dedup(docs, 50)
    cut = cut.filter("n_removed = 0 OR n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumns({"text": text, "n_chars": n_chars}).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept document's token pieces and their places in sequences of at most 4096 tokens.

    A null or empty text is its end token; repeated rows are packed each.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("substring dedup", drop_passages),
    ("best-fit packing", pack),
]

#: SQL can express neither the model nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder.

    Every stage's result is a table in the shared folder; what a stage wrote on its way, and the table it read, are
    removed once its own is there, so that only the last remains. Nulls, repeated rows and empty tables pass as the
    stages' operators define: a null text is an empty one, rows with a null id are compared with no others but equal texts.
    """
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        made = staged(spark, name.replace(" ", "-"), lambda: stage(spark, docs, sf_dir))  # noqa: B023
        if k:
            discard(docs)
        docs = made
    return docs
