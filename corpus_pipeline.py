"""A corpus pipeline over documents: toxicity, quality rules, near copies, mixing, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame, whose result is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.

Defined results, for every stage: a null text is the empty text; an empty table gives an empty table; a row without
doc_id is never a copy of another and stays until mixing, which takes it like others; rows that repeat (same doc_id and
text) are copies, of which one stays; where an id that stays has several texts, each of them stays once; ties are broken
by doc_id and the text's hash; columns beside doc_id, text and source are carried along whatever their names and types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.llm import mixing, near_dups, packing, quality_rules, toxicity
from terrasift.llm.common import crc_mod, read, table


def toxic_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: the documents that aren't toxic. It learns from the labelled rows of the docs it is given; where those show nothing, all stay."""
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    scorer = toxicity.train(spark, docs, read(spark, sf_dir, "labels"), held_out)
    if scorer.toxic == scorer.ordinary:
        return docs
    rows = toxicity.scored(docs.select(F.struct("*").alias("_row"), "text"), scorer, "_score")
    return rows.where(F.col("_score") < toxicity.THRESHOLD).select("_row.*")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: the documents that the quality rules keep."""
    return quality_rules.filter_documents(spark, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: one document of each group of copies and near copies."""
    return near_dups.deduplicate(spark, docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents as often as the mix takes them, in the order of training."""
    rows = docs.select("doc_id", "text", "source", F.struct("*").alias("_row"))
    return mixing.mix(spark, rows, ("_row",)).epochs().select("_row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: sequences of token ids, each of a power of two of them."""
    return packing.pack(docs).select("doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", toxic_filter),
    ("quality_rules", quality_filter),
    ("simhash_near_dedup", near_dedup),
    ("mixing", mixture),
    ("packing", packed),
]

#: The stages learn, tokenise and compress: SQL can't state them. tests/llm/ tests near_dedup and packed against brute force, mixture by its targets, and
#: the two filters by what their operators reject.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = table(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
