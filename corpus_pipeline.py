"""Training corpus from documents: rules, boilerplate, near copies, mixture, sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.llm import jaccard_join, line_dedup, mixing, packing, quality_rules
from notemill.llm.common import split_size, stored, with_owner
from notemill.operators.sizing import broadcast_if_small

#: Learned rules, optimised packings and tokenizers are beyond SQL.
ORACLE_SQL = None
#: On two pages a line can be a quotation; from three different ones on the ratio decides, at every size of host.
LEAST_PAGES = 3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the learned list rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rules = quality_rules.learn(*quality_rules.training_rows(docs, labels))
    return quality_rules.judge(docs, rules).where("kept").select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their hosts' boilerplate lines; n_chars follows the text. Copies count as one page: they are the next stage's."""
    out = line_dedup.drop_boilerplate(docs, min_pages=LEAST_PAGES, copies=False)
    new = {"text": F.col("text"), "n_chars": F.when(F.col("n_dropped") > 0, F.length("text").cast("bigint")).otherwise(F.col("row.n_chars"))}
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones, that of the smallest id; of equal rows one. Texts that share an id are documents of their own."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text")
    rows = with_owner(rows).select("row", F.col("owner").alias("doc_id"), "text")
    linked = stored(jaccard_join.link(rows), "linked")
    gone = linked.where("doc_id <> component_id").select("doc_id").distinct()
    left = rows.join(broadcast_if_small(gone), "doc_id", "left_anti")
    twice = stored(linked.where("doc_id = component_id AND n_shingles > 0").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    if not twice.isEmpty():
        few = broadcast_if_small(twice)
        once = left.join(few, "doc_id", "left_anti").select("row", "doc_id")
        left = once.unionByName(left.join(few, "doc_id", "left_semi").select("row", "doc_id").dropDuplicates(["doc_id"]))
    return left.select("row.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order that interleaves their sources to the target weights."""
    return mixing.mixed(docs, F.octet_length("text"), split_size(spark))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 1024 tokens, numbered in mixed order.

    Files keep no order by contract: the slots are derived again, the same ones for the same documents.
    """
    return packing.pack(mixture(spark, docs, sf_dir), ordered=True)


STAGES = [
    ("quality rules", quality), ("line dedup", lines), ("near copies", near_copies), ("mixing sources", mixture), ("packing", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
