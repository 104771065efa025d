"""A corpus pipeline: five operators, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next stage's ``docs``. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedspark.llm import decontamination, language_id, mixing, near_dedup, toxicity
from feedspark.llm.shared import small, table, written

#: Near-duplicates: words of a shingle and percentage of the union.
WORDS, PERCENT = 5, 80
#: Rejected ids up to which they are broadcast; beyond, they are joined by shuffle.
BROADCAST_IDS = 500_000

#: Trees, Viterbi paths, set similarity and dual iterations aren't expressed in SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def _without(docs: DataFrame, rejected: DataFrame, name: str) -> DataFrame:
    """``docs`` less the rows of the rejected ids (one column, doc_id); rows of a null id stay."""
    return docs.join(small(written(rejected, name), BROADCAST_IDS), "doc_id", "left_anti")


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on ``labels``, calls toxic go; null and empty texts are scored as texts without words."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the languages of the column lang go: texts that are null or have no letters, and
    those of which less than a quarter is surely in one of them."""
    return language_id.keep_identified(docs, language_id.train(docs))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest id stays; of rows that repeat an id, one."""
    found = near_dedup.near_duplicates(docs, WORDS, PERCENT)
    out = _without(docs, found.where("NOT kept").select("doc_id").distinct(), "duplicates")
    repeated = written(docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return out
    some = small(repeated, BROADCAST_IDS)
    first = out.join(some, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*[F.col(c) for c in docs.columns if c != "doc_id"])).alias("r"))
    return out.join(some, "doc_id", "left_anti").select(docs.columns).unionByName(first.select("doc_id", "r.*").select(docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of ``benchmark`` go, however long they are: a window of an item is enough.

    Measured by the share of its words, as op4's ``contaminated`` is, a long document would keep whole passages.
    """
    found = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.where("n_hit > 0").select("doc_id").distinct(), "contaminated")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: a row for each copy of a document that it takes.

    Columns of documents, and copy (from 1), copies, size, source_size, target (the source's) and
    taken (words of this row); of these names the mix's own column counts, and the documents' is left out. Documents of
    which no copy is taken, and those without words, go.
    """
    docs_columns = [c for c in docs.columns if c.lower() not in ("copy", "copies", "size", "source_size", "target", "taken")]
    plan = mixing.plan(written(mixing.sized(docs), "sized"))
    rows = docs.select(*[F.col(c).alias(f"d_{c}") for c in docs_columns], *[c.alias(n) for n, c in mixing.measures().items()])
    mixed = mixing.apply(rows, plan).where("copies > 0 AND size > 0")
    mixed = mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return mixed.select(*[F.col(f"d_{c}").alias(c) for c in docs_columns], "copy", "copies", "size", "source_size", "target", F.col("size").alias("taken"))


STAGES = [
    ("toxicity", remove_toxic),
    ("language_id", identify_language),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
