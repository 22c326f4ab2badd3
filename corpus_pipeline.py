"""The corpus pipeline: toxicity, exact dedup, n-gram Jaccard join, substring
dedup, packing.

Every stage takes the documents that its predecessor kept, as written Parquet,
and all but the last return the columns of ``documents`` (further ones, too).
Rows that repeat or lack a ``doc_id`` are told apart: each is kept or dropped on
its own, the first of equal ones in id order stays, and an empty table gives one.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import exact_dedup, ngram_join, packing, substring_dedup, toxicity
from quillspark.llm.common import ROW, Workspace, join_counted, keyed, table
from quillspark.llm.queries import tokenizer_file


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the toxicity models reject; those without text or id
    are scored like any other."""
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic")
    model = toxicity.train(Workspace(spark, "stage1"), docs.select("doc_id", "text"), labels)
    return toxicity.score(docs, model, keep=True).where(F.col(toxicity.SCORE) < toxicity.THRESHOLD).drop(toxicity.SCORE)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of equal texts (null counts as empty)."""
    ws = Workspace(spark, "stage2")
    docs = keyed(docs, ws)
    gone = exact_dedup.dedup(docs, ws, id_col=ROW).where("not kept").select(ROW)
    return join_counted(docs, ws.keep(gone, "gone"), ROW, "left_anti").drop(ROW)


def distinct_sets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each component of near duplicates; those without
    words are alone in theirs."""
    ws = Workspace(spark, "stage3")
    docs = keyed(docs, ws)
    gone = ngram_join.similar(docs, ws, id_col=ROW).where(f"{ROW} <> component_id").select(ROW)
    return join_counted(docs, ws.keep(gone, "gone"), ROW, "left_anti").drop(ROW)


def distinct_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove repeated lines and passages, and set ``n_chars`` of what is left; a
    document of which nothing is left goes, one that was empty or null stays."""
    ws = Workspace(spark, "stage4")
    docs = keyed(docs, ws)
    found = ws.keep(substring_dedup.repeats(docs, ws, id_col=ROW), "found")
    done = substring_dedup.remove(docs, found, ws, id_col=ROW).drop(ROW)
    done = done.where(F.col("text").isNull() | (F.col("text") != "") | (F.col("n_chars") == 0))
    return done.withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 4096 tokens."""
    return packing.pack(docs, Workspace(spark, "stage5"), tokenizer_file("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("toxicity", clean),
    ("exact_dedup", distinct_texts),
    ("ngram_jaccard", distinct_sets),
    ("substring_dedup", distinct_passages),
    ("packing", packed),
]

#: The first and the last stage cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws, docs = Workspace(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = ws.keep(stage(spark, docs, sf_dir), f"{k}-{name}")
    return docs
