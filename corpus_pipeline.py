"""Corpus pipeline: toxicity, line dedup, near duplicates, decontamination,
packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the
stage before kept.  All but the last return the columns of ``documents``; the
last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shipcast.llm import decontaminate, line_dedup, near_duplicates, packing, toxicity
from shipcast.llm.common import staged
from shipcast.llm.queries import tokenizer_path
from shipcast.sources.tables import read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents of the stage's input; documents that
    score as toxic go."""
    model = toxicity.fit_toxicity(docs, read_table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.drop_toxic(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs are deleted from the texts; a document of which
    nothing is left goes.  n_chars follows a changed text."""
    out = line_dedup.dedup_lines(spark, docs)
    changed = F.col("n_removed") > 0
    kept = out.where(~changed | (F.col("n_removed") < F.col("n_lines")))
    values = {
        "text": F.when(changed, F.col("kept_text")).otherwise(F.col("text")),
        "n_chars": F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")),
    }
    return kept.select(*[values.get(c, F.col(c)).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that of its smallest doc_id."""
    classes = staged(spark, near_duplicates.near_duplicates(spark, docs), "classes")
    return near_duplicates.one_of_each(spark, docs, classes)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words in a row of a benchmark item go."""
    found = decontaminate.decontaminate(spark, docs, read_table(spark, sf_dir, "benchmark"))
    bad = staged(spark, found.where("contaminated").select("doc_id", "text_key").distinct(), "contaminated")
    return near_duplicates.without(docs, bad)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens."""
    return packing.pack_documents(spark, docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: No SQL expresses learning and packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
