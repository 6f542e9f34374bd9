"""From raw documents to packed training sequences, in five stages.

Each stage works on all rows its predecessor kept and drops what its operator
rejects; all but the last return the columns of ``documents``. An id stands for
all its rows: a rejected id takes its repeated rows with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm import decontam, langid, neardup, packing, quality
from tallyhouse.llm.common import drop_staged, id_bucket, removing, stage, table


def without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """``docs`` less the rows whose id is in ``rejected`` (null ids stay)."""
    return docs.join(rejected.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a language (``und``) or with an ambiguous one."""
    found = langid.identify(docs, langid.train(docs))
    return found.where("lang_pred <> 'und' and not lang_ambiguous").select(*docs.columns)


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts whose quality score is below 0.3."""
    scored = quality.classify(docs, table(spark, sf_dir, "labels"), ~id_bucket("doc_id", 5).isin(0, -1))
    return without(docs, scored.where("score < 0.3"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group."""
    return without(docs, neardup.near_duplicates(docs).where(~F.col("kept")))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that hold a benchmark item."""
    return without(docs, decontam.leaks(docs, table(spark, sf_dir, "benchmark")).where("contaminated"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 4096 tokens."""
    return packing.pack(docs, keep_ids=False)


STAGES = [
    ("language", identify_language),
    ("quality", filter_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("packing", pack_sequences),
]

#: Trained models, signatures and a tokenizer are beyond SQL; tests/llm checks
#: the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage leaves in the shared folder goes once the next
    one is written, and the last one's pieces when the application ends."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        with removing(spark) as keep:
            after = keep(stage(function(spark, docs, sf_dir), name))
        drop_staged(docs)
        docs = after
    packed = STAGES[-1][1](spark, docs, sf_dir)
    # packing has written its pieces and reads the texts no more
    drop_staged(docs)
    return packed
