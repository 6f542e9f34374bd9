"""The registered queries of this subpackage and their SQL.

Each query applies one operator, with production parameters, to its whole
table and derives the contract's columns from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, fim, langid, licenses, linerules, neardup, packing, pagetext, prefixtrie, quality, repeats, toxicity
from .common import id_bucket, table
from .queries_sql import SQL


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.sql(f"select -1L conv_id, i turn, element_at(array('user', 'assistant'), cast(i as int) + 1) role, '{said}' text from range(2) t(i)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(more)
    return chat.digest(chat.format_conversations(rows))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.classify(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~id_bucket("doc_id", 5).isin(0, -1)
    )
    return scored.select(
        "doc_id", (id_bucket("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), keep_ids=False)


def op5_toxicity_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), lambda c: ~id_bucket(c, 3).isin(1, -1))
    return toxicity.score(docs, model).select(
        "doc_id", (id_bucket("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_hits"
    )


def op6_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return pagetext.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_decontamination_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.where("contaminated")


def op8_license_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linerules.apply_rules(table(spark, sf_dir, "documents"), keep_text=False)


def op10_language_ecoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.train(docs))
    return found.select(
        "doc_id", (id_bucket("doc_id", 4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"),
        F.col("lang_ambiguous").alias("ambiguous"),
    )


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", "output_sha256",
        F.sha2(fim.restore(), 256).alias("restored_sha256"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, ids = prefixtrie.share_heads(prefixtrie.numbered_turns(table(spark, sf_dir, "conversations")))
    return prefixtrie.prefix_trie(turns, ids).drop("digest")


def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), keep_text=False).drop("kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return {**dict(sorted(own.items())), "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
