"""Queries over whole tables for the operators of this package, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.llm import oracles


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectide.llm.language_model import score_texts
    from vectide.llm.quality_model import id_number

    return score_texts(_table(spark, sf_dir, "documents"), id_number("doc_id", 5) == 1)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectide.llm.substring import dedup_substrings

    out = dedup_substrings(_table(spark, sf_dir, "documents"), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectide.llm.suffix_dedup import dedup_bytes

    out = dedup_bytes(_table(spark, sf_dir, "documents"), length=100)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectide.llm.jaccard import similar_components

    return similar_components(_table(spark, sf_dir, "documents"), percent=75, width=5)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectide.llm.language import fit, identify
    from vectide.llm.quality_model import id_number

    docs = _table(spark, sf_dir, "documents")
    model = fit(docs.where(id_number("doc_id", 5) != 0))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (id_number("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectide.llm.quality_rules import apply_quality_rules

    return apply_quality_rules(_table(spark, sf_dir, "documents")).drop("failed_rule")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectide.llm.decontaminate import find_contamination

    out = find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)
    digest = F.sha2(F.concat_ws(",", "items").cast("binary"), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectide.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectide.llm.quality_model import fit, id_number, score_quality

    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(id_number("doc_id", 5) != 0))
    out = score_quality(docs, model, threshold=0.3)
    return out.select("doc_id", (id_number("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectide.llm.chat import canonical_turns, format_chat, read_back

    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    rows = rows.unionByName(spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], rows.schema))
    record = F.to_json(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content")))
    turns = canonical_turns(rows.select("conv_id", "turn", "role", "text", record.alias("record")), "record")
    # A record too long for a variant gives no turn: its row is the turn.
    own = F.array(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))
    turns = turns.select("conv_id", "turn", F.inline(F.when(F.size("turns") > 0, F.col("turns")).otherwise(own)))
    return read_back(format_chat(turns))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectide.llm.merkle import leaf, manifest

    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    own, more = ([F.col(c) for c in ("doc_id", "source", "lang")], F.col("text"))
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    rows = docs.select("doc_id", "lang", leaf(*own, F.col("n_chars"), more).alias("leaf"), F.when(tampered, leaf(*own, F.col("n_chars") + 1, more)).alias("other"))
    out = manifest(rows, other_col="other")
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectide.llm.html_extract import extract_main_text

    return extract_main_text(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op13_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectide.llm.filter_audit import audit, cells, fail_masks

    return audit(cells(fail_masks(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_suffix_array_dedup, op2_ngram_jaccard_join, op3_language_id, op4_quality_rules, op5_decontamination, op6_best_fit_packing, op7_lm_scoring, op8_substring_dedup, op9_quality_classifier, op10_chat_formatting, op11_merkle_manifest, op12_html_extraction, op13_filter_interaction_audit)}

#: SQL can't state the models of op3, op7 and op9 and the tokenizer and packing of op6; those have brute-force tests.
ORACLE_SQL: dict[str, str] = oracles.ORACLE_SQL
