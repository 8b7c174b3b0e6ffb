"""The queries opN_<name>: each applies its operator to the whole documents or conversations table."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkgrain.llm import langid, licenses, pii, quality, secrets, toxicity
from talkgrain.llm.common import documents
from talkgrain.llm.decontaminate import leaks
from talkgrain.llm.exact_substrings import remove_repeats
from talkgrain.llm.fingerprints import fingerprints
from talkgrain.llm.near_dedup import near_duplicates
from talkgrain.llm.packing import pack
from talkgrain.llm.prefix_trie import prefix_trie
from talkgrain.llm.repair import repair
from talkgrain.llm.sql import ORACLE_SQL  # noqa: F401


def op1_minhash_near_dedup(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir))


def op2_decontamination(spark, sf_dir):
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_suffix_dedup(spark, sf_dir):
    return remove_repeats(documents(spark, sf_dir))


def op4_best_fit_packing(spark, sf_dir):
    return pack(documents(spark, sf_dir))


def op5_license_scan(spark, sf_dir):
    return licenses.scan(documents(spark, sf_dir))


def op6_secret_scan(spark, sf_dir):
    return secrets.summary(secrets.scan(documents(spark, sf_dir)))


def op7_personal_data(spark, sf_dir):
    return pii.summary(pii.scan(documents(spark, sf_dir)))


def op8_quality_rules(spark, sf_dir):
    """Learns from labels of documents whose crc32 leaves 0 or 2 on division by 3."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.score(documents(spark, sf_dir), labels, ~langid.held_out(F.col("doc_id"), 3, 1))
    return scored.select("doc_id", langid.held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_language_id(spark, sf_dir):
    """Learns from documents whose crc32 leaves 0, 1 or 3 on division by 4."""
    docs = documents(spark, sf_dir)
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"), 4, 2)))
    return langid.predict(docs, model).select("doc_id", langid.held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


def op10_fingerprints(spark, sf_dir):
    return fingerprints(documents(spark, sf_dir))


def op11_toxicity(spark, sf_dir):
    """Learns from labels of documents whose crc32 leaves 0, 1 or 3 on division by 4."""
    held = langid.held_out(F.col("doc_id"), 4, 2)
    scored = toxicity.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_hits", "n_words")


def op12_prefix_trie(spark, sf_dir):
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_conversation_repair(spark, sf_dir):
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_license_scan": op5_license_scan,
    "op6_secret_scan": op6_secret_scan,
    "op7_personal_data": op7_personal_data,
    "op8_quality_rules": op8_quality_rules,
    "op9_language_id": op9_language_id,
    "op10_fingerprints": op10_fingerprints,
    "op11_toxicity": op11_toxicity,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_conversation_repair": op13_conversation_repair,
}
