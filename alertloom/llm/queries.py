"""One registered query per operator: the contract's columns over whole tables."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from alertloom.llm import (
    chat, decontaminate, manifest, minhash, mixing, pii, quality, repeats, set_join, sharding, toxicity, variants, warc,
)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_minhash_near_dedup(spark, sf_dir):
    found = minhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op2_toxicity_grammar(spark, sf_dir):
    return toxicity.score_toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_warc_dictionary_archive(spark, sf_dir):
    manifest = warc.write_archives(_read(spark, sf_dir, "pages"))
    return warc.read_archives(manifest, manifest._folder).drop("url")


def op4_pareto_source_mix(spark, sf_dir):
    mixed = mixing.mix_sources(_read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_kd_tree_shards(spark, sf_dir):
    return sharding.shard_documents(_read(spark, sf_dir, "documents"))


def op6_wu_manber_decontamination(spark, sf_dir):
    found = decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_budgeted_chat_windows(spark, sf_dir):
    said = "</s>[INST] ok [/INST]"
    check = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = _read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(check)
    return chat.conversation_digests(chat.format_windows(turns))


def op9_line_first_quality(spark, sf_dir):
    judged = quality.clean_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_suffix_array_dedup(spark, sf_dir):
    return repeats.repeated_bytes(_read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_bootstrapped_personal_data(spark, sf_dir):
    return pii.personal_data(_read(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.regexp_replace("text", "\n", "")).otherwise(F.col("text"))
    rows = manifest.merkle_manifest(docs, found=manifest.leaf_digest([*manifest.FIELDS[:-1], tampered]))
    folded = rows.withColumn("folded_root", manifest.fold(F.col("path"), F.col("found")))
    return folded.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", manifest.proof_digest(F.col("path")).alias("proof_sha256"),
                         "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_set_relation_join(spark, sf_dir):
    return set_join.jaccard_components(_read(spark, sf_dir, "documents"))


def op11_spelling_variants(spark, sf_dir):
    return variants.spelling_variants(_read(spark, sf_dir, "documents"))
