"""The registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlex.llm import chat, decontaminate, flac, hash_shards, licenses, oracles, packing, prefix_trie, quality, simhash, spelling, substring_dedup, suffix_dedup, token_output
from netlex.llm._common import table, written


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_simple8b_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.read_ids(token_output.write_ids(table(spark, sf_dir, "documents"), tokenizer()))


def op3_length_bucket_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer())


def op4_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.features(flac.store(table(spark, sf_dir, "documents")))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Passages of some 50 words are often shorter than 400 bytes: n_shared tells of all strings of 280 bytes that repeat.
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"), whole_characters=False, shorter=(160, 121)).drop("kept")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), size=3, threshold=2)


def op7_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    row = lambda turn, role: F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(turn).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(said).alias("text"))
    extra = spark.range(1).select(F.inline(F.array(row(0, "user"), row(1, "assistant"))))
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.read_back(written(chat.expand(conversations), "chat")))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents")).drop("kept")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie_of(*prefix_trie.rebuilt(prefix_trie.turn_digests(table(spark, sf_dir, "conversations"))))


def op12_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_shards.shard(table(spark, sf_dir, "documents"), shards=24)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_simple8b_token_output": op2_simple8b_token_output,
    "op3_length_bucket_packing": op3_length_bucket_packing,
    "op4_flac_media": op4_flac_media,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_latent_decontamination": op7_latent_decontamination,
    "op8_quality_rules": op8_quality_rules,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_hash_tree_shards": op12_hash_tree_shards,
    "op13_spelling_variants": op13_spelling_variants,
}
SQL = oracles.SQL
