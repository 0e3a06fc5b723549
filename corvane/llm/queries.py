"""The contract queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, embedding_duplicates, license_scan, mixing, near_duplicates, packing, prefix_trie, private_data, quality, resharding, source_divergence, token_counts, topk_search
from .common import table
from .oracles import ORACLES as ORACLES

#: Tokens over which a document is called long.
TOKEN_LIMIT = 512


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return private_data.find(docs, private_data.train(docs))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    counted = token_counts.count_tokens(docs, "doc_id", "text", tokenizer_path("byte_bpe_50k.tiktoken"), {"<|endoftext|>": 50256}, public_tokenizers.PATTERN)
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op8_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = resharding.reshard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard", "moved")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "\\### Assistant: </turn> ok"
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema))
    record = lambda *fields: F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    prompt, response = record(F.col("text").alias("prompt")), record(F.col("text").alias("response"))
    payload = F.when(F.col("role") == "user", prompt).when(F.col("role") == "assistant", response).otherwise(record("role", "text"))
    records = rows.select("conv_id", "turn", payload.alias("payload"))  # three layouts
    turns = chat_format.canonical_turns(records, "payload")
    return chat_format.digests(chat_format.format_conversations(turns))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.group_documents(table(spark, sf_dir, "documents"))


def op7_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates.link_vectors(table(spark, sf_dir, "embeddings"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.col("host").alias("source"), "path", F.col("p").alias("doc_score"), F.col("site").alias("site_score"), "score", "accepted")


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(table(spark, sf_dir, "documents"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_private_data,
        op2_packing,
        op3_token_counts,
        op4_mixing,
        op5_chat_format,
        op6_near_duplicates,
        op7_embedding_duplicates,
        op8_resharding,
        op9_quality,
        op10_topk_search,
        op11_prefix_trie,
        op12_source_divergence,
        op13_license_scan,
    )
}
