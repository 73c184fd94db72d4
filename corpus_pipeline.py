"""From raw documents to token ids in five stages; each stage is written and read again."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyscope.llm import byte_bpe, language, line_chunks, ngram_join, string_tiling
from tallyscope.llm.tokens import in_small_batches
from tallyscope.session import ensure_checkpoint_dir

#: Documents whose language has a pooled probability below this are rejected.
LEAST_SCORE = 0.3
VOCABULARY = "byte_bpe_50k.tiktoken"


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that was learned."""
    text = F.col("text")
    usable = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    model = language.train(language.sample_windows(docs, text, F.col("lang"), usable))
    judged = docs.select(*docs.columns, language.predictor(model)(text).alias("__language"))
    return judged.filter(
        (F.col("__language.lang") != language.UNKNOWN) & (F.col("__language.score") >= LEAST_SCORE)
    ).select(*docs.columns)


def unrepeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out line chunks that occurred before; documents that lose all their text go with it."""
    had, left = "__had_text", "__text"
    shorter = line_chunks.dedupe(docs.withColumn(had, F.length("text") > 0)).withColumn(left, F.length("text") > 0)
    kept = shorter.filter(~F.coalesce(had, F.lit(False)) | F.col(left))
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return kept.withColumn("n_chars", length).select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of every group of near copies."""
    return ngram_join.one_of_each(docs)


def outside_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that hold no benchmark item."""
    return string_tiling.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_ok`` of every document that is left; the ids decode back to the text."""
    path, pattern = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
    encode, decode = byte_bpe.encoder(path, pattern), byte_bpe.decoder(path, pattern)
    encoded = in_small_batches(docs).select("doc_id", "text", encode("text").alias("ids"))
    return encoded.select("doc_id", "text", "ids", decode("ids").alias("decoded")).select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("decoded_ok"),
    )


STAGES = [
    ("language", known_language),
    ("line_dedup", unrepeated_lines),
    ("ngram_jaccard", one_of_near_copies),
    ("decontamination", outside_benchmark),
    ("byte_bpe", token_ids),
]

#: The stages train and search; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents of ``sf_dir``."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
