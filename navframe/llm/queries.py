"""The registered queries of the operators, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navframe.llm import bitplane, bpe, centroids, contamination, imatch, licenses, ngram_jaccard, oracles, pii, quality, repeats, resampling, spelling, transcripts
from navframe.llm.common import table


def tokenizer_path(name: str) -> str:
    """A public vocabulary file; ``NAVFRAME_TOKENIZERS`` names another folder."""
    folder = os.environ.get("NAVFRAME_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.similar(table(spark, sf_dir, "documents")).drop("text_key")


def op2_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[pii.count_kind(kind).alias(f"n_{kind}") for kind in pii.BASE_KINDS],
        F.sha2(pii.joined_spans(pii.BASE_KINDS), 256).alias("base_sha256"),
        pii.joined_spans(pii.KINDS).alias("spans"),
    )


def op3_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = transcripts.raw_transcript(table(spark, sf_dir, "conversations"))
    model = transcripts.train(raw, raw_col="raw")
    return transcripts.parse(raw, model, text_col="raw").withColumnRenamed("conv", "conv_id")


def op4_bitplane_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = bitplane.write_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return bitplane.read_tokens(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).withColumnRenamed("spans", "template_spans")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_multi_50k.tiktoken")
    decoded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("text_key")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hits = F.aggregate(F.arrays_zip("hit_starts", "hit_ends"), F.lit(0).cast("bigint"), lambda n, s: n + s["hit_ends"] - s["hit_starts"])
    return found.select(
        "doc_id",
        "n_words",
        hits.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("hit_starts") > 0).alias("contaminated"),
    )


def op9_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op10_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), good).drop("text_key")


def op11_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprint_documents(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_ptolemaic_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.with_inertia(*centroids.cluster(table(spark, sf_dir, "embeddings")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_pii_anchors": op2_pii_anchors,
    "op3_transcripts": op3_transcripts,
    "op4_bitplane_tokens": op4_bitplane_tokens,
    "op5_license_scan": op5_license_scan,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_line_quality": op7_line_quality,
    "op8_decontamination": op8_decontamination,
    "op9_repeated_substrings": op9_repeated_substrings,
    "op10_importance_resampling": op10_importance_resampling,
    "op11_imatch": op11_imatch,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_ptolemaic_clusters": op13_ptolemaic_clusters,
}

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard": oracles.OP1,
    "op7_line_quality": oracles.OP7.format(max_texts=quality.MAX_TEXTS),
    "op8_decontamination": oracles.OP8,
    "op9_repeated_substrings": oracles.OP9,
    "op11_imatch": oracles.OP11.format(rare=imatch.RARE, common=imatch.COMMON, spread=imatch.SPREAD, subsets=imatch.SUBSETS),
    "op13_ptolemaic_clusters": oracles.op13(centroids.N_CENTROIDS, centroids.ROUNDS, centroids.DIM, centroids.SCALE),
}
