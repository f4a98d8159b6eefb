"""Quality by importance resampling (operator 10).

Two generative models over hashed word uni- and bigrams: one of a target (texts
labelled good), one of the raw table. A document's log weight is the sum of the
log ratio of the two over its n-grams. Gumbel noise is added and the largest
``k`` keys are kept: a sample without replacement in proportion to the weights.

The raw model counts every document. The target model counts the labelled good
documents with the smallest id hashes, ``MAX_TARGET`` at most (a documented
bound, so their ids can be broadcast). Counts are summed per task before the
shuffle; ``BUCKETS`` pairs of numbers reach the driver. The key of rank ``k`` is
found exactly by four histograms of 16 bits each over the stored keys.

Defined results: null and empty texts have no n-grams and weight 0; noise depends
on the seed, the id and the text, so repeated rows tie and are kept or dropped
together; without labels all weights are 0, without a share to keep all are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navframe.llm import common

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
MAX_TARGET = 20_000
SMOOTHING = 1.0


def features(data: bytes) -> np.ndarray:
    """Bucket of every word and of every pair of neighbouring words."""
    buf = common.byte_array(data)
    starts, ends = common.word_spans(buf, common.SPACE_WORDS)
    words = common.span_hashes(buf, starts, ends)
    both = np.concatenate([words, common.window_hashes(words, 2)])
    return (both >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def target_ids(labels: DataFrame, good: Column, id_col: str = "doc_id", most: int = MAX_TARGET) -> DataFrame:
    """Ids of at most ``most`` good documents, the smallest by a hash."""
    ids = labels.filter(good & F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("bigint").alias("t_id")).distinct()
    return ids.orderBy(F.xxhash64("t_id"), "t_id").limit(most)


def count_features(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``bucket``, ``raw`` and ``target`` counts over all documents."""
    marked = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(target.withColumn("hit", F.lit(True))), F.col("id") == F.col("t_id"), "left")

    def run(batches):
        raw, hits = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            flags = batch.column(1).to_pylist()
            texts = common.text_bytes(batch.column(0))
            for a in range(0, len(texts), 256):
                found = [features(t or b"") for t in texts[a : a + 256]]
                raw += np.bincount(np.concatenate(found), minlength=BUCKETS)
                good = [f for f, flag in zip(found, flags[a : a + 256]) if flag]
                if good:
                    hits += np.bincount(np.concatenate(good), minlength=BUCKETS)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_pydict({"bucket": used.astype(np.int32), "raw": raw[used], "target": hits[used]})

    common.on_workers(docs.sparkSession)
    parts = marked.select("text", "hit").mapInArrow(run, "bucket int, raw bigint, target bigint")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame) -> np.ndarray:
    """log p(bucket | target) - log p(bucket | raw), smoothed."""
    raw, hits = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for bucket, r, t in counts.collect():  # BUCKETS rows at most
        raw[bucket], hits[bucket] = r, t
    if not hits.any():
        return np.zeros(BUCKETS)
    p, q = ((c + SMOOTHING) / (c.sum() + SMOOTHING * BUCKETS) for c in (hits, raw))
    return np.log(p) - np.log(q)


def weigh(docs: DataFrame, ratios: np.ndarray, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``text_key``, ``n_features``, ``log_weight`` and ``sample_key``
    (the weight with Gumbel noise)."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)  # BUCKETS doubles
    picked = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("text_key"), F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("noise"), F.col(f"`{text_col}`").alias("text"))

    def make():
        table = shared.value

        def run(batch: pa.RecordBatch):
            found = [features(t or b"") for t in common.text_bytes(batch.column(3))]
            weights = np.array([table[f].sum() for f in found])
            noise = common.mix(batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64), 9)
            uniform = ((noise >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
            return {"doc_id": batch.column(0), "text_key": batch.column(1), "n_features": [len(f) for f in found], "log_weight": weights, "sample_key": weights - np.log(-np.log(uniform))}

        return run

    return common.map_rows(picked, ["doc_id", "text_key", "noise", "text"], "doc_id bigint, text_key bigint, n_features bigint, log_weight double, sample_key double", make)


def _ordered_bits(value: np.ndarray) -> np.ndarray:
    """64-bit integers in the order of the doubles."""
    bits = value.view(np.int64)
    return np.where(bits < 0, ~bits.view(np.uint64), bits.view(np.uint64) | np.uint64(1 << 63))


def kth_largest(keys: DataFrame, column: str, k: int) -> float | None:
    """The value of rank ``k`` from above: 16 more bits of it each round."""
    if k <= 0:
        return None

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"bits": _ordered_bits(batch.column(0).to_numpy(zero_copy_only=False).astype(np.float64)).view(np.int64)})

    common.on_workers(keys.sparkSession)
    bits = keys.select(column).mapInArrow(run, "bits bigint")
    prefix = 0
    for shift in (48, 32, 16, 0):
        inside = bits if shift == 48 else bits.filter(F.shiftrightunsigned("bits", shift + 16) == F.lit(prefix))
        rows = inside.groupBy(F.shiftrightunsigned("bits", shift).bitwiseAND(F.lit(0xFFFF)).alias("b")).count().collect()
        for b, n in sorted(rows, reverse=True):
            if n >= k:
                prefix = prefix << 16 | b
                break
            k -= n
        else:
            return None  # fewer than k values
    raw = np.array([prefix], dtype=np.uint64)
    raw = np.where(raw >> np.uint64(63) == 1, raw ^ np.uint64(1 << 63), ~raw)
    return float(raw.view(np.float64)[0])


def resample(docs: DataFrame, labels: DataFrame, good: Column, keep: Column | None = None, share: float | None = None, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", most: int = MAX_TARGET) -> DataFrame:
    """One row a document: ``doc_id``, ``text_key``, ``n_features``,
    ``log_weight``, ``sample_key``, ``kept``. ``share`` of the documents is kept;
    by default the share of labels that ``keep`` (default: ``good``) holds for."""
    ratios = log_ratios(count_features(docs, target_ids(labels, good, label_id_col, most), id_col, text_col))
    keys = common.store(weigh(docs, ratios, seed, id_col, text_col), "resampling_keys")
    if share is None:
        share = labels.agg(F.avg(F.coalesce(good if keep is None else keep, F.lit(False)).cast("double"))).first()[0]
    k = round((1.0 if share is None else share) * keys.count())
    least = kth_largest(keys, "sample_key", k)
    return keys.withColumn("kept", F.lit(k > 0) if least is None else F.col("sample_key") >= F.lit(least))
