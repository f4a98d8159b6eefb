"""Model inputs (tier B): past-return sequences and document chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navframe.operators.returns import KEY, ORDER, nav_window

SEQUENCE_ROWS = 30
CHUNK_WORDS = 200
CHUNK_OVERLAP = 40


def sequence_features(daily_returns: DataFrame, n: int = SEQUENCE_ROWS, value_col: str = "daily_return_pct") -> DataFrame:
    """For every row with a return, the ``n`` returns before it as an array
    (oldest first) and its own as ``target``; only full frames are kept. A frame
    is bounded by ``n`` rows, and rows share the exchange of the feature window."""
    known = daily_returns.filter(F.col(value_col).isNotNull()).select(KEY, ORDER, F.col(value_col).alias("target"))
    past = F.collect_list("target").over(nav_window().rowsBetween(-n, -1))
    return known.withColumn("sequence", past).filter(F.size("sequence") == n)


def document_chunks(
    docs: DataFrame, size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Whole texts cut into chunks of ``size`` words, each starting
    ``size - overlap`` words after the one before; the last one reaches the end.
    Texts without words give no chunk."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the chunk")
    step = size - overlap
    words = F.filter(F.split(F.col(text_col), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select(id_col, words.alias("_words")).filter(F.size("_words") > 0)
    last = F.greatest(F.size("_words") - overlap - 1, F.lit(0))
    starts = rows.select(id_col, "_words", F.posexplode(F.sequence(F.lit(0), last, F.lit(step))).alias("chunk_no", "start_word"))
    chunk = F.slice("_words", F.col("start_word") + 1, F.lit(size))
    return starts.select(
        id_col,
        F.col("chunk_no").cast("bigint").alias("chunk_no"),
        F.col("start_word").cast("bigint").alias("start_word"),
        F.size(chunk).cast("bigint").alias("n_words"),
        F.array_join(chunk, " ").alias("chunk"),
    )
