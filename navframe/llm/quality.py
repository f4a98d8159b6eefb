"""Quality rules with cross-document line frequency (operator 7).

Every document gives its counts and, for each distinct normalised line (words
lower-cased in ASCII and joined by one space), a 64-bit hash. Spark counts per
host and line the distinct texts that hold it (exact copies are one text), with
partial sums before each shuffle. A line in more than ``max_texts`` texts of a
host is boilerplate: it is removed from every document of the host but the one
with the smallest id that holds it. A document with less than ``min_left`` of its
words left is depleted and rejected, as is one that fails a base rule. ``clean``
gives the documents that stay, without these lines.

Defined results: a null, empty or wordless text has zero counts and fails the
base rule on words; null hosts are one host; null ids come after all others as
holders; repeated rows are one text of the host and share their verdict, and rows
alike in id and text share it and the lines they lose, whatever their hosts. Ids are
whole numbers (or text that casts to them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from navframe.llm import common

MAX_TEXTS = 100
MIN_LEFT = 0.2
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
REPEAT_WINDOW = 5

_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
_BLANKS = b" \t\n\x0b\x0c\r"


def _line_keys(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the normalised words, number and number of words of each worded line."""
    line_of = np.searchsorted(np.flatnonzero(low == 0x0A), starts)
    first = np.flatnonzero(np.diff(line_of, prepend=-1))
    last = np.append(first[1:], len(starts))
    return common.sequence_hashes(common.span_hashes(low, starts, ends), first, last), line_of[first], last - first


def without_lines(data: bytes, keys: np.ndarray) -> bytes:
    """The text without the lines of these hashes."""
    low = common.byte_array(data.lower())
    found, at, _ = _line_keys(low, *common.word_spans(low, common.SPACE_WORDS))
    gone = set(at[np.isin(found, keys)].tolist())
    return b"\n".join(line for i, line in enumerate(data.split(b"\n")) if i not in gone)


def document_counts(data: bytes) -> tuple[int, int, int, int, int, np.ndarray, np.ndarray]:
    """Words, characters in words, symbols, repeated lines, words in repeated
    windows; hashes and word counts of the distinct normalised lines (a line that
    stands k times counts k times its words)."""
    buf = common.byte_array(data)
    starts, ends = common.word_spans(buf, common.SPACE_WORDS)
    n = len(starts)
    none = np.zeros(0, dtype=np.uint64)
    symbols = int(np.count_nonzero(_SYMBOLS[buf]))
    if not n:
        return 0, 0, symbols, 0, 0, none, none.astype(np.int64)
    chars = int(np.count_nonzero(common.SPACE_WORDS[buf] & ((buf & 0xC0) != 0x80)))
    windows = common.window_hashes(common.span_hashes(buf, starts, ends), REPEAT_WINDOW)
    repeated = 0
    if len(windows) > 1:
        _, which, times = np.unique(windows, return_inverse=True, return_counts=True)
        at = np.flatnonzero(times[which] > 1)
        if len(at):
            repeated = int(np.count_nonzero(common.covered(n, at, at + REPEAT_WINDOW)))
    lines = data.split(b"\n")
    dup = 0
    if len(lines) > 1:
        worded = [line for line in lines if line.strip(_BLANKS)]
        dup = len(worded) - len(set(worded))
    keys, _, sizes = _line_keys(common.byte_array(data.lower()), starts, ends)
    keys, which = np.unique(keys, return_inverse=True)
    return n, chars, symbols, dup, repeated, keys, np.bincount(which, weights=sizes).astype(np.int64)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def count_documents(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row a document: id, ``host``, ``text_key``, the counts, ``lines`` and
    ``line_words``."""
    schema = "doc_id bigint, host string, text_key bigint, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", lines array<bigint>, line_words array<bigint>"

    def make():
        def run(batch: pa.RecordBatch):
            rows = [document_counts(data or b"") for data in common.text_bytes(batch.column(3))]
            made = {c: [r[k] for r in rows] for k, c in enumerate(COUNTS)}
            return {"doc_id": batch.column(0), "host": batch.column(1), "text_key": batch.column(2), **made, "lines": common.list_array([r[5] for r in rows], pa.int64()), "line_words": common.list_array([r[6] for r in rows], pa.int64())}

        return run

    picked = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{host_col}`").cast("string").alias("host"), text_key(text_col).alias("text_key"), F.col(f"`{text_col}`").alias("text"))
    return common.map_rows(picked, ["doc_id", "host", "text_key", "text"], schema, make)


def text_key(text_col: str = "text"):
    """64 bits of a text, for rows of one id or one host."""
    return F.xxhash64(F.col(f"`{text_col}`"))


def _judged(docs: DataFrame, id_col: str, host_col: str, text_col: str, max_texts: int, min_left: float) -> tuple[DataFrame, DataFrame]:
    """(verdicts with ``uid``, lines above the limit that each ``uid`` loses)."""
    counted = common.store(count_documents(docs, id_col, host_col, text_col).withColumn("uid", F.monotonically_increasing_id()), "quality_counts")
    lines = counted.select("uid", "doc_id", "host", "text_key", F.explode(F.arrays_zip("lines", "line_words")).alias("l")).select("uid", "doc_id", "host", "text_key", F.col("l.lines").alias("line"), F.col("l.line_words").alias("words"))
    texts = lines.groupBy("host", "line", "text_key").agg(F.min("doc_id").alias("first"))
    frequent = texts.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_texts"), F.min("first").alias("first")).filter(F.col("n_texts") > max_texts).select(F.col("host").alias("f_host"), F.col("line").alias("f_line"), "first")
    held = lines.join(frequent, F.col("host").eqNullSafe(F.col("f_host")) & (F.col("line") == F.col("f_line")))
    gone = held.filter(~F.col("doc_id").eqNullSafe(F.col("first"))).select("uid", "line", "words")
    lost = gone.groupBy("uid").agg(F.sum("words").alias("n_line_words"))
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    depleted = (F.col("n_words") - F.col("n_line_words")) < F.lit(min_left) * F.col("n_words")
    verdicts = (
        counted.drop("lines", "line_words", "host")
        .join(lost, "uid", "left")
        .withColumn("n_line_words", F.coalesce("n_line_words", F.lit(0).cast("bigint")))
        .withColumn("base_failed", base_failed)
        .withColumn("kept", ~base_failed & ~depleted)
    )
    return verdicts, gone


def judge(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", max_texts: int = MAX_TEXTS, min_left: float = MIN_LEFT) -> DataFrame:
    """One row a document: ``doc_id``, ``text_key``, the counts, ``n_line_words``
    (words in lines above the limit), ``base_failed`` and ``kept``."""
    return _judged(docs, id_col, host_col, text_col, max_texts, min_left)[0].drop("uid")


def _same_row(docs: DataFrame, id_col: str, text_col: str, id_name: str, key_name: str):
    return F.col(f"`{id_col}`").cast("bigint").eqNullSafe(F.col(id_name)) & (text_key(text_col) == F.col(key_name))


def keep_good(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", **limits) -> DataFrame:
    """The documents that are not rejected, rows and columns unchanged."""
    r_id, r_key = common.free_name(docs, "r_id"), common.free_name(docs, "r_key")
    rejected = judge(docs, id_col, host_col, text_col, **limits).filter(~F.col("kept")).select(F.col("doc_id").alias(r_id), F.col("text_key").alias(r_key)).distinct()
    return docs.join(rejected, _same_row(docs, id_col, text_col, r_id, r_key), "left_anti")


def clean(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", size_col: str = "n_chars", max_texts: int = MAX_TEXTS, min_left: float = MIN_LEFT) -> DataFrame:
    """The documents that are not rejected, without their lines above the limit;
    ``size_col``, if it is there, follows the texts that change. Other rows and all
    other columns are unchanged."""
    verdicts, gone = _judged(docs, id_col, host_col, text_col, max_texts, min_left)
    lines = gone.groupBy("uid").agg(F.collect_set("line").alias("lines"))  # at most a document's lines
    names = {wish: common.free_name(docs, wish) for wish in ("r_id", "r_key", "r_kept", "r_lines")}
    changes = verdicts.join(lines, "uid", "left").filter(~F.col("kept") | F.col("lines").isNotNull())
    changes = changes.groupBy(F.col("doc_id").alias(names["r_id"]), F.col("text_key").alias(names["r_key"])).agg(
        F.min("kept").alias(names["r_kept"]), F.array_distinct(F.flatten(F.collect_set("lines"))).alias(names["r_lines"])
    )
    # a shuffle at any size: the plan, and what it costs, doesn't change with the table
    joined = docs.join(common.store(changes, "quality_changes").hint("merge"), _same_row(docs, id_col, text_col, names["r_id"], names["r_key"]), "left")
    left = joined.filter(F.coalesce(F.col(names["r_kept"]), F.lit(True))).select(*[F.col(f"`{c}`") for c in docs.columns], F.col(names["r_lines"]))
    return _without_lines(left, docs.schema, text_col, size_col)


def _without_lines(rows: DataFrame, schema: T.StructType, text_col: str, size_col: str) -> DataFrame:
    """``rows`` of ``schema`` and, last, the hashes of the lines that each loses."""
    out = common.arrow_schema(schema)
    text, size = schema.names.index(text_col), schema.names.index(size_col) if size_col in schema.names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns[:-1])
            lost = batch.columns[-1]
            changed = np.flatnonzero(pc.fill_null(pc.list_value_length(lost), 0).to_numpy(zero_copy_only=False) > 0)
            if len(changed):
                texts = columns[text].to_pylist()
                sizes = columns[size].to_pylist() if size is not None else None
                for i in changed.tolist():
                    keys = np.array(lost[i].as_py(), dtype=np.int64).view(np.uint64)
                    texts[i] = without_lines((texts[i] or "").encode(), keys).decode()
                    if sizes is not None:
                        sizes[i] = len(texts[i])
                columns[text] = pa.array(texts, type=out.field(text).type)
                if size is not None:
                    columns[size] = pa.array(sizes).cast(out.field(size).type)
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out)], schema=out)

    common.on_workers(rows.sparkSession)
    return rows.mapInArrow(run, schema)
