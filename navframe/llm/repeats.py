"""Substring removal by level-wise doubling (operator 9).

A window is ``window`` consecutive words. Levels go from a short length to the full
window, each about twice the one before (13, 25, 50). At the first level every window
of the second length is stood for by its anchor, its shortest-length window with the
smallest hash: equal windows have equal anchors. Anchors that stand in one document
alone fall out. At each next level only windows whose shorter windows all stand for
something repeated are extended to the next length and compared again, by their
anchors, until the full length is reached or no candidate survives.

Texts of equal words form a class: the member with the smallest id goes through
the levels, the others lose every word that a window covers, without being
compared again, so groups of copies of any size cost one row each.

Removed is every word covered by a window that also starts in a document with a
smaller id, judged on the input.

Defined results: null, empty and wordless texts, and texts shorter than a window,
lose nothing; rows of equal id never make each other lose words; rows with a
null id neither lose words nor make others lose any. Ids are whole numbers (or text
that casts to them).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navframe.llm import common

WINDOW = 50
#: halvings from the full window to the first level
HALVINGS = 2


def levels(window: int, halvings: int = 1) -> list[int]:
    """Lengths from the first level to the full window, each at most twice the
    one before."""
    out = [window]
    for _ in range(halvings):
        out.append(-(-out[-1] // 2))
    return out[::-1]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    n, reach = len(values) - width + 1, 1
    if n <= 0:
        return values[:0]
    while 2 * reach <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    return np.minimum(values[:n], values[width - reach : width - reach + n])


def word_hashes(data: bytes, lane: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    buf = common.byte_array(data)
    starts, ends = common.word_spans(buf, common.SPACE_WORDS)
    return common.span_hashes(buf, starts, ends, lane), starts, ends


def anchors(words: np.ndarray, window: int, length: int) -> np.ndarray:
    """The anchor (smallest hash of its windows of ``length``) of every window."""
    return sliding_min(common.window_hashes(words, length), window - length + 1)


def kept_digest(data: bytes, starts: np.ndarray, ends: np.ndarray, keep: np.ndarray | None = None) -> str:
    """SHA-256 of the kept words, joined by one space."""
    if keep is not None:
        starts, ends = starts[keep], ends[keep]
    return hashlib.sha256(b" ".join([data[a:b] for a, b in zip(starts.tolist(), ends.tolist())])).hexdigest()


def profile(docs: DataFrame, id_col: str, text_col: str, window: int, length: int) -> DataFrame:
    """One row a document: id, ``text_key``, class key (``k1``, ``k2``: 128 bits
    of the word sequence), ``n_words``, ``sha`` of all words, distinct ``anchors``."""

    def make():
        def run(batch: pa.RecordBatch):
            out = {c: [] for c in ("k1", "k2", "n_words", "sha", "anchors")}
            for data in common.text_bytes(batch.column(2)):
                data = data or b""
                words, starts, ends = word_hashes(data)
                whole = [np.array([0]), np.array([len(words)])]
                keys = [int(common.sequence_hashes(w, *whole)[0].view(np.int64)) for w in (words, common.mix(words, 5))]
                found = np.unique(anchors(words, window, length))
                for column, value in zip(out.values(), (*keys, len(words), kept_digest(data, starts, ends), found)):
                    column.append(value)
            out["anchors"] = common.list_array(out["anchors"], pa.int64())
            return {"doc_id": batch.column(0), "text_key": batch.column(1), **out}

        return run

    picked = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("text_key"), F.col(f"`{text_col}`").alias("text"))
    return common.map_rows(picked, ["doc_id", "text_key", "text"], "doc_id bigint, text_key bigint, k1 bigint, k2 bigint, n_words bigint, sha string, anchors array<bigint>", make)


def _repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand in documents of two ids, with the smallest id."""
    return rows.groupBy(*keys).agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).filter("first_id < last_id").drop("last_id")


def _alive(words: np.ndarray, length: int, shorter: int, known: np.ndarray) -> np.ndarray:
    """Which windows of ``length`` have a known anchor of the length before."""
    return np.isin(anchors(words, length, shorter), known)


def next_anchors(words: np.ndarray, lengths: tuple[int, int, int], known: np.ndarray) -> np.ndarray:
    """Distinct anchors of the middle length of those windows of the longest whose
    windows of the middle length all have a known anchor of the shortest."""
    shortest, middle, longest = lengths
    whole = sliding_min(_alive(words, middle, shorter=shortest, known=known).astype(np.int8), longest - middle + 1)
    return np.unique(anchors(words, longest, middle)[whole > 0])


def _known(column: pa.Array, i: int) -> np.ndarray:
    return np.array(column[i].as_py(), dtype=np.int64).view(np.uint64)


def _next_level(rows: DataFrame, lengths: tuple[int, int, int]) -> DataFrame:
    """id, ``text_key`` and each anchor of the next level (see ``next_anchors``)."""

    def make():
        def run(batch: pa.RecordBatch):
            for i, data in enumerate(common.text_bytes(batch.column(2))):
                found = next_anchors(word_hashes(data or b"")[0], lengths, _known(batch.column(3), i))
                yield {"doc_id": pa.repeat(batch.column(0)[i], len(found)), "text_key": pa.repeat(batch.column(1)[i], len(found)), "anchor": found}

        return run

    return common.map_rows(rows, ["doc_id", "text_key", "text", "anchors"], "doc_id bigint, text_key bigint, anchor bigint", make)


def _windows(rows: DataFrame, window: int, length: int) -> DataFrame:
    """The full windows over repeated anchors of ``length``.

    ``rows`` has id, ``text_key``, ``text`` and the repeated ``anchors``. Returns
    id, ``text_key``, ``h1``, ``h2`` and ``at``, the word where a window starts.
    """

    def make():
        def run(batch: pa.RecordBatch):
            for i, data in enumerate(common.text_bytes(batch.column(2))):
                words = word_hashes(data or b"")[0]
                at = np.flatnonzero(_alive(words, window, length, _known(batch.column(3), i)))
                h1, h2 = (common.window_hashes(w, window, lane)[at] for w, lane in ((words, 0), (common.mix(words, 5), 1)))
                n = len(at)
                yield {"doc_id": pa.repeat(batch.column(0)[i], n), "text_key": pa.repeat(batch.column(1)[i], n), "h1": h1, "h2": (h2 & np.uint64(0x7FFFFFFF)).astype(np.int32), "at": at.astype(np.int32)}

        return run

    return common.map_rows(rows, ["doc_id", "text_key", "text", "anchors"], "doc_id bigint, text_key bigint, h1 bigint, h2 int, at int", make)


def _surviving(spread: DataFrame) -> DataFrame:
    """``doc_id``, ``text_key`` and the ``anchors`` of theirs that stand in documents
    of two ids, from one row an anchor."""
    # written, so that the join reads two plain exchanges and a hot key can be split
    again = common.store(_repeated(spread.select("doc_id", "anchor"), ["anchor"]).select("anchor"), "repeat_anchors")
    return spread.join(again, "anchor").groupBy("doc_id", "text_key").agg(F.collect_list("anchor").alias("anchors"))


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, halvings: int = HALVINGS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(profiles, classes, found).

    ``profiles``: see ``profile``. ``classes``: ``k1``, ``k2``, ``doc_id`` and
    ``text_key`` of the member with the smallest id. ``found``: for class members
    that lose words, id, ``text_key``, ``text`` and ``at``, the starts of the
    windows that a smaller id has too.
    """
    lengths = sorted(set(levels(window, halvings)))
    lengths = lengths if len(lengths) > 1 else [window, window]
    profiles = common.store(profile(docs, id_col, text_col, lengths[1], lengths[0]), "repeat_profiles")
    long = profiles.filter((F.col("n_words") >= window) & F.col("doc_id").isNotNull())
    classes = common.store(
        long.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "text_key")).alias("m"), F.first("anchors").alias("anchors")).select("k1", "k2", "m.doc_id", "m.text_key", "anchors"), "repeat_classes"
    )
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("text_key"), F.col(f"`{text_col}`").alias("text"))
    held = _surviving(classes.select("doc_id", "text_key", F.explode("anchors").alias("anchor")))
    # one row for each id and text: repeated rows share their class member's row
    candidates = common.store(held.join(texts, ["doc_id", "text_key"]), "repeat_texts").dropDuplicates(["doc_id", "text_key"])
    for level in zip(lengths, lengths[1:], lengths[2:]):
        if candidates.isEmpty():
            break
        held = _surviving(common.store(_next_level(candidates, level), "repeat_spread"))
        candidates = common.store(held.join(candidates.drop("anchors"), ["doc_id", "text_key"]), "repeat_texts")
    windows = _windows(candidates, window, lengths[-2])
    first = common.store(_repeated(windows.select("doc_id", "h1", "h2"), ["h1", "h2"]), "repeat_windows")
    later = windows.join(first, ["h1", "h2"]).filter("doc_id > first_id")
    starts = later.groupBy("doc_id", "text_key").agg(F.collect_list("at").alias("at"))
    return profiles, classes.drop("anchors"), starts.join(candidates.drop("anchors"), ["doc_id", "text_key"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, halvings: int = HALVINGS) -> DataFrame:
    """One row a document: ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256``."""
    profiles, classes, found = find_repeats(docs, id_col, text_col, window, halvings)

    def make():
        def run(batch: pa.RecordBatch):
            removed, digests = [], []
            for data, at in zip(common.text_bytes(batch.column(2)), batch.column(3).to_pylist()):
                _, starts, ends = word_hashes(data or b"")
                gone = common.covered(len(starts), np.array(at), np.array(at) + window)
                removed.append(int(gone.sum()))
                digests.append(kept_digest(data or b"", starts, ends, ~gone))
            return {"doc_id": batch.column(0), "text_key": batch.column(1), "n_removed": removed, "kept_sha256": digests}

        return run

    cut = common.map_rows(found, ["doc_id", "text_key", "text", "at"], "doc_id bigint, text_key bigint, n_removed bigint, kept_sha256 string", make)
    by_class = classes.join(cut, ["doc_id", "text_key"], "left").select("k1", "k2", F.col("doc_id").alias("first_id"), "n_removed", "kept_sha256")
    copy = F.col("doc_id") > F.col("first_id")
    return profiles.join(by_class, ["k1", "k2"], "left").select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).when(F.col("first_id").isNotNull() & F.col("doc_id").isNotNull(), F.coalesce("n_removed", F.lit(0).cast("bigint"))).otherwise(F.lit(0).cast("bigint")).alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).when(F.col("doc_id").isNotNull(), F.coalesce("kept_sha256", "sha")).otherwise(F.col("sha")).alias("kept_sha256"),
    )
