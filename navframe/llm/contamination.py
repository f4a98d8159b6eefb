"""Benchmark decontamination with one Aho-Corasick automaton (operator 8).

The benchmark's normalised words get numbers; every window of ``WINDOW``
consecutive words of an item (all of a shorter item) is a pattern of the
automaton over these numbers. A document is scanned once: its words are numbered
in numpy, runs of benchmark words that are long enough for a pattern stream
through the automaton, and hits keep the place in the original text.

The benchmark is held in blocks of about ``BLOCK_BYTES`` of text, dealt by a hash
of the item, so the broadcast automaton has a fixed bound. A benchmark of
``FEW_BLOCKS`` at most takes a pass a block. A larger one is first met in one scan of the documents by the sorted hashes of its
windows, eight bytes each: documents without such a window are done, and only the
others, whose texts are kept, go through the automata of the blocks, each adding its
hits. The hashes are broadcast ``HASHES`` at a time, some 30 MB, so a benchmark of
under about 25 MB takes one scan, and one more for each further such part.

Defined results: null, empty or wordless texts and items have no words and no
hits; items with a null id mark words but aren't listed; items that repeat are one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from navframe.llm import common

WINDOW = 10
BLOCK_BYTES = 1 << 20
FEW_BLOCKS = 8
#: window hashes broadcast at once
HASHES = 4_000_000


def normalised(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end byte of each word."""
    buf = common.byte_array(data.lower())
    starts, ends = common.word_spans(buf, common.ALNUM_WORDS)
    return common.span_hashes(buf, starts, ends), starts, ends


class Patterns:
    """The automaton of one block of items."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        import ahocorasick

        words = [(item, normalised((text or "").encode("utf-8", "replace"))[0]) for item, text in items]
        self.known = np.unique(np.concatenate([h for _, h in words] or [np.zeros(0, dtype=np.uint64)]))
        patterns: dict[tuple[int, ...], set[str]] = {}
        for item, hashes in words:
            numbers = np.searchsorted(self.known, hashes).tolist()
            size = min(window, len(numbers))
            for i in range(len(numbers) - size + 1) if size else ():
                patterns.setdefault(tuple(numbers[i : i + size]), set()).update([item] if item is not None else [])
        self.shortest = min(map(len, patterns), default=0)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for pattern, found in patterns.items():
            self.automaton.add_word(pattern, (len(pattern), tuple(found)))
        if patterns:
            self.automaton.make_automaton()

    def scan(self, hashes: np.ndarray) -> tuple[list[int], list[int], set[str]]:
        """Starts and ends (words) of the occurrences, and the items."""
        starts, ends, items = [], [], set()
        if not self.shortest or len(hashes) < self.shortest:
            return starts, ends, items
        number = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        runs = common.slices(self.known[number] == hashes)
        for a, b in zip(*(r.tolist() for r in runs)):
            if b - a < self.shortest:
                continue
            for last, (size, found) in self.automaton.iter(tuple(number[a:b].tolist())):
                starts.append(a + last + 1 - size)
                ends.append(a + last + 1)
                items.update(found)
        return starts, ends, items


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> tuple[int, Iterator[list[tuple]]]:
    """The number of blocks, and their lists of (item, text), each of about
    ``block_bytes`` at most and collected when it is asked for."""
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 if total <= block_bytes else 2 * math.ceil(total / block_bytes)
    chosen = (items if n == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) for k in range(n))
    return n, ([tuple(r) for r in c.collect()] for c in chosen)  # bounded by the block


def _window_hashes(benchmark: DataFrame, text_col: str, window: int, most: int) -> Iterator[dict[int, np.ndarray]]:
    """The sorted hashes of the items' windows by window size, about ``most`` at a
    time: parts are dealt by the hash and collected when they are asked for."""

    def make():
        def run(batch: pa.RecordBatch):
            for data in common.text_bytes(batch.column(0)):
                words = normalised(data or b"")[0]
                size = min(window, len(words))
                found = np.unique(common.window_hashes(words, size)) if size else np.zeros(0, dtype=np.uint64)
                yield {"size": np.full(len(found), size), "h": found}

        return run

    found = common.store(common.map_rows(benchmark.select(F.col(f"`{text_col}`").alias("text")).distinct(), ["text"], "size int, h bigint", make).distinct(), "benchmark_windows")
    n = max(1, math.ceil(found.count() / most))
    for k in range(n):
        part = found if n == 1 else found.filter(F.pmod("h", F.lit(n)) == k)
        table = part.toArrow()
        sizes, h = table["size"].to_numpy(), table["h"].to_numpy().view(np.uint64)
        yield {int(size): np.sort(h[sizes == size]) for size in np.unique(sizes)}


def _may_hit(data: bytes, known: dict[int, np.ndarray]) -> bool:
    words = normalised(data)[0]
    for size, hashes in known.items():
        found = common.window_hashes(words, size)
        if len(found):
            at = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
            if (hashes[at] == found).any():
                return True
    return False


def _marked(rows: DataFrame, known: dict[int, np.ndarray], name: str) -> DataFrame:
    """``rows`` (``text``, ``may``) with ``may`` true also where a window is known;
    written, so that the hashes needn't stay."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(known)
    at, may = rows.columns.index("text"), rows.columns.index("may")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = batch.column(may).to_pylist()
            marks = [old or _may_hit(data or b"", shared.value) for old, data in zip(before, common.text_bytes(batch.column(at)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:may], pa.array(marks, pa.bool_()), *batch.columns[may + 1 :]], schema=batch.schema)

    common.on_workers(spark)
    stored = common.store(rows.mapInArrow(run, rows.schema), name)
    shared.destroy()
    return stored


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None, few_blocks: int = FEW_BLOCKS) -> DataFrame:
    """One row a document: the columns ``keep`` (default the id), ``n_words``,
    ``hit_starts`` and ``hit_ends`` (merged word slices), ``char_starts`` and
    ``char_ends`` (the same in code points of the original text) and ``items``
    (ids as sorted strings)."""
    keep = [id_col] if keep is None else keep
    spark = docs.sparkSession
    made = "n_words bigint, hit_starts array<bigint>, hit_ends array<bigint>, char_starts array<bigint>, char_ends array<bigint>, items array<string>"
    arrays = ["hit_starts", "hit_ends", "char_starts", "char_ends"]
    n_blocks, blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    results = ["n_words", *arrays, "items"]
    n = len(keep)
    rows = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text_col}`").alias("text"))
    done = None
    if n_blocks > few_blocks:
        rows = rows.withColumn("may", F.lit(False))
        for known in _window_hashes(benchmark, item_text_col, window, HASHES):
            rows = _marked(rows, known, "decontamination_marks")
        clean = rows.filter(~F.col("may")).drop("may")
        rows = rows.filter("may").drop("may")
        done = _scanned(clean, [], n, window, results, made)
    for number, items in enumerate(blocks):
        last = number == n_blocks - 1
        shared = spark.sparkContext.broadcast(items)
        rows = _scanned(rows, shared, n, window, results, made, first=number == 0)
        if not last:
            rows = common.store(rows, "decontamination")
            shared.destroy()  # the stored rows don't need it
    rows = rows if done is None else rows.unionByName(done)
    return rows.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *results)


def _scanned(rows: DataFrame, shared, n: int, window: int, results: list[str], made: str, first: bool = True) -> DataFrame:
    """``rows`` (``n`` columns, ``text`` and, but for the ``first`` block, results) with
    the hits of a block's items added; ``shared`` is their broadcast, or no items."""

    def make():
        patterns = Patterns(shared.value if shared else [], window)

        def run(batch: pa.RecordBatch):
            texts = common.text_bytes(batch.column(n))
            before = [([], [], [])] * len(texts) if first else list(zip(*(batch.column(n + 1 + j).to_pylist() for j in (1, 2, 5))))
            found = [_scan_one(data or b"", patterns, *old) for data, old in zip(texts, before)]
            return {f"k{i}": batch.column(i) for i in range(n)} | {"text": batch.column(n)} | {c: [f[j] for f in found] for j, c in enumerate(results)}

        return run

    kinds = T.StructType([*rows.schema.fields[: n + 1], *T._parse_datatype_string(made)])
    return common.map_rows(rows, rows.columns, kinds, make)


def _scan_one(data: bytes, patterns: Patterns, old_starts, old_ends, old_items):
    hashes, starts, ends = normalised(data)
    a, b, items = patterns.scan(hashes)
    if not a and not old_starts:
        return len(hashes), [], [], [], [], sorted(old_items)
    hit = common.slices(common.covered(len(hashes), np.array([*a, *old_starts], dtype=np.int64), np.array([*b, *old_ends], dtype=np.int64)))
    buf = common.byte_array(data)
    chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    return len(hashes), hit[0].tolist(), hit[1].tolist(), chars[starts[hit[0]]].tolist(), chars[ends[hit[1] - 1]].tolist(), sorted({*items, *old_items})


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents without a hit, rows and columns unchanged."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    scanned = scan(docs.select(row.alias("row"), F.col(f"`{text_col}`").alias("text")), benchmark, keep=["row"], **options)
    return scanned.filter(F.size("hit_starts") == 0).select("row.*")
