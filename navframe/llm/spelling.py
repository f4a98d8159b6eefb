"""Spelling variants by Bloom-guided neighbourhoods (operator 12).

Words are counted; two words are near if they differ by one inserted, deleted or
replaced character. A word's form is its most frequent near word, if that is at least
``RATIO`` times as frequent; following forms to the last gives a word's root.

Near words are found from generated edits. Every pair of near words is generated
once: as the deletion of one character of the longer word, or as the replacement of
a character by a greater one, among the characters that words hold. An edit's hash
follows from the word's polynomial hash without spelling the edit out. Edits probe
blocked Bloom filters (512 bits a block, one block an edit) of the vocabulary,
sharded by word length; only those found there, about one false one in a thousand,
are written and joined with the vocabulary by 128 bits of hash. The words of these
pairs are then compared, so no pair is false; a Bloom filter loses none.

Filters are built in segments of a fixed size, so no task gathers a length that holds
most words. Segments are broadcast ``FILTER_BYTES`` at a time: a pass reads the words
of the lengths that its segments concern. Until a vocabulary's filters exceed that
bound there is one pass; beyond it a pass covers some lengths, or some segments of one.

Defined results: null texts hold no words; a null id counts as the empty string in
the deletion rule. Words are compared by code points. Repeated rows count each. Very
long words are words like others. An empty vocabulary gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navframe.llm import common

MIN_CHARS, MIN_COUNT, RATIO = 7, 2, 10
#: of an occurrence whose hash this divides, one character is deleted
EVERY = 31
RUN = r"[A-Za-zÀ-ÿ]{%d,}"
#: Bloom filter: bits a word, probes an edit, 64-bit words of a block
BITS, PROBES, BLOCK = 16, 6, 8
#: blocks of a segment (1 MB), and bytes of filters broadcast at once
SEGMENT_BLOCKS = (1 << 20) // (8 * BLOCK)
FILTER_BYTES = 32 << 20
#: lengths from this one on share a shard
LONGEST = 64
#: words counted before a task hands its counts on, and characters of words probed at once
COUNTED, PROBED = 200_000, 1 << 16


# -- words -------------------------------------------------------------------------------


_UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def document_words(text: str, doc_id: str, min_chars: int = MIN_CHARS, every: int = EVERY) -> Counter:
    """The document's words and their occurrences, one character deleted from those
    runs whose hash ``every`` divides."""
    out: Counter = Counter()
    seed = zlib.crc32(f"{doc_id}:".encode())
    for run, n in Counter(re.findall(RUN % min_chars, text)).items():
        word = run.translate(_UPPER)
        h = zlib.crc32(word.encode(), seed)
        if h % every == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        if len(word) >= min_chars:
            out[word] += n
    return out


def vocabulary(docs: DataFrame, id_col: str, text_col: str, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """``word``, ``n``, ``size`` and its hash ``h1``, ``h2``, of words that occur
    ``min_count`` times or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def made():
            return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total.update(document_words(text or "", doc_id or "", min_chars))
                if len(total) >= COUNTED:
                    yield made()
                    total.clear()
        yield made()

    common.on_workers(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`"))
    words = rows.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)

    def make():
        def run(batch: pa.RecordBatch):
            codes, starts, ends = code_points(batch.column(0))
            h1, h2 = common.char_hashes(codes, starts, ends)
            return {"word": batch.column(0), "n": batch.column(1), "size": ends - starts, "h1": h1, "h2": h2}

        return run

    return common.store(common.map_rows(words, ["word", "n"], "word string, n bigint, size int, h1 bigint, h2 bigint", make), "spelling_words")


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of all words, and where each word starts and ends."""
    words = column.to_pylist()
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    ends = np.cumsum(sizes)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    return codes, ends - sizes, ends


# -- Bloom filters -------------------------------------------------------------------------


def shard_of(size):
    return np.minimum(size, LONGEST)


def n_blocks(n_words: int) -> int:
    return max(1, math.ceil(n_words * BITS / (64 * BLOCK)))


def _block(h: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The block of a hash, among as many as its shard has (up to 2**32)."""
    return ((h >> np.uint64(32)) * blocks.astype(np.uint64)) >> np.uint64(32)


def _bits(h: np.ndarray, probe: int) -> tuple[np.ndarray, np.ndarray]:
    """Which word of the block a probe reads, and its bit there."""
    mixed = common.mix(h, 40 + probe)
    return (mixed >> np.uint64(61)).astype(np.int64), np.uint64(1) << (mixed & np.uint64(63))


def build_segments(words: DataFrame, blocks: dict[int, int]) -> DataFrame:
    """``shard``, ``segment`` and ``bits`` of the filters of the words (``size``, ``h1``)."""
    shards = np.array(sorted(blocks))
    counts = np.array([blocks[s] for s in shards.tolist()], dtype=np.int64)

    def make():
        def run(batch: pa.RecordBatch):
            h = batch.column(1).to_numpy().view(np.uint64)
            shard = shard_of(batch.column(0).to_numpy())
            block = _block(h, counts[np.searchsorted(shards, shard)]).astype(np.int64)
            return {"shard": shard, "segment": block // SEGMENT_BLOCKS, "block": block % SEGMENT_BLOCKS, "h1": h}

        return run

    def build(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        shard, segment = (int(k.as_py()) for k in key)
        size = min(SEGMENT_BLOCKS, blocks[shard] - segment * SEGMENT_BLOCKS)
        bits = np.zeros(size * BLOCK, dtype=np.uint64)
        h, block = rows["h1"].to_numpy().view(np.uint64), rows["block"].to_numpy()
        for probe in range(PROBES):
            at, bit = _bits(h, probe)
            np.bitwise_or.at(bits, block * BLOCK + at, bit)
        return pa.table({"shard": pa.array([shard], pa.int32()), "segment": pa.array([segment], pa.int64()), "bits": pa.array([bits.tobytes()])})

    dealt = common.map_rows(words, ["size", "h1"], "shard int, segment bigint, block bigint, h1 bigint", make)
    return common.store(dealt.groupBy("shard", "segment").applyInArrow(build, "shard int, segment bigint, bits binary"), "spelling_filters")


class Filters:
    """Segments of some shards, for probing: those of a shard are consecutive."""

    def __init__(self, segments: list[tuple[int, int, bytes]], blocks: dict[int, int]):
        segments = sorted(segments, key=lambda s: s[:2])
        parts = [np.frombuffer(bits, dtype=np.uint64) for _, _, bits in segments]
        self.bits = np.concatenate(parts)
        self.total = np.zeros(LONGEST + 2, dtype=np.int64)  # blocks of the whole shard
        self.low, self.high, self.at = (np.zeros(LONGEST + 2, dtype=np.int64) for _ in range(3))
        place = 0
        for (shard, segment, _), part in zip(segments, parts):
            if not self.high[shard]:
                self.total[shard], self.low[shard], self.at[shard] = blocks[shard], segment * SEGMENT_BLOCKS, place
            self.high[shard] = segment * SEGMENT_BLOCKS + len(part) // BLOCK
            place += len(part) // BLOCK

    def __contains__(self, shard: int) -> bool:
        return self.high[shard] > 0

    def probe(self, h: np.ndarray, shard: np.ndarray) -> np.ndarray:
        """Which of the hashes may be words of their shards."""
        block = _block(h, self.total[shard]).astype(np.int64)
        found = np.flatnonzero((block >= self.low[shard]) & (block < self.high[shard]))
        h, base = h[found], (block[found] - self.low[shard[found]] + self.at[shard[found]]) * BLOCK
        for probe in range(PROBES):
            at, bit = _bits(h, probe)
            hit = self.bits[base + at] & bit != 0
            found, h, base = found[hit], h[hit], base[hit]
        return found


# -- edits -----------------------------------------------------------------------------------


class Edits:
    """Hashes of a batch's edits, from prefix sums of the words' polynomial hash."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.codes = codes
        self.word = np.repeat(np.arange(len(starts)), ends - starts)
        self.place = np.arange(len(codes)) - starts[self.word]
        self.lanes = [self._lane(lane, starts, ends) for lane in (0, 1)]

    def _lane(self, lane: int, starts: np.ndarray, ends: np.ndarray):
        up, down = common.char_powers(int((ends - starts).max(initial=0)) + 2, lane)
        terms = common.char_values(self.codes) * up[self.place]
        prefix = np.zeros(len(terms) + 1, dtype=np.uint64)
        np.cumsum(terms, out=prefix[1:])
        before = prefix[:-1] - prefix[starts][self.word]
        whole = (prefix[ends] - prefix[starts])[self.word]
        return up, down[1], terms, before, whole

    def deletion(self, lane: int, at: np.ndarray) -> np.ndarray:
        _, back, terms, before, whole = self.lanes[lane]
        after = whole[at] - before[at] - terms[at]
        return common.char_hash(before[at] + after * back, lane)

    def replacement(self, lane: int, at: np.ndarray, code: int) -> np.ndarray:
        up, _, terms, _, whole = self.lanes[lane]
        value = common.char_values(np.array([code]))[0]
        return common.char_hash(whole[at] - terms[at] + value * up[self.place[at]], lane)

    def deleted(self) -> np.ndarray:
        """Places to delete at; of a run of one character the first."""
        fresh = np.ones(len(self.codes), dtype=bool)
        fresh[1:] = (self.codes[1:] != self.codes[:-1]) | (self.word[1:] != self.word[:-1])
        return np.flatnonzero(fresh)


def _groups(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of words of about ``PROBED`` characters."""
    begin, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > begin and total + size > PROBED:
            yield begin, i
            begin, total = i, 0
        total += size
    if len(sizes):
        yield begin, len(sizes)


def candidates(words: DataFrame, filters: Filters, alphabet: list[int], sent) -> DataFrame:
    """Pairs of hashes (``a1``, ``a2`` of a word, ``b1``, ``b2`` of an edit) that pass
    the filters of this pass, which ``sent`` carries to the tasks."""
    wanted = [s for s in range(LONGEST + 1) if s in filters]

    def make():
        held: Filters = sent.value

        def run(batch: pa.RecordBatch):
            all_codes, all_starts, all_ends = code_points(batch.column(0))
            a1, a2 = (batch.column(i).to_numpy().view(np.uint64) for i in (1, 2))
            for begin, end in _groups(all_ends - all_starts):
                base = all_starts[begin]
                starts, ends = all_starts[begin:end] - base, all_ends[begin:end] - base
                codes = all_codes[base : base + ends[-1]]
                edits, size = Edits(codes, starts, ends), ends - starts
                own, shorter = shard_of(size), shard_of(size - 1)
                out = []
                at = edits.deleted()
                at = at[held.high[shorter[edits.word[at]]] > 0]
                h = edits.deletion(0, at)
                hit = held.probe(h, shorter[edits.word[at]])
                out.append((edits.word[at[hit]], h[hit], edits.deletion(1, at[hit])))
                mine = np.flatnonzero(held.high[own[edits.word]] > 0)
                for code in alphabet if len(mine) else ():
                    at = mine[codes[mine] < code]
                    h = edits.replacement(0, at, code)
                    hit = held.probe(h, own[edits.word[at]])
                    out.append((edits.word[at[hit]], h[hit], edits.replacement(1, at[hit], code)))
                word, b1, b2 = (np.concatenate(x) for x in zip(*out))
                yield {"a1": a1[begin:end][word], "a2": a2[begin:end][word], "b1": b1, "b2": b2}

        return run

    concerned = words.filter(F.least("size", F.lit(LONGEST)).isin(wanted) | F.least(F.col("size") - 1, F.lit(LONGEST)).isin(wanted))
    return common.map_rows(concerned, ["word", "h1", "h2"], "a1 bigint, a2 bigint, b1 bigint, b2 bigint", make)


def _alphabet(words: DataFrame) -> list[int]:
    """The characters of the words, at most those a run may hold."""
    chars = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct()
    return sorted(ord(r.c) for r in chars.collect() if r.c)


def near_pairs(words: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """``a``, ``n_a``, ``b``, ``n_b`` of near words, each pair once."""
    spark = words.sparkSession
    shards = words.groupBy(F.least("size", F.lit(LONGEST)).alias("shard")).count().collect()  # 58 rows at most
    blocks = {r.shard: n_blocks(r["count"]) for r in shards}
    pairs = None
    if blocks:
        segments = build_segments(words, blocks)
        alphabet = _alphabet(words)
        for wave in _passes(blocks, filter_bytes):
            chosen = F.lit(False)
            for shard, low, high in wave:
                chosen = chosen | ((F.col("shard") == shard) & F.col("segment").between(low, high - 1))
            filters = Filters([tuple(r) for r in segments.filter(chosen).collect()], blocks)
            sent = spark.sparkContext.broadcast(filters)
            found = common.store(candidates(words, filters, alphabet, sent), "spelling_candidates")
            sent.destroy()
            pairs = found if pairs is None else pairs.union(found)
    else:
        pairs = spark.createDataFrame([], "a1 bigint, a2 bigint, b1 bigint, b2 bigint")
    # positives alone meet the vocabulary, by hash; then the words themselves are compared
    exact = pairs.distinct().join(words.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("word").alias("b"), F.col("n").alias("n_b")), ["b1", "b2"])
    exact = exact.join(words.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("word").alias("a"), F.col("n").alias("n_a")), ["a1", "a2"])
    return exact.select("a", "n_a", "b", "n_b").filter(F.levenshtein("a", "b", 1) == 1)


def _passes(blocks: dict[int, int], filter_bytes: int) -> Iterator[list[tuple[int, int, int]]]:
    """Ranges of segments (shard, first, end) that fit a broadcast together."""
    most = max(1, filter_bytes // (8 * BLOCK * SEGMENT_BLOCKS)) * SEGMENT_BLOCKS
    wave, held = [], 0
    for shard in sorted(blocks):
        segment, left = 0, blocks[shard]
        while left:
            room = (most - held) // SEGMENT_BLOCKS * SEGMENT_BLOCKS
            part = left if left <= most - held else room
            if not part:
                yield wave
                wave, held = [], 0
                continue
            n = math.ceil(part / SEGMENT_BLOCKS)
            wave.append((shard, segment, segment + n))
            segment, left, held = segment + n, left - part, held + part
    if wave:
        yield wave


# -- forms and roots ----------------------------------------------------------------------------


def forms(words: DataFrame, pairs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word``, ``n``, ``form``, ``form_n`` and ``n_near`` of all words."""
    both = pairs.select("a", "b", "n_b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n_a").alias("n_b")))
    # the most frequent near word, of equally frequent ones the smallest
    best = both.groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("k"), F.col("b"))).alias("f"))
    near = words.select("word", "n").join(best, F.col("word") == F.col("a"), "left")
    enough = -F.col("f.k") >= F.col("n") * ratio
    return near.select("word", "n", F.when(enough, F.col("f.b")).alias("form"), F.when(enough, -F.col("f.k")).alias("form_n"), F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"))


def with_roots(formed: DataFrame) -> DataFrame:
    """``root``: forms followed to the last, in steps that double. Each form is
    ``ratio`` times as frequent as its word, so chains are short and end."""
    links = common.store(formed.filter("form is not null").select("word", F.col("form").alias("root")), "spelling_roots")
    while True:
        further = links.select(F.col("word").alias("via"), F.col("root").alias("next"))
        moved = common.store(links.join(further, F.col("root") == F.col("via"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling_roots")
        links = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            break
    return formed.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """One row a word: ``word``, ``n``, ``n_near``, ``form``, ``form_n``, ``root``."""
    words = vocabulary(docs, id_col, text_col)
    formed = common.store(forms(words, near_pairs(words, filter_bytes)), "spelling_forms")
    return with_roots(formed).select("word", "n", "n_near", "form", "form_n", "root")
