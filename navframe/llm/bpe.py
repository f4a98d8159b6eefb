"""Byte-level BPE encoding and decoding (operator 6).

Pre-tokenisation is ``pretoken.token_starts``: class arrays and prefix products
of transition functions over a whole chunk of text. The slices of a chunk are
grouped by a 128-bit hash, so only distinct slices reach the pair merging, whose
results are kept in a bounded cache of the Python worker. Ids of the chunk are
then gathered with numpy. Decoding gathers the bytes of the ids the same way.

Defined results: a null or empty text has no ids and decodes to no bytes; bytes
that are not valid UTF-8 become U+FFFD before encoding. Rows are treated one by
one, so repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from navframe.llm import common, pretoken

#: bytes of text handled at once
CHUNK_BYTES = 1 << 19
#: distinct slices whose ids a Python worker keeps
CACHE_SLICES = 300_000
#: rows decoded at once
DECODED_ROWS = 128
#: from this length on, merging uses a heap
HEAP_BYTES = 48


# -- pair merging ---------------------------------------------------------------


def merge_pairs(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one slice: the pair of lowest rank merges first, leftmost on ties."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    if len(piece) >= HEAP_BYTES:
        return _merge_with_heap(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [ranks.get(piece[i : i + 2]) for i in range(len(piece) - 1)]
    while True:
        best, at = None, -1
        for i, rank in enumerate(pairs):
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            return [ranks[p] for p in parts]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del pairs[at]
        if at < len(pairs):
            pairs[at] = ranks.get(parts[at] + parts[at + 1])
        if at:
            pairs[at - 1] = ranks.get(parts[at - 1] + parts[at])


def _merge_with_heap(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for long slices, in n log n steps over a linked list of parts."""
    n = len(piece)
    ends = list(range(1, n + 1))  # the part that starts at i ends at ends[i]
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n + [False]
    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i] or ends[i] >= end or not alive[ends[i]] or ends[ends[i]] != end:
            continue  # one of the two parts has changed meanwhile
        alive[ends[i]] = False
        ends[i] = end
        if end < n:
            before[end] = i
            rank = ranks.get(piece[i : ends[end]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, ends[end]))
        if before[i] >= 0:
            rank = ranks.get(piece[before[i] : end])
            if rank is not None:
                heapq.heappush(heap, (rank, before[i], end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return out


# -- chunks ------------------------------------------------------------------------


class SliceCache:
    """Ids of distinct slices, in two generations.

    What is looked up is in the young generation or moves there; when that is
    full it becomes the old one, and what the old one held and nobody asked for
    is forgotten. Ids are kept as packed 32-bit integers.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], most: int = CACHE_SLICES):
        self.encode, self.most = encode, most // 2
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def look_up(self, slices: list[str]) -> list[bytes]:
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        found = list(map(young.get, slices))
        missing = [i for i, ids in enumerate(found) if ids is None]
        new = []
        for i in missing:
            s = slices[i]
            if s in old:
                found[i] = young[s] = old[s]
            else:
                new.append(i)
        if new:
            for i, ids in zip(new, self.encode([slices[i] for i in new])):
                found[i] = young[slices[i]] = ids
        return found


def _gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenation of flat[start : start + length], and where each part ends."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    index = np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
    return flat[index], ends


def encode_chunk(texts: list[str], cache: SliceCache) -> list[np.ndarray]:
    """Ids of each text."""
    joined = "".join(texts)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    if not joined:
        return [np.zeros(0, dtype=np.int32) for _ in texts]
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    text_ends = np.cumsum(lengths)
    text_starts = (text_ends - lengths)[lengths > 0]
    starts = pretoken.token_starts(codes, text_starts)
    ends = np.append(starts[1:], len(codes))
    first, second = common.char_hashes(codes, starts, ends)
    keys, one_of, which = np.unique(first, return_index=True, return_inverse=True)
    if not np.array_equal(second[one_of][which], second):  # two slices share a 64-bit hash
        pairs = np.stack([first, second], axis=1)
        _, one_of, which = np.unique(pairs, axis=0, return_index=True, return_inverse=True)
    slices = [joined[a:b] for a, b in zip(starts[one_of].tolist(), ends[one_of].tolist())]
    known = cache.look_up(slices)
    sizes = np.fromiter(map(len, known), dtype=np.int64, count=len(known)) // 4
    flat = np.frombuffer(b"".join(known), dtype=np.int32)
    ids, id_ends = _gather(flat, (np.cumsum(sizes) - sizes)[which], sizes[which])
    upto = np.concatenate([[0], id_ends])[np.searchsorted(starts, text_ends)]
    return np.split(ids, upto[:-1])


def decoded(texts: list[bytes | None]) -> list[str]:
    return [(t or b"").decode("utf-8", "replace") for t in texts]


# -- vocabulary ----------------------------------------------------------------------


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Vocabulary:
    def __init__(self, path: str):
        self.ranks = ranks = read_ranks(path)  # the cache doesn't refer to its vocabulary, so both go at once
        self.cache = SliceCache(lambda new: [array("i", merge_pairs(s.encode("utf-8", "replace"), ranks)).tobytes() for s in new])
        by_id = {i: t for t, i in self.ranks.items()}
        tokens = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = common.byte_array(b"".join(tokens))

    def decode(self, ids: np.ndarray) -> bytes:
        return _gather(self.bytes, self.starts[ids], self.lengths[ids])[0].tobytes()


def vocabulary(path: str) -> Vocabulary:
    """One per Python worker, while its tasks encode or decode."""
    return common.kept(("vocabulary", path), lambda: Vocabulary(path))


# -- operators -------------------------------------------------------------------------


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """Ids of every text.

    Returns ``id_col``, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit
    integers); with ``offsets`` also ``token_ends``, the byte offset in the text
    where each token ends.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, n_tokens bigint, ids binary" + ", token_ends array<bigint>" * offsets

    def make():
        vocab = vocabulary(ranks_path)

        def run(batch: pa.RecordBatch):
            texts = common.text_bytes(batch.column(1))
            for a, b in common.chunks(texts, CHUNK_BYTES):
                ids = encode_chunk(decoded(texts[a:b]), vocab.cache)
                made = {id_col: batch.column(0).slice(a, b - a), "n_tokens": [len(x) for x in ids], "ids": [x.astype("<u4").tobytes() for x in ids]}
                if offsets:
                    made["token_ends"] = common.list_array([np.cumsum(vocab.lengths[x]) for x in ids], pa.int64())
                yield made

        return run

    return common.map_rows(docs, [id_col, text_col], schema, make)


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Bytes of every id sequence: ``id_col``, ``n_tokens``, ``ids``, ``decoded``."""
    id_type = encoded.schema[id_col].dataType.simpleString()

    def make():
        vocab = vocabulary(ranks_path)

        def run(batch: pa.RecordBatch):
            for a in range(0, batch.num_rows, DECODED_ROWS):
                part = batch.slice(a, DECODED_ROWS)
                raw = [x or b"" for x in part.column(1).to_pylist()]
                yield {id_col: part.column(0), "n_tokens": [len(x) // 4 for x in raw], "ids": raw, "decoded": [vocab.decode(np.frombuffer(x, dtype="<u4")) for x in raw]}

        return run

    return common.map_rows(encoded, [id_col, ids_col], f"`{id_col}` {id_type}, n_tokens bigint, ids binary, decoded binary", make)
