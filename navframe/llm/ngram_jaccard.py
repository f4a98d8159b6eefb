"""N-gram Jaccard join with PartEnum signatures (operator 1).

A document is the set of hashes of its word shingles; documents of equal sets are
one class, and classes are joined. Sizes are cut into bands whose ends differ by
the threshold, so two similar sets lie in one band or in neighbours and differ in
at most ``k`` elements. For a band the feature domain is cut by a hash into
``n1`` parts and each part into ``n2`` cells. Two sets that differ in at most
``k`` elements differ in at most ``k2`` elements of at least ``need`` parts, so
they agree on ``n2 - k2`` cells of each of these: every such subset's projection
is a signature. A set signs for its own band and the next. ``need`` grows with
``k``, at the price of some more parts, so chance agreements fall short of it;
empty projections aren't signatures, and ``need`` is less by a set's own empty ones.

Signatures travel packed (32 bits besides the bucket, and a document number
within a chunk of text) to buckets whose number grows with the input. A signature that
many documents of one chunk share is emitted once with its members listed beside
it, so no bucket gathers a large group.

1. Members of a signature that up to ``ALL_PAIRS`` documents share are counted
   pair by pair; pairs that share as many as a similar pair must are compared. A
   document in fewer larger sets than its ``need`` shares others with any similar
   one, so larger sets matter to the rest alone: each member is compared with the
   set's hub, the member of most large sets, linear in the set's size. Links give
   components. Pairs whose sketches, a sixtieth of the sets at most, differ in more
   bits than a similar pair may in elements are out, so that chance candidates don't
   make sets travel. Pairs are compared in tasks of a bounded number of sets and elements:
   candidates that pairs connect are one cluster, cut into blocks, and a set travels
   once to each block that holds one of its partners.
2. Two similar documents that are still apart share no small signature, so at least
   ``need`` larger ones, which then span components. Documents in fewer spanning sets
   are done, and again in those that still span without them; the others leave their
   ``need - 1`` largest sets, as a similar pair shares one more. What is left is
   compared block by block, members outside the largest component of a cluster of
   overlapping sets against all. Tasks return links alone; pairs are never rows.

Comparison is exact on the shingle sets, so no link is lost or made up; links
between documents that are in one component already aren't looked for, as the
result holds components.

Defined results: null, empty and wordless texts have empty sets and link with
nothing; shorter texts than a shingle are one sequence; repeated rows and equal
sets are one class; rows with a null id link but are never a component's name
unless all its ids are null. Ids are whole numbers (or text that casts to them).
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from navframe.llm import common, graph

#: a signature that more documents of one batch share travels as a list
HOT_IN_BATCH = 32
#: sharers of a signature up to which their pairs are counted
ALL_PAIRS = 8
#: sets, and elements of them about, on either side of one task's comparison
BLOCK = 1024
BLOCK_ELEMENTS = 1 << 18
#: pairs counted at once in a bucket
PAIRS_AT_ONCE = 1 << 18
#: packed signatures of a bucket, about, and text whose signatures are packed at once
BUCKET_BYTES = 8 << 20
CHUNK_BYTES = 4 << 20


# -- sets and signatures ------------------------------------------------------------


def shingles(data: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``n`` lower-cased words."""
    buf = common.byte_array(data.lower())
    starts, ends = common.word_spans(buf, common.SPACE_WORDS)
    words = common.span_hashes(buf, starts, ends)
    if not len(words):
        return words
    return np.unique(common.window_hashes(words, min(n, len(words))))


class Bands:
    """Size bands and partition numbers for a threshold of ``num / den``."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.group = 1 if 100 * num >= 88 * den else 2
        self.ends = [0]

    def band(self, size: int) -> int:
        while self.ends[-1] < size:
            self.ends.append(max(self.ends[-1] + 1, (self.ends[-1] + 1) * self.den // self.num))
        return int(np.searchsorted(self.ends, size))

    @functools.lru_cache(maxsize=4096)  # noqa: B019
    def shape(self, band: int) -> tuple[int, int, int, int]:
        """(k, n1, n2, k2) for sets of the band and the one before.

        ``k // group`` parts at most can differ in ``group`` elements or more, so
        ``need`` of ``k // group + need`` differ in fewer.
        """
        while len(self.ends) <= band:
            self.band(self.ends[-1] + 1)
        k = 2 * (self.den - self.num) * self.ends[band] // (self.den + self.num)
        group = min(self.group, k + 1)
        return k, k // group + self.need(k), (group + 1 if group > 1 else 1), group - 1

    def bytes_an_element(self) -> float:
        """Packed signatures of an element, about: six bytes a signature."""
        subsets = self.group + 1 if self.group > 1 else 1
        return 2.6 * 2 * (self.den - self.num) / (self.den + self.num) * (1 / self.group + 1 / 16) * subsets * 6

    @staticmethod
    def need(k: int) -> int:
        return 1 + k // 16


def _parts(elements: np.ndarray, n1: int, n2: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the elements' hashes, and their number, in each cell."""
    cells = (common.mix(elements, seed) % np.uint64(n1 * n2)).astype(np.int64)
    sums = np.zeros(n1 * n2, dtype=np.uint64)
    np.add.at(sums, cells, common.mix(elements, seed + 1))
    return sums.reshape(n1, n2), np.bincount(cells, minlength=n1 * n2).reshape(n1, n2)


def _instances(elements: np.ndarray, bands: Bands) -> Iterator[tuple[int, tuple[int, int, int, int]]]:
    """Bands that a set signs for, with their shapes; none where sets can differ
    in no element, as equal sets are one class."""
    band = bands.band(len(elements))
    for b in (band, band + 1) if len(elements) else ():
        if bands.shape(b)[0]:
            yield b, bands.shape(b)


def _spare(empty: np.ndarray, k: int) -> int:
    """Signatures of a band that a similar set shares besides those of empty
    projections, which say nothing: parts with one may all be among the ``need``."""
    return Bands.need(k) - int(np.count_nonzero(empty.any(axis=1)))


def _empty(counts: np.ndarray, n2: int, k2: int) -> np.ndarray:
    """Which projections of which part are empty."""
    return np.stack([counts[:, chosen].sum(axis=1) == 0 for chosen in itertools.combinations(range(n2), n2 - k2)], axis=1)


def needed(elements: np.ndarray, bands: Bands) -> int:
    """Signatures that a set shares at least with any similar one."""
    out = []
    for b, (k, n1, n2, k2) in _instances(elements, bands):
        cells = (common.mix(elements, b * 64) % np.uint64(n1 * n2)).astype(np.int64)
        out.append(_spare(_empty(np.bincount(cells, minlength=n1 * n2).reshape(n1, n2), n2, k2), k))
    return max(1, min(out, default=1))


def signatures(elements: np.ndarray, bands: Bands) -> np.ndarray:
    """PartEnum signatures of a set for its band and the next.

    Empty projections are left out where enough others remain. Where they don't
    (a few small sets), an empty projection is joined with each part under
    another hash, of which similar sets share one too.
    """
    out = []
    for b, (k, n1, n2, k2) in _instances(elements, bands):
        base = b * 64
        sums, counts = _parts(elements, n1, n2, base)
        empty = _empty(counts, n2, k2)
        part = np.arange(n1, dtype=np.uint64)
        rest = None
        if _spare(empty, k) < 1:
            rest = _parts(elements, k + 1, 1, base + 8)[0][:, 0]
            rest = common.mix(rest + common.mix(np.arange(k + 1, dtype=np.uint64), base + 9), base + 10)
        for c, chosen in enumerate(itertools.combinations(range(n2), n2 - k2)):
            names = common.mix(part * np.uint64(1009) + np.uint64(c), base + 2)
            made = common.mix(sums[:, chosen].sum(axis=1, dtype=np.uint64) ^ names, base + 3)
            if rest is not None:
                out.append(common.mix(made[empty[:, c]][:, None] ^ rest[None, :], base + 4).ravel())
            out.append(made[~empty[:, c]])
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


# -- sketches ----------------------------------------------------------------------------

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1)


def sketch(elements: np.ndarray) -> bytes:
    """The parity of the number of elements in each cell, of as many cells as elements
    or more, a power of two. Two sets differ in as many elements as their sketches in
    bits, at least; a sketch's halves xor-ed are the sketch of half the cells."""
    cells = max(64, 1 << (len(elements) - 1).bit_length())
    counts = np.bincount((common.mix(elements, 6) & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def _differing(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Bits in which each left sketch differs from its right one; the longer is folded."""
    out = np.zeros(len(left), dtype=np.int64)
    lengths = np.array([(len(a), len(b)) for a, b in zip(left, right)], dtype=np.int64).reshape(-1, 2)
    for pair in np.unique(lengths, axis=0):
        at = np.flatnonzero((lengths == pair).all(axis=1))
        sides = [np.frombuffer(b"".join([side[i] for i in at.tolist()]), dtype=np.uint8).reshape(len(at), -1) for side in (left, right)]
        while sides[0].shape[1] != sides[1].shape[1]:
            long = int(sides[1].shape[1] > sides[0].shape[1])
            half = sides[long].shape[1] // 2
            sides[long] = sides[long][:, :half] ^ sides[long][:, half:]
        out[at] = _BITS[sides[0] ^ sides[1]].sum(axis=1)
    return out


# -- packed signatures -----------------------------------------------------------------


def _pack(batch_ids: np.ndarray, signs: list[np.ndarray], n_buckets: int):
    """Rows of a batch, each (bucket, signatures, document numbers, ids, set): of
    a bucket (set null; without numbers, an id for each signature), and of a hot signature (set: its name, ids: its members
    in the batch), which any bucket may take."""
    which = np.repeat(np.arange(len(signs)), [len(s) for s in signs])
    sig = np.concatenate(signs) if signs else np.zeros(0, dtype=np.uint64)
    order = np.argsort(sig, kind="stable")
    sig, which = sig[order], which[order]
    bucket = (sig % np.uint64(n_buckets)).astype(np.int64)
    first = np.flatnonzero(np.diff(sig, prepend=~sig[:1]) != 0) if len(sig) else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.append(first, len(sig)))
    hot = sizes > HOT_IN_BATCH
    keep = np.repeat(~hot, sizes)
    keep[first[hot]] = True  # one member of a hot signature stays in its bucket
    flag = np.zeros(len(sig), dtype=np.uint32)
    flag[first[hot]] = 1 << 31
    rows = []
    for a, n in zip(first[hot].tolist(), sizes[hot].tolist()):
        members = batch_ids[which[a : a + n]]
        name = _set_id(int(bucket[a]), int(sig[a]) >> 32)
        rows.append((int(common.mix(members[:1])[0] % np.uint64(n_buckets)), b"", b"", members.tobytes(), name))
    sig, which, bucket, flag = sig[keep], which[keep], bucket[keep], flag[keep]
    by_bucket = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[by_bucket])) + 1
    for part in np.split(by_bucket, cuts) if len(by_bucket) else ():
        used, number = np.unique(which[part], return_inverse=True)
        packed = (sig[part] >> np.uint64(32)).astype("<u4")
        if len(used) * 8 + len(part) * 2 > len(part) * 8 and not flag[part].any():
            # many buckets: few documents come twice, so each signature has its id
            rows.append((int(bucket[part[0]]), packed.tobytes(), b"", batch_ids[which[part]].tobytes(), None))
            continue
        wide = len(used) > 0x7FFF or flag[part].any()
        rows.append((int(bucket[part[0]]), packed.tobytes(), (number.astype(np.uint32) | flag[part]).astype("<u4" if wide else "<u2").tobytes(), batch_ids[used].tobytes(), None))
    return rows


def _unpack(sigs: bytes, numbers: bytes, ids: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(sigs, dtype="<u4")
    if not numbers:
        return raw, np.frombuffer(ids, dtype=np.uint64), np.zeros(len(raw), dtype=bool)
    wide = len(numbers) == 4 * len(raw)
    number = np.frombuffer(numbers, dtype="<u4" if wide else "<u2").astype(np.uint32)
    hot = number >> 31 == 1 if wide else np.zeros(len(raw), dtype=bool)
    return raw, np.frombuffer(ids, dtype=np.uint64)[number & 0x7FFFFFFF], hot


def _set_id(bucket: int, sig: int) -> int:
    """A set's name: its bucket and the bits of its signature that travel."""
    return int(common.mix(np.array([bucket << 32 | sig], dtype=np.uint64), 77)[0].view(np.int64))


def _counted(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs and how often each occurs."""
    left, right = (np.concatenate(x) if x else np.zeros(0, dtype=np.uint64) for x in (a, b))
    order = np.lexsort((right, left))
    left, right = left[order], right[order]
    first = np.ones(len(left), dtype=bool)
    first[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
    at = np.flatnonzero(first)
    return left[at], right[at], np.diff(np.append(at, len(left)))


def _pairs(ids: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs within each run of ``ids`` (from ``first`` on, ``sizes`` long), counted
    ``PAIRS_AT_ONCE`` or so at a time."""
    left, right, held = [], [], 0
    for size in np.unique(sizes).tolist():
        i, j = np.triu_indices(size, 1)  # ids are in order
        runs = first[sizes == size]
        step = max(1, PAIRS_AT_ONCE // len(i))
        for begin in range(0, len(runs), step):
            base = runs[begin : begin + step, None]
            left.append(ids[base + i].ravel())
            right.append(ids[base + j].ravel())
            held += len(left[-1])
            if held >= PAIRS_AT_ONCE:
                yield _counted(left, right)
                left, right, held = [], [], 0
    yield _counted(left, right)


def _meet(rows: pa.Table) -> dict[str, list]:
    return {name: column.to_pylist() for name, column in _met(rows).items()}


def _met(rows: pa.Table) -> dict[str, pa.Array]:
    """One bucket: pairs and how many signatures they share (``set`` null), and
    members of large sets (``a`` null). A pair may come in several rows."""
    kept: list[tuple[int, np.ndarray]] = []
    counts = []
    parts = []
    for sigs, numbers, ids, name in zip(*(rows[c].to_pylist() for c in ("sigs", "numbers", "ids", "set"))):
        if name is None:
            parts.append(_unpack(sigs, numbers, ids))
        else:  # members of a hot signature in one batch
            kept.append((name, np.unique(np.frombuffer(ids, dtype=np.uint64))))
    if parts:
        sig, ids, hot = (np.concatenate(column) for column in zip(*parts))
        order = np.lexsort((ids, sig))
        sig, ids, hot = sig[order], ids[order], hot[order]
        marked = np.unique(sig[hot])
        fresh = np.ones(len(sig), dtype=bool)  # copies within and across batches
        fresh[1:] = (sig[1:] != sig[:-1]) | (ids[1:] != ids[:-1])
        sig, ids = sig[fresh], ids[fresh]
        first = np.flatnonzero(np.diff(sig.astype(np.int64), prepend=-1))
        sizes = np.diff(np.append(first, len(sig)))
        # a set that is hot in one batch is large, even if it meets no one else here
        large = (sizes > ALL_PAIRS) | np.isin(sig[first], marked)
        bucket = rows["bucket"][0].as_py()
        kept += [(_set_id(bucket, int(sig[a])), ids[a : a + n]) for a, n in zip(first[large].tolist(), sizes[large].tolist())]
        small = ~large & (sizes > 1)
        counts = list(_pairs(ids, first[small], sizes[small]))
    a, b, shared = (np.concatenate(x) for x in zip(*counts)) if counts else (np.zeros(0, dtype=np.uint64),) * 3
    n, m = len(a), len(kept)
    nothing = pa.nulls(n, pa.list_(pa.int64()))
    return {
        "a": pa.concat_arrays([pa.array(a.view(np.int64)), pa.nulls(m, pa.int64())]),
        "b": pa.concat_arrays([pa.array(b.view(np.int64)), pa.nulls(m, pa.int64())]),
        "shared": pa.concat_arrays([pa.array(shared.astype(np.int64)), pa.nulls(m, pa.int64())]),
        "set": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array([name for name, _ in kept], pa.int64())]),
        "members": pa.concat_arrays([nothing, common.list_array([members for _, members in kept], pa.int64())]),
    }


# -- the join ---------------------------------------------------------------------------


def profile(docs: DataFrame, id_col: str, text_col: str, n: int, bands: Bands) -> DataFrame:
    """``doc_id``, ``text_key``, set size ``n_shingles``, ``k1`` and ``k2`` (128
    bits of the set), ``needed`` (signatures shared with a similar set)."""

    def make():
        def run(batch: pa.RecordBatch):
            sets = [shingles(data or b"", n) for data in common.text_bytes(batch.column(2))]
            keys = [_set_keys(s) for s in sets]
            return {"doc_id": batch.column(0), "text_key": batch.column(1), "n_shingles": [len(s) for s in sets], "k1": [k[0] for k in keys], "k2": [k[1] for k in keys], "needed": [needed(s, bands) for s in sets]}

        return run

    return common.map_rows(_picked(docs, id_col, text_col), ["doc_id", "text_key", "text"], "doc_id bigint, text_key bigint, n_shingles bigint, k1 bigint, k2 bigint, needed int", make)


def _picked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("text_key"), F.col(f"`{text_col}`").alias("text"))


def _set_keys(elements: np.ndarray) -> tuple[int, int]:
    whole = np.array([0]), np.array([len(elements)])
    return tuple(int(common.sequence_hashes(e, *whole)[0].view(np.int64)) for e in (elements, common.mix(elements, 5)))


def _candidates(docs: DataFrame, text_col: str, n: int, bands: Bands, n_buckets: int) -> DataFrame:
    """Pairs (``a``, ``b``, ``shared``) and sets (``set``, ``members``) of ``k1``."""
    columns = ("bucket", "sigs", "numbers", "ids", "set")

    def make():
        def run(batch: pa.RecordBatch):
            texts = common.text_bytes(batch.column(0))
            for begin, end in common.chunks(texts, CHUNK_BYTES):
                seen: dict[int, np.ndarray] = {}
                for data in texts[begin:end]:
                    elements = shingles(data or b"", n)
                    key = _set_keys(elements)[0]
                    if len(elements) and key not in seen:
                        seen[key] = signatures(elements, bands)
                rows = _pack(np.array(list(seen), dtype=np.int64).view(np.uint64), list(seen.values()), n_buckets)
                if rows:
                    yield dict(zip(columns, map(list, zip(*rows))))

        return run

    packed = common.map_rows(docs, [text_col], "bucket int, sigs binary, numbers binary, ids binary, set bigint", make)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("shared", pa.int64()), ("set", pa.int64()), ("members", pa.list_(pa.int64()))])

    def meet(rows: pa.Table) -> pa.Table:
        return pa.table(_met(rows), schema=schema)

    return packed.groupBy("bucket").applyInArrow(meet, "a bigint, b bigint, shared bigint, set bigint, members array<bigint>")


def _sets(rows: pa.Table) -> list[np.ndarray]:
    """The ``elements`` of each row."""
    elements = rows["elements"].combine_chunks()
    ends = elements.offsets.to_numpy()
    return np.split(elements.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]], ends[1:-1] - ends[0])


def _possible(pairs: DataFrame, sets: DataFrame, bands: Bands) -> DataFrame:
    """Pairs of classes (``a``, ``b``) that their sets' ``size`` and ``sketch`` don't rule
    out: those of all pairs that reach the threshold, and of few others."""
    seen = pairs
    for side in ("a", "b"):
        seen = seen.join(sets.select(F.col("class").alias(side), F.col("size").alias(f"size_{side}"), F.col("sketch").alias(f"sketch_{side}")), side)

    def make():
        def run(batch: pa.RecordBatch):
            sizes = sum(batch.column(i).to_numpy().astype(np.int64) for i in (2, 3))
            bits = _differing(*(batch.column(i).to_pylist() for i in (4, 5)))
            near = pa.array((sizes - bits) * bands.den >= (sizes + bits) * bands.num)
            return {"a": batch.column(0).filter(near), "b": batch.column(1).filter(near)}

        return run

    return common.map_rows(seen, ["a", "b", "size_a", "size_b", "sketch_a", "sketch_b"], "a bigint, b bigint", make).distinct()


def _compare_pairs(pairs: pa.Table, rows: pa.Table, bands: Bands) -> dict[str, np.ndarray]:
    """Which of a task's pairs reach the threshold; ``rows`` are their sets."""
    names = rows["class"].to_numpy()
    order = np.argsort(names)
    sets = _sets(rows) if len(names) else []
    size = np.array([len(e) for e in sets], dtype=np.int64)
    _, number = np.unique(np.concatenate(sets), return_inverse=True) if sets else (None, np.zeros(0, dtype=np.int64))
    numbered = np.split(number, np.cumsum(size)[:-1])
    a, b = (order[np.searchsorted(names, pairs[c].to_numpy(), sorter=order)] for c in ("a", "b"))
    by_a = np.argsort(a, kind="stable")
    a, b = a[by_a], b[by_a]
    inter = np.zeros(len(a), dtype=np.int64)
    mark = np.full(len(number) + 1, -1, dtype=np.int64)
    for begin, end in zip(*_runs(a)):
        mark[numbered[a[begin]]] = a[begin]
        for low in range(begin, end, BLOCK):  # a set's partners, some at a time
            partners = b[low : min(end, low + BLOCK)]
            hits = mark[np.concatenate([numbered[i] for i in partners.tolist()])] == a[begin]
            inter[low : low + len(partners)] = np.add.reduceat(hits, np.append(0, np.cumsum(size[partners])[:-1]))
    near = inter * bands.den >= (size[a] + size[b] - inter) * bands.num
    return {"u": names[a[near]], "v": names[b[near]]}


def _runs(values: np.ndarray) -> tuple[list[int], list[int]]:
    first = np.flatnonzero(np.diff(values, prepend=-1))
    return first.tolist(), np.append(first[1:], len(values)).tolist() if len(first) else []


def _blocks(n: Column, elements: Column, block: int) -> Column:
    """Into how many blocks a cluster of ``n`` sets is cut."""
    return F.greatest(F.ceil(n / block), F.ceil(elements / BLOCK_ELEMENTS), F.lit(1)).cast("int")


def _verified(pairs: DataFrame, sets: DataFrame, bands: Bands, block: int = BLOCK) -> DataFrame:
    """Pairs of classes (``a``, ``b``) that reach the threshold, as ``u`` and ``v``.

    Clusters of pairs are cut into blocks; a task compares the pairs between two
    blocks, or of some whole small clusters."""
    clusters = graph.components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
    nodes = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    nodes = nodes.join(clusters, F.col("class") == F.col("node"), "left").select("class", F.coalesce("root", "class").alias("cluster"))
    nodes = common.store(nodes.join(sets.select("class", F.size("elements").alias("size")), "class"), "jaccard_nodes")
    counted = nodes.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).withColumn("blocks", _blocks(F.col("n"), F.col("size"), block))
    small = counted.filter("blocks = 1").agg(F.sum("n"), F.sum("size")).first()
    n_small = max(1, math.ceil((small[0] or 0) / block), math.ceil((small[1] or 0) / BLOCK_ELEMENTS))
    together = F.pmod(F.xxhash64("cluster"), F.lit(n_small))
    whole = F.col("blocks") == 1
    placed = nodes.join(counted.select("cluster", "blocks"), "cluster").select(
        "class",
        F.when(whole, -1 - together).otherwise(F.col("cluster")).alias("cluster"),
        F.when(whole, F.lit(0)).otherwise(F.pmod(F.xxhash64("class"), F.col("blocks"))).cast("int").alias("at"),
    )
    placed = common.store(placed, "jaccard_placed")
    dealt = pairs.join(placed.select(F.col("class").alias("a"), "cluster", F.col("at").alias("i")), "a").join(placed.select(F.col("class").alias("b"), F.col("at").alias("j")), "b")
    turned = F.col("i") > F.col("j")
    dealt = dealt.select("cluster", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.when(turned, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("b"))
    dealt = common.store(dealt, "jaccard_dealt")
    keys = ["cluster", "i", "j"]
    ends = F.explode(F.array("a", "b")).alias("class")
    used = dealt.select(*[F.col(k).alias(f"{k}_") for k in keys], ends).distinct()
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def compare(asked: pa.Table, held: pa.Table) -> pa.Table:
        return pa.table(_compare_pairs(asked, held, bands), schema=schema)

    held = used.join(sets.select("class", "elements"), "class")
    return dealt.groupBy(*keys).cogroup(held.groupBy(*[f"{k}_" for k in keys])).applyInArrow(compare, "u bigint, v bigint")


def _incidence(sets: list[np.ndarray], order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column (rank in ``order``) of the elements in ``order``, by column."""
    rows = np.repeat(np.arange(len(sets)), [len(e) for e in sets])
    elements = np.concatenate(sets)
    columns = np.minimum(np.searchsorted(order, elements), max(len(order) - 1, 0))
    inside = order[columns] == elements if len(order) else np.zeros(len(elements), dtype=bool)
    rows, columns = rows[inside], columns[inside]
    by_column = np.argsort(columns, kind="stable")
    return rows[by_column], columns[by_column]


def shared_sizes(left: list[np.ndarray], right: list[np.ndarray], chunk: int = 2048) -> np.ndarray:
    """Size of the intersection of every left with every right set, by products
    of 0/1 matrices over some elements at a time."""
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    order = np.intersect1d(np.concatenate(left), np.concatenate(right))
    sides = [_incidence(side, order) for side in (left, right)]
    for begin in range(0, len(order), chunk):
        parts = []
        for (rows, columns), n in zip(sides, out.shape):
            a, b = np.searchsorted(columns, [begin, begin + chunk])
            part = np.zeros((n, chunk), dtype=np.float32)
            part[rows[a:b], columns[a:b] - begin] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out.astype(np.int64)


def _compare_blocks(rows: pa.Table, bands: Bands) -> dict[str, list]:
    """Links between the two blocks of a task, of different components."""
    sets = _sets(rows)
    side, root, name = (rows[c].to_numpy() for c in ("side", "root", "class"))
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(right):  # a block against itself
        right = left
    if not len(left):
        return {"u": [], "v": []}
    inter = shared_sizes([sets[i] for i in left], [sets[i] for i in right])
    size = np.array([len(e) for e in sets])
    union = size[left][:, None] + size[right][None, :] - inter
    links = (inter * bands.den >= union * bands.num) & (root[left][:, None] != root[right][None, :])
    at = np.nonzero(links)
    return {"u": name[left][at[0]].tolist(), "v": name[right][at[1]].tolist()}


def _spanning(members: DataFrame) -> DataFrame:
    """The members of sets that span components, of classes in as many of them as a
    similar pair shares; each without its ``needed - 1`` largest sets."""
    while True:
        spans = members.groupBy("set").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo < hi").select("set", "n")
        held = members.join(spans, "set")
        enough = held.groupBy("class").agg(F.count(F.lit(1)).alias("n_sets"), F.max("needed").alias("least")).filter("n_sets >= least").select("class")
        left = common.store(held.join(enough, "class").select("set", "class", "root", "needed", "n"), "jaccard_spanning")
        # without the classes that went some sets span no more
        if left.count() == members.count():
            break
        members = left.drop("n")
    rank = F.row_number().over(Window.partitionBy("class").orderBy(F.col("n").desc(), "set"))  # at most its signatures
    return left.withColumn("rank", rank).filter(F.col("rank") >= F.col("needed")).select("set", "class", "root")


def _links_in_large_sets(members: DataFrame, sets: DataFrame, bands: Bands, block: int = BLOCK) -> DataFrame:
    """Links between members (``set``, ``class``, ``root``, and ``needed`` if it is
    there: how many sets a similar pair shares at least) of one set that are in
    different components. Sets that overlap are one cluster; its members outside
    the largest component are compared with all of it, a block of them with a
    block in one task."""
    if "needed" not in members.columns:
        members = members.withColumn("needed", F.lit(1))
    spanning = _spanning(members)
    heads = spanning.groupBy("set").agg(F.min("class").alias("u"))
    spanning = common.store(spanning.join(heads, "set").select("u", F.col("class").alias("v"), "root"), "jaccard_spanning")
    clusters = graph.components(spanning.select("u", "v"))
    nodes = spanning.select(F.col("v").alias("class"), "root").distinct()
    nodes = nodes.join(clusters, F.col("class") == F.col("node"), "left").select("class", nodes["root"], F.coalesce(clusters["root"], F.col("class")).alias("cluster"))
    nodes = common.store(nodes.join(sets.select("class", F.size("elements").alias("size")), "class"), "jaccard_nodes")
    by_root = nodes.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("count"), F.sum("size").alias("size"))
    largest = by_root.groupBy("cluster").agg(F.max(F.struct("count", "root", "size")).alias("m"), F.sum("count").alias("n"), F.sum("size").alias("size"))
    others_n, others_size = F.col("n") - F.col("m.count"), F.col("size") - F.col("m.size")
    largest = largest.filter(others_n > 0).select("cluster", F.col("m.root").alias("main"), _blocks(F.col("m.count"), F.col("m.size"), block).alias("main_blocks"), _blocks(others_n, others_size, block).alias("blocks"))
    placed = nodes.join(largest, "cluster").withColumn("in_main", F.col("root") == F.col("main"))
    mine = F.pmod(F.xxhash64("class"), F.when(F.col("in_main"), F.col("main_blocks")).otherwise(F.col("blocks"))).cast("int")
    placed = placed.withColumn("mine", mine)
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    task = lambda i, kind, j, side: F.struct(i.cast("int").alias("i"), F.lit(kind).alias("kind"), j.cast("int").alias("j"), side.alias("side"))
    me = F.col("mine")
    # a block outside the main component: against the others of its kind, each once, and all of the main one
    outside = F.concat(
        F.transform(others, lambda j: task(F.least(me, j), 0, F.greatest(me, j), (me > j).cast("int"))),
        F.transform(F.sequence(F.lit(0), F.col("main_blocks") - 1), lambda j: task(me, 1, j, F.lit(0))),
    )
    inside = F.transform(others, lambda i: task(i, 1, me, F.lit(1)))
    # sets join before a class is dealt to its tasks, whose number is in no size estimate:
    # the dealt rows would pass for a small table and be broadcast. A shuffle at any size
    held = placed.join(sets.select("class", "elements").hint("merge"), "class")
    full = held.withColumn("t", F.explode(F.when(F.col("in_main"), inside).otherwise(outside))).select("cluster", "t.*", "class", "root", "elements")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def compare(rows: pa.Table) -> pa.Table:
        return pa.table(_compare_blocks(rows, bands), schema=schema)

    return full.groupBy("cluster", "i", "kind", "j").applyInArrow(compare, "u bigint, v bigint").distinct()


def _first_row() -> Column:
    """The smallest id and text; null ids come last."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key"))


def _grouped(docs: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Profiles of the documents, and classes of equal sets (``k1``, ``k2``, their
    first ``doc_id`` and ``text_key``) with the ``root`` of their component."""
    bands = Bands(num, den)
    spark = docs.sparkSession
    profiles = common.store(profile(docs, id_col, text_col, n, bands), "jaccard_profiles")
    classes = common.store(
        profiles.filter("n_shingles > 0").groupBy("k1", "k2").agg(_first_row().alias("m"), F.first("n_shingles").alias("n_shingles"), F.first("needed").alias("needed"))
        .select("k1", "k2", "m.doc_id", "m.text_key", "n_shingles", "needed").withColumn("class", F.monotonically_increasing_id()),
        "jaccard_classes",
    )
    total = profiles.agg(F.sum("n_shingles")).first()[0] or 0
    n_buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total * bands.bytes_an_element() / BUCKET_BYTES))
    found = common.store(_candidates(docs, text_col, n, bands, n_buckets), "jaccard_candidates")
    members = found.filter("set is not null").select("set", F.explode("members").alias("k1")).distinct()
    members = common.store(members.join(classes.select("k1", "class", "n_shingles", "needed"), "k1").drop("k1"), "jaccard_members")
    # signatures that a class shares with any similar one besides those of large sets
    in_large = members.groupBy("class").agg(F.countDistinct("set").alias("n_large"))
    names = common.store(classes.join(in_large, "class", "left").select("k1", "class", "n_shingles", (F.col("needed") - F.coalesce("n_large", F.lit(0))).alias("spare")), "jaccard_names")
    a = names.withColumnsRenamed({"k1": "a", "class": "ca", "n_shingles": "na", "spare": "spare_a"})
    b = names.withColumnsRenamed({"k1": "b", "class": "cb", "n_shingles": "nb", "spare": "spare_b"})
    sized = F.least("na", "nb") * den >= F.greatest("na", "nb") * num
    counted = found.filter("set is null").groupBy("a", "b").agg(F.sum("shared").alias("shared")).join(a, "a").join(b, "b")
    likely = counted.filter((F.col("shared") >= F.greatest("spare_a", "spare_b", F.lit(1))) & sized)
    # large sets matter to classes that have no signature to spare: members against a hub
    bare = names.filter("spare < 1").join(in_large, "class").select("class", "n_large")
    members = common.store(members.join(bare, "class"), "jaccard_members")
    hubs = members.groupBy("set").agg(F.max_by(F.struct("class", "n_shingles"), F.struct("n_large", "class")).alias("h")).select("set", F.col("h.class").alias("ca"), F.col("h.n_shingles").alias("na"))
    stars = members.select("set", F.col("class").alias("cb"), F.col("n_shingles").alias("nb")).join(hubs, "set").filter(sized & (F.col("ca") != F.col("cb")))
    both = likely.select("ca", "cb").union(stars.select("ca", "cb"))
    pairs = common.store(both.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct(), "jaccard_pairs")
    # the shingle sets of the candidates alone
    wanted = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).union(members.select("class")).distinct()
    # a shuffle at any size: the plan, and what it costs, doesn't change with the table
    texts = classes.join(wanted, "class").select("class", "doc_id", "text_key").hint("merge").join(_picked(docs, id_col, text_col).withColumnsRenamed({"doc_id": "d", "text_key": "t"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")))

    def make_sets():
        last = [None]

        def run(batch: pa.RecordBatch):
            keys = batch.column(0).to_pylist()  # repeated rows follow each other: one is enough
            fresh = pa.array([k != before for k, before in zip(keys, last + keys)], type=pa.bool_())
            last[:] = keys[-1:]
            batch = batch.filter(fresh)
            made = [shingles(t or b"", n) for t in common.text_bytes(batch.column(1))]
            return {"class": batch.column(0), "size": [len(s) for s in made], "sketch": [sketch(s) for s in made], "elements": common.list_array(made, pa.int64())}

        return run

    sets = common.store(common.map_rows(texts, ["class", "text"], "class bigint, size int, sketch binary, elements array<bigint>", make_sets), "jaccard_sets")
    pairs = common.store(_possible(pairs, sets, bands), "jaccard_pairs")
    links = common.store(_verified(pairs, sets, bands), "jaccard_links")
    roots = graph.components(links)
    rooted = members.join(roots, F.col("class") == F.col("node"), "left").select("set", "class", F.coalesce("root", "class").alias("root"), "needed")
    later = common.store(_links_in_large_sets(rooted, sets, bands), "jaccard_links")
    if not later.isEmpty():
        roots = graph.components(links.union(later))
    return profiles, classes.join(roots, F.col("class") == F.col("node"), "left").withColumn("root", F.coalesce("root", "class"))


def similar(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``doc_id``, ``text_key``, ``n_shingles`` and
    ``component_id`` (the smallest id reachable by links), for shingles of ``n``
    words and a Jaccard similarity of at least ``num / den``."""
    profiles, grouped = _grouped(docs, n, num, den, id_col, text_col)
    named = grouped.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_class = grouped.join(named, "root").select("k1", "k2", "component_id")
    return profiles.join(by_class, ["k1", "k2"], "left").select("doc_id", "text_key", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near duplicates stays: the one with the smallest id
    (null ids last), then the smallest hash of its text; of rows alike in both, one.
    Rows and columns are unchanged; documents without words are no duplicates."""
    profiles, grouped = _grouped(docs, n, num, den, id_col, text_col)
    g_id, g_key, g_root = (common.free_name(docs, wish) for wish in ("g_id", "g_key", "g_root"))
    stays = grouped.groupBy("root").agg(_first_row().alias("s")).select("root", F.col("s.doc_id").alias("s_id"), F.col("s.text_key").alias("s_key"))
    rows = profiles.filter("n_shingles > 0").groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"))
    judged = rows.join(stays, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("text_key") == F.col("s_key")), "left")
    # rows that go, and those that stay once (with their group's root)
    marked = common.store(judged.filter("root is null or n > 1").select(F.col("doc_id").alias(g_id), F.col("text_key").alias(g_key), F.col("root").alias(g_root)), "jaccard_marked")
    same = F.col(f"`{id_col}`").cast("bigint").eqNullSafe(F.col(g_id)) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col(g_key))
    out = docs.join(marked.hint("merge"), same, "left_anti")
    repeated = marked.filter(F.col(g_root).isNotNull())
    if repeated.isEmpty():
        return out
    # grouped by root, not by the join's keys: rows meet after a partial aggregate
    order = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if isinstance(f.dataType, T.AtomicType)])
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    once = docs.join(repeated, same).groupBy(g_root).agg(F.min_by(row, order).alias("r"))
    return out.unionByName(once.select("r.*"))
