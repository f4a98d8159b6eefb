"""Operators 11, 12 and 13 against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.conftest import MESSY, as_rows
from navframe.llm import centroids, imatch, spelling

# -- 11: I-Match ------------------------------------------------------------------------


def distinct_words(text):
    return set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()))


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def imatch_brute(rows, rare=imatch.RARE, common=imatch.COMMON):
    """The fingerprints of (doc_id, text) rows, as the module's docstring defines them."""
    docs = sorted({(i, t or "") for i, t in rows}, key=lambda d: (d[0] is None, -(d[0] or 0), md5(d[1])))
    texts = {t for _, t in docs}
    df = Counter(w for t in texts for w in distinct_words(t))
    lexicon = {w for w, n in df.items() if n * rare >= len(texts) and n * common <= len(texts)}

    def codes(text):
        words = distinct_words(text)
        level = max(len(words) // imatch.SPREAD, 1).bit_length() - 1
        out = {}
        for up in (level, level + 1):
            slots = [[] for _ in range(min(imatch.SUBSETS, 2**up))]
            for w in sorted(words & lexicon):
                k = int(md5(w)[:8], 16) % 2**up
                if k < imatch.SUBSETS:
                    slots[k].append(w)
            out[up] = [md5(" ".join(s))[:8] if s else "" for s in slots]
        if not any(out[level]):
            return None, "text:" + hashlib.sha256(text.encode()).hexdigest()
        return out, f"{level}:{'.'.join(out[level])}:{'.'.join(out[level + 1])}"

    def near(a, b):
        if a[1] == b[1]:
            return 1.0
        if a[0] is None or b[0] is None:
            return 0.0
        pairs = [(x, y) for level in a[0].keys() & b[0].keys() for x, y in zip(a[0][level], b[0][level]) if x or y]
        return sum(x == y for x, y in pairs) / len(pairs) if pairs else 0.0

    out = {}
    for at, (i, text) in enumerate(docs):
        following = docs[(at + 1) % len(docs)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        own, new, nxt = codes(text), codes(edited), codes(following)
        out[i, text] = (i, len(text), hashlib.sha256(edited.encode()).hexdigest(), own[1], new[1], near(own, new), near(own, nxt))
    return sorted((out[i, t or ""] for i, t in rows), key=repr)


COLUMNS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def prose(seed, n, words=400):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(words)]
    rows = []
    for i in range(n):
        text = " ".join(rng.choices(vocabulary, weights=[1 / (k + 1) for k in range(words)], k=rng.randrange(1, 160)))
        rows.append((rng.randrange(10**6) * 2 + 1, text if i % 9 else rng.choice(rows)[1] if rows else text))
    return rows


def test_fingerprints_equal_brute_force(spark):
    rows = prose(1, 120) + [(None, "a text without an id w3 w9"), (None, None), (2, ""), (2, "x"), (4, None)]
    got = imatch.fingerprint_documents(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5))
    assert as_rows(got, *COLUMNS) == imatch_brute(rows)


def test_fingerprints_of_messy_rows(messy, nothing):
    got = as_rows(imatch.fingerprint_documents(messy), *COLUMNS)
    assert got == imatch_brute(MESSY)
    assert imatch.fingerprint_documents(nothing).collect() == []


def test_a_sole_document_follows_itself(spark):
    got = imatch.fingerprint_documents(spark.createDataFrame([("k", "one two three")], "doc_id string, text string")).collect()
    assert got[0].near_next == 1.0 and got[0].n_chars == 13  # any id that can be ordered


@pytest.mark.parametrize("range_rows", [1, 7, 10**6])
def test_next_documents_across_ranges(spark, range_rows):
    rows = [(i * i % 101, f"t{i % 40}") for i in range(150)]
    links = imatch.next_documents(imatch._keyed(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text"), range_rows).collect()
    uid = {r.uid: r for r in links}
    assert len(uid) == len(links) == len(set(rows))
    order = sorted(set(rows), key=lambda d: (-d[0], md5(d[1])))
    name = lambda d: md5(f"{d[0]}:{md5(d[1])}")
    assert all(uid[name(d)].next_uid == name(e) for d, e in zip(order, order[1:] + order[:1]))
    assert sum(r.first for r in links) == len({t for _, t in rows})


def test_fingerprints_use_no_python(spark, messy):
    plan = imatch.fingerprint_documents(messy)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


# -- 12: spelling variants ----------------------------------------------------------------


def edited(doc_id, run):
    word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    at = h % len(word)
    return word[:at] + word[at + 1 :] if h % 31 == 0 else word


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelling_brute(rows):
    counts = Counter()
    for i, t in rows:
        counts.update(edited("" if i is None else i, r) for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""))
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: [v for v in counts if abs(len(v) - len(w)) <= 1 and one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), counts[w], len(near[w]), counts[form[w]] if form[w] else None) for w in counts)


def misspelt(seed, n_docs):
    rng = random.Random(seed)
    stems = ["calculation", "Zürichberg", "mountains", "aaaaaaa", "abababab", "ÀÉÎõüÿz", "x" * 70, "y" * 300]
    rows = []
    for i in range(n_docs):
        words = []
        for _ in range(60):
            w = rng.choice(stems)
            for _ in range(rng.choice([0, 0, 0, 0, 0, 0, 0, 0, 1, 1, 2, 3])):
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abzéÿ") + w[at:], w[:at] + rng.choice("abzéÿ") + w[at + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 and w.isascii() else w)
        rows.append((i * 7, rng.choice([" ", "1", "\n"]).join(words)))
    return rows


SPELLED = ("word", "form", "root", "n", "n_near", "form_n")


@pytest.mark.parametrize("filter_bytes", [spelling.FILTER_BYTES, 1])
def test_variants_equal_brute_force(spark, monkeypatch, filter_bytes):
    if filter_bytes == 1:  # many segments, one broadcast each
        monkeypatch.setattr(spelling, "SEGMENT_BLOCKS", 2)
        monkeypatch.setattr(spelling, "PROBED", 500)
    rows = misspelt(3, 120 if filter_bytes > 1 else 30)
    got = spelling.variants(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), filter_bytes=filter_bytes)
    want = spelling_brute(rows)
    assert as_rows(got, *SPELLED) == sorted(want, key=repr)
    assert any(w[1] for w in want)
    assert filter_bytes == 1 or any(w[1] != w[2] for w in want if w[1])  # a chain of forms


def test_variants_of_messy_rows(messy, nothing):
    assert as_rows(spelling.variants(messy), *SPELLED) == sorted(spelling_brute(MESSY), key=repr)
    assert spelling.variants(nothing).collect() == []


def test_edit_hashes_are_those_of_the_edits():
    import pyarrow as pa

    from navframe.llm import common

    words = ["aabbccd", "zürich", "ÿ" * 9, "m"]
    codes, starts, ends = spelling.code_points(pa.array(words))
    edits = spelling.Edits(codes, starts, ends)

    def hashes(made):
        return common.char_hashes(*spelling.code_points(pa.array(made)))

    every = np.flatnonzero((ends - starts)[edits.word] > 1)
    where = [(words[edits.word[i]], int(edits.place[i])) for i in every]
    for lane in (0, 1):
        assert (edits.deletion(lane, every) == hashes([w[:i] + w[i + 1 :] for w, i in where])[lane]).all()
        assert (edits.replacement(lane, every, ord("q")) == hashes([w[:i] + "q" + w[i + 1 :] for w, i in where])[lane]).all()
    assert [int(edits.place[i]) for i in edits.deleted() if edits.word[i] == 0] == [0, 2, 4, 6]


@pytest.mark.parametrize("most", [1, 3, 1000])
def test_passes_cover_every_segment_once(monkeypatch, most):
    monkeypatch.setattr(spelling, "SEGMENT_BLOCKS", 4)
    blocks = {7: 1, 8: 23, 9: 4, 64: 9}
    passes = list(spelling._passes(blocks, most * 4 * 64))
    held = Counter((s, i) for wave in passes for s, low, high in wave for i in range(low, high))
    assert held == Counter((s, i) for s, b in blocks.items() for i in range(math.ceil(b / 4)))
    assert all(sum(high - low for _, low, high in wave) <= max(most, 1) + 3 for wave in passes)


def test_the_filter_loses_nothing_and_passes_little():
    rng = np.random.default_rng(5)
    h = rng.integers(0, 2**63, 40_000).astype(np.uint64) * np.uint64(2)
    blocks = {8: spelling.n_blocks(len(h))}
    block = spelling._block(h, np.full(len(h), blocks[8])).astype(np.int64)
    bits = np.zeros(blocks[8] * spelling.BLOCK, dtype=np.uint64)
    for probe in range(spelling.PROBES):
        at, bit = spelling._bits(h, probe)
        np.bitwise_or.at(bits, block * spelling.BLOCK + at, bit)
    filters = spelling.Filters([(8, i, bits[i * spelling.SEGMENT_BLOCKS * spelling.BLOCK :][: spelling.SEGMENT_BLOCKS * spelling.BLOCK].tobytes()) for i in range(math.ceil(blocks[8] / spelling.SEGMENT_BLOCKS))], blocks)
    shard = np.full(len(h), 8)
    assert len(filters.probe(h, shard)) == len(h)
    assert len(filters.probe(h + np.uint64(1), shard)) < 0.005 * len(h)


# -- 13: centroid clustering --------------------------------------------------------------


def clusters_brute(rows, k=40, rounds=5, dim=64):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(256 * float(x)) for x in v]))
    seeds = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    places = [v for _, v in seeds]
    if not places:
        return []

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(places)) for _, v in kept]

    for _ in range(rounds):
        owners = assign()
        for j in range(len(places)):
            mine = [v for (_, v), (_, o) in zip(kept, owners) if o == j]
            if mine:
                places[j] = [sum(col) // len(mine) for col in zip(*mine)]
    owners = assign()
    inertia = Counter()
    for d, j in owners:
        inertia[j] += d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in places]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), names[j]) for (i, _), (d, j) in zip(kept, owners)), key=repr)


CLUSTERED = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def vectors(seed, n, spread):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(12, 64))
    made = middles[rng.integers(0, 12, n)] + spread * rng.normal(size=(n, 64))
    return [(i * 3, [float(np.float32(x)) for x in v]) for i, v in enumerate(made)]


ODD = [
    (1, None), (None, [0.5] * 64), (4, [0.0] * 63), (5, [0.0] * 65), (7, [0.0] * 63 + [None]), (8, [0.0] * 63 + [math.nan]),
    (10, [math.inf] + [0.0] * 63), (11, [0.0] * 64), (11, [0.0] * 64), (11, [0.25] * 64), (13, [0.0] * 64), (14, []),
]


@pytest.mark.parametrize(("n", "spread"), [(300, 0.05), (300, 1.0), (20, 0.3), (0, 1.0)])
def test_clusters_equal_brute_force(spark, n, spread):
    rows = vectors(n, n, spread) + ODD
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumns({"cluster": F.lit("x"), "v": F.lit(1), "near": F.lit(2)}).repartition(4)
    assert as_rows(centroids.with_inertia(*centroids.cluster(df)), *CLUSTERED) == clusters_brute(rows)


def test_clusters_of_nothing(spark):
    for rows in ([], [(None, [0.0] * 64)], [(3, None)]):
        df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
        assert centroids.with_inertia(*centroids.cluster(df)).collect() == []


def test_components_beyond_the_exact_range_stop_the_job(spark):
    df = spark.createDataFrame([(1, [1e9] + [0.0] * 63), (2, [0.0] * 64)], "vec_id bigint, embedding array<float>")
    with pytest.raises(Exception, match="after scaling"):
        centroids.cluster(df)


def test_bounds_never_exceed_distances_and_prune_clustered_vectors():
    for spread in (0.01, 0.3, 2.0):
        v = np.floor(256 * np.array([x for _, x in vectors(7, 2000, spread)])).astype(np.int64)
        c = v[:40]
        pivots = centroids.Pivots(c)
        low = pivots.bounds(pivots.distances(v), pivots.distances(c))
        exact = centroids.squared(v, c)
        assert (low <= exact).all()
        best, dist, computed = centroids.nearest(v, pivots.distances(v), pivots, c)
        assert (best == exact.argmin(axis=1)).all() and (dist == exact.min(axis=1)).all()
        if spread == 0.01:  # far fewer than all 40 distances a vector
            assert computed < 0.35 * exact.size
