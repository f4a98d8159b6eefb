"""Operators 1, 3, 7, 9, 10 and the components against brute force."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.conftest import MESSY, as_rows
from navframe.llm import common, graph, ngram_jaccard, quality, repeats, resampling, transcripts

SPACE = r"[^\x20\x09-\x0D]+"


def lower(text):
    return (text or "").encode().lower().decode()


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string")


# -- 1: n-gram Jaccard join -------------------------------------------------------------


def shingle_set(text, n):
    w = re.findall(SPACE, lower(text))
    return frozenset(tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))) if w else frozenset()


def components_of(sets, ids, num, den):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(sets)), 2):
        if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = defaultdict(list)
    for i in range(len(sets)):
        least[find(i)].append(ids[i])
    return [min((x for x in least[find(i)] if x is not None), default=None) for i in range(len(sets))]


def near_copies(seed, n_groups, size, edits):
    """Groups of edited copies of a text, and copies of copies."""
    rng = random.Random(seed)
    rows = []
    for g in range(n_groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(4, 120))]
        for _ in range(rng.randrange(1, size)):
            copy = list(base)
            for _ in range(rng.randrange(edits)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(copy))
            if rng.random() < 0.3:
                base = copy
            if rng.random() < 0.2:
                rows.append(rng.choice(rows).upper())
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80), (1, 80)])
def test_components_are_exact(spark, n, num):
    texts = near_copies(num + n, 14, 9, 5)
    rows = [(i * 3 % 1009, t, "h") for i, t in enumerate(texts)]
    rows += [(5000, None, "h"), (5001, "", "h"), (5002, " \n", "h"), (5003, "one", "h"), (5004, "ONE", "h")]
    sets = [shingle_set(t, n) for _, t, _ in rows]
    want = components_of(sets, [i for i, _, _ in rows], num, 100)
    got = as_rows(ngram_jaccard.similar(table(spark, rows), n, num, 100), "doc_id", "n_shingles", "component_id")
    assert got == sorted(((r[0], len(s), c) for r, s, c in zip(rows, sets, want)), key=repr)


@pytest.mark.parametrize(("num", "den"), [(90, 100), (80, 100), (95, 100), (70, 100)])
def test_similar_sets_share_enough_signatures(num, den):
    rng = np.random.default_rng(num)
    bands = ngram_jaccard.Bands(num, den)
    for _ in range(250):
        size = int(rng.integers(1, 400))
        a = rng.integers(0, 2**63, size).astype(np.uint64)
        gone, new = rng.integers(0, max(1, size * (den - num) // den) + 1, 2)
        b = np.concatenate([a[gone:], rng.integers(0, 2**63, new).astype(np.uint64)])
        a, b = np.unique(a), np.unique(b)
        common = len(np.intersect1d(a, b))
        if len(b) and den * common >= num * (len(a) + len(b) - common) and not np.array_equal(a, b):
            shared = np.intersect1d(ngram_jaccard.signatures(a, bands), ngram_jaccard.signatures(b, bands)).size
            assert shared >= min(ngram_jaccard.needed(a, bands), ngram_jaccard.needed(b, bands)) >= 1


@pytest.mark.parametrize("hot", [1, 3, 32])
def test_packed_buckets_lose_no_pair(monkeypatch, hot):
    import pyarrow as pa

    monkeypatch.setattr(ngram_jaccard, "HOT_IN_BATCH", hot)
    rng = np.random.default_rng(hot)
    ids = np.arange(1, 40, dtype=np.uint64) * np.uint64(10**15)
    signs = [np.unique(rng.integers(0, 30, 4)).astype(np.uint64) << np.uint64(30) for _ in ids]
    packed = defaultdict(list)
    for part in (slice(0, 20), slice(20, 39)):  # two batches
        for row in ngram_jaccard._pack(ids[part], signs[part], 3):
            packed[row[0]].append(row)
    pairs, sets = set(), defaultdict(set)
    for rows in packed.values():
        met = ngram_jaccard._meet(pa.table(dict(zip(("bucket", "sigs", "numbers", "ids", "set"), map(list, zip(*rows)))), schema=pa.schema([("bucket", pa.int32()), ("sigs", pa.binary()), ("numbers", pa.binary()), ("ids", pa.binary()), ("set", pa.int64())])))
        for a, b, s, m in zip(met["a"], met["b"], met["set"], met["members"]):
            if s is None:
                pairs.add(frozenset((a, b)))
            else:
                sets[s].update(m)
    for (i, a), (j, b) in itertools.combinations(enumerate(signs), 2):
        if np.intersect1d(a, b).size:
            both = {int(ids[i]), int(ids[j])}
            assert frozenset(both) in pairs or any(both <= s for s in sets.values())


def test_large_groups_of_far_copies_are_split(spark):
    """Copies that are similar to the original alone: no member is near another."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base)]
    for _ in range(70):
        copy = list(base)
        for k in rng.sample(range(200), 3):
            copy[k] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(i, texts[k], "h") for i, k in enumerate(order)]
    sets = [shingle_set(t, 3) for _, t, _ in rows]
    want = components_of(sets, [r[0] for r in rows], 90, 100)
    assert len(set(want)) == 1
    assert as_rows(ngram_jaccard.similar(table(spark, rows)), "doc_id", "component_id") == sorted(((r[0], c) for r, c in zip(rows, want)), key=repr)


def test_blocks_find_the_links_between_components(spark):
    bands = ngram_jaccard.Bands(80, 100)
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**62), 2**62, 60)
    rows = [(c, np.unique(np.concatenate([base[k:], rng.integers(-(2**62), 2**62, k)])).tolist()) for c, k in enumerate(rng.integers(0, 9, 25).tolist())]
    sets = spark.createDataFrame(rows, "class bigint, elements array<bigint>")
    roots = {c: 0 if c < 8 else c for c in range(25)}  # the first eight are one component
    members = spark.createDataFrame([(s, c, roots[c]) for s in (1, 2) for c in range(25) if c % 2 == s - 1 or c < 3], "set bigint, class bigint, root bigint")
    want = {frozenset((i, j)) for (i, a), (j, b) in itertools.combinations(rows, 2) if roots[i] != roots[j] and 100 * len({*a} & {*b}) >= 80 * len({*a} | {*b})}
    for block in (4, 256):
        got = {frozenset(r) for r in ngram_jaccard._links_in_large_sets(members, sets, bands, block).collect()}
        assert got == want


def test_dealt_rows_of_large_sets_are_never_broadcast(spark):
    """A class is dealt to its tasks after its set has joined, above a shuffle join."""
    sets = common.store(spark.range(40).select(F.col("id").alias("class"), F.array("id", F.lit(-1)).alias("elements")), "test_sets")
    members = spark.range(40).select(F.lit(1).cast("bigint").alias("set"), F.col("id").alias("class"), F.col("id").alias("root"))
    links = ngram_jaccard._links_in_large_sets(members, sets, ngram_jaccard.Bands(80, 100), 4)
    plan = links._jdf.queryExecution().sparkPlan().toString().splitlines()
    dealt = next(i for i, line in enumerate(plan) if "Generate explode" in line)
    joins = [i for i, line in enumerate(plan) if "Join " in line]
    assert min(joins) > dealt and "SortMergeJoin [class#" in plan[min(joins)]


def test_shared_sizes():
    rng = random.Random(2)
    sides = [[sorted(rng.sample(range(-50, 50), rng.randrange(1, 40))) for _ in range(n)] for n in (7, 11)]
    got = ngram_jaccard.shared_sizes(*[[np.array(e) for e in side] for side in sides], chunk=16)
    assert got.tolist() == [[len({*a} & {*b}) for b in sides[1]] for a in sides[0]]


def test_join_of_messy_rows(messy, nothing):
    got = as_rows(ngram_jaccard.similar(messy), "doc_id", "n_shingles", "component_id")
    sets = [shingle_set(t, 3) for _, t in MESSY]
    want = components_of(sets, [i for i, _ in MESSY], 90, 100)
    assert got == sorted(((i, len(s), c) for (i, _), s, c in zip(MESSY, sets, want)), key=repr)
    assert ngram_jaccard.similar(nothing).count() == 0
    one = ngram_jaccard.one_of_each(messy)
    assert one.columns == messy.columns
    ids = Counter(r["doc_id"] for r in one.collect())
    assert 6 not in ids and ids[5] == 1 and ids[8] >= 1 and {1, 2, 3, 4, 9, 10, None} <= set(ids)


def test_one_row_of_each_group(spark, messy, nothing):
    ids = Counter(r["doc_id"] for r in ngram_jaccard.one_of_each(messy).collect())
    assert ids == Counter([None, 1, 2, 3, 4, 5, 7, 8, 8, 9, 10])
    base = [f"w{k}" for k in range(60)]
    near = [" ".join(base[:k]) for k in (60, 59, 58)]
    far = " ".join(f"v{k}" for k in range(30))
    rows = [(20, near[0], "a"), (20, near[1], "b"), (20, near[1], "b"), (21, near[2], "c")]  # copies under one id
    rows += [(None, far, "a"), (None, far, "a"), (None, far + " v30", "b")]  # no ids at all
    rows += [(30, "x y z u v w", "a"), (30, "x y z u v w", "b"), (30, "x y z u v w", "b")]  # one id and text, other hosts
    rows += [(None, "p q r s t u", "a"), (40, "p q r s t u", "a"), (40, "p q r s t u", "a")]  # the id that is there
    rows += [(50, None, "a"), (50, None, "a")]
    docs = table(spark, rows)
    one = ngram_jaccard.one_of_each(docs)
    assert one.columns == docs.columns
    left = [tuple(r) for r in one.collect()]
    assert not Counter(left) - Counter(rows)
    assert sorted((r[1] or "").split(" ")[0] for r in left) == ["", "", "p", "v0", "w0", "x"]
    assert sorted((r[0] for r in left if r[0]), key=repr) == [20, 30, 40, 50, 50]
    assert ngram_jaccard.one_of_each(nothing).count() == 0


def test_graph_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 200 + i) for i in range(1, 30)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert graph.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


# -- 7: quality rules -----------------------------------------------------------------


def judged(rows, max_texts, min_left):
    lines = defaultdict(set)
    first = {}
    split = lambda t: [x for x in (t or "").split("\n") if re.search(SPACE, x)]
    norm = lambda x: " ".join(re.findall(SPACE, lower(x)))
    for i, t, host in rows:
        for x in split(t):
            key = host, norm(x)
            lines[key].add(t)
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t, host in rows:
        words = re.findall(SPACE, t or "")
        windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        repeat = {k + o for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for o in range(5)}
        lost = sum(len(x.split()) for x in split(t) if len(lines[host, norm(x)]) > max_texts and first.get((host, norm(x))) != i)
        failed = len(words) < 10 or 100 * len(repeat) > 20 * len(words)
        out.append((i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(split(t)) - len(set(split(t))), len(repeat), lost, failed, not failed and len(words) - lost >= min_left * len(words)))
    return sorted(out, key=repr)


def test_quality_rules(spark, messy, nothing):
    rng = random.Random(5)
    lines = ["Buy now # 100% | here", "subscribe to our LETTER today", "subscribe  to our letter TODAY", "ünïcode line of words"]
    rows = []
    for i in range(120):
        own = [" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(14))) for _ in range(rng.randrange(3))]
        text = "\n".join(rng.sample([*own, *rng.choices(lines, k=rng.randrange(4))], k=None or 0) or [*own, *rng.choices(lines, k=3)])
        rows.append((i, text, rng.choice(["a", "b", None])))
    rows += [(200, None, "a"), (201, "", "a"), (None, "\n".join(lines * 2), "a"), rows[3], rows[3], (300, rows[4][1], rows[4][2])]
    columns = ["doc_id", *quality.COUNTS, "n_line_words", "base_failed", "kept"]
    for max_texts in (2, 10):
        assert as_rows(quality.judge(table(spark, rows), max_texts=max_texts), *columns) == judged(rows, max_texts, quality.MIN_LEFT)
    assert as_rows(quality.judge(messy), *columns) == judged([(i, t, "h") for i, t in MESSY], quality.MAX_TEXTS, quality.MIN_LEFT)
    assert quality.judge(nothing).count() == 0
    kept = quality.keep_good(messy)
    assert kept.columns == messy.columns
    good = Counter(r[0] for r in judged([(i, t, "h") for i, t in MESSY], quality.MAX_TEXTS, quality.MIN_LEFT) if r[-1])
    assert Counter(r["doc_id"] for r in kept.collect()) == good


def test_texts_without_frequent_lines(spark, messy, nothing):
    rng = random.Random(15)
    common_lines = ["Subscribe to OUR letter", "all  rights reserved é"]
    rows = []
    for i in range(40):
        own = [" ".join(f"w{rng.randrange(900)}" for _ in range(rng.randrange(8, 14))) for _ in range(2)]
        lines = [own[0], *rng.sample([*common_lines, common_lines[0].lower(), "", "  "], 3), own[1]]
        rows.append((i, "\n".join(lines), "a" if i % 4 else "b", len("\n".join(lines))))
    rows += [rows[5], (50, None, "a", 0), (None, rows[7][1], "a", rows[7][3])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars int")
    got = quality.clean(docs, max_texts=4)
    assert got.schema == docs.schema
    norm = lambda x: " ".join(re.findall(SPACE, lower(x)))
    held, first = defaultdict(set), {}
    for i, t, host, _ in rows:
        for x in (t or "").split("\n"):
            if norm(x):
                held[host, norm(x)].add(t)
                first[host, norm(x)] = min(i, first.get((host, norm(x)), i)) if i is not None else first.get((host, norm(x)))
    good = Counter(r[0] for r in judged([r[:3] for r in rows], 4, quality.MIN_LEFT) if r[-1])
    want = []
    for i, t, host, _ in rows:
        if i in good:
            gone = lambda x: norm(x) and len(held[host, norm(x)]) > 4 and first[host, norm(x)] != i  # noqa: B023, E731
            kept = "\n".join(x for x in t.split("\n") if not gone(x))
            want.append((i, kept, host, len(kept)))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert any(len(w[1]) < r[3] for w, r in zip(want, rows))
    left = quality.clean(messy)
    assert left.schema == messy.schema and as_rows(left, "doc_id", "text") == as_rows(quality.keep_good(messy), "doc_id", "text")
    assert quality.clean(nothing).count() == 0


# -- 9: repeated substrings -------------------------------------------------------------


def cut(rows, window):
    first = {}
    words = [re.findall(SPACE, t or "") for _, t in rows]
    for (i, _), w in zip(rows, words):
        for k in range(len(w) - window + 1) if i is not None else ():
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = {k + o for k in range(len(w) - window + 1) if i is not None and first[tuple(w[k : k + window])] < i for o in range(window)}
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [2, 6, 50])
def test_repeated_windows(spark, window):
    rng = random.Random(window)
    passages = [" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(window, 3 * window))) for _ in range(6)]
    rows = []
    for i in range(80):
        parts = [rng.choice(passages) if rng.random() < 0.4 else " ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2 * window))) for _ in range(3)]
        rows.append((rng.randrange(200), rng.choice([" ", "\n", "  "]).join(parts)))
    rows += [rows[0], rows[0], (0, rows[1][1]), (199, rows[2][1].replace(" ", "\t")), (None, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert as_rows(repeats.remove_repeats(docs, window=window), "doc_id", "n_words", "n_removed", "kept_sha256") == cut(rows, window)


def test_repeats_of_messy_rows(messy, nothing):
    assert as_rows(repeats.remove_repeats(messy, window=5), "doc_id", "n_words", "n_removed", "kept_sha256") == cut(MESSY, 5)
    assert repeats.remove_repeats(nothing).count() == 0


def test_levels_and_sliding_minimum():
    assert repeats.levels(50) == [25, 50] and repeats.levels(50, 3) == [7, 13, 25, 50]
    x = np.random.default_rng(0).integers(0, 100, 57)
    for width in (1, 2, 3, 8, 26, 57, 58):
        assert repeats.sliding_min(x, width).tolist() == [min(x[i : i + width]) for i in range(len(x) - width + 1)]


# -- 10: importance resampling ------------------------------------------------------------


def test_kth_largest(spark):
    rng = random.Random(6)
    values = [rng.choice([rng.gauss(0, 1e3), 0.0, 1.5, -1.5, rng.gauss(0, 1e-9)]) for _ in range(300)]
    keys = spark.createDataFrame([(v,) for v in values], "k double")
    for k in (1, 2, 100, 150, 299, 300):
        assert resampling.kth_largest(keys, "k", k) == sorted(values, reverse=True)[k - 1]
    assert resampling.kth_largest(keys, "k", 301) is None and resampling.kth_largest(keys, "k", 0) is None


def test_weights_are_the_models_and_part_held_out_documents(spark):
    from conftest import SF01

    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    got = {r["doc_id"]: r for r in resampling.resample(docs, labels, good, most=100).collect()}
    used = {r["t_id"] for r in resampling.target_ids(labels, good, most=100).collect()}
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    raw = np.zeros(resampling.BUCKETS)
    hits = np.zeros(resampling.BUCKETS)
    for i, t in texts.items():
        f = np.bincount(resampling.features(t), minlength=resampling.BUCKETS)
        raw += f
        hits += f * (i in used)
    ratio = np.log((hits + 1) / (hits.sum() + len(hits))) - np.log((raw + 1) / (raw.sum() + len(raw)))
    for i, t in texts.items():
        assert math.isclose(got[i]["log_weight"], ratio[resampling.features(t)].sum(), rel_tol=1e-9, abs_tol=1e-7)
    n_kept = sum(r["kept"] for r in got.values())
    share = labels.agg(F.avg(good.cast("double"))).first()[0]
    assert n_kept == round(share * len(texts))
    assert min(r["sample_key"] for r in got.values() if r["kept"]) >= max(r["sample_key"] for r in got.values() if not r["kept"])


def test_weights_part_held_out_documents(spark):
    from conftest import SF01

    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    train = labels.filter("doc_id % 2 = 0")
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    got = {r["doc_id"]: r for r in resampling.resample(docs, train, good, keep=F.col("quality") == 1).collect()}
    held_out = [(r["quality"], got[r["doc_id"]]) for r in labels.filter("doc_id % 2 = 1 and toxic = 0").collect()]
    pairs = [a["log_weight"] > b["log_weight"] for p, a in held_out for q, b in held_out if p > q]
    assert sum(pairs) / len(pairs) > 0.75  # area under the curve
    clean = [r["kept"] for q, r in held_out if q]
    assert sum(clean) / len(clean) > 0.85


def test_query_catches_held_out_toxic_documents(spark, monkeypatch):
    from navframe.llm import queries

    read = lambda spark, sf_dir, name: spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet")
    half = lambda spark, sf_dir, name: read(spark, sf_dir, name).filter("doc_id % 2 = 0") if name == "labels" else read(spark, sf_dir, name)
    monkeypatch.setattr(queries, "table", half)
    kept = {r["doc_id"]: r["kept"] for r in queries.op10_importance_resampling(spark, "").select("doc_id", "kept").collect()}
    held_out = read(spark, "", "labels").filter("doc_id % 2 = 1 and quality = 1").collect()
    caught = [not kept[r["doc_id"]] for r in held_out if r["toxic"]]
    clean = [kept[r["doc_id"]] for r in held_out if not r["toxic"]]
    print(f"toxic caught {sum(caught) / len(caught):.3f} of {len(caught)}, clean kept {sum(clean) / len(clean):.3f} of {len(clean)}")
    assert sum(caught) / len(caught) > 0.25
    assert sum(clean) / len(clean) > 0.85


def test_resampling_of_messy_rows(spark, messy, nothing):
    labels = spark.createDataFrame([(5, 1), (4, 0), (None, 1), (4, None)], "doc_id bigint, quality int")
    good = F.col("quality") == 1
    rows = resampling.resample(messy, labels, good, share=0.5).collect()
    assert len(rows) == len(MESSY)
    assert {r["log_weight"] for r in rows if r["n_features"] == 0} == {0.0}
    assert len({r["kept"] for r in rows if r["doc_id"] == 7}) == 1
    assert all(r["kept"] for r in resampling.resample(messy, labels.limit(0), good).collect())
    assert resampling.resample(nothing, labels, good).count() == 0
    assert not any(r["kept"] for r in resampling.resample(messy, labels, good, share=0.0).collect())


# -- 3: transcripts -----------------------------------------------------------------------


def small_model():
    rng = np.random.default_rng(1)
    return transcripts.Model(rng.integers(0, 9, (7, 7)).astype(float), rng.integers(0, 9, (7, transcripts.N_SYMBOLS)).astype(float))


def test_viterbi_path_is_the_best():
    model = small_model()
    rng = random.Random(2)
    for _ in range(30):
        matrices = [model.line(rng.randrange(transcripts.N_SYMBOLS)) for _ in range(rng.randrange(1, 6))]
        score = lambda states, matrices=matrices: sum(m[a, b] for m, a, b in zip(matrices, [transcripts.BEGIN, *states], states))
        best = max(score(s) for s in itertools.product(range(6), repeat=len(matrices)))
        found = transcripts.path(matrices, transcripts.BEGIN, None)
        assert math.isclose(score(found), best)
        assert math.isclose(transcripts.product(matrices)[transcripts.BEGIN].max(), best)


def test_markers():
    assert transcripts.split_marker("Human: hello") == (1, "hello")
    assert transcripts.split_marker("[system] be kind") == (0, "be kind")
    assert transcripts.split_marker("**Assistant**: yes") == (2, "yes")
    assert transcripts.split_marker("A: yes") == (2, "yes")
    assert transcripts.split_marker("Note: this is no speaker") == (None, "Note: this is no speaker")
    assert transcripts.split_marker("") == (None, "")


def test_turns_of_a_marked_transcript(spark):
    text = "System: be kind\nUser: what is\nthe time?\nAssistant: noon\nor later\nHuman: thanks"
    labelled = spark.createDataFrame([(c, t, r, x) for c in range(20) for t, (r, x) in enumerate([("system", "System: be kind"), ("user", "User: a\nb c?"), ("assistant", "AI: noon\nor"), ("user", "Human: ok")])], "conv_id bigint, turn bigint, role string, text string")
    model = transcripts.train(labelled)
    docs = spark.createDataFrame([(1, 0, text), (None, None, text), (2, 5, None), (1, 0, text)], "conv_id bigint, turn bigint, text string")
    for block in (2, 64):
        got = as_rows(transcripts.parse(docs, model, block=block), "conv", "turn_no", "role", "text")
        one = [(0, "system", "be kind"), (1, "user", "what is\nthe time?"), (2, "assistant", "noon\nor later"), (3, "user", "thanks")]
        assert [r for r in got if r[0] != 2] == sorted([(c, *r) for c in (1, None) for r in one], key=repr)
        assert sum(r[0] == 2 for r in got) == 1
    assert transcripts.parse(docs.limit(0), model).count() == 0
    rendered = transcripts.parse(docs, model).filter("conv = 1 and turn_no = 3").collect()[0]["rendered"]
    assert rendered == "<|user|>\nthanks<|end|>\n"


def test_blocks_change_nothing_and_held_out_roles_are_recovered(spark):
    from conftest import SF01

    raw = transcripts.raw_transcript(spark.read.parquet(f"{SF01}/conversations.parquet"))
    model = transcripts.train(raw.filter("conv_id % 2 = 0"), raw_col="raw")
    held_out = raw.filter("conv_id % 2 = 1")
    columns = ("conv", "turn_no", "role", "n_lines", "text")
    whole = as_rows(transcripts.parse(held_out, model, text_col="raw"), *columns)
    assert whole == as_rows(transcripts.parse(held_out, model, text_col="raw", block=2), *columns)
    lines = Counter()
    for r in held_out.collect():
        lines[r["conv_id"], r["role"]] += len(r["text"].split("\n"))
    found = Counter()
    for conv, _, role, n, _ in whole:
        found[conv, role] += n
    assert sum((lines & found).values()) / sum(lines.values()) > 0.9


def test_blocks_hold_a_bounded_number_of_rows(spark, monkeypatch):
    rng = random.Random(8)
    words = ("what is it?", "yes", "Human: why", "AI: so", "[system] be kind", "a\nb")
    rows = [(None, rng.choice([None, *range(20)]), f"{rng.choice(words)} {k}") for k in range(3000)] + [(1, 0, f"Q: {k}") for k in range(500)] + [(2, k, f"A: {k}") for k in range(70)]
    docs = spark.createDataFrame(rows, "conv_id bigint, turn bigint, text string")
    most = []
    by_group = transcripts.by_group

    def counted(df, keys, *args):
        most.append(df.groupBy(*keys).count().agg(F.max("count")).first()[0])
        return by_group(df, keys, *args)

    monkeypatch.setattr(transcripts, "by_group", counted)
    model = small_model()
    got = as_rows(transcripts.parse(docs, model), "conv", "turn_no", "role", "n_lines", "text")
    assert max(most) <= transcripts.BLOCK
    want = []
    for conv in (None, 1, 2):
        order = sorted({(t is not None, t or 0, x) for c, t, x in rows if c == conv})
        lines = [line for *_, x in order for line in x.split("\n")]
        turn = -1
        for state, line in zip(transcripts.path([model.line(transcripts.symbol(x)) for x in lines], transcripts.BEGIN, None), lines):
            if state % 2 == 0:
                turn += 1
                want.append([conv, turn, transcripts.ROLES[state // 2], []])
            want[-1][3].append(line if state % 2 else transcripts.split_marker(line)[1])
    assert got == sorted(((c, t, r, len(x), "\n".join(x)) for c, t, r, x in want), key=repr)


def test_steps_of_repeated_turns(spark):
    rng = random.Random(9)
    rows = [(rng.choice([0, 1, None]), rng.choice([0, 1, 2, None]), rng.choice(transcripts.ROLES), rng.choice(["a", "a\nb"])) for _ in range(200)]
    steps = np.zeros((7, 7))
    symbols = np.zeros((7, transcripts.N_SYMBOLS))
    for c, t, role, text in rows:
        r = transcripts.ROLES.index(role)
        came = [2 * transcripts.ROLES.index(y[2]) + ("\n" in y[3]) for y in rows if None not in (c, t, y[1]) and (y[0], y[1] + 1) == (c, t)]
        for s in came or [transcripts.BEGIN]:
            steps[s, 2 * r] += 1
        for k, line in enumerate(text.split("\n")):
            symbols[2 * r + (k > 0), transcripts.symbol(line)] += 1
        steps[2 * r, 2 * r + 1] += "\n" in text
    schema = "conv_id bigint, turn bigint, role string, text string"
    model = transcripts.train(spark.createDataFrame(rows, schema))
    want = transcripts.Model(steps, symbols)
    assert np.allclose(model.steps, want.steps) and np.allclose(model.symbols, want.symbols)
    # 10^10 pairs of neighbouring rows
    hot = spark.range(200_000).select(F.lit(0).alias("conv_id"), (F.col("id") % 2).alias("turn"), F.lit("user").alias("role"), F.lit("a").alias("text"))
    steps = np.zeros((7, 7))
    steps[2, 2], steps[transcripts.BEGIN, 2] = 1e10, 1e5
    assert np.allclose(transcripts.train(hot).steps, transcripts.Model(steps, symbols).steps)


def test_a_long_turn_comes_in_pieces(spark):
    """One conversation without an id, its lines mostly unmarked, beside short ones."""
    from conftest import SF01

    model = transcripts.train(transcripts.raw_transcript(spark.read.parquet(f"{SF01}/conversations.parquet")), raw_col="raw")
    rng = random.Random(12)
    rows = [(None, i, ("User: hello" if i in (0, 400) else " ".join(rng.choice("abcdefgh") for _ in range(9)))) for i in range(900)]
    rows += [(c, i, t) for c in range(3) for i, t in enumerate(["User: hi there", "Assistant: yes\nand more\nof it", "User: bye"])]
    docs = spark.createDataFrame(rows, "conv_id bigint, turn bigint, text string")
    whole = {(r["conv"], r["turn_no"]): r for r in transcripts.parse(docs, model).collect()}
    assert max(r["n_lines"] for r in whole.values()) > 60 and {r["piece"] for r in whole.values()} == {0}
    for block, run in ((4, 2), (64, 3), (64, 4096)):
        pieces = defaultdict(list)
        for r in transcripts.parse(docs, model, block=block, piece=50, run=run).collect():
            assert 0 < r["n_lines"] <= 50
            pieces[r["conv"], r["turn_no"]].append(r)
        assert pieces.keys() == whole.keys()
        for key, parts in pieces.items():
            parts.sort(key=lambda r: r["piece"])
            assert [r["piece"] for r in parts] == list(range(len(parts)))
            assert all(r["n_lines"] == 50 for r in parts[:-1])
            assert "".join(r["rendered"] for r in parts) == whole[key]["rendered"]
            assert "\n".join(r["text"] for r in parts) == whole[key]["text"]


def test_signatures_of_many_buckets_carry_no_dictionary():
    """With more buckets than a document has signatures, an id and the signature travel."""
    rng = np.random.default_rng(5)
    ids = np.arange(1, 301, dtype=np.uint64)
    signs = [rng.integers(0, 1 << 63, 200).astype(np.uint64) for _ in ids]
    for n_buckets in (4, 3000):
        got = set()
        size = 0
        for bucket, sigs, numbers, members, name in ngram_jaccard._pack(ids, signs, n_buckets):
            assert name is None
            size += len(sigs) + len(numbers) + len(members)
            raw, found, hot = ngram_jaccard._unpack(sigs, numbers, members)
            assert not hot.any()
            got |= {(bucket, int(x), int(i)) for x, i in zip(raw, found)}
        assert got == {(int(x) % n_buckets, int(x) >> 32, int(i)) for i, xs in zip(ids, signs) for x in xs}
        assert size <= 12 * 300 * 200


@pytest.mark.parametrize(("num", "den"), [(80, 100), (90, 100)])
def test_sketches_rule_no_link_out(num, den):
    rng = np.random.default_rng(num)
    ruled_out = 0
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 700))).astype(np.uint64))
        kept = a[rng.random(len(a)) < rng.choice([0.5, 0.9, 1.0])]
        b = np.unique(np.concatenate([kept, rng.integers(0, 2**63, int(rng.integers(1, len(a) + 1))).astype(np.uint64)]))
        apart, both = len(np.setxor1d(a, b)), len(a) + len(b)
        bits = ngram_jaccard._differing([ngram_jaccard.sketch(a), ngram_jaccard.sketch(a)], [ngram_jaccard.sketch(b), ngram_jaccard.sketch(a)])
        assert bits[0] <= apart and bits[1] == 0
        ruled_out += (both - bits[0]) * den < (both + bits[0]) * num
    assert ruled_out > 150


def test_sets_of_unlike_texts_do_not_travel(spark, monkeypatch):
    rng = random.Random(4)
    phrases = [" ".join(f"p{i}_{j}" for j in range(12)) for i in range(30)]
    texts = [" ".join([*rng.sample(phrases, 6), *(f"t{t}_{j}" for j in range(8))]) for t in range(150)]
    texts += [f"{t} more" for t in texts[:10]]
    compared, verified = [], ngram_jaccard._verified

    def spied(pairs, sets, bands, *rest):
        compared.extend(pairs.join(sets.select(F.col("class").alias("a"), F.col("elements").alias("x")), "a").join(sets.select(F.col("class").alias("b"), F.col("elements").alias("y")), "b").select(F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))).collect())
        return verified(pairs, sets, bands, *rest)

    monkeypatch.setattr(ngram_jaccard, "_verified", spied)
    got = as_rows(ngram_jaccard.similar(table(spark, [(i, t, "h") for i, t in enumerate(texts)]), 5, 80, 100), "doc_id", "component_id")
    assert got == sorted(((i, i if i < 150 else i - 150) for i in range(160)), key=repr)
    assert len(compared) >= 10 and all(r[0] > 0.6 for r in compared)
