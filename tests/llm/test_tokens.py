"""Operators 6 and 4 against the libraries, and exact round trips."""

import hashlib
import random
import weakref
import zlib

import numpy as np
import pytest
import public_tokenizers
import regex
import tiktoken

from llm.conftest import MESSY, as_rows
from navframe.llm import bitplane, bpe, common, pretoken

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LIBRARY = public_tokenizers.path("byte_bpe_50k.json")
ODD = list("abetrsmdlv'’ .!1\n\t é½") + ["\U00013470", "\U000105d0", "中", "\x85", "\x1c", " ", "😀", "́"]


def _texts(seed, n, most):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randrange(most))) for _ in range(n)]


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_token_starts_are_the_patterns():
    pattern = regex.compile(public_tokenizers.PATTERN)
    known = [c for c in ODD if not pretoken.unassigned_table()[ord(c)]]
    rng = random.Random(1)
    for _ in range(400):
        texts = ["".join(rng.choice(known) for _ in range(rng.randrange(1, 30))) for _ in range(5)]
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        begins = np.cumsum([0, *map(len, texts)])[:-1]
        starts = pretoken.token_starts(codes, begins)
        assert [joined[a:b] for a, b in zip(starts, [*starts[1:], len(joined)])] == [m for t in texts for m in pattern.findall(t)]


def test_prefix_products_equal_a_plain_scan():
    symbols, product, act = pretoken.monoid()
    kinds = np.array([random.Random(2).randrange(pretoken.N_CLASSES) for _ in range(10_000)])
    state, want = pretoken.BEGIN, []
    for k in kinds:
        state = pretoken.next_state(state, int(k))
        want.append(state)
    assert act[pretoken.prefix_products(symbols[kinds], product)].tolist() == want


def test_encoding_is_the_librarys(encoding):
    vocab = bpe.vocabulary(RANKS)
    texts = [*_texts(3, 400, 90), *_texts(4, 3, 5000), "", "a" * 3000, " " * 700, "'" * 300]
    for text, ids in zip(texts, bpe.encode_chunk(texts, vocab.cache)):
        assert ids.tolist() == encoding.encode_ordinary(text)
        assert vocab.decode(ids) == text.encode()


def test_small_cache_changes_nothing(encoding):
    vocab = bpe.vocabulary(RANKS)
    cache = bpe.SliceCache(vocab.cache.encode, most=4)
    texts = _texts(5, 60, 40)
    for k in range(0, 60, 7):
        for text, ids in zip(texts[k : k + 7], bpe.encode_chunk(texts[k : k + 7], cache)):
            assert ids.tolist() == encoding.encode_ordinary(text)


def test_encode_and_decode_rows(messy, nothing, encoding):
    encoded = bpe.encode(messy, RANKS, offsets=True)
    want = []
    for i, text in MESSY:
        ids = encoding.encode_ordinary(text or "")
        want.append((i, len(ids), bytearray(np.array(ids, dtype="<u4").tobytes())))
    assert as_rows(encoded, "doc_id", "n_tokens", "ids") == sorted(want, key=repr)
    for r in encoded.collect():
        assert len(r["token_ends"]) == r["n_tokens"]
    decoded = bpe.decode(encoded, RANKS)
    assert as_rows(decoded, "doc_id", "decoded") == sorted(((i, bytearray((t or "").encode())) for i, t in MESSY), key=repr)
    assert bpe.decode(bpe.encode(nothing, RANKS), RANKS).count() == 0


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("n", [0, 1, 8, 100, 1000])
def test_plane_files_round_trip(bits, n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 2**32, n, dtype=np.uint32)
    ends = np.sort(rng.integers(0, n + 1, 5)) if n else np.zeros(0, dtype=np.int64)
    data = bitplane.write_file(ids, ends, block_ids=64, bits=bits)
    back, back_ends = bitplane.read_file(data)
    assert back.tolist() == ids.tolist() and back_ends.tolist() == ends.tolist()
    if n == 1000:  # some blocks alone, by the chunk index
        assert bitplane.read_file(data, 3, 5)[0].tolist() == ids[192:320].tolist()
    with pytest.raises(ValueError):
        bitplane.read_file(data[:-1])


@pytest.mark.parametrize("options", [{}, {"parts": 3, "block_ids": 128, "file_ids": 1000, "bits": True}])
def test_token_files(messy, options):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(LIBRARY)
    library.encode_special_tokens = True
    files = bitplane.write_tokens(messy, LIBRARY, **options)
    got = as_rows(bitplane.read_tokens(files), "doc_id", "start", "n_tokens", "ids")
    rows = [(i, library.encode(t or "", add_special_tokens=False).ids + [bitplane.END_ID]) for i, t in MESSY]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, len(r[1]), np.array(r[1], dtype="<u2").tobytes()))
    want, at = [], 0
    for i, ids in rows:
        want.append((i, at, len(ids), bytearray(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    assert got == sorted(want, key=repr)


def test_a_table_of_one_id_is_dealt_to_many_ranges(spark):
    from pyspark.sql import functions as F

    rows = [(7, f"word {i % 3}") for i in range(900)] + [(None, "a b")] * 300 + [(i, "x") for i in (1, 2, 9, 10)]
    files = bitplane.write_tokens(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), LIBRARY, parts=12)
    sizes = [r["n"] for r in files.groupBy("part").agg(F.sum("n_docs").alias("n")).collect()]
    assert len(sizes) >= 8 and max(sizes) <= 0.25 * len(rows)
    got = sorted(((r["start"], r["n_tokens"], r["doc_id"]) for r in bitplane.read_tokens(files).collect()), key=lambda r: r[0])
    assert len(got) == len(rows) and got[0][0] == 0
    assert all(a[0] + a[1] == b[0] for a, b in zip(got, got[1:]))  # no gap, no overlap
    ids = [r[2] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_ranges_of_ids():
    bounds = [3, 7, 7, 7, 9]
    ids = np.array([1, 3, 5, 7, 7, 7, 7, 8, 9, 20])
    assert bitplane._parts(ids, np.arange(10), bounds).tolist() == [0, 1, 1, 2, 3, 4, 2, 4, 5, 5]


def test_library_ids_of_odd_texts():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(LIBRARY)
    library.encode_special_tokens = True
    texts = [*_texts(6, 300, 60), "<|endoftext|>", " the  cat's <|endoftext|>"]
    for text, ids in zip(texts, bitplane.encode_texts(texts, LIBRARY)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_empty_table_gives_no_file(nothing):
    files = bitplane.write_tokens(nothing, LIBRARY)
    assert files.count() == 0 and bitplane.read_tokens(files).count() == 0


def test_queries_against_the_libraries(spark, encoding):
    from conftest import SF001
    from tokenizers import Tokenizer

    from navframe.llm import queries

    docs = spark.read.parquet(f"{SF001}/documents.parquet").orderBy("doc_id").collect()
    got = {r["doc_id"]: r for r in queries.op6_byte_bpe(spark, SF001).collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids = encoding.encode_ordinary(d["text"] or "")
        assert (got[d["doc_id"]]["n_tokens"], got[d["doc_id"]]["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
        assert got[d["doc_id"]]["decoded_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()
    library = Tokenizer.from_file(LIBRARY)
    library.encode_special_tokens = True
    got, at = {r["doc_id"]: r for r in queries.op4_bitplane_tokens(spark, SF001).collect()}, 0
    for d in docs:
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids + [2]
        assert (got[d["doc_id"]]["start"], got[d["doc_id"]]["n_tokens"], got[d["doc_id"]]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)


def test_a_worker_keeps_the_vocabulary_for_tasks_that_use_it():
    first = weakref.ref(common.begun(lambda: bpe.vocabulary(RANKS)))
    assert first() is not None and common.begun(lambda: bpe.vocabulary(RANKS)) is first()
    common.begun(lambda: None)  # a task of another operator
    assert first() is None
