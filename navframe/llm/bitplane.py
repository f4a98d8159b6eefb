"""Token ids in bit-plane or byte-plane files (operator 4).

Every text is encoded with the tokenizers library and gets an end id. Documents
are dealt to ranges of ascending ``doc_id`` of about ``PART_BYTES`` of text (bounds from the id
column alone, so encoding runs once; an id that holds the rows of several ranges is
dealt among them), sorted inside a range and packed into files of about
``file_ids`` ids that end at document borders. A file holds

* fixed-size blocks of ids, each transposed into planes, each plane compressed
  with zstandard;
* the chunk index: for each block its byte position, length of each plane and
  number of ids;
* the document table: the end of each document.

Files are binary values of one row each in a Parquet table in the shared folder,
so any store that Spark can write to holds them and every file is read alone.
The start of a range follows from the sum of the ranges before it (one number
per range), so nothing passes through one task.

Defined results: a null or empty text is the end id alone; null ids come first;
repeated ids are ordered by their token ids within a range; an empty table gives no
file.
"""

from __future__ import annotations

import functools
import itertools
import os
import struct
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navframe.llm import bpe, common, pretoken

MAGIC = b"PLANES01"
BLOCK_IDS = 1 << 16
FILE_IDS = 1 << 20
END_ID = 2
#: distinct slices whose ids a Python worker keeps, and bytes of text handled at once
CACHE_SLICES = 800_000
CHUNK_BYTES = 1 << 20
#: text of a range, about; ranges' worth of rows from which one id is split; and the
#: place of null ids
PART_BYTES, SPLIT, NO_ID = 64 << 20, 3, -(2**63)
#: slices that go to the library as one text
JOINED = 256


# -- one file -----------------------------------------------------------------------


def to_planes(ids: np.ndarray, bits: bool) -> list[np.ndarray]:
    """The ids' four byte planes, or 32 bit planes of eight ids a byte."""
    as_bytes = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    if not bits:
        return [np.ascontiguousarray(as_bytes[:, k]) for k in range(4)]
    as_bits = np.unpackbits(as_bytes, axis=1, bitorder="little")
    return [np.packbits(as_bits[:, k], bitorder="little") for k in range(32)]


def from_planes(planes: list[np.ndarray], n: int, bits: bool) -> np.ndarray:
    if bits:
        as_bits = np.stack([np.unpackbits(p, count=n, bitorder="little") for p in planes], axis=1)
        as_bytes = np.packbits(as_bits, axis=1, bitorder="little")
    else:
        as_bytes = np.stack(planes, axis=1)
    return np.ascontiguousarray(as_bytes).view("<u4").ravel()


def write_file(ids: np.ndarray, doc_ends: np.ndarray, block_ids: int = BLOCK_IDS, bits: bool = False, level: int = 3) -> bytes:
    """Header, blocks, chunk index, document table, footer."""
    import zstandard

    press = zstandard.ZstdCompressor(level=level)
    n_planes = 32 if bits else 4
    out, index, at = [MAGIC], [], len(MAGIC)
    for begin in range(0, len(ids), block_ids):
        block = ids[begin : begin + block_ids]
        planes = [press.compress(p.tobytes()) for p in to_planes(block, bits)]
        index.append(struct.pack(f"<QI{n_planes}I", at, len(block), *map(len, planes)))
        out += planes
        at += sum(map(len, planes))
    table = press.compress(np.diff(doc_ends, prepend=0).astype("<u8").tobytes())
    out += [*index, table, struct.pack("<QIIIIQ", at, len(index), n_planes, block_ids, len(table), len(doc_ends)), MAGIC]
    return b"".join(out)


_FOOTER = struct.calcsize("<QIIIIQ") + len(MAGIC)


def read_file(data: bytes, first_block: int = 0, last_block: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the blocks asked for, ends of all documents), by the chunk index."""
    import zstandard

    if not data.startswith(MAGIC) or not data.endswith(MAGIC):
        raise ValueError("not a plane file")
    at, n_blocks, n_planes, _, n_table, n_docs = struct.unpack_from("<QIIIIQ", data, len(data) - _FOOTER)
    expand = zstandard.ZstdDecompressor()
    entry = struct.calcsize(f"<QI{n_planes}I")
    blocks = []
    for k in range(first_block, n_blocks if last_block is None else last_block):
        place, n, *sizes = struct.unpack_from(f"<QI{n_planes}I", data, at + k * entry)
        planes = []
        for size in sizes:
            planes.append(common.byte_array(expand.decompress(data[place : place + size])))
            place += size
        blocks.append(from_planes(planes, n, n_planes == 32))
    table = at + n_blocks * entry
    lengths = np.frombuffer(expand.decompress(data[table : table + n_table]), dtype="<u8") if n_docs else np.zeros(0, dtype="<u8")
    return np.concatenate(blocks) if blocks else np.zeros(0, dtype="<u4"), np.cumsum(lengths).astype(np.int64)


# -- encoding -------------------------------------------------------------------------


@functools.lru_cache(maxsize=2)
def _library(path: str):
    """The tokenizer and the cache of its results for slices, one per worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text

    def encode(new: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(new, add_special_tokens=False)]

    def encode_slices(new: list[str]) -> list[bytes]:
        """Slices of a space and letters are joined: the pre-tokeniser parts them
        again, and the library says which slice an id is from."""
        plain = [s[0] == " " and s[1:].isalpha() for s in new]
        worded = list(itertools.compress(new, plain))
        other = [s for s, p in zip(new, plain) if not p]
        joined = ["".join(worded[i : i + JOINED]) for i in range(0, len(worded), JOINED)]
        parts = []
        for e in tokenizer.encode_batch(joined, add_special_tokens=False):
            ids, ends = array("i", e.ids).tobytes(), (4 * np.cumsum(np.bincount(e.word_ids))).tolist()
            parts += [ids[a:b] for a, b in zip([0, *ends], ends)]
        from_words, from_other = iter(parts), (array("i", ids).tobytes() for ids in encode(other))
        return [next(from_words if p else from_other) for p in plain]

    return encode, bpe.SliceCache(encode_slices, CACHE_SLICES)


def encode_texts(texts: list[str], path: str) -> list[np.ndarray]:
    """Library ids of each text.

    The library encodes each slice of its pre-tokeniser by itself, so distinct
    slices are encoded once and reused. Texts with code points that are
    unassigned in this Python's Unicode tables go to the library whole.
    """
    encode, cache = _library(path)
    out: list[np.ndarray | None] = [None] * len(texts)
    unassigned = pretoken.unassigned_table()
    joined = "".join(texts)
    if not joined.isascii():
        odd = unassigned[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        if odd.any():
            upto = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            whole = np.unique(np.searchsorted(upto, np.flatnonzero(odd), side="right") - 1).tolist()
            for i, ids in zip(whole, encode([texts[i] for i in whole])):
                out[i] = np.array(ids, dtype=np.int32)
    rest = [i for i in range(len(texts)) if out[i] is None]
    for i, ids in zip(rest, bpe.encode_chunk([texts[i] for i in rest], cache)):
        out[i] = ids
    return out


def _bounds(docs: DataFrame, id_col: str, parts: int) -> list[int]:
    """Ids that cut the table into about equal ranges, null ids as the smallest; reads
    the id column only. An id with the rows of several ranges comes several times."""
    ids = F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(NO_ID))
    cuts = docs.select(ids.cast("double").alias("i")).approxQuantile("i", [k / parts for k in range(1, parts)], 0.2 / parts)
    return sorted(int(np.ceil(c)) if abs(c) < 2**62 else NO_ID for c in cuts)


def _parts(ids: np.ndarray, rows: np.ndarray, bounds: list[int]) -> np.ndarray:
    """The range of each id: ranges follow each other by id. An id that ``SPLIT`` cuts
    or more fall on has as many ranges, and its rows are dealt among them by ``rows``."""
    first = np.searchsorted(bounds, ids, side="left")
    last = np.searchsorted(bounds, ids, side="right")
    again = last - first  # cuts on the id itself
    return np.where(again < SPLIT, last, first + 1 + rows % np.maximum(again, 1)).astype(np.int32)


def _n_parts(docs: DataFrame, text_col: str) -> int:
    """Ranges of about ``PART_BYTES`` of text, and at least the shuffle's partitions."""
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None, block_ids: int = BLOCK_IDS, file_ids: int = FILE_IDS, bits: bool = False) -> DataFrame:
    """Write the files and return their table.

    ``part`` and ``file`` give the order, ``start_in_part`` the ids of the range
    before the file, ``n_ids``, ``n_docs`` its counts, ``doc_ids`` its documents
    and ``data`` the file.
    """
    bounds = _bounds(docs, id_col, parts or _n_parts(docs, text_col))

    def make_ids():
        def run(batch: pa.RecordBatch):
            texts = common.text_bytes(batch.column(1))
            for a, b in common.chunks(texts, CHUNK_BYTES):
                ids = [np.append(x, end_id) for x in encode_texts(bpe.decoded(texts[a:b]), tokenizer_path)]
                doc_ids = batch.column(0).slice(a, b - a)
                yield {
                    "part": _parts(np.array([d if d is not None else NO_ID for d in doc_ids.to_pylist()], dtype=np.int64), np.array(batch.column(2).slice(a, b - a)), bounds),
                    "doc_id": doc_ids,
                    "n_tokens": [len(x) for x in ids],
                    "width": [2 if x.max() < 1 << 16 else 4 for x in ids],
                    "ids": [x.astype("<u2" if x.max() < 1 << 16 else "<u4").tobytes() for x in ids],
                }

        return run

    numbered = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"), F.monotonically_increasing_id().alias("row"))
    encoded = common.map_rows(numbered, ["id", "text", "row"], "part int, doc_id bigint, n_tokens bigint, width int, ids binary", make_ids)
    dealt = encoded.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "doc_id", "n_tokens", "ids")

    def make_files():
        state = {"part": None}

        def flush():
            ids = np.concatenate(state["ids"])
            ends = np.cumsum([len(x) for x in state["ids"]])
            made = {"part": [state["part"]], "file": [state["file"]], "start_in_part": [state["start"]], "n_ids": [len(ids)], "n_docs": [len(ends)], "doc_ids": [state["docs"]], "data": [write_file(ids, ends, block_ids, bits)]}
            state.update(file=state["file"] + 1, start=state["start"] + len(ids), ids=[], docs=[], held=0)
            return made

        def run(batch: pa.RecordBatch | None):
            if batch is None:
                if state["part"] is not None and state["ids"]:
                    yield flush()
                return
            for part, doc_id, n, width, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if part != state["part"] or state["held"] + n > file_ids:
                    if state["part"] is not None and state["ids"]:
                        yield flush()
                    if part != state["part"]:
                        state.update(part=part, file=0, start=0, ids=[], docs=[], held=0)
                state["ids"].append(np.frombuffer(raw, dtype="<u2" if width == 2 else "<u4").astype(np.uint32))
                state["docs"].append(doc_id)
                state["held"] += n

        return run

    files = _map_to_end(dealt, "part int, file int, start_in_part bigint, n_ids bigint, n_docs bigint, doc_ids array<bigint>, data binary", make_files)
    return common.store(files, "token_files")


def _map_to_end(df: DataFrame, schema: str, make) -> DataFrame:
    """``mapInArrow`` whose function also gets None after the last batch."""
    from pyspark.sql import types as T

    kinds = T._parse_datatype_string(schema)

    def run(batches):
        out, f = common.arrow_schema(kinds), make()
        for made in _with_end(batches, f):
            yield pa.RecordBatch.from_arrays([common._array(made[x.name], x.type) for x in out], schema=out)

    return df.mapInArrow(run, kinds)


def _with_end(batches, f):
    for batch in batches:
        yield from f(batch)
    yield from f(None)


def read_tokens(files: DataFrame) -> DataFrame:
    """Documents of the files: ``doc_id``, ``start``, ``n_tokens``, ``ids``.

    ``start`` counts the ids of all documents before, over all files.
    """
    totals = {r["part"]: r["n"] for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}  # one row a range
    before, starts = 0, {}
    for part in sorted(totals):
        starts[part] = before
        before += totals[part]

    def make():
        def run(batch: pa.RecordBatch):
            for part, start, doc_ids, data in zip(*(c.to_pylist() for c in batch.columns)):
                ids, ends = read_file(data)
                begins = np.concatenate([[0], ends[:-1]])
                yield {"doc_id": doc_ids, "start": begins + starts[part] + start, "n_tokens": ends - begins, "ids": [ids[a:b].astype("<u4").tobytes() for a, b in zip(begins, ends)]}

        return run

    return common.map_rows(files, ["part", "start_in_part", "doc_ids", "data"], "doc_id bigint, start bigint, n_tokens bigint, ids binary", make)
