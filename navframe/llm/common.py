"""Shared helpers of the text operators: Arrow access, words, hashes, stores.

All text work happens inside ``mapInArrow`` tasks, one document at a time with
numpy over the UTF-8 bytes, so memory is bounded by one Arrow batch plus one
document. Byte-level rules are exact for UTF-8: every byte of a multi-byte
character is at least 0x80.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from navframe.session import shared_dir

U64 = np.uint64

# -- word classes --------------------------------------------------------------


def _byte_class(inside: Callable[[int], bool]) -> np.ndarray:
    return np.array([inside(b) for b in range(256)], dtype=bool)


#: words [^\x20\x09-\x0D]+
SPACE_WORDS = _byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (digits, a-z and everything non-ASCII)
ALNUM_WORDS = _byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)


def byte_array(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint8)


def word_spans(buf: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte offsets of the maximal runs of ``inside`` bytes."""
    flags = np.zeros(len(buf) + 2, dtype=np.int8)
    flags[1:-1] = inside[buf]
    turns = np.flatnonzero(np.diff(flags))
    return turns[::2], turns[1::2]


# -- hashes ----------------------------------------------------------------------

_MULT = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_WORD_MULT = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    h = h ^ U64((seed * 0x2545F4914F6CDD1D) & (2**64 - 1))
    h = (h ^ (h >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


class _Powers:
    """Powers of an odd multiplier and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, mult: int):
        self.mult, self.inverse = mult, pow(mult, -1, 2**64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 12)
            for name, m in (("up", self.mult), ("down", self.inverse)):
                steps = np.full(size, m, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_BYTE_VALUES = tuple(mix(np.arange(256, dtype=np.uint64), lane + 1) for lane in (0, 1))
_CHAR_VALUES = mix(np.arange(1 << 16, dtype=np.uint64), 3)
_BYTE_POWERS = tuple(_Powers(m) for m in _MULT)
_WORD_POWERS = tuple(_Powers(m) for m in _WORD_MULT)


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """64-bit hash of each slice of a byte array: prefix sums of a polynomial."""
    return _span_hashes(_BYTE_VALUES[lane][codes], starts, ends, lane)


def char_values(codes: np.ndarray) -> np.ndarray:
    """The 64-bit value of each code point."""
    return _CHAR_VALUES[codes] if codes.max(initial=0) <= 0xFFFF else mix(codes.astype(np.uint64), 3)


def char_powers(n: int, lane: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of a lane's multiplier, and of its inverse."""
    return _BYTE_POWERS[lane].upto(n)


def char_hash(polynomial: np.ndarray, lane: int) -> np.ndarray:
    """What ``char_hashes`` gives for sums of values times powers of their places."""
    return mix(polynomial, lane + 11)


def char_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each slice of an array of code points."""
    values = char_values(codes)
    return _span_hashes(values, starts, ends, 0), _span_hashes(values, starts, ends, 1)


def _span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int) -> np.ndarray:
    up, down = _BYTE_POWERS[lane].upto(len(values) + 1)
    prefix = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts], lane + 11)


def window_hashes(words: np.ndarray, length: int, lane: int = 0) -> np.ndarray:
    """64-bit hash of every window of ``length`` consecutive word hashes."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    up, down = _WORD_POWERS[lane].upto(len(words) + 1)
    prefix = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * up[: len(words)], out=prefix[1:])
    return mix((prefix[length:] - prefix[:n]) * down[:n], lane + 21)


def sequence_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """64-bit hash of each slice of a sequence of word hashes."""
    up, down = _WORD_POWERS[lane].upto(len(words) + 1)
    prefix = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * up[: len(words)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts], lane + 31)


def covered(length: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of ``length`` positions lie in any of the slices."""
    steps = np.zeros(length + 1, dtype=np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0


def slices(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true flags."""
    steps = np.diff(flags.astype(np.int8), prepend=0, append=0)
    turns = np.flatnonzero(steps)
    return turns[::2], turns[1::2]


# -- Arrow -------------------------------------------------------------------------


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The UTF-8 bytes of a string column (None for null)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist() if not pa.types.is_null(column.type) else [None] * len(column)


def chunks(texts: list[bytes | None], most: int) -> list[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or of one longer text."""
    out, begin, total = [], 0, 0
    for i, text in enumerate(texts):
        size = len(text or b"")
        if i > begin and total + size > most:
            out.append((begin, i))
            begin, total = i, 0
        total += size
    return [*out, (begin, len(texts))] if texts else []


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    return pa.schema([pa.field(f.name, arrow_type(f.dataType)) for f in schema.fields])


#: Spark's setting for the bytes of an Arrow batch, and what the text operators take
#: where it isn't set: a worker holds a batch several times over
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def on_workers(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from any working
    directory (a cluster gets it with ``--py-files``), and read batches of a
    bounded size."""
    if BATCH_SETTING not in dict(spark.sparkContext.getConf().getAll()):
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


_kept: dict = {}
_asked: set = set()


def kept(key, make: Callable):
    """What ``make()`` gave, for as long as the tasks of this Python worker ask for it.

    Workers live on between jobs, so what only one operator needs would count
    against the memory of all later ones.
    """
    _asked.add(key)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def begun(make: Callable):
    """``make()`` at a task's start; what it doesn't ask for is let go."""
    _asked.clear()
    made = make()
    unasked = _kept.keys() - _asked
    for key in unasked:
        del _kept[key]
    if unasked:
        pa.default_memory_pool().release_unused()
    return made


def map_rows(df: DataFrame, columns: list[str], schema: str | T.StructType, make: Callable) -> DataFrame:
    """``mapInArrow`` over some columns only.

    ``make()`` runs once per task and returns ``f(batch) -> dict of columns``
    (or an iterator of such dicts). What it takes from ``kept`` stays for the
    next task.
    """
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = arrow_schema(schema)
        f = begun(make)
        for batch in batches:
            made = f(batch)
            for columns_ in [made] if isinstance(made, dict) else made:
                yield pa.RecordBatch.from_arrays(
                    [_array(columns_[field.name], field.type) for field in out], schema=out
                )

    on_workers(df.sparkSession)
    return df.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, schema)


def _array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    if isinstance(values, np.ndarray) and values.dtype == np.uint64:
        values = values.view(np.int64)
    return pa.array(values, type=kind)


def list_array(parts: list[np.ndarray], value_type: pa.DataType) -> pa.Array:
    """A list column from one numpy array per row."""
    offsets = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
    flat = flat.view(np.int64) if flat.dtype == np.uint64 else flat
    values = pa.array(flat, type=value_type)
    return pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), values)


# -- stores ------------------------------------------------------------------------


def store(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage at a copy that survives lost executors; the folder is the
    one the session names in ``spark.checkpoint.dir``.
    """
    spark = df.sparkSession
    path = shared_dir(spark, "llm", name, unique=True)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, with underscores added until it clashes with no column."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def safe_name(name: str) -> str:
    return re.sub(r"\W", "_", name)
