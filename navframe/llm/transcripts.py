"""Transcript parsing with a hidden Markov model (operator 3).

States are (role, first line or later line of a turn). A line's symbol is its
speaker marker (none, or the role it hints at), its length class and whether it
ends as a question. Probabilities are counted on labelled turns. Viterbi's best
path gives every line its role and the turns' borders; turns are then rendered in
a canonical form.

A conversation may be longer than a task should hold. Viterbi steps are max-plus
matrix products, which associate: rows are numbered in the conversation and cut into
blocks of ``BLOCK`` rows, each block gives one matrix, blocks of blocks are multiplied up
to one matrix a conversation, and the best end state is passed down again as the
entry and exit state of every block, which then finds its own path.

A turn may be long too: it comes in pieces of ``PIECE`` lines at most, numbered from
0, whose ``rendered`` texts follow each other to the whole turn. Lines and turns are
numbered by running sums over blocks in two levels, so no task reads all blocks of a
conversation.

Defined results: rows that repeat wholly count once; rows of one place are ordered
by their text; null places come first; a null text is an empty line; null
conversation ids are one conversation; ties take the first state in order.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from navframe.llm import common

ROLES = ("system", "user", "assistant")
BLOCK = 64
#: lines of a turn in one row, and blocks whose sums one task runs through
PIECE, RUN = 1024, 4096
#: rows are dealt by ranges of conversation, place and so many characters of the text
RANGE_CHARS = 256
#: state 2 * role: first line of a turn, 2 * role + 1: later line, 6: before the text
N_STATES = 7
BEGIN = 6
N_SYMBOLS = 4 * 3 * 2

#: Speaker markers and the role they hint at.
MARKERS = {
    "system": ("system", "sys", "instructions"),
    "user": ("user", "human", "question", "q", "me"),
    "assistant": ("assistant", "ai", "bot", "answer", "a"),
}
_HINT = {name: k for k, role in enumerate(ROLES) for name in MARKERS[role]}
_MARKER = re.compile(r"[\x20\t]{0,4}[\[(*<|]{0,4}([A-Za-z]{1,12})[\])*>|]{0,4}[\x20\t]?(?::|>|\])[\x20\t]{0,2}")
_LABEL = re.compile(r"[\x20\t]{0,4}\[([A-Za-z]{1,12})\][\x20\t]{1,2}")


def split_marker(line: str) -> tuple[int | None, str]:
    """The role a line's marker hints at, and the line without it."""
    m = _LABEL.match(line) or _MARKER.match(line)
    hint = _HINT.get(m[1].lower()) if m else None
    return (None, line) if hint is None else (hint, line[m.end() :])


def symbol(line: str) -> int:
    hint, rest = split_marker(line)
    words = rest.count(" ") + 1
    length = 0 if words < 6 else 1 if words < 25 else 2
    return ((0 if hint is None else hint + 1) * 3 + length) * 2 + rest.rstrip().endswith("?")


# -- the model -------------------------------------------------------------------------


class Model:
    """Log probabilities of steps (from, to) and of symbols in states."""

    def __init__(self, steps: np.ndarray, symbols: np.ndarray, smoothing: float = 0.5):
        allowed = np.zeros((N_STATES, N_STATES), dtype=bool)
        allowed[:, 0:BEGIN:2] = True  # a new turn may follow anything
        for role in range(len(ROLES)):
            allowed[2 * role : 2 * role + 2, 2 * role + 1] = True  # a later line keeps the role
        counts = np.where(allowed, steps + smoothing, 0.0)
        emitted = symbols + smoothing
        with np.errstate(divide="ignore"):
            self.steps = np.log(counts / counts.sum(axis=1, keepdims=True))
            self.symbols = np.log(emitted / emitted.sum(axis=1, keepdims=True))
        self.symbols[BEGIN] = -np.inf
        self.lines = [self.steps + self.symbols[:, sym][None, :] for sym in range(N_SYMBOLS)]

    def line(self, sym: int) -> np.ndarray:
        """Max-plus matrix of one line."""
        return self.lines[sym]


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def product(matrices: Iterable[np.ndarray]) -> np.ndarray:
    rest = iter(matrices)
    out = next(rest)
    for m in rest:
        out = multiply(out, m)
    return out


def path(matrices: Iterable[np.ndarray], entry: int, end: int | None) -> list[int]:
    """Best state after each matrix, from ``entry`` to ``end`` (None: the best).
    Held are ``N_STATES`` bytes a matrix."""
    rest = iter(matrices)
    scores, back = next(rest)[entry], bytearray()
    for m in rest:
        steps = scores[:, None] + m
        back += steps.argmax(axis=0).astype(np.uint8).tobytes()
        scores = steps.max(axis=0)
    states = [int(scores.argmax()) if end is None else end]
    for k in range(len(back) - N_STATES, -1, -N_STATES):
        states.append(back[k + states[-1]])
    return states[::-1]


def train(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", raw_col: str | None = None) -> Model:
    """Counts over labelled turns; a turn's successor has the next number. Rows of
    one turn are counted together, and its steps are products of two counts. What
    reaches the driver is one number a pair of states and a state and symbol."""
    rows = turns.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), F.col(f"`{role_col}`").alias("role"), F.coalesce(F.col(f"`{raw_col or text_col}`"), F.lit("")).alias("text")).filter(F.col("role").isin(*ROLES))
    common.on_workers(turns.sparkSession)

    def count(batches):
        totals: dict[tuple[int, int], int] = {}
        for batch in batches:
            for role, text in zip(*(c.to_pylist() for c in batch.columns)):
                for k, line in enumerate(text.split("\n")):
                    key = (2 * ROLES.index(role) + (k > 0), symbol(line))
                    totals[key] = totals.get(key, 0) + 1
        if totals:
            yield pa.RecordBatch.from_pydict({"state": [s for s, _ in totals], "symbol": [y for _, y in totals], "n": list(totals.values())}, schema=pa.schema([("state", pa.int32()), ("symbol", pa.int32()), ("n", pa.int64())]))

    symbols = np.zeros((N_STATES, N_SYMBOLS))
    for s, y, n in rows.select("role", "text").mapInArrow(count, "state int, symbol int, n bigint").groupBy("state", "symbol").agg(F.sum("n")).collect():
        symbols[s, y] = n
    role = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")).cast("int") - 1
    lines = F.size(F.split("text", "\n"))
    short = rows.select("conv", "turn", role.alias("role"), lines.alias("lines"))
    none, turn = F.lit(None).cast("int"), F.col("turn").cast("bigint")
    last = 2 * F.col("role") + (F.col("lines") > 1).cast("int")
    sides = F.array(F.struct(turn.alias("turn"), F.col("role").alias("now"), none.alias("before")), F.struct((turn + 1).alias("turn"), none.alias("now"), last.alias("before")))
    # turns without a conversation or a number follow none
    met = short.select("conv", F.explode(sides).alias("x")).select("conv", "x.*").filter("before is null or (conv is not null and turn is not null)")
    now = [F.count(F.when(F.col("now") == r, 1)).cast("double").alias(f"now_{r}") for r in range(len(ROLES))]
    before = [F.count(F.when(F.col("before") == s, 1)).cast("double").alias(f"before_{s}") for s in range(BEGIN)]
    first = F.when(sum(F.col(f"before_{s}") for s in range(BEGIN)) == 0, 1.0).otherwise(0.0)
    pairs = [(s, r) for s in range(N_STATES) for r in range(len(ROLES))]
    steps = np.zeros((N_STATES, N_STATES))
    counts = met.groupBy("conv", "turn").agg(*now, *before).withColumn(f"before_{BEGIN}", first)
    for (s, r), n in zip(pairs, counts.agg(*[F.sum(F.col(f"before_{s}") * F.col(f"now_{r}")) for s, r in pairs]).first()):
        steps[s, 2 * r] += n or 0
    for r, starts, later in short.groupBy("role").agg(F.count(F.when(F.col("lines") > 1, 1)), F.sum(F.greatest(F.col("lines") - 2, F.lit(0)))).collect():
        steps[2 * r, 2 * r + 1] += starts
        steps[2 * r + 1, 2 * r + 1] += later
    return Model(steps, symbols)


# -- grouped streams -------------------------------------------------------------------


def by_group(df: DataFrame, keys: list[str], order: list[str], schema: str | T.StructType, f: Callable[[Iterator[dict]], Iterator[dict]]) -> DataFrame:
    """``f`` over the rows of each group in order; groups are bounded blocks. Rows
    are dealt by the keys, sorted, and streamed, many groups a task."""
    kinds = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def run(batches):
        out = common.arrow_schema(kinds)
        rows = (row for batch in batches for row in batch.to_pylist())
        held: list[dict] = []
        for _, group in itertools.groupby(rows, key=lambda r: tuple(r[k] for k in keys)):
            for row in f(group):
                held.append(row)
                if len(held) > 2000:
                    yield pa.RecordBatch.from_pylist(held, schema=out)
                    held = []
        yield pa.RecordBatch.from_pylist(held, schema=out)

    common.on_workers(df.sparkSession)
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, kinds)


def _conv_field(df: DataFrame) -> T.StructField:
    return T.StructField("conv", df.schema["conv"].dataType)


def _schema(df: DataFrame, rest: str) -> T.StructType:
    return T.StructType([_conv_field(df), *T._parse_datatype_string(rest).fields])


def _matrix(row: dict) -> np.ndarray:
    return np.array(row["matrix"]).reshape(N_STATES, N_STATES)


def _line_matrices(rows: Iterable[dict], model: Model) -> Iterator[np.ndarray]:
    return (model.line(symbol(line)) for r in rows for line in (r["text"] or "").split("\n"))


def _in_blocks(rows: DataFrame, block: int) -> DataFrame:
    """``rows`` with ``block``: the running number of a row in its conversation, by
    place and text, over ``block``. Rows are dealt by ranges and numbered in each;
    of the conversations in a range only the first can go on from the ranges before."""
    from pyspark.sql import Window

    ranges = rows.repartitionByRange("conv", "place", F.substring("text", 1, RANGE_CHARS)).sortWithinPartitions("conv", "place", "text")
    kinds = T.StructType([*rows.schema.fields, *T._parse_datatype_string("part int, nth bigint").fields])

    def number(batches):
        out = common.arrow_schema(kinds)
        last: list = []
        n = 0
        for batch in batches:
            nth = []
            for conv in batch.column(0).to_pylist():
                n = n + 1 if last == [conv] else 0
                last = [conv]
                nth.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nth, type=pa.int64())], schema=out)

    common.on_workers(rows.sparkSession)
    stored = common.store(ranges.withColumn("part", F.spark_partition_id()).mapInArrow(number, kinds), "transcript_rows")
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ongoing = stored.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n")).select(F.col("conv").alias("o_conv"), F.col("part").alias("o_part"), before.alias("before")).filter("before > 0")
    ongoing = F.broadcast(common.store(ongoing, "transcript_ranges"))  # one row a range at most
    joined = stored.join(ongoing, F.col("conv").eqNullSafe(F.col("o_conv")) & (F.col("part") == F.col("o_part")), "left")
    return joined.select(*rows.columns, F.floor((F.coalesce("before", F.lit(0)) + F.col("nth")) / block).alias("block"))


# -- the operator ----------------------------------------------------------------------


def parse(chunks: DataFrame, model: Model, conv_col: str = "conv_id", order_col: str = "turn", text_col: str = "text", block: int = BLOCK, piece: int = PIECE, run: int = RUN) -> DataFrame:
    """Turns of raw transcripts: ``conv``, ``turn_no``, ``piece``, ``role``,
    ``n_lines``, ``text`` (markers removed) and ``rendered``.

    ``chunks`` holds the transcripts' text in pieces of whole lines, placed by an
    integer ``order_col``.
    """
    if block < 2:
        raise ValueError("a block must hold at least two rows")
    rows = chunks.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{order_col}`").cast("bigint").alias("place"), F.col(f"`{text_col}`").alias("text")).distinct()
    rows = _in_blocks(rows, block)
    kinds = _schema(rows, "block bigint, matrix array<double>")

    def leaf(group):
        first = next(group)
        yield {"conv": first["conv"], "block": first["block"], "matrix": product(_line_matrices(itertools.chain([first], group), model)).ravel().tolist()}

    def node(group):
        first = next(group)
        yield {"conv": first["conv"], "block": first["parent"], "matrix": product(map(_matrix, itertools.chain([first], group))).ravel().tolist()}

    levels = [common.store(by_group(rows, ["conv", "block"], ["place", "text"], kinds, leaf), "transcript_blocks")]
    while (levels[-1].agg(F.max("block")).first()[0] or 0) > 0:
        above = levels[-1].withColumn("parent", F.floor(F.col("block") / block))
        levels.append(common.store(by_group(above, ["conv", "parent"], ["block"], kinds, node), "transcript_blocks"))

    ends = _schema(rows, "block bigint, entry int, end int")

    def top(batches):
        for batch in batches:
            found = [{"conv": r["conv"], "block": r["block"], "entry": BEGIN, "end": int(_matrix(r)[BEGIN].argmax())} for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(found, schema=common.arrow_schema(ends))

    def down(group):
        group = list(group)  # a block's children
        entry = group[0]["entry"]
        for r, end in zip(group, path(map(_matrix, group), entry, group[0]["end"])):
            yield {"conv": r["conv"], "block": r["block"], "entry": entry, "end": end}
            entry = end

    known = levels[-1].mapInArrow(top, ends)
    for level in reversed(levels[:-1]):
        parents = known.select(F.col("conv").alias("p_conv"), F.col("block").alias("parent"), "entry", "end")
        children = level.withColumn("parent_", F.floor(F.col("block") / block)).join(parents, F.col("conv").eqNullSafe(F.col("p_conv")) & (F.col("parent_") == F.col("parent"))).select("conv", "block", "matrix", "parent", "entry", "end")
        known = common.store(by_group(children, ["conv", "parent"], ["block"], ends, down), "transcript_ends")

    lines = _schema(rows, "block bigint, line bigint, role int, nth bigint, starts int, since bigint, ends int, text string")

    def label(group):
        group = list(group)  # a block's rows
        states = path(_line_matrices(group, model), group[0]["entry"], group[0]["end"])
        nth = line = 0
        since = -1  # the line of the block that the turn began with
        for r in group:
            for text in (r["text"] or "").split("\n"):
                starts = 1 - states[line] % 2
                nth += starts
                since = line if starts else since
                ends = 1 - states[line + 1] % 2 if line + 1 < len(states) else None  # the next block says
                yield {"conv": r["conv"], "block": r["block"], "line": line, "role": states[line] // 2, "nth": nth, "starts": starts, "since": since, "ends": ends, "text": split_marker(text)[1] if starts else text}
                line += 1

    named = known.select(F.col("conv").alias("k_conv"), F.col("block").alias("k_block"), "entry", "end")
    placed = rows.join(named, F.col("conv").eqNullSafe(F.col("k_conv")) & (F.col("block") == F.col("k_block"))).drop("k_conv", "k_block")
    labelled = common.store(by_group(placed, ["conv", "block"], ["place", "text"], lines, label), "transcript_lines")
    sums = _before_blocks(labelled, run)
    numbered = labelled.join(sums, F.col("conv").eqNullSafe(F.col("b_conv")) & (F.col("block") == F.col("b_block")))
    begun = F.when(F.col("since") >= 0, F.col("lines_before") + F.col("since")).otherwise(F.col("begun_before"))
    numbered = numbered.withColumn("turn_no", F.col("turns_before") + F.col("nth") - 1).withColumn("piece", F.floor((F.col("lines_before") + F.col("line") - begun) / piece).cast("int"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("block", "line", "text"))), lambda x: x["text"])
    turns = numbered.groupBy("conv", "turn_no", "piece").agg(
        F.min("role").alias("r"), F.count(F.lit(1)).alias("n_lines"), F.concat_ws("\n", ordered).alias("text"), F.max(F.coalesce("ends", "next_starts")).alias("closed")
    )
    role = F.element_at(F.array(*map(F.lit, ROLES)), F.col("r") + 1)
    named = turns.select("conv", "turn_no", "piece", role.alias("role"), "n_lines", "text", "closed")
    head = F.when(F.col("piece") == 0, F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"))).otherwise("")
    tail = F.when(F.col("closed") == 1, "<|end|>\n").otherwise("\n")
    return named.withColumn("rendered", F.concat(head, "text", tail)).drop("closed")


def _before_blocks(labelled: DataFrame, run: int) -> DataFrame:
    """Of each block (``b_conv``, ``b_block``): ``turns_before`` and ``lines_before``
    it, the line that the last turn before it began with (``begun_before``), both
    counted through the conversation, and whether the next block's first line begins
    a turn (``next_starts``; the end does).

    Running values are taken within ``run`` blocks, and then over the totals of these."""
    from pyspark.sql import Window

    first = F.max(F.when(F.col("line") == 0, F.col("starts")))
    last = F.max(F.when(F.col("starts") == 1, F.col("line")))
    blocks = labelled.groupBy("conv", "block").agg(F.sum("starts").alias("n"), F.count(F.lit(1)).alias("lines"), last.alias("last"), first.alias("first"))
    blocks = common.store(blocks.withColumn("group", F.floor(F.col("block") / run)), "transcript_sums")
    totals = blocks.groupBy("conv", "group").agg(F.sum("n").alias("g_n"), F.sum("lines").alias("g_lines"), F.min_by("first", "block").alias("g_first"))
    inner, outer = Window.partitionBy("conv", "group").orderBy("block"), Window.partitionBy("t_conv").orderBy("t_group")
    past = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(F.col("conv").alias("t_conv"), F.col("group").alias("t_group"), "g_n", "g_lines", "g_first")
    totals = totals.select("t_conv", "t_group", past("g_n", outer).alias("g_n"), past("g_lines", outer).alias("g_lines"), F.lead("g_first").over(outer).alias("g_next"))
    same = F.col("conv").eqNullSafe(F.col("t_conv")) & (F.col("group") == F.col("t_group"))
    placed = blocks.withColumns({"n_in": past("n", inner), "lines_in": past("lines", inner), "next_in": F.lead("first").over(inner)}).join(totals, same)
    lines_before = F.col("g_lines") + F.col("lines_in")
    placed = placed.select("conv", "group", "block", (F.col("g_n") + F.col("n_in")).alias("turns_before"), lines_before.alias("lines_before"), (lines_before + F.col("last")).alias("begun"), F.coalesce("next_in", "g_next", F.lit(1)).alias("next_starts"))
    placed = common.store(placed, "transcript_sums")
    latest = placed.groupBy("conv", "group").agg(F.max("begun").alias("g_begun")).select(F.col("conv").alias("t_conv"), F.col("group").alias("t_group"), "g_begun")
    upto = lambda c, w: F.max(c).over(w.rowsBetween(Window.unboundedPreceding, -1))
    latest = latest.withColumn("g_begun", upto("g_begun", outer))
    begun = placed.withColumn("begun_in", upto("begun", inner)).join(latest, same)
    return begun.select(F.col("conv").alias("b_conv"), F.col("block").alias("b_block"), "turns_before", "lines_before", F.coalesce("begun_in", "g_begun").alias("begun_before"), "next_starts")


def raw_transcript(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``raw``: each turn as it stands in a raw transcript, with a full marker, an
    alias, a short marker or none, by a hash of its place."""
    style = F.pmod(F.xxhash64(F.col(f"`{conv_col}`"), F.col(f"`{turn_col}`")), F.lit(10))
    role = F.col(f"`{role_col}`")
    alias = F.when(role == "user", "Human: ").when(role == "assistant", "AI: ").otherwise("[system] ")
    short = F.when(role == "user", "Q: ").when(role == "assistant", "A: ").otherwise("SYS: ")
    marker = F.when(style < 5, F.concat(F.initcap(role), F.lit(": "))).when(style < 7, alias).when(style < 8, short).otherwise("")
    return turns.withColumn("raw", F.concat(F.coalesce(marker, F.lit("")), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
