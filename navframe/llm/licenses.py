"""Licence scans with a generalised suffix automaton (operator 5).

The automaton holds the word sequences of licence texts, notices and phrases.
Each document streams through it: the current state and match length after every
word are the matching statistics. A phrase ends where its state is reached on the
suffix links with enough length. Maximal matches of at least ``MIN_MATCH`` words
are chained per template (increasing in both texts) into covered spans; a
template's label is given when its coverage reaches ``MIN_COVER`` and the words that
set it apart (its marks, such as "mozilla public license v 2 0") stand in the span
unbroken, so that a gap cannot turn one licence into another. Of two labels whose
spans overlap, one inside the other, the one with fewer matched words is dropped: a
three-clause text isn't a two-clause one, and a notice isn't also its first line.

Words that occur in no template, and word pairs that are adjacent in none, reset
the automaton, so numpy cuts a document into the few runs worth streaming.

Defined results: a null, empty or wordless text has no words, no places, null
``first_word`` and ``last_word``, empty labels and score 0. Rows are independent.
"""

from __future__ import annotations

import functools
import heapq
import json
import pkgutil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from navframe.llm import common

#: Base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Public licence texts, notices and one-line notices, with the words
#: that set each apart (marks); "~2" is another wording of a label.
_FILE = "license_texts.json"


def load_texts() -> dict[str, dict]:
    return json.loads(pkgutil.get_data(__package__, _FILE))


_TEXTS = load_texts()
TEMPLATES = {label: t["text"] for label, t in _TEXTS.items()}
MARKS = {label: t["marks"] for label, t in _TEXTS.items()}

MIN_MATCH = 3
MIN_COVER = 0.8


def words_of(data: bytes) -> list[bytes]:
    lowered = data.lower()
    starts, ends = common.word_spans(common.byte_array(lowered), common.ALNUM_WORDS)
    return [lowered[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


class SuffixAutomaton:
    """Generalised suffix automaton of integer sequences."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for number, sequence in enumerate(sequences):
            state = 0
            for i, symbol in enumerate(sequence):
                state = self._extend(state, symbol)
                self.ends[state].add((number, i + 1))
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]

    def _state(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.link) - 1

    def _split(self, parent: int, symbol: int, old: int) -> int:
        """A copy of ``old`` for the strings that come through ``parent``."""
        copy = self._state(self.length[parent] + 1, dict(self.next[old]), self.link[old])
        self.link[old] = copy
        while parent >= 0 and self.next[parent].get(symbol) == old:
            self.next[parent][symbol] = copy
            parent = self.link[parent]
        return copy

    def _extend(self, last: int, symbol: int) -> int:
        old = self.next[last].get(symbol)
        if old is not None:  # the sequence so far is there already
            return old if self.length[old] == self.length[last] + 1 else self._split(last, symbol, old)
        new = self._state(self.length[last] + 1, {}, 0)
        parent = last
        while parent >= 0 and symbol not in self.next[parent]:
            self.next[parent][symbol] = new
            parent = self.link[parent]
        if parent >= 0:
            old = self.next[parent][symbol]
            self.link[new] = old if self.length[old] == self.length[parent] + 1 else self._split(parent, symbol, old)
        return new

    def statistics(self, symbols) -> list[tuple[int, int]]:
        """(state, match length) after each symbol."""
        state, length, out = 0, 0, []
        for symbol in symbols:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            state = self.next[state].get(symbol, 0)
            length = length + 1 if state else 0
            out.append((state, length))
        return out


def chain(matches: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """Best chain of (document start, template start, length): covered template
    words, and the document span. Matches follow each other in both texts. The
    best chain up to each template word is kept, so the work is linear in the
    matches."""
    best = (0, 0, 0)
    upto: dict[int, tuple[int, int]] = {}  # template end: (covered words, document start)
    open_: list[tuple[int, int, int, int]] = []  # chains whose last match may not have ended
    for start, at, length in sorted(matches):
        while open_ and open_[0][0] <= start:
            _, template_end, covered, begin = heapq.heappop(open_)
            upto[template_end] = max(upto.get(template_end, (0, 0)), (covered, begin))
        covered, begin = max((v for k, v in upto.items() if k <= at), default=(0, start))
        link = (start + length, at + length, covered + length, begin)
        heapq.heappush(open_, link)
        if link[2] > best[0]:
            best = (link[2], begin, link[0])
    return best


def _place(mark: list[bytes], text: list[bytes]) -> tuple[int, int]:
    """Where the words of a mark first stand in its text."""
    at = next(i for i in range(len(text)) if text[i : i + len(mark)] == mark)
    return at, at + len(mark)


def given_labels(covers: dict[str, tuple[float, int, int, int]]) -> dict[str, tuple[float, int, int, int]]:
    """The labels of templates (coverage, first and last word, matched words) without
    those inside another's span that match more words; wordings of a label are one."""
    order = sorted(covers.items(), key=lambda c: (-c[1][3], c[0]))
    kept: dict[str, tuple[float, int, int, int]] = {}
    spans: list[tuple[int, int]] = []
    for label, cover in order:
        if not any(first <= cover[1] and cover[2] <= last for first, last in spans):
            spans.append(cover[1:3])
            kept.setdefault(label.split("~")[0], cover)
    return kept


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: dict[str, str], marks: dict[str, list[str]] | None = None):
        self.phrases, self.labels = list(phrases.values()), list(templates)
        texts = [words_of(t.encode()) for t in (*phrases, *templates.values())]
        self.sizes = [len(t) for t in texts]
        vocabulary = sorted({w for t in texts for w in t})
        joined = b" ".join(vocabulary)
        lengths = np.array([len(w) for w in vocabulary])
        starts = np.cumsum(lengths + 1) - lengths - 1
        hashes = common.span_hashes(common.byte_array(joined), starts, starts + lengths)
        order = np.argsort(hashes)
        self.known = hashes[order]
        number = {vocabulary[k]: i for i, k in enumerate(order.tolist())}
        sequences = [[number[w] for w in t] for t in texts]
        self.marks = [[_place(words_of(m.encode()), words_of(t.encode())) for m in (marks or {}).get(label, [])] for label, t in templates.items()]
        self.pairs = np.unique([a * len(number) + b for s in sequences for a, b in zip(s, s[1:])])
        self.phrase_pairs = np.unique([a * len(number) + b for s in sequences[: len(phrases)] for a, b in zip(s, s[1:])])
        self.automaton = SuffixAutomaton(sequences)
        self.phrase_at: list[list[int]] = [[] for _ in self.automaton.link]  # phrases that end a state's strings
        for state in sorted(range(1, len(self.phrase_at)), key=self.automaton.length.__getitem__):
            link, length = self.automaton.link[state], self.automaton.length
            whole = {k for k in range(len(self.phrases)) if (k, self.sizes[k]) in self.automaton.ends[state] and length[link] < self.sizes[k] <= length[state]}
            self.phrase_at[state] = sorted(whole.union(self.phrase_at[link]))

    def scan(self, data: bytes) -> tuple[int, list[tuple[int, int]], dict[str, tuple]]:
        """Words, (start, phrase) of the places, and (coverage, first and last word,
        matched words, whether all marks stand there) of templates."""
        buf = common.byte_array(data.lower())
        starts, ends = common.word_spans(buf, common.ALNUM_WORDS)
        n = len(starts)
        if n < 2:
            return n, [], {}
        hashes = common.span_hashes(buf, starts, ends)
        number = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        inside = self.known[number] == hashes
        pair = number[:-1] * len(self.known) + number[1:]
        adjacent = np.zeros(n + 1, dtype=np.int8)
        adjacent[1:-1] = inside[:-1] & inside[1:] & np.isin(pair, self.pairs)
        turns = np.flatnonzero(np.diff(adjacent))
        begin, end = turns[::2], turns[1::2] + 1
        worth = (end - begin >= MIN_MATCH) | np.isin(pair[begin], self.phrase_pairs)
        places, matches = [], {}
        for a, b in zip(begin[worth].tolist(), end[worth].tolist()):
            self._stream(a, number[a:b].tolist(), places, matches)
        covers = {}
        for k, found in matches.items():
            cover, first, last = chain(found)
            inside_ = [(at, at + length) for start, at, length in found if first <= start and start + length <= last]
            whole = all(any(a <= begin and end <= b for a, b in inside_) for begin, end in self.marks[k])
            covers[self.labels[k]] = (cover / self.sizes[k + len(self.phrases)], first, last, cover, whole)
        return n, places, covers

    def _stream(self, begin: int, symbols: list[int], places: list, matches: dict) -> None:
        walked = self.automaton.statistics(symbols)
        for i, (state, length) in enumerate(walked):
            for k in self.phrase_at[state]:
                if length >= self.sizes[k]:
                    places.append((begin + i + 1 - self.sizes[k], k))
            if length >= MIN_MATCH:  # a match is recorded where its text goes on otherwise
                goes_on = self.automaton.ends[walked[i + 1][0]] if i + 1 < len(walked) and walked[i + 1][1] > length else ()
                for text, end in self.automaton.ends[state]:
                    if text >= len(self.phrases) and (text, end + 1) not in goes_on:
                        matches.setdefault(text - len(self.phrases), []).append((begin + i + 1 - length, end - length, length))


@functools.cache
def scanner() -> Scanner:
    return Scanner(PHRASES, TEMPLATES, MARKS)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_words``, ``n_base``, ``first_word``, ``last_word``,
    ``base_labels``, ``labels``, ``score`` (best template coverage, 1 where a base
    phrase stands) and ``spans`` (label:first:last of labelled templates, words)."""
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans string"

    def make():
        scan_one = scanner()

        def run(batch: pa.RecordBatch):
            out = {name: [] for name in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
            for data in common.text_bytes(batch.column(1)):
                n, places, covers = scan_one.scan(data or b"")
                base = {scan_one.phrases[k] for _, k in places}
                given = given_labels({label: c[:4] for label, c in covers.items() if c[0] >= MIN_COVER and c[4]})
                at = [start for start, _ in places]
                row = (n, len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | given.keys())), float(max([0.0, 1.0 * bool(places), *(c[0] for c in covers.values())])), ",".join(f"{label}:{c[1]}:{c[2]}" for label, c in sorted(given.items())))
                for column, value in zip(out.values(), row):
                    column.append(value)
            return {id_col: batch.column(0), **out}

        return run

    return common.map_rows(docs, [id_col, text_col], schema, make)
