"""Personal data by anchor expansion (operator 2).

One Aho-Corasick automaton finds anchors in the lower-cased text: at-signs,
schemes, plus signs, digits and identifier cues (``token``, ``iban``,
``account`` ...). A deterministic parser of the anchor's kind then expands to
the left and right inside the original text and validates what it found.

Base kinds: ``email``, ``ip``, ``card``, ``phone`` as the patterns below, the
leftmost non-overlapping matches of each kind. Kinds of the method: ``secret``
(cue, assignment, mixed token), ``account`` (cue and a valid IBAN, a social
security number or an account number) and ``url`` (scheme with credentials).

Defined results: a null or empty text has no spans; offsets are code points, end
exclusive; invalid UTF-8 counts as U+FFFD. Rows are independent of each other.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navframe.llm import common

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "account", "url")

# The base patterns' classes and shapes, as local parsers.
_LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "access_key")
_ACCOUNT_CUES = ("iban", "ssn", "account", "acct")
_SCHEMES = ("http://", "https://", "ftp://", "ssh://")
_SECRET = re.compile(r"""[\x20\t]{0,4}[=:][\x20\t]{0,4}["']?([A-Za-z0-9_/+-]{16,})["']?""")
_IBAN = re.compile(r"[\x20:=#-]{0,4}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_SSN = re.compile(r"[\x20:=#-]{0,4}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")
_ACCOUNT = re.compile(r"(?:\x20(?:number|no|nr)\.?)?[\x20:=#]{1,4}([0-9]{8,17})(?![0-9])", re.IGNORECASE)
_USERINFO = re.compile(r"[^\s/@:\"'<>]+:[^\s/@\"'<>]+@[A-Za-z0-9.-]+[^\s\"'<>]*")


@functools.cache
def _automaton():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    anchors = [("@", "at"), ("+", "plus"), *((str(d), "digit") for d in range(10))]
    anchors += [(c, "secret") for c in _SECRET_CUES] + [(s, "scheme") for s in _SCHEMES]
    anchors += [(c, c if c in ("iban", "ssn") else "account") for c in _ACCOUNT_CUES]
    for word, kind in anchors:
        automaton.add_word(word, (kind, len(word)))
    automaton.make_automaton()
    return automaton


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    packed = text.replace(" ", "")
    if not 15 <= len(packed) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _identifier(text: str, end: int, kind: str) -> tuple[int, int] | None:
    """The value after an account cue that ends at ``end``."""
    if kind == "iban":
        found = _IBAN.match(text, end)
        while found:  # the run may take in a following upper-case word
            value = text[found.start(1) : found.end(1)]
            for cut in [len(value), *(m.start() for m in reversed(list(re.finditer(" ", value))))]:
                if iban_valid(value[:cut]):
                    return found.start(1), found.start(1) + cut
            return None
        return None
    found = (_SSN if kind == "ssn" else _ACCOUNT).match(text, end)
    return found.span(1) if found else None


def spans_of(text: str, lowered: str | None = None) -> list[tuple[int, int, int]]:
    """(start, index in KINDS, end) of all spans, ordered."""
    lowered = text.encode("utf-8", "replace").lower().decode() if lowered is None else lowered
    found: list[tuple[int, int, int]] = []
    email_end = ip_end = card_end = 0
    previous = -2  # position of the digit before
    for last, (kind, length) in _automaton().iter(lowered):
        if kind == "digit":
            run_start = last != previous + 1
            previous = last
            if last >= card_end:
                m = _CARD.match(text, last)
                if m:
                    card_end = m.end()
                    digits = m[0].replace(" ", "").replace("-", "") if m.end() - last <= 64 else ""
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        found.append((last, 2, card_end))
            if last >= ip_end and run_start or last == ip_end:
                m = _IP.match(text, last)
                if m:
                    ip_end = m.end()
                    if all(map(_small, m.groups())):
                        found.append((last, 1, ip_end))
        elif kind == "at":
            m = _DOMAIN.match(text, last)
            if m:
                start = last
                while start > email_end and text[start - 1] in _LOCAL_PART:
                    start -= 1
                if start < last:
                    email_end = m.end()
                    found.append((start, 0, email_end))
        elif kind == "plus":
            m = _PHONE.match(text, last)
            if m and 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((last, 3, m.end()))
        elif kind == "secret":
            m = _SECRET.match(text, last + 1)
            if m and any(c.isdigit() for c in m[1]) and any(c.isalpha() for c in m[1]):
                found.append((m.start(1), 4, m.end(1)))
        elif kind == "scheme":
            m = _USERINFO.match(text, last + 1)
            if m:
                found.append((last + 1 - length, 6, m.end()))
        else:
            before = last - length
            if before < 0 or not lowered[before].isalnum():
                span = _identifier(text, last + 1, kind)
                if span:
                    found.append((span[0], 5, span[1]))
    return sorted(set(found))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``kinds``, ``starts``, ``ends``: aligned arrays, ordered by
    start, then kind."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def make():
        def run(batch: pa.RecordBatch):
            kinds, starts, ends = [], [], []
            for data in common.text_bytes(batch.column(1)):
                spans = spans_of((data or b"").decode("utf-8", "replace"))
                starts.append([s for s, _, _ in spans])
                kinds.append([KINDS[k] for _, k, _ in spans])
                ends.append([e for _, _, e in spans])
            return {id_col: batch.column(0), "kinds": kinds, "starts": starts, "ends": ends}

        return run

    return common.map_rows(docs, [id_col, text_col], f"`{id_col}` {id_type}, kinds array<string>, starts array<bigint>, ends array<bigint>", make)


def count_kind(kind: str) -> Column:
    return F.size(F.filter("kinds", lambda k: k == kind)).cast("bigint")


def joined_spans(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of the spans of some kinds, comma-joined."""
    rows = F.filter(F.arrays_zip("kinds", "starts", "ends"), lambda s: s["kinds"].isin(*kinds))
    return F.concat_ws(",", F.transform(rows, lambda s: F.concat_ws(":", s["kinds"], s["starts"].cast("string"), s["ends"].cast("string"))))


def masked(text: str) -> str:
    """The text with every span replaced by its kind, as ``<EMAIL>``."""
    out, at = [], 0
    for start, kind, end in spans_of(text):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns, personal data in ``text_col`` masked."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def mask_texts(texts):
        return texts.map(masked, na_action="ignore")

    common.on_workers(docs.sparkSession)
    return docs.withColumn(text_col, mask_texts(F.col(f"`{text_col}`")))
