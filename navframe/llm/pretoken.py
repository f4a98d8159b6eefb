"""Pre-tokenisation without regular expressions.

The byte-level BPE pattern (contractions, letter, number and symbol runs with
an optional leading space, white space) is a small automaton over classes of
code points. A class acts on the automaton's states as a function; functions
compose associatively, so the state before every character is a prefix product.
The closure of the class functions under composition is finite (a monoid with a
few dozen elements), so a product is one table lookup, and the prefix products
of a whole chunk are computed block-wise in numpy: inside blocks, over the block
totals, then applied. Token starts follow from the state before a character, its
class and the class after it.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

# classes of code points
LETTER, SUFFIX1, SUFFIX_RV, SUFFIX_E, SUFFIX_L, NUMBER, APOSTROPHE, OTHER, SPACE, BLANK = range(10)
N_CLASSES = 10
# states: what the last character belongs to
BEGIN, IN_LETTERS, IN_NUMBER, IN_OTHER, AFTER_SPACE, AFTER_BLANK, APO, APO_RV, APO_L, SUFFIX_DONE = range(10)
N_STATES = 10

#: The White_Space code points other than U+0020.
WHITE_SPACE = (
    [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0xA0, 0x1680]
    + list(range(0x2000, 0x200B))
    + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)


def next_state(state: int, kind: int) -> int:
    if kind == NUMBER:
        return IN_NUMBER
    if kind == SPACE:
        return AFTER_SPACE
    if kind == BLANK:
        return AFTER_BLANK
    if kind == OTHER:
        return IN_OTHER
    if kind == APOSTROPHE:
        return IN_OTHER if state in (IN_OTHER, APO, AFTER_SPACE) else APO
    if state == APO:
        return {SUFFIX1: SUFFIX_DONE, SUFFIX_RV: APO_RV, SUFFIX_L: APO_L}.get(kind, IN_LETTERS)
    if (state, kind) in ((APO_RV, SUFFIX_E), (APO_L, SUFFIX_L)):
        return SUFFIX_DONE
    return IN_LETTERS


def starts_token(state: int, kind: int, follows: int) -> bool:
    """Whether a character of class ``kind`` starts a token.

    ``state`` is the state before it, ``follows`` the class after it (-1 at the
    end of the text).
    """
    blank = kind in (SPACE, BLANK)
    letter = kind <= SUFFIX_L
    if state == BEGIN or state == SUFFIX_DONE:
        return True
    if state in (AFTER_SPACE, AFTER_BLANK):
        if blank:  # the last white space before a word stands apart
            return follows not in (-1, SPACE, BLANK)
        return state == AFTER_BLANK
    if blank:
        return True
    if state in (IN_LETTERS, APO_RV, APO_L):
        return not letter
    if state == IN_NUMBER:
        return kind != NUMBER
    if state == IN_OTHER:
        return kind not in (OTHER, APOSTROPHE)
    # after an apostrophe that started a token
    if kind in (OTHER, APOSTROPHE, SUFFIX1):
        return False
    return (kind, follows) not in ((SUFFIX_RV, SUFFIX_E), (SUFFIX_L, SUFFIX_L))


@functools.cache
def class_table() -> np.ndarray:
    """Class of every code point, from the general category."""
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    category = unicodedata.category
    for code in range(0x110000):
        first = category(chr(code))[0]
        if first == "L":
            table[code] = LETTER
        elif first == "N":
            table[code] = NUMBER
    table[WHITE_SPACE] = BLANK
    table[0x20] = SPACE
    table[0x27] = APOSTROPHE
    for letters, kind in (("stmd", SUFFIX1), ("rv", SUFFIX_RV), ("e", SUFFIX_E), ("l", SUFFIX_L)):
        table[[ord(c) for c in letters]] = kind
    return table


@functools.cache
def unassigned_table() -> np.ndarray:
    """Code points whose category depends on the Unicode version in use."""
    table = np.zeros(0x110000, dtype=bool)
    for code in range(0x110000):
        if unicodedata.category(chr(code)) == "Cn":
            table[code] = True
    return table


@functools.cache
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, product, act) of the transition monoid.

    ``symbols[c]`` is the element of class ``c``; ``symbols[c + N_CLASSES]`` that
    of class ``c`` at the start of a text, which forgets what came before.
    ``product[a, b]`` is "a, then b"; ``act[a]`` is where ``a`` leads from BEGIN.
    """
    steps = [tuple(next_state(s, c) for s in range(N_STATES)) for c in range(N_CLASSES)]
    steps += [(next_state(BEGIN, c),) * N_STATES for c in range(N_CLASSES)]
    identity = tuple(range(N_STATES))
    elements = {identity: 0}
    queue = [identity]
    while queue:
        f = queue.pop()
        for g in steps:
            h = tuple(g[x] for x in f)
            if h not in elements:
                elements[h] = len(elements)
                queue.append(h)
    names = list(elements)
    product = np.array([[elements[tuple(g[x] for x in f)] for g in names] for f in names], dtype=np.uint16)
    return np.array([elements[g] for g in steps], dtype=np.uint16), product, np.array([f[BEGIN] for f in names], dtype=np.uint8)


def prefix_products(items: np.ndarray, product: np.ndarray, block: int = 64) -> np.ndarray:
    """Inclusive prefix products of monoid elements (0 is the identity)."""
    n, width = len(items), product.shape[0]
    flat = product.ravel()
    rows = -(-n // block)
    padded = np.zeros(rows * block, dtype=items.dtype)
    padded[:n] = items
    grid = np.ascontiguousarray(padded.reshape(rows, block).T)
    for j in range(1, block):
        grid[j] = flat[grid[j - 1].astype(np.int32) * width + grid[j]]
    if rows > 1:
        totals = grid[block - 1]
        before = np.zeros(rows, dtype=items.dtype)
        before[1:] = prefix_products(totals, product, block)[:-1]
        scaled = before.astype(np.int32) * width
        for j in range(block):
            grid[j] = flat[scaled + grid[j]]
    return np.ascontiguousarray(grid.T).ravel()[:n]


@functools.cache
def _start_table() -> np.ndarray:
    table = np.zeros((N_STATES, N_CLASSES, N_CLASSES + 1), dtype=bool)
    for s in range(N_STATES):
        for c in range(N_CLASSES):
            for f in range(-1, N_CLASSES):
                table[s, c, f] = starts_token(s, c, f)  # index -1 is the last cell
    return table


@functools.cache
def newer_class_table() -> np.ndarray:
    """The class table, with letters and numbers that this Python's Unicode
    tables don't know yet taken from the tables of the tiktoken library."""
    import tiktoken

    table = class_table().copy()
    unknown = "".join(map(chr, np.flatnonzero(unassigned_table()).tolist()))
    ranks = {bytes([i]): i for i in range(256)}
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER)):
        only = tiktoken.Encoding(pattern, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        table[[ord(c) for c in bytes(only.encode_ordinary(unknown)).decode()]] = kind
    return table


def token_starts(codes: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Positions where a token starts, over concatenated non-empty texts.

    ``codes`` are the code points of all texts, ``text_starts`` the position of
    each text's first one.
    """
    if not len(codes):
        return np.zeros(0, dtype=np.int64)
    symbols, product, act = monoid()
    newer = int(codes.max()) > 0x2FF and unassigned_table()[codes].any()
    kinds = (newer_class_table() if newer else class_table())[codes]
    first = np.zeros(len(codes) + 1, dtype=bool)
    first[text_starts] = True
    first[len(codes)] = True
    states = act[prefix_products(symbols[kinds + first[:-1] * np.uint8(N_CLASSES)], product)]
    before = np.full(len(codes), BEGIN, dtype=np.uint8)
    before[1:] = states[:-1]
    before[first[:-1]] = BEGIN
    follows = np.full(len(codes), N_CLASSES, dtype=np.uint8)
    follows[:-1] = kinds[1:]
    follows[first[1:]] = N_CLASSES
    width = N_CLASSES + 1
    cell = (before.astype(np.int32) * N_CLASSES + kinds) * width + follows
    return np.flatnonzero(_start_table().ravel()[cell])
