"""The byte-level tokenizers' word splitting as a finite-state machine.

The pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` is compiled to a
deterministic transducer over character classes. An output says that a word begins at the current character, at the one
before it, or both: one character of delay is all that the look-ahead and the contractions need.

Text runs through it in chunks side by side. Each chunk first gives its state map (the end state for every start state);
the maps compose by a parallel prefix scan; the start states found that way drive the pass that writes the outputs.
"""

from __future__ import annotations

import functools

import numpy as np
import regex

from .bytescan import range_hashes

FRESH, LETTERS, NUMBERS, OTHERS, SPACE, BLANK, SPACES, BLANKS, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L = range(12)
ONE, R, V, E, EL, LETTER, NUMBER, SP, WS, APOS, OTHER, END = range(12)
STATES = CLASSES = 12
HERE, BEFORE = 1, 2
CHUNK = 128
#: The white space of the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _start(c: int) -> int:
    if c <= LETTER:
        return LETTERS
    return {NUMBER: NUMBERS, SP: SPACE, WS: BLANK, APOS: QUOTE, OTHER: OTHERS, END: FRESH}[c]


def _run(state: int, c: int) -> tuple[int, int]:
    """Next state and output within or after a run of letters, numbers or other characters."""
    goes_on = {LETTERS: c <= LETTER, NUMBERS: c == NUMBER, OTHERS: c in (APOS, OTHER)}.get(state, False)
    return (state, 0) if goes_on else (_start(c), HERE)


def _step(state: int, c: int) -> tuple[int, int]:
    if c == END:
        return FRESH, HERE | (BEFORE if state in (QUOTE_R, QUOTE_V, QUOTE_L) else 0)
    if state in (FRESH, LETTERS, NUMBERS, OTHERS):
        return _run(state, c)
    if state in (SPACE, BLANK, SPACES, BLANKS):
        if c in (SP, WS):
            return (SPACES if c == SP else BLANKS), 0
        late = BEFORE if state in (SPACES, BLANKS) else 0
        if state in (SPACE, SPACES):  # the last space leads the word
            return (OTHERS if c == APOS else _start(c)), late
        return _start(c), late | HERE
    if state == QUOTE:
        if c == ONE:
            return FRESH, 0
        if c in (R, V, EL):
            return {R: QUOTE_R, V: QUOTE_V, EL: QUOTE_L}[c], 0
        return _run(OTHERS, c)
    if c == (EL if state == QUOTE_L else E):
        return FRESH, 0
    after, out = _run(LETTERS, c)
    return after, out | BEFORE


NEXT, OUT = (np.array([[_step(s, c)[k] for c in range(CLASSES)] for s in range(STATES)], np.uint8).reshape(-1) for k in (0, 1))
_NEXT_ROW = (NEXT * CLASSES).astype(np.uint8)


@functools.cache
def class_table() -> np.ndarray:
    """Class of each code point."""
    points = np.concatenate((np.arange(0xD800), np.arange(0xE000, 0x110000))).astype(np.uint32)
    text = points.tobytes().decode("utf-32-le")
    table = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for m in regex.finditer(pattern, text):
            table[points[m.start() : m.end()]] = kind
    table[WHITE_SPACE] = WS
    table[0x20] = SP
    for chars, kind in (("stmd", ONE), ("r", R), ("v", V), ("e", E), ("l", EL), ("'", APOS)):
        table[[ord(c) for c in chars]] = kind
    return table


@functools.cache
def _codes() -> np.ndarray:
    return np.random.default_rng(77).integers(1, 2**63, 0x110000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def state_maps(columns: np.ndarray) -> np.ndarray:
    """End state (times CLASSES) of each chunk for each start state. columns: classes, one chunk a column."""
    length, n = columns.shape
    now = np.tile(np.arange(STATES, dtype=np.uint8) * CLASSES, (n, 1))
    head = min(8, length)
    for j in range(head):
        now = _NEXT_ROW[now + columns[j][:, None]]
    one = (now == now[:, :1]).all(axis=1)  # most chunks forget their start at once
    single, rest = np.flatnonzero(one), np.flatnonzero(~one)
    lane, lanes = now[single, 0], now[rest]
    for j in range(head, length):
        lane = _NEXT_ROW[lane + columns[j][single]]
        if len(rest):
            lanes = _NEXT_ROW[lanes + columns[j][rest][:, None]]
    now[single] = lane[:, None]
    now[rest] = lanes
    return now


def start_states(maps: np.ndarray) -> np.ndarray:
    """State (times CLASSES) in which each chunk starts: the maps composed by a parallel prefix scan."""
    composed, step = maps // CLASSES, 1
    while step < len(composed):
        later = np.take_along_axis(composed[step:], composed[:-step].astype(np.intp), axis=1)
        composed = np.concatenate((composed[:step], later))
        step *= 2
    return np.concatenate(([FRESH], composed[:-1, FRESH])).astype(np.uint8) * np.uint8(CLASSES)


def word_starts(classes: np.ndarray) -> np.ndarray:
    """Positions at which words begin; each END is a position of its own."""
    n = len(classes)
    chunks = -(-n // CHUNK)
    padded = np.full(chunks * CHUNK, END, np.uint8)
    padded[:n] = classes
    columns = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T)
    state = start_states(state_maps(columns))
    out = np.empty_like(columns)
    for j in range(CHUNK):
        at = state + columns[j]
        out[j] = OUT[at]
        state = _NEXT_ROW[at]
    flat = out.T.reshape(-1)[:n]
    begins = flat & HERE > 0
    begins[:-1] |= flat[1:] & BEFORE > 0
    return np.flatnonzero(begins)


class Pretokens:
    """Words of texts: code points, starts, ends, 64-bit hashes, and the range of word numbers of each text."""

    def __init__(self, texts: list[str]):
        joined = "\n".join(texts) + "\n"
        self.raw = joined.encode()
        self.points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        self.text_starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))).astype(np.int64)
        classes = class_table()[self.points]
        classes[self.text_starts[1:] - 1] = END
        begins = word_starts(classes)
        ends = np.append(begins[1:], len(classes))
        real = classes[begins] != END
        self.starts, self.ends = begins[real], ends[real]
        self.bounds = np.searchsorted(self.starts, self.text_starts)
        self.hashes = range_hashes(_codes()[self.points], self.starts, self.ends)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes, the first word of each, and for each word the number of its hash."""
        return np.unique(self.hashes, return_index=True, return_inverse=True)

    def words(self, numbers: np.ndarray) -> list[bytes]:
        """The bytes of the words of these numbers."""
        at = np.zeros(len(self.points) + 1, np.int64)
        np.cumsum(1 + (self.points >= 0x80) + (self.points >= 0x800) + (self.points >= 0x10000), out=at[1:])
        raw = self.raw
        return [raw[a:b] for a, b in zip(at[self.starts[numbers]].tolist(), at[self.ends[numbers]].tolist(), strict=True)]

    def word(self, i: int) -> bytes:
        return self.points[self.starts[i] : self.ends[i]].tobytes().decode("utf-32-le").encode()
