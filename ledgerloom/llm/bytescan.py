"""Vectorised scanning of UTF-8 text, shared by the corpus operators.

A batch of texts is laid end to end in one byte buffer; word limits and 64-bit word hashes come from a few numpy
passes over that buffer, so no Python statement runs per character or per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are handled in groups of about so many bytes, which bounds a worker's memory whatever the batch size.
GROUP_BYTES = 1 << 20

_SEED = np.random.default_rng(20_240_611)
_BYTE_CODES = _SEED.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def _space_separated() -> np.ndarray:
    table = np.ones(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


def _alphanumeric() -> np.ndarray:
    table = np.zeros(256, bool)
    table[0x30:0x3A] = table[0x61:0x7B] = table[0x80:] = True
    return table


#: Words of the class ``[^\x20\x09-\x0D]+``, and of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` with A-Z lower-cased.
SPACED, ALNUM = "spaced", "alnum"
#: Words of the first class with A-Z lower-cased.
LOWERED = "lowered"
#: Bytes that belong to such words.
_IN_WORD = {SPACED: _space_separated(), LOWERED: _space_separated(), ALNUM: _alphanumeric()}
#: bytes.translate table that lower-cases A-Z and blanks what is not in an ALNUM word.
FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if _IN_WORD[ALNUM][c] else 0x20 for c in range(256))
LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(16, int(n).bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def range_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the code sequences codes[start:end]; equal sequences have equal hashes wherever they stand."""
    up, down = powers(len(codes))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[np.minimum(starts, max(len(codes) - 1, 0))]) if len(starts) else np.zeros(0, np.uint64)


class Words:
    """Words of a group of texts: starts and ends in ``buffer``, ``bounds`` the range of word numbers of each text."""

    def __init__(self, texts: list[str | None], kind: str):
        raw = [b"" if t is None else t.encode() for t in texts]
        joined = b"\n".join(raw) + b"\n"
        self.raw = raw
        self.bytes = joined.translate(FOLD) if kind == ALNUM else joined.translate(LOWER) if kind == LOWERED else joined
        self.buffer = np.frombuffer(self.bytes, np.uint8)
        inside = np.zeros(len(self.buffer) + 2, np.int8)
        inside[1:-1] = _IN_WORD[kind][self.buffer]
        edges = np.diff(inside)
        self.starts, self.ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        self.text_starts = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw]))).astype(np.int64)
        self.bounds = np.searchsorted(self.starts, self.text_starts)

    def hashes(self) -> np.ndarray:
        return range_hashes(_BYTE_CODES[self.buffer], self.starts, self.ends)

    def text_of(self) -> np.ndarray:
        """The text's number for each word."""
        return np.repeat(np.arange(len(self.raw)), np.diff(self.bounds))


def gram_starts(bounds: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the words at which k words of one text begin."""
    n = int(bounds[-1])
    good = np.ones(n + 1, bool)
    for b in bounds[1:]:
        good[max(0, b - k + 1) : b] = False
    good[max(0, n - k + 1) :] = False
    return np.flatnonzero(good[:n])


def grams(hashes: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    return range_hashes(hashes, starts, starts + k)


def groups(batches: Iterator[pa.RecordBatch], text: str, limit: int = GROUP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts hold about ``limit`` bytes; a longer text stands alone."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)
        at = 0
        while at < batch.num_rows:
            taken = int(np.searchsorted(np.cumsum(sizes[at:]), limit, side="right"))
            taken = max(1, min(taken, batch.num_rows - at))
            yield batch.slice(at, taken)
            at += taken


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts_of(batch: pa.RecordBatch, name: str) -> list[str | None]:
    return column(batch, name).to_pylist()
