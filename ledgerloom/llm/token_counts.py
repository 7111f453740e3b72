"""Token counts of a byte-level BPE tokenizer by finite-state compilation.

Words come from the transducer in pretokens.py, whose chunk state maps compose by a prefix scan. A word's bytes then run
through a second transducer, whose transitions carry the change of the number of emitted tokens; every word starts it anew, so its
map over a word is one number, and the counts of a text compose by a prefix sum.

A prefix ends in the one token whose pair with the token before it survives the merges. So of a prefix only this matters: its longest
ends that may still grow into a token, and for each of them the token before it and the number of tokens up to there, relative
to the prefix's own. Such a record is a state; there are finitely many, whatever the length of words, and prefixes that agree in it
share one. States and transitions are compiled on first use, into a table of bounded size; one that is full starts anew from
the current state. Words are told apart by 64-bit hashes within one slice of about 1 MB and by their bytes from slice to slice.

Defined cases: a null text counts as empty (no bytes, no tokens); special strings inside a text are one token each, as the
library has it by default; a very long text is a slice of its own and counted whole, a word of any length in the same bounded table; rows are
independent, so repeated rows, ties, null ids, empty tables and other columns, whatever their names, change nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytescan import column, groups, texts_of
from .pretokens import Pretokens
from .store import prepare

#: Bounds of what a worker keeps: transducer states, token pairs, distinct words.
MAX_STATES, MAX_PAIRS, MAX_WORDS = 300_000, 500_000, 1_000_000
#: Longer words, in bytes, are counted each time they are met.
LONG = 256
LIMIT = 1024


def byte_alphabet() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write for bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(moved)}


class Merges:
    """Vocabulary and merges of a tokenizer file for the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        self.ids = {raw(token): i for token, i in spec["model"]["vocab"].items()}
        self.bytes = {i: b for b, i in self.ids.items()}
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = (raw(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.ranks[self.ids[a], self.ids[b]] = rank, self.ids[a + b]
        self.special = [t["content"] for t in spec.get("added_tokens", ())]

    def merge(self, parts: list[int]) -> list[int]:
        while len(parts) > 1:
            best = min(((self.ranks[p][0], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in self.ranks), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [self.ranks[parts[i], parts[i + 1]][1]]
        return parts


class CountTransducer:
    """Deterministic transducer from bytes to changes of the token count, compiled state by state on first use.

    A state is the longest end of the prefix that may grow into a token, and for each such end, longest first: its length, the token
    before it (-1 at the word's start) and the count there less the count here.
    """

    START = (b"", ((0, -1, 0),))

    def __init__(self, merges: Merges):
        self.merges = merges
        self.growing = {token[:k] for token in merges.ids for k in range(1, len(token))}
        self.pairs: dict[tuple[int, int], bool] = {}
        self._reset(self.START)

    def _reset(self, *states: tuple) -> None:
        self.edges: dict[int, tuple[int, int]] = {}
        self.states, self.numbers = [], {}
        for state in (self.START, *states):
            self._number(state)

    def _number(self, state: tuple) -> int:
        number = self.numbers.setdefault(state, len(self.states))
        if number == len(self.states):
            self.states.append(state)
        return number

    def _survives(self, a: int, b: int) -> bool:
        """Whether the merges leave these two neighbours as they are."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            m = self.merges
            known = self.pairs[a, b] = m.merge([m.ids[bytes((c,))] for c in m.bytes[a] + m.bytes[b]]) == [a, b]
        return known

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        """The transition of a state on a byte: new state and change of the count."""
        end, live = self.states[state]
        end += bytes((byte,))
        grown = [(end[len(end) - length - 1 :], length, before, count) for length, before, count in live]
        for text, _, before, count in grown:
            token = self.merges.ids.get(text)
            if token is not None and (before < 0 or self._survives(before, token)):
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        change = count + 1
        kept = tuple((length + 1, before, count - change) for text, length, before, count in grown if text in self.growing)
        longest = kept[0][0] if kept else 0
        return self._number((end[len(end) - longest :], (*kept, (0, token, 0)))), change

    def count(self, word: bytes) -> int:
        total, edges, state = 0, self.edges, 0
        for byte in word:
            edge = edges.get(state << 8 | byte)
            if edge is None:
                if len(self.states) >= MAX_STATES:
                    now = self.states[state]
                    self._reset(now)
                    edges, state = self.edges, self.numbers[now]
                edge = edges[state << 8 | byte] = self._compile(state, byte)
            state, change = edge
            total += change
        return total


class Counter:
    """Counts tokens of texts, remembering distinct words."""

    def __init__(self, path: str):
        merges = Merges(path)
        self.transducer = CountTransducer(merges)
        self.known: dict[bytes, int] = {}
        self.special = regex.compile("|".join(map(regex.escape, sorted(merges.special, key=len, reverse=True)))) if merges.special else None

    def count(self, texts: list[str]) -> list[int]:
        owners, parts, extra = range(len(texts)), texts, [0] * len(texts)
        if self.special and any(self.special.search(t) for t in texts):
            owners, parts = [], []
            for i, t in enumerate(texts):
                pieces = self.special.split(t)
                extra[i] = len(pieces) - 1
                parts += pieces
                owners += [i] * len(pieces)
        words = Pretokens(parts)
        _, first, numbers = words.distinct()
        if len(self.known) > MAX_WORDS:
            self.known.clear()
        known, counts = self.known, np.empty(len(first), np.int64)
        for k, word in enumerate(words.words(first)):
            c = known.get(word)
            if c is None:
                c = self.transducer.count(word)
                if len(word) <= LONG:
                    known[word] = c
            counts[k] = c
        sums = np.concatenate(([0], np.cumsum(counts[numbers])))
        out = np.array(extra, np.int64)
        np.add.at(out, np.asarray(owners, np.int64), sums[words.bounds[1:]] - sums[words.bounds[:-1]])
        return out.tolist()


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit. ``tokenizer``: file of a byte-level BPE, there on every machine."""
    prepare(docs.sparkSession)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches, "text"):
            texts = [t or "" for t in texts_of(batch, "text")]
            sizes, tokens = [len(t.encode()) for t in texts], counter(tokenizer).count(texts)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return own.mapInArrow(count, T.StructType([T.StructField("doc_id", own.schema["doc_id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]))
