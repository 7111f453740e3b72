"""Similarity of many labels with a fixed list of variants at once: the scores of ``similarity``, by arrays.

Texts are rows of letter numbers, letters that no variant has being 0. The longest common subsequence of many pairs is found side by side: one
row of bits a pair, in lanes of 64, and one step for each letter of the longer texts. Before that, counts of letters and shared words bound each pair's
score, and only pairs that can reach the best found so far are compared; nothing here runs once a pair.
"""

from __future__ import annotations

import numpy as np

#: Pairs of a label that are compared first, rows of bits that are held at once, and labels of a block.
FIRST, ROWS, BLOCK = 4, 1 << 15, 1024


class Letters:
    """Numbers of the letters that a list of texts has, from 1."""

    def __init__(self, texts: list[str]):
        self.known = np.unique(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32))
        self.size = len(self.known) + 1

    def rows(self, texts: list[str]) -> Rows:
        lengths = np.array([len(t) for t in texts], np.int64)
        flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.minimum(np.searchsorted(self.known, flat), max(len(self.known) - 1, 0))
        codes = np.where(self.known[at] == flat, at + 1, 0) if len(self.known) else np.zeros(len(flat), np.int64)
        grid = np.zeros((len(texts), int(lengths.max(initial=0))), np.int16)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        grid[np.repeat(np.arange(len(texts)), lengths), place] = codes
        return Rows(grid, lengths, self.size)


class Rows:
    """Texts as numbers of letters, padded with 0, their lengths, and how often each has each letter."""

    def __init__(self, grid: np.ndarray, lengths: np.ndarray, size: int):
        self.grid, self.lengths, self.size = grid, lengths, size
        self._counts: np.ndarray | None = None
        self._masks: list[np.ndarray] | None = None
        self._reversed: Rows | None = None

    def reversed(self) -> Rows:
        if self._reversed is None:
            at = self.lengths[:, None] - 1 - np.arange(self.grid.shape[1])[None, :]
            self._reversed = Rows(np.where(at >= 0, np.take_along_axis(self.grid, np.maximum(at, 0), axis=1), 0), self.lengths, self.size)
        return self._reversed

    def counts(self) -> np.ndarray:
        if self._counts is None:
            n = len(self.grid)
            flat = self.grid.astype(np.int64) + np.arange(n)[:, None] * self.size
            self._counts = np.bincount(flat.ravel(), minlength=n * self.size).reshape(n, self.size).astype(np.int32)
            self._counts[:, 0] = 0
        return self._counts

    def masks(self) -> list[np.ndarray]:
        """For each lane: the places of each letter in each text, as bits."""
        if self._masks is None:
            n, width = self.grid.shape
            self._masks = [np.zeros((n, self.size), np.uint64) for _ in range(-(-max(width, 1) // 64))]
            for k in range(width):
                self._masks[k // 64][np.arange(n), self.grid[:, k]] |= np.uint64(1) << np.uint64(k % 64)
            for lane in self._masks:
                lane[:, 0] = 0
        return self._masks


class Running:
    """Longest common subsequences of texts at[p] of ``bits`` with rows of numbers that are given letter by letter."""

    def __init__(self, bits: Rows, at: np.ndarray):
        self.masks = [m.ravel() for m in bits.masks()]
        self.base = at.astype(np.int64) * bits.size
        self.rows = [np.full(len(at), ~np.uint64(0)) for _ in self.masks]
        self.inside = [_below(bits.lengths[at], w) for w in range(len(self.masks))]

    def take(self, letters: np.ndarray) -> None:
        place, carry = self.base + letters, None
        for w, mask in enumerate(self.masks):
            row = self.rows[w]
            hit = mask.take(place)
            hit &= row
            total = row + hit
            if len(self.masks) > 1:
                over = total < row
                if carry is not None:
                    total += carry
                    over |= total < carry
                carry = over.astype(np.uint64)
            row -= hit
            row |= total

    def lengths(self) -> np.ndarray:
        return sum(np.bitwise_count(~row & own).astype(np.int64) for row, own in zip(self.rows, self.inside, strict=True))


def common(bits: Rows, at: np.ndarray, stream: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of text at[p] of ``bits`` with row p of numbers."""
    run = Running(bits, at)
    for k in range(stream.shape[1]):
        run.take(stream[:, k])
    return run.lengths()


def _below(lengths: np.ndarray, lane: int) -> np.ndarray:
    """The bits of a lane that lie within the texts."""
    inside = np.clip(lengths - 64 * lane, 0, 64).astype(np.uint64)
    return np.where(inside == 64, ~np.uint64(0), (np.uint64(1) << (inside & np.uint64(63))) - np.uint64(1))


def _percent(found: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.where(total > 0, 200 * found / np.maximum(total, 1), 100.0)


def ratios(a: Rows, i: np.ndarray, b: Rows, j: np.ndarray) -> np.ndarray:
    out = np.zeros(len(i))
    for k in range(0, len(i), ROWS):
        own, other = i[k : k + ROWS], j[k : k + ROWS]
        stream = a.grid[own][:, : int(a.lengths[own].max(initial=0))]
        out[k : k + ROWS] = _percent(common(b, other, stream), a.lengths[own] + b.lengths[other])
    return out


def partial_ratios(a: Rows, i: np.ndarray, b: Rows, j: np.ndarray) -> np.ndarray:
    """The best ratio of the shorter text with a window of the longer, windows cut off at the ends included."""
    out = np.zeros(len(i))
    flip = a.lengths[i] > b.lengths[j]
    for short, s, long, t, own in ((a, i, b, j, np.flatnonzero(~flip)), (b, j, a, i, np.flatnonzero(flip))):
        n, m = short.lengths[s[own]], long.lengths[t[own]]
        out[own[n == 0]] = np.where(m[n == 0] == 0, 100.0, 0.0)
        own, n, m = own[n > 0], n[n > 0], m[n > 0]
        windows = n + m - 1
        cuts = np.searchsorted(np.cumsum(windows), np.arange(ROWS, int(windows.sum()) + ROWS, ROWS), side="right")
        for low, high in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(own)])), strict=True):
            if low < high:
                part = own[low:high]
                out[part] = _best_window(short, s[part], long, t[part], n[low:high], m[low:high], windows[low:high])
    return out


def _best_window(short: Rows, s: np.ndarray, long: Rows, t: np.ndarray, n: np.ndarray, m: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Windows that an end cuts off are prefixes and suffixes, each of which one run meets in turn; the others are runs of their own."""
    most = int(n.max())
    best = np.zeros(len(s))
    for bits, stream in ((short, long), (short.reversed(), long.reversed())):
        run = Running(bits, s)
        for k in range(1, most):
            run.take(stream.grid[t, k - 1] if k <= stream.grid.shape[1] else 0)
            best = np.maximum(best, np.where(k < n, 200 * run.lengths() / (n + k), 0))
    whole = m - n + 1
    of = np.repeat(np.arange(len(s)), whole)
    place = t[of] * long.grid.shape[1] + np.arange(len(of)) - np.repeat(np.cumsum(whole) - whole, whole)
    run, letters, last = Running(short, s[of]), long.grid.ravel(), long.grid.size - 1
    for k in range(most):
        own = letters.take(np.minimum(place + k, last))
        own[k >= n[of]] = 0
        run.take(own)
    found = 200 * run.lengths() / (2 * n[of])
    return np.maximum(best, np.maximum.reduceat(found, np.cumsum(whole) - whole))


class Tokens:
    """Words of texts: the texts with sorted words, with sorted distinct words, and which known words each has."""

    def __init__(self, texts: list[str], letters: Letters, known: dict[str, int]):
        split = [t.split() for t in texts]
        self.distinct = [sorted(set(x)) for x in split]
        self.sorted = letters.rows([" ".join(sorted(x)) for x in split])
        self.unique = letters.rows([" ".join(x) for x in self.distinct])
        self.some = np.array([bool(x) for x in split], bool)
        n, most = len(texts), max(map(len, self.distinct), default=0)
        self.ids = np.full((n, most + 1), -1)
        self.has = np.zeros((n, len(known) + 1), bool)  # the last: words that are not known
        sizes = np.zeros((n, most), np.int64)
        for k, x in enumerate(self.distinct):  # once a text
            self.ids[k, : len(x)] = [known.get(w, -1) for w in x]
            sizes[k, : len(x)] = [len(w) for w in x]
        rows, at = np.nonzero(self.ids >= 0)
        self.has[rows, self.ids[rows, at]] = True
        # The word that each letter of ``unique`` is part of; the blank after a word counts as its own.
        ends = np.cumsum(sizes + 1, axis=1) if most else np.zeros((n, 0), np.int64)
        places = np.arange(self.unique.grid.shape[1])
        self.word = (places[None, :, None] >= ends[:, None, :]).sum(axis=2) if most else np.zeros((n, len(places)), np.int64)
        self.word = np.minimum(self.word, most)

    def without(self, i: np.ndarray, other: Tokens, j: np.ndarray) -> Rows:
        """``unique`` of texts i without the words that texts j of the other have."""
        words = self.ids[i]
        gone = other.has[j[:, None], words] & (words >= 0)
        inside = np.arange(self.unique.grid.shape[1])[None, :] < self.unique.lengths[i][:, None]
        stays = inside & ~np.take_along_axis(gone, self.word[i], axis=1)
        order = np.argsort(~stays, axis=1, kind="stable")
        lengths = stays.sum(axis=1)
        grid = np.where(np.arange(stays.shape[1])[None, :] < lengths[:, None], np.take_along_axis(self.unique.grid[i], order, axis=1), 0)
        # Where the last word went, the blank before it stays behind.
        last = np.take_along_axis(order, np.maximum(lengths - 1, 0)[:, None], axis=1)[:, 0]
        blank = np.take_along_axis(self.word[i], np.minimum(last + 1, stays.shape[1] - 1)[:, None], axis=1)[:, 0] != np.take_along_axis(self.word[i], last[:, None], axis=1)[:, 0]
        blank &= (lengths > 0) & (last + 1 < self.unique.lengths[i])
        grid[np.flatnonzero(blank), lengths[blank] - 1] = 0
        return Rows(grid, lengths - blank, self.unique.size)


class Variants:
    """The fixed side: variants that labels are compared with."""

    def __init__(self, variants: list[str]):
        self.letters = Letters([*variants, " "])
        self.known = {w: k for k, w in enumerate(sorted({w for v in variants for w in v.split()}))}
        self.plain, self.tokens = self.letters.rows(variants), Tokens(variants, self.letters, self.known)

    def labels(self, labels: list[str]) -> tuple[Rows, Tokens]:
        return self.letters.rows(labels), Tokens(labels, self.letters, self.known)

    def scores(self, plain: Rows, tokens: Tokens, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The weighted ratio of labels i with variants j."""
        n, m = plain.lengths[i], self.plain.lengths[j]
        out = ratios(plain, i, self.plain, j)
        size = np.maximum(n, m) / np.maximum(np.minimum(n, m), 1)
        shared = (tokens.has[i] & self.tokens.has[j]).any(axis=1)
        near, far = np.flatnonzero(size < 1.5), np.flatnonzero(size >= 1.5)
        x, y = i[near], j[near]
        out[near] = np.maximum(out[near], 0.95 * np.maximum(ratios(tokens.sorted, x, self.tokens.sorted, y), self._set_ratios(tokens, x, y, shared[near])))
        x, y = i[far], j[far]
        scale = np.where(size[far] <= 8, 0.9, 0.6)
        by_words = np.full(len(far), 100.0)
        apart = np.flatnonzero(~shared[far])
        by_words[apart] = partial_ratios(tokens.sorted, x[apart], self.tokens.sorted, y[apart])
        out[far] = np.maximum(out[far], np.maximum(scale * partial_ratios(plain, x, self.plain, y), scale * 0.95 * by_words))
        out[(n == 0) | (m == 0)] = 0.0
        return out

    def _set_ratios(self, tokens: Tokens, i: np.ndarray, j: np.ndarray, shared: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i))
        some = tokens.some[i] & self.tokens.some[j]
        apart = np.flatnonzero(~shared & some)
        out[apart] = ratios(tokens.unique, i[apart], self.tokens.unique, j[apart])
        met = np.flatnonzero(shared & some)
        for k in range(0, len(met), ROWS):
            own = met[k : k + ROWS]
            a, b = tokens.without(i[own], self.tokens, j[own]), self.tokens.without(j[own], tokens, i[own])
            whole_a, whole_b = tokens.unique.lengths[i[own]], self.tokens.unique.lengths[j[own]]
            every = np.arange(len(own))
            # With the shared words in front on both sides: they, and the blank behind them, are common.
            head = whole_a - a.lengths - 1
            best = _percent(head + 1 + common(b, every, a.grid), whole_a + whole_b)
            best = np.maximum(best, np.maximum(_percent(head, head + whole_a), _percent(head, head + whole_b)))
            out[own] = np.where((a.lengths == 0) | (b.lengths == 0), 100.0, best)
        return out

    def bounds(self, plain: Rows, tokens: Tokens) -> np.ndarray:
        """No label's score with a variant is above: by the letters that they share, and whether they share a word."""

        def shared_letters(a: Rows, b: Rows) -> np.ndarray:
            x, y = a.counts(), b.counts()
            out = np.zeros((len(x), len(y)), np.int32)
            for c in range(1, a.size):
                out += np.minimum(x[:, c, None], y[None, :, c])
            return out

        def pairs(a: Rows, b: Rows) -> tuple[np.ndarray, np.ndarray]:
            """Bounds of the ratio, and of the partial ratio: a window holds no more of the common letters than there are."""
            found, n, m = shared_letters(a, b), a.lengths[:, None], b.lengths[None, :]
            return _percent(found, n + m), _percent(found, np.minimum(n, m) + found)

        n, m = plain.lengths[:, None], self.plain.lengths[None, :]
        size = np.maximum(n, m) / np.maximum(np.minimum(n, m), 1)
        scale = np.where(size < 1.5, 1.0, np.where(size <= 8, 0.9, 0.6))
        whole, part = pairs(plain, self.plain)
        by_sorted, by_sorted_part = pairs(tokens.sorted, self.tokens.sorted)
        by_set, _ = pairs(tokens.unique, self.tokens.unique)
        met = tokens.has.astype(np.float32) @ self.tokens.has.T.astype(np.float32) > 0
        near = np.maximum(whole, 0.95 * np.where(met, 100.0, np.maximum(by_sorted, by_set)))
        far = np.maximum(whole, scale * np.maximum(part, 0.95 * np.where(met, 100.0, by_sorted_part)))
        return np.where(size < 1.5, near, far) + 1e-9

    def best(self, labels: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number and score of each label's best variant, the first of equals."""
        found, score = np.zeros(len(labels), np.int64), np.zeros(len(labels))
        for k in range(0, len(labels), BLOCK):
            part = labels[k : k + BLOCK]
            plain, tokens = self.labels(part)
            bounds = self.bounds(plain, tokens)
            known = np.full(bounds.shape, -1.0)
            first = np.argpartition(-bounds, min(FIRST, bounds.shape[1] - 1), axis=1)[:, :FIRST]
            i = np.repeat(np.arange(len(part)), first.shape[1])
            known[i, first.ravel()] = self.scores(plain, tokens, i, first.ravel())
            i, j = np.nonzero((bounds >= known.max(axis=1)[:, None]) & (known < 0))
            known[i, j] = self.scores(plain, tokens, i, j)
            found[k : k + BLOCK], score[k : k + BLOCK] = known.argmax(axis=1), known.max(axis=1)
        return found, score


def partial_matrix(texts: list[str], names: list[str]) -> np.ndarray:
    """The partial ratio of each text with each name."""
    letters = Letters(names)
    a, b = letters.rows(texts), letters.rows(names)
    i, j = np.repeat(np.arange(len(texts)), len(names)), np.tile(np.arange(len(names)), len(texts))
    return partial_ratios(a, i, b, j).reshape(len(texts), len(names))
