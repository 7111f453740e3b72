"""A gated recurrent network over word numbers in numpy: truncated backpropagation, and an output softmax factored by classes.

Number 0 is the end of a text, then come the frequent words by rank; all other words share one class, the last, and are told apart
as inputs by BUCKETS hash rows. The probability of a frequent word is that of its class times its own within the class; of another word it is that of the
last class (what follows within that class is not the network's part). Output biases begin at the words' shares of the corpus, so
an untrained network is a unigram model.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np

#: Size of the state; words of a class; rows that words beyond the frequent ones are hashed to as inputs; steps of a window in training and in scoring.
STATE, CLASS, BUCKETS, WINDOW, SCORE_WINDOW = 32, 64, 64, 32, 128
#: Texts that run side by side in training and in scoring; rate of learning.
LANES, SCORE_LANES, RATE = 256, 256, 0.1
#: Lanes in scoring that are run though a long text leaves some empty.
LEAST_LANES = 64
#: Words whose outputs are held at once, so that they stay in a processor's cache.
BLOCK = 2048
#: Size of logits whose exponentials neither overflow nor vanish.
CALM = 60.0


def exponentials(x: np.ndarray, calm: bool = False) -> tuple[np.ndarray, np.ndarray | float]:
    """In place, of the rows less their largest values; the rows' sums, and those values. calm: no row's largest value is beyond CALM either way, and nothing is taken off."""
    most: np.ndarray | float = 0.0
    if not calm:
        most = x.max(axis=1)
        x -= most[:, None]
    np.exp(x, out=x)
    return x @ np.ones(x.shape[1], x.dtype), most


class Network:
    """words: the numbers below this one have an output of their own; ``start`` is the input before a text's first word."""

    NAMES = ("inputs", "recur", "to_class", "class_bias", "to_word", "word_bias")

    def __init__(self, words: int, state: int = STATE):
        self.words, self.state = words, state
        self.classes = -(-words // CLASS)
        self.start = words + BUCKETS
        self.shapes = dict(zip(self.NAMES, ((self.start + 1, 3 * state), (state, 3 * state), (state, self.classes + 1), (self.classes + 1,), (self.classes, CLASS, state), (self.classes, CLASS)), strict=True))

    @classmethod
    def begun(cls, counts: np.ndarray, rest: float, state: int = STATE) -> Network:
        """counts: of each word with an output of its own; rest: of all others together. Biases are their shares, plus one each."""
        net = cls(len(counts), state)
        random = np.random.default_rng(17)
        own = np.zeros(net.classes * CLASS)
        own[: len(counts)] = counts + 1.0
        own = own.reshape(net.classes, CLASS)
        mass = np.append(own.sum(axis=1), rest + 1.0)
        net.inputs = random.normal(0, 0.3, net.shapes["inputs"]).astype(np.float32)
        net.recur = random.normal(0, 1 / math.sqrt(state), net.shapes["recur"]).astype(np.float32)
        net.to_class, net.to_word = (np.zeros(net.shapes[n], np.float32) for n in ("to_class", "to_word"))
        net.class_bias = np.log(mass / mass.sum()).astype(np.float32)
        with np.errstate(divide="ignore"):
            net.word_bias = np.maximum(np.log(own / own.sum(axis=1, keepdims=True)), -1e9).astype(np.float32)  # places of no word
        return net

    def packed(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def unpack(self, flat: np.ndarray) -> Network:
        at = 0
        for name, shape in self.shapes.items():
            size = math.prod(shape)
            setattr(self, name, flat[at : at + size].reshape(shape).astype(np.float32))
            at += size
        return self

    def calm(self) -> bool:
        """Whether all logits stay within CALM: a state's components are below one, so weights and biases bound them."""
        by_class = np.abs(self.to_class).sum(axis=0) + np.abs(self.class_bias)
        by_word = np.abs(self.to_word).sum(axis=2) + np.where(self.word_bias < -1e8, 0, np.abs(self.word_bias))
        return max(by_class.max(), by_word.max(initial=0)) < CALM

    def class_of(self, words: np.ndarray) -> np.ndarray:
        return np.where(words < self.words, words // CLASS, self.classes)

    def unfolded(self, given: np.ndarray) -> np.ndarray:
        """The inputs' rows of steps by lanes, by part: both gates, their sign turned, and the candidate."""
        rows = np.take(self.inputs, given.ravel(), axis=0).reshape(*given.shape, 3, self.state)
        out = np.ascontiguousarray(np.moveaxis(rows, 2, 0))
        np.negative(out[:2], out=out[:2])
        return out

    def turned(self) -> np.ndarray:
        """``recur`` by part, as ``unfolded``."""
        out = np.ascontiguousarray(self.recur.reshape(self.state, 3, self.state).transpose(1, 0, 2))
        np.negative(out[:2], out=out[:2])
        return out

    @staticmethod
    def step(given: np.ndarray, state: np.ndarray, turned: np.ndarray, part: np.ndarray, gates: np.ndarray, new: np.ndarray, after: np.ndarray) -> None:
        """Fills recurrent parts, gates, candidate and new state from the inputs' rows (``unfolded``) and the last state."""
        np.matmul(state, turned, out=part)
        np.add(given[:2], part[:2], out=gates)
        with np.errstate(over="ignore"):  # an exponential that overflows gives 0, as it should
            np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        np.multiply(gates[0], part[2], out=new)
        new += given[2]
        np.tanh(new, out=new)
        np.subtract(state, new, out=after)
        after *= gates[1]
        after += new

    def _biased(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of classes, and of words by class, that take the biases as those of one more component."""
        return np.vstack((self.to_class, self.class_bias)), np.concatenate((self.to_word, self.word_bias[:, :, None]), axis=2)

    def _by_class(self, states: np.ndarray, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """The places ``at`` in order of their words' classes: places, classes, numbers within the class, limits of the classes, states with one more component that is 1."""
        kind = self.class_of(words[at]).astype(np.min_scalar_type(self.classes))
        order = np.argsort(kind, kind="stable")
        at, kind = at[order], kind[order].astype(np.int64)
        given = np.ones((len(at), states.shape[1] + 1), states.dtype)
        given[:, :-1] = np.take(states, at, axis=0)
        return at, kind, words[at] - kind * CLASS, np.searchsorted(kind, np.arange(self.classes + 1)).tolist(), given

    @staticmethod
    def _blocks(kind: np.ndarray, limits: list[int]) -> Iterator[tuple[int, int, int, list[tuple[int, int, int]]]]:
        """Blocks of places in order of classes: low, high, the end of those whose word has an output of its own, and the classes among these with their limits."""
        for low in range(0, len(kind), BLOCK):
            high = min(low + BLOCK, len(kind))
            stop = max(low, min(high, limits[-1]))
            own = range(int(kind[low]), int(kind[stop - 1]) + 1) if stop > low else ()
            yield low, high, stop, [(c, max(limits[c], low), min(limits[c + 1], stop)) for c in own if limits[c] < limits[c + 1]]

    def log_probabilities(self, states: np.ndarray, words: np.ndarray, calm: bool = False) -> np.ndarray:
        """Natural logarithms of the probabilities of words (for words without an output of their own, of their class) after states."""
        at, kind, place, limits, given = self._by_class(states, words, np.arange(len(words)))
        to_class, to_word = self._biased()
        found = np.empty(len(at), states.dtype)
        for low, high, stop, classes in self._blocks(kind, limits):
            x = given[low:high] @ to_class
            chosen = x[np.arange(high - low), kind[low:high]]
            sums, most = exponentials(x, calm)
            found[low:high] = chosen - most - np.log(sums)
            if classes:
                x = np.empty((stop - low, CLASS), states.dtype)
                for c, a, b in classes:
                    np.matmul(given[a:b], to_word[c].T, out=x[a - low : b - low])
                chosen = x[np.arange(stop - low), place[low:stop]]
                sums, most = exponentials(x, calm)
                found[low:stop] += chosen - most - np.log(sums)
        out = np.empty_like(found)
        out[at] = found
        return out

    def _output_gradients(self, states: np.ndarray, words: np.ndarray, at: np.ndarray) -> tuple[float, dict, np.ndarray]:
        """Loss a word at the places, gradients of the outputs' parameters, and of all states."""
        scale, s, calm = states.dtype.type(1 / max(len(at), 1)), self.state, self.calm()
        at, kind, place, limits, given = self._by_class(states, words, at)
        to_class, to_word = self._biased()
        by_class, by_word = np.zeros_like(to_class), np.zeros((self.classes, CLASS, s + 1), states.dtype)
        back, loss, seen = np.empty((len(at), s), states.dtype), 0.0, []

        def errors(x: np.ndarray, wanted: np.ndarray) -> float:
            """Turns logits to errors; the loss."""
            rows = np.arange(len(x))
            chosen = x[rows, wanted]
            sums, most = exponentials(x, calm)
            x *= (scale / sums)[:, None]
            x[rows, wanted] -= scale
            return float((np.log(sums) + most - chosen).sum())

        for low, high, stop, classes in self._blocks(kind, limits):
            own = given[low:high]
            x = own @ to_class
            loss += errors(x, kind[low:high])
            by_class += own.T @ x
            np.matmul(x, self.to_class.T, out=back[low:high])
            x = np.empty((stop - low, CLASS), states.dtype)
            for c, a, b in classes:
                np.matmul(given[a:b], to_word[c].T, out=x[a - low : b - low])
            loss += errors(x, place[low:stop])
            for c, a, b in classes:
                part = x[a - low : b - low]
                by_word[c] += part.T @ given[a:b]
                back[a:b] += part @ self.to_word[c]
            seen += [c for c, *_ in classes]
        by_state = np.zeros_like(states)
        by_state[at] = back
        seen = sorted(set(seen))
        out = {"to_class": by_class[:-1], "class_bias": by_class[-1], "to_word": {c: by_word[c, :, :s] for c in seen}, "word_bias": {c: by_word[c, :, s] for c in seen}}
        return loss / max(len(at), 1), out, by_state

    def gradients(self, given: np.ndarray, words: np.ndarray, real: np.ndarray, state: np.ndarray) -> tuple[float, dict, np.ndarray]:
        """Loss a word, gradients and the state after a window; given (inputs), words and real (not padding) are steps by lanes.

        Gradients of inputs are (rows, values), of to_word and word_bias by class.
        """
        steps, lanes = given.shape
        s = self.state
        rows, turned = self.unfolded(given), self.turned()
        part, gates, new, states = np.empty_like(rows), np.empty_like(rows[:2]), np.empty_like(rows[0]), np.empty((steps + 1, lanes, s), rows.dtype)
        states[0] = state
        for t in range(steps):
            self.step(rows[:, t], states[t], turned, part[:, t], gates[:, t], new[t], states[t + 1])
        loss, out, by_state = self._output_gradients(states[1:].reshape(-1, s), words.ravel(), np.flatnonzero(real.ravel()))
        by_state = by_state.reshape(steps, lanes, s)
        rec, by_new = part, rows[2]  # gradients of the recurrent parts, and of the candidate, take the place of what they came from
        back, carry = np.ascontiguousarray(self.recur.reshape(s, 3, s).transpose(1, 2, 0)), np.zeros((lanes, s), rows.dtype)
        met, rest, slope = np.empty((3, lanes, s), rows.dtype), np.empty_like(carry), np.empty_like(carry)
        for t in range(steps - 1, -1, -1):
            d, reset, update = by_state[t], gates[0, t], gates[1, t]
            d += carry
            np.subtract(1, update, out=rest)
            rest *= d
            np.multiply(new[t], new[t], out=slope)
            np.subtract(1, slope, out=slope)
            np.multiply(slope, rest, out=by_new[t])
            np.subtract(1, reset, out=slope)
            slope *= reset
            slope *= part[2, t]
            np.multiply(slope, by_new[t], out=rec[0, t])
            np.subtract(states[t], new[t], out=slope)
            slope *= update
            np.multiply(slope, rest, out=rec[1, t])
            np.multiply(by_new[t], reset, out=rec[2, t])
            np.matmul(rec[:, t], back, out=met)
            np.multiply(d, update, out=carry)
            for k in range(3):
                carry += met[k]
        flat = states[:-1].reshape(-1, s).T
        out["recur"] = np.concatenate([flat @ rec[k].reshape(-1, s) for k in range(3)], axis=1)
        out["inputs"] = summed(given.ravel(), np.concatenate([x.reshape(-1, s) for x in (rec[0], rec[1], by_new)], axis=1), len(self.inputs))
        return loss, out, states[-1]


def summed(keys: np.ndarray, rows: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys (below the limit), and the sums of their rows; those of one row are not summed."""
    order = np.argsort(keys.astype(np.min_scalar_type(limit)), kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(starts, len(keys)))
    lone = sizes == 1
    several = ~np.repeat(lone, sizes)
    met = sizes[~lone]
    sums = np.add.reduceat(np.take(rows, order[several], axis=0), np.cumsum(met) - met, axis=0) if len(met) else rows[:0]
    return np.concatenate((keys[starts[lone]], keys[starts[~lone]])), np.concatenate((np.take(rows, order[starts[lone]], axis=0), sums))


class Learner:
    """Adaptive steps: each parameter's rate falls with the sum of its squared gradients."""

    def __init__(self, net: Network, rate: float = RATE):
        self.net, self.rate = net, np.float32(rate)
        self.sums = {n: np.full(shape, 1e-3, np.float32) for n, shape in net.shapes.items()}

    def _move(self, name: str, at, gradient: np.ndarray) -> None:
        g = np.clip(gradient, -1, 1)
        total = self.sums[name][at] + g * g
        self.sums[name][at] = total
        getattr(self.net, name)[at] -= self.rate * g / np.sqrt(total)

    def learn(self, pieces: list[np.ndarray], lanes: int = LANES, window: int = WINDOW) -> tuple[float, int]:
        """One pass over pieces of texts, each the input before it and then its words; loss summed over the words, and their number.

        Pieces of like length run side by side, window after window, the state carried from each to the next.
        """
        total, n = 0.0, 0
        batches = [sorted(pieces, key=len)[k : k + lanes] for k in range(0, len(pieces), lanes)]
        for k in np.random.default_rng(len(pieces)).permutation(len(batches)):
            batch = batches[k]
            longest = max(map(len, batch))
            grid, real = np.full((longest, len(batch)), self.net.start, np.int64), np.zeros((longest, len(batch)), bool)
            for i, x in enumerate(batch):
                grid[: len(x), i] = x
                real[1 : len(x), i] = True
            state = np.zeros((len(batch), self.net.state), np.float32)
            for at in range(0, longest - 1, window):
                stop = min(at + window, longest - 1)
                loss, found, state = self.net.gradients(grid[at:stop], grid[at + 1 : stop + 1], real[at + 1 : stop + 1], state)
                seen = int(real[at + 1 : stop + 1].sum())
                total, n = total + loss * seen, n + seen
                for name in ("recur", "to_class", "class_bias"):
                    self._move(name, ..., found[name])
                self._move("inputs", *found["inputs"])
                for name in ("to_word", "word_bias"):
                    if found[name]:
                        self._move(name, list(found[name]), np.stack(list(found[name].values())))
        return total, n


def text_scores(net: Network, words: np.ndarray, limits: np.ndarray, lanes: int = SCORE_LANES, window: int = SCORE_WINDOW) -> np.ndarray:
    """Natural logarithm of each text's probability; words of text i are words[limits[i]:limits[i + 1]].

    Whole texts run in lanes, one after the other in each; windows bound what is held, the state goes on from window to window.
    """
    sizes = np.diff(limits)
    out = np.zeros(len(sizes))
    order = np.argsort(-sizes, kind="stable")
    # As many lanes as are full until the longest text ends, and steps that make windows of like size.
    fit = int(sizes.sum()) // max(int(sizes.max(initial=0)), 1)
    lanes = max(1, min(lanes, len(sizes), max(fit, LEAST_LANES)))
    window *= max(1, SCORE_LANES // lanes)
    loads, dealt = [(0, k) for k in range(lanes)], [[] for _ in range(lanes)]
    for i in order:
        load, k = heapq.heappop(loads)
        dealt[k].append(int(i))
        heapq.heappush(loads, (load + int(sizes[i]), k))
    dealt = sorted((x for x in dealt if x), key=lambda own: -int(sizes[own].sum()))
    length = np.array([int(sizes[own].sum()) for own in dealt])
    of = [np.repeat(own, sizes[own]) for own in dealt]
    places = [np.concatenate([np.arange(limits[i], limits[i + 1]) for i in own]) for own in dealt]
    state = np.zeros((len(dealt), net.state), np.float32)
    firsts, calm, turned = limits[:-1], net.calm(), net.turned()
    for at in range(0, int(length.max(initial=0)), window):
        width = np.minimum(length - at, window)
        live = int((width > 0).sum())
        place = np.zeros((min(window, int(width[0])), live), np.int64)
        text, real = np.zeros_like(place), np.zeros(place.shape, bool)
        for k in range(live):
            w = int(width[k])
            place[:w, k], text[:w, k], real[:w, k] = places[k][at : at + w], of[k][at : at + w], True
        first = firsts[text] == place
        given = net.unfolded(np.where(first, net.start, words[np.maximum(place - 1, 0)]))
        states, now = np.empty((*place.shape, net.state), np.float32), state[:live]
        part, gates, new = np.empty_like(given[:, 0]), np.empty_like(given[:2, 0]), np.empty_like(given[0, 0])
        begun = first.any(axis=1).tolist()
        for t in range(len(place)):
            if begun[t]:
                now = np.where(first[t][:, None], np.float32(0), now)
            net.step(given[:, t], now, turned, part, gates, new, states[t])
            now = states[t]
        state[:live] = now
        out += np.bincount(text[real], net.log_probabilities(states[real], words[place[real]], calm), len(sizes))
    return out
