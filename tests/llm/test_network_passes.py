"""The network's kernels: one step of the parameters of all classes, sums by row number, lanes beside a long text."""

import numpy as np

from ledgerloom.llm import gated_network as g


def test_parameters_of_all_classes_move_at_once(monkeypatch):
    net, moves, move = g.Network.begun(np.arange(300, 0, -1), 50, 8), [], g.Learner._move
    monkeypatch.setattr(g.Learner, "_move", lambda self, name, *a: (moves.append(name), move(self, name, *a)))
    before = net.to_word.copy()
    g.Learner(net).learn([np.arange(-1, 300) % net.start], window=300)
    assert sorted(moves) == sorted(net.NAMES) and (net.to_word != before).any(axis=(1, 2)).all()


def test_sums_by_key():
    rng = np.random.default_rng(4)
    for keys in (rng.integers(0, 40, 100), np.arange(9), np.zeros(5, np.int64)):
        rows = rng.normal(0, 1, (len(keys), 6))
        wanted = np.zeros((70_000, 6))
        np.add.at(wanted, keys, rows)
        used, sums = g.summed(keys, rows, 70_000)
        assert sorted(used) == sorted(set(keys.tolist())) and np.allclose(sums, wanted[used])


def test_a_long_text_beside_short_ones_takes_few_steps_of_few_lanes(monkeypatch):
    net, seen, step = g.Network.begun(np.arange(300, 0, -1), 50, 8), [], g.Network.step
    monkeypatch.setattr(g.Network, "step", staticmethod(lambda *a: (seen.append(len(a[1])), step(*a))))
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 300, n) for n in [3000, *[20] * 10_000]]
    limits = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    found = g.text_scores(net, np.concatenate(texts), limits)
    assert limits[-1] <= sum(seen) < 1.05 * limits[-1] and np.median(seen) >= g.LEAST_LANES
    apart = [0, 1, 5000]
    assert np.allclose(found[apart], [g.text_scores(net, texts[i], np.array([0, len(texts[i])]))[0] for i in apart], rtol=1e-5)
