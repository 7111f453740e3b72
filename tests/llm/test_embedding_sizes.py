"""Vectors of any finite size link as their directions do."""

import numpy as np

from ledgerloom.llm import embedding_dedup


def test_very_large_and_very_small_vectors(spark):
    rng = np.random.default_rng(41)
    base = rng.standard_normal((60, 16))
    near = base + 0.15 * rng.standard_normal(base.shape)
    directions = np.concatenate([base, near])
    sizes = [1.0, 1e200, 1e-200, 1e307, 1e-300, 5e-320]
    rows = [(i, (v * sizes[i % len(sizes)] / np.abs(v).max()).tolist()) for i, v in enumerate(directions)]
    mixed = [0.0] * 15 + [1e-200]
    rows += [(500, mixed), (501, [0.0] * 15 + [5e-324]), (502, [1e200, *[0.0] * 14, 1e-200]), (503, [1e-200, *[0.0] * 15]), (504, [1e-170] * 16), (505, [0.0] * 16)]
    held = np.array([v for _, v in rows[:-1]])
    unit = np.ldexp(held, -np.frexp(np.abs(held).max(axis=1))[1][:, None])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.9
    np.fill_diagonal(close, False)
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    wanted = dict(zip([i for i, _ in rows[:-1]], close.sum(axis=1).tolist(), strict=True)) | {505: 0}
    assert len(got) == len(rows) and all(got[i] <= n for i, n in wanted.items())
    assert sum(got.values()) >= 0.95 * sum(wanted.values()) and got[500] == got[501] >= 1 and got[502] == got[503] >= 1 and got[505] == 0


def test_scaling_changes_no_digit():
    v = np.array([[3.0, -5.5, 0.1], [1e200, 3e199, -7e150], [5e-324, 0.0, -1e-323]])
    s = embedding_dedup.scaled(v)
    assert ((np.abs(s).max(axis=1) >= 0.5) & (np.abs(s).max(axis=1) < 1)).all()
    assert (s[0] * 8 == v[0]).all() and s[2].tolist() == [0.25, 0.0, -0.5]
