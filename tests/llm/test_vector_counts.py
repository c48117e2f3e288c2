"""Exact link counts inside components, by cells, and links beside the threshold, against brute force."""

import numpy as np
import pyarrow as pa
import pytest

from raterlens.llm import vec_dedup

REACH = np.arccos(0.95)


def around(rng, centre, angle, n):
    """n unit vectors at angles up to ``angle`` from a centre."""
    side = rng.normal(size=(n, len(centre)))
    side -= (side @ centre)[:, None] * centre
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    a = rng.uniform(0, angle, n)[:, None]
    return np.cos(a) * centre + np.sin(a) * side


def unit(rng, dim):
    v = rng.normal(size=dim)
    return v / np.linalg.norm(v)


@pytest.fixture(scope="module")
def case(spark):
    rng = np.random.default_rng(4)
    one = unit(rng, 8)
    tight = around(rng, one, 0.2 * REACH, 900)                     # all pairs linked
    loose = around(rng, unit(rng, 8), 1.5 * REACH, 700)            # linked or not, cell by cell
    two = around(rng, one, 1e-9, 1)[0]
    far = np.concatenate([around(rng, two, 0.1 * REACH, 400), -around(rng, two, 0.1 * REACH, 400)])  # two far groups
    few = around(rng, unit(rng, 8), REACH, 30)
    x = np.concatenate([tight, loose, far, few])
    part = np.repeat([0, 900, 1600, 2400], [900, 700, 800, 30])
    mult = rng.integers(1, 4, len(x))
    ids = np.arange(len(x)) * 3 - 2000  # negative ids too
    vecs = spark.createDataFrame([(int(i), int(m), v.tolist()) for i, m, v in zip(ids, mult, x)],
                                 "id long, mult long, vec array<double>")
    parts = spark.createDataFrame([(int(i), int(ids[p])) for i, p in zip(ids, part)], "id long, component long")
    near = (x @ x.T >= 0.95) & (part[:, None] == part[None, :]) & ~np.eye(len(x), dtype=bool)
    return vecs, parts, dict(zip(ids.tolist(), zip((near @ mult).tolist(), near.sum(1).tolist())))


def test_counts_equal_those_of_all_pairs(case):
    vecs, parts, want = case
    got = {r.u: (r.links, r.vectors) for r in vec_dedup._count(parts, vecs, 0.95).collect()}
    assert got == want


def test_only_cells_that_straddle_the_threshold_meet(spark, case, monkeypatch):
    vecs, parts, _ = case
    rows = []
    plain = vec_dedup._multiplied
    monkeypatch.setattr(vec_dedup, "_multiplied", lambda d, n, t: rows.append(d.count()) or plain(d, n, t))
    clique = parts.filter("component = -2000")
    vec_dedup._count(clique, vecs, 0.95)
    assert rows == [0, 900]  # each vector once, for its own cell
    rows.clear()
    vec_dedup._count(parts.filter(f"component = {1600 * 3 - 2000}"), vecs, 0.95)
    assert rows[0] == 0 and rows[1] < 800 * 3


def test_rounding_bounds_the_error_of_short_vectors():
    rng = np.random.default_rng(9)
    for size in (1, 2, 8, 64, 700, 4096):
        x = rng.normal(size=(60, size))
        x[:20] = x[20:40] + rng.normal(size=(20, size)) * 0.01
        x[40:] = 1.0  # all components alike: the largest error of one sign
        x /= np.linalg.norm(x, axis=1)[:, None]
        column = pa.array([np.rint(v * vec_dedup.SHORT).astype("<i2").tobytes() for v in x])
        short = vec_dedup._short_matrix(column)
        assert short.shape == x.shape
        assert np.abs(short @ short.T - x @ x.T).max() <= vec_dedup.rounding(size)


def test_links_closer_to_the_threshold_than_the_rounding(spark):
    """Pairs a little above and a little below 0.95, which 16-bit vectors can't
    tell apart, are decided in double precision."""
    rng = np.random.default_rng(8)
    rows, want = [], []
    for k in range(240):
        a = unit(rng, 24)
        away = 10.0 ** -(4 + k % 8) * (1 if k % 2 else -1)
        side = rng.normal(size=24)
        side -= (side @ a) * a
        side /= np.linalg.norm(side)
        b = (0.95 + away) * a + np.sqrt(1 - (0.95 + away) ** 2) * side
        rows += [(2 * k, a.tolist()), (2 * k + 1, b.tolist())]
        want += [int(away > 0)] * 2
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in vec_dedup.embedding_duplicates(df).collect()}
    assert [got[i].n_links for i in range(480)] == want
    assert [got[i].component_id for i in range(480)] == [i - i % 2 if want[i] else i for i in range(480)]
