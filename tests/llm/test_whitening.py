import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docketry.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, component string, n string, y string"


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(i, v, 1, "a", "b", "c") for i, v in rows], SCHEMA).repartition(parts)


def brute(rows, components=32):
    """Values by the definition, on whole numbers and with an eigenvalue routine for the whole covariance."""
    kept = [(i, [math.floor(64 * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max(len(v) for _, v in kept)
    x = [[c + 1_000_000 for c in v + [0] * (width - len(v))] for _, v in kept]
    n, sums = len(x), [sum(col) for col in zip(*x, strict=True)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums, strict=True)] for v in x])
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)
    k = min(components, int((values > values.max() * 1e-11).sum()))
    values, vectors = values[order][:k], vectors[:, order][:, :k]
    return [i for i, _ in kept], deviation, centred @ vectors / np.sqrt(values), values / np.trace(cov)


def compare(spark, rows, **how):
    out = whitening.whitened(frame(spark, rows), **how).collect()
    ids, deviation, white, explained = brute(rows)
    k = white.shape[1]
    assert len(out) == len(ids) * k
    got = {}
    for r in out:
        got.setdefault((r.vec_id, int(r.deviation)), {}).setdefault(r.component, []).append(r)
    assert {(i, d) for i, d in zip(ids, deviation, strict=True)} == set(got)
    sign = np.ones(k)
    first = next(iter(got))
    for c in range(k):
        at = max(range(len(ids)), key=lambda r: abs(white[r, c]))
        sign[c] = np.sign(white[at, c] * got[ids[at], deviation[at]][c + 1][0].whitened)
    for at, key in enumerate(zip(ids, deviation, strict=True)):
        for c in range(k):
            r = got[key][c + 1][0]
            assert r.n == len(ids) and abs(r.explained / explained[c] - 1) < 1e-9
            assert abs(r.whitened - sign[c] * white[at, c]) < 1e-7 * max(1, abs(white[at, c]))
            assert r.identity_error < 1e-9
    assert sorted(got[first]) == list(range(1, k + 1))


def sample(n, width, seed=1):
    rng = np.random.default_rng(seed)
    shape = rng.normal(0, 0.2, (width, width)) * np.linspace(1.5, 0.3, width)
    return [(k, (rng.normal(0, 1, width) @ shape + 0.4).tolist()) for k in range(n)]


ODD = [(900, None), (901, [float("nan")] * 40), (902, [0.1, None] * 20), (903, [float("inf")] * 40), (904, [0.5, -0.5]), (905, []), (None, [0.25] * 40)]


@pytest.mark.parametrize("fan", [2, 8])
def test_matches_the_definition(spark, fan):
    rows = sample(500, 40) + ODD
    compare(spark, [*rows, rows[3], (3, rows[4][1])], fan=fan)


def test_fewer_rows_than_entries(spark):
    compare(spark, sample(7, 40))


def test_narrow_vectors(spark):
    compare(spark, sample(100, 3))


def test_nothing_to_whiten(spark):
    columns = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], ODD[:4], [(1, [])], [(1, [0.5, 0.25])], [(1, [0.5, 0.25]), (2, [0.5, 0.25])]):
        out = whitening.whitened(frame(spark, rows))
        assert out.columns == columns and out.count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 9), st.integers(1, 40), st.sampled_from([1, 2, 50, 10**6]))
def test_updates_keep_the_eigenpairs(seed, width, n, top):
    """Small whole numbers give many equal eigenvalues and untouched directions."""
    rng = np.random.default_rng(seed)
    x = rng.integers(-top, top + 1, (n, width)) * (rng.random(width) < 0.8)
    own, other = whitening.Spectrum.empty(width), whitening.Spectrum.empty(width)
    for row in x[: n // 2]:
        own.add(row)
    for row in x[n // 2 :]:
        other.add(row)
    own.merge(other)
    centred = x - x.mean(axis=0)
    scatter = centred.T @ centred
    size = max(1.0, np.abs(scatter).max())
    assert own.n == n and (own.sums == x.sum(axis=0)).all()
    assert np.abs(own.basis.T @ own.basis - np.eye(width)).max() < 1e-12
    assert np.abs(scatter @ own.basis - own.basis * own.values).max() < 1e-12 * size * n
    assert (np.diff(own.values) >= 0).all()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.floats(1e-6, 1e6), st.floats(1e-5, 1e3), st.booleans()), min_size=1, max_size=12))
def test_roots_lie_between_the_poles(poles):
    d = np.cumsum([p[0] for p in poles])
    z = np.array([p[1] * (1 if p[2] else -1) for p in poles])
    roots, apart = whitening.secular_roots(d, z)
    assert (roots >= d).all() and (roots[:-1] <= d[1:]).all()
    want = np.linalg.eigvalsh(np.diag(d) + np.outer(z, z))
    assert np.abs(roots - want).max() <= 1e-12 * want.max()
    assert (np.diag(apart) < 0).all()
