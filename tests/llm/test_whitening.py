import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from timeloom.llm import whitening as W


def brute(vectors, components=32):
    """(covariance, values, vectors) by numpy's own solver, from exact sums."""
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(axis=0)
    off = n * x - s
    cov = np.array([[int(c) / n**3 for c in row] for row in off.T @ off])
    values, units = np.linalg.eigh(cov)
    return x, s, cov, values[::-1][:components], units.T[::-1][:components]


def same_vector(a, b):
    return min(np.abs(a - b).max(), np.abs(a + b).max())


def test_query_equals_numpy(spark, small):
    table = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    got = {(r.vec_id, r.component): r for r in W.op13_whitening(spark, small).collect()}
    x, s, cov, values, units = brute([r.embedding for r in table])
    n = len(x)
    assert len(got) == 32 * n and len({r.identity_error for r in got.values()}) == 1
    assert next(iter(got.values())).identity_error < 1e-9
    whitened = ((x - s / n).astype(float) @ units.T) / np.sqrt(values)
    for k in range(32):
        mine = np.array([got[r.vec_id, k + 1].whitened for r in table])
        assert same_vector(mine, whitened[:, k]) < 1e-6
        assert abs(got[table[0].vec_id, k + 1].explained / (values[k] / np.trace(cov)) - 1) < 1e-9
    for i, r in enumerate(table):
        assert {got[r.vec_id, k + 1].deviation for k in range(32)} == {sum(int(v) ** 2 for v in n * x[i] - s)} and got[r.vec_id, 1].n == n


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 12), st.integers(0, 2**32 - 1), st.sampled_from(["any", "repeated", "low", "close", "integer"]), st.integers(1, 12))
def test_eigenpairs(d, seed, kind, most):
    rng = np.random.default_rng(seed)
    basis = np.linalg.qr(rng.standard_normal((d, d)))[0]
    values = {
        "any": rng.random(d) * 100, "repeated": rng.integers(1, 3, d) * 1.0, "low": (rng.random(d) < 0.5) * rng.random(d),
        "close": 1 + 1e-12 * rng.random(d), "integer": rng.random(d),
    }[kind]
    a = basis * values @ basis.T
    a = np.diag(rng.integers(0, 3, d) * 1.0) if kind == "integer" else (a + a.T) / 2
    want = np.linalg.eigvalsh(a)[::-1]
    got, units = W.leading(a, most)
    rank = int((want > 1e-10 * max(want.sum(), 1e-300)).sum())
    assert len(got) == min(most, rank)
    assert np.abs(got - want[: len(got)]).max(initial=0) < 1e-9 * max(want[0], 1e-9)
    assert np.abs(units @ units.T - np.eye(len(got))).max(initial=0) < 1e-9
    assert np.abs(units @ a - got[:, None] * units).max(initial=0) < 1e-8 * max(want[0], 1e-9)


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 9), st.integers(0, 2**32 - 1), st.booleans())
def test_inertia_counts_eigenvalues(d, seed, whole):
    rng = np.random.default_rng(seed)
    a = rng.integers(-2, 3, (d, d)).astype(float) if whole else rng.standard_normal((d, d))
    a = a + a.T
    for shift in (-1.237, 0.0113, 0.731):
        assert W.inertia(a, shift) == (np.linalg.eigvalsh(a) > shift).sum()


KIND = "vec_id long, embedding array<float>, label int, n string, whitened double, v int, i int"


def rows(spark, vectors):
    return spark.createDataFrame([(None if i == 2 else i % 7, v, 1, "n", 0.5, 3, 4) for i, v in enumerate(vectors)], KIND)


def test_defined_cases(spark):
    rng = np.random.default_rng(1)
    good = [[float(c) for c in v] for v in rng.standard_normal((40, 5)).astype("f4")]
    bad = [None, [1.0, None, 2.0, 3.0, 4.0], [float("nan")] * 5, [1.0, float("inf"), 0.0, 0.0, 0.0]]
    hot = [good[0]] * 30
    df = rows(spark, [*good, *bad, *hot]).repartition(5)
    s = W.fit(df)
    _, _, _, values, _ = brute([*good, *hot])
    assert s.n == 70 and np.allclose(s.values, values)
    out = W.whiten(df, s).collect()
    assert len(out) == 70 and len({tuple(np.round(r.whitened, 12)) for r in out}) == 40 and sum(r.vec_id is None for r in out) == 1
    assert W.identity_error(df, s) < 1e-9
    for few in ([], bad, [good[0]], [good[0]] * 9, [[]] * 3):
        s = W.fit(rows(spark, few))
        assert len(s.values) == 0 and all(len(r.whitened) == 0 for r in W.whiten(rows(spark, few), s).collect())
        assert W.identity_error(rows(spark, few), s) == 0.0


def test_no_vectors_and_no_variance_give_no_rows(spark, tmp_path):
    for name, vectors in (("none", []), ("one", [[1.0, 2.0]]), ("same", [[1.0, 2.0]] * 3)):
        rows(spark, vectors).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        assert W.op13_whitening(spark, f"{tmp_path}/{name}").count() == 0


def test_short_and_large_vectors(spark):
    vectors = [[1.0, 2.0], [3.0], [], [0.5, 0.25, 8.0], [1e7, -1e7, 3.0], [-2.0, 1e9, 1e9]]
    s = W.fit(rows(spark, vectors))
    padded = [v + [0.0] * (3 - len(v)) for v in vectors]
    x, sums, cov, values, _ = brute(padded)
    assert np.allclose(s.values, values[: len(s.values)], rtol=1e-9) and abs(s.trace / np.trace(cov) - 1) < 1e-12
    got = W.whiten(rows(spark, vectors), s).collect()
    assert sorted(int(r.deviation) for r in got) == sorted(sum(int(v) ** 2 for v in len(x) * r - sums) for r in x)


@pytest.mark.parametrize("d", [1, 2, 64])
def test_products_are_exact(d):
    rng = np.random.default_rng(d)
    for most in (3, 10**6, 2**29, 2**31):
        a = rng.integers(-most, most, (50, d))
        got = W._products(a if most < 2**31 else a.astype(object))
        assert (got == a.astype(object).T @ a.astype(object)).all()
