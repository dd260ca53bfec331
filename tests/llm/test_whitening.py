import math

import numpy as np

from framelattice.llm import queries, whitening

from .conftest import SF


def plain(vectors):
    """(distinct integer vectors, means, covariance) by exact integers and numpy."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    d = np.array([[float(n * a - s) / n for a, s in zip(row, sums)] for row in fit])
    return x, n, sums, d.T @ d / n


def held(out, rows, most=16):
    """Every figure of the query against the plain version."""
    rows = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x, n, sums, cov = plain([v for _, v in rows])
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    rank = int((e > 1e-12 * e[0]).sum())
    assert len(out) == len(rows) * min(most, rank)
    want = {}
    for (i, _), v in zip(rows, x):
        d = np.array([float(n * a - s) / n for a, s in zip(v, sums)])
        want.setdefault(i, []).append((sum((n * a - s) ** 2 for a, s in zip(v, sums)), d))
    sign = {}
    for r in out:
        k = r["component"] - 1
        assert r["n"] == n and r["deviation"] in [d for d, _ in want[r["vec_id"]]] and r["identity_error"] <= 1e-9
        assert abs(r["explained"] / (e[k] / e.sum()) - 1) < 1e-9
        gap = min(abs(e[k] - e[j]) for j in range(len(e)) if j != k) / e[0]
        if gap > 1e-6:
            values = [float(d @ u[:, k] / math.sqrt(e[k])) for _, d in want[r["vec_id"]]]
            s = sign.setdefault(k, 1 if min(abs(r["whitened"] - v) for v in values) <= min(abs(r["whitened"] + v) for v in values) else -1)
            if all(abs(v) < 1e-7 for v in values):
                del sign[k]
            assert min(abs(s * r["whitened"] - v) for v in values) < 1e-6


def test_whole_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    out = [r.asDict() for r in queries.QUERIES["op11_whitening"](spark, SF).collect()]
    held(out, [(r["vec_id"], r["embedding"]) for r in table.collect()])


def run(spark, rows, tmp_path, extra=""):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    if extra:
        df = df.selectExpr("*", *extra.split(";"))
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    return [r.asDict() for r in queries.QUERIES["op11_whitening"](spark, str(tmp_path)).collect()]


def test_nulls_copies_other_sizes_and_clashes(spark, tmp_path):
    rng = np.random.default_rng(1)
    good = [(k, rng.normal(size=5).round(3).tolist()) for k in range(40)]
    good += [(100, good[0][1]), (0, good[0][1]), (101, good[3][1])]  # copies, a repeated row
    bad = [(200, None), (201, []), (202, [1.0, None, 0.0, 0.0, 0.0]), (203, [math.nan] * 5), (204, [math.inf, 0.0, 0.0, 0.0, 0.0]), (205, [1.0, 2.0]), (None, good[1][1])]
    out = run(spark, good + bad, tmp_path, "'c' AS whitened;1 AS deviation;2 AS _whitened2;3 AS dim")
    held(out, good + [(None, good[1][1])])
    assert all(r["vec_id"] is None or r["vec_id"] < 200 for r in out)


def test_dependent_dimensions(spark, tmp_path):
    """A repeated, a constant and a summed dimension leave two components."""
    rng = np.random.default_rng(2)
    rows = []
    for k in range(60):
        a, b = rng.integers(-500, 500, 2) / 64
        rows.append((k, [float(a), float(a), 3.0, float(a + b), float(b)]))
    out = run(spark, rows, tmp_path)
    assert {r["component"] for r in out} == {1, 2}
    held(out, rows)


def test_no_rows_and_no_variance(spark, tmp_path):
    assert run(spark, [], tmp_path / "a") == []
    assert run(spark, [(1, None)], tmp_path / "b") == []
    assert run(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])], tmp_path / "c") == []


def test_huge_values_stay_exact_or_null(spark, tmp_path):
    out = run(spark, [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [2.0**40, 5.0]), (4, [0.5, 9.0])], tmp_path)
    assert {r["vec_id"] for r in out} == {1, 2, 3, 4} and all(r["n"] == 4 for r in out)
    assert all(r["deviation"] is None for r in out)  # beyond a long
    assert all(math.isfinite(r["whitened"]) for r in out)


def test_factor_and_rotations():
    rng = np.random.default_rng(3)
    for d, r in ((1, 1), (7, 7), (12, 5)):
        b = rng.normal(size=(d, r)) * np.logspace(0, -5, r)
        a = b @ b.T
        low = whitening.pivoted_cholesky(a)
        assert np.abs(low @ low.T - a).max() <= 1e-13 * np.abs(a).max()
        e, u = whitening.one_sided_jacobi(low)
        assert np.allclose(u.T @ u, np.eye(u.shape[1]), atol=1e-10)
        assert np.allclose(e, np.linalg.eigvalsh(a)[::-1][:len(e)], rtol=1e-6, atol=1e-13 * np.abs(a).max())
    assert whitening.pivoted_cholesky(np.zeros((3, 3))).shape == (3, 0)
