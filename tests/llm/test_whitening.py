"""Whitening against plain eigendecomposition of all rows."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from sportlake.llm import registry, whitening


@pytest.mark.parametrize("seed", range(60))
def test_rank_one_update(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 40))
    e = np.sort(rng.random(n) * 10)
    if seed % 3 == 0:
        e = np.round(e)  # equal eigenvalues
    if seed % 5 == 0:
        e[: n // 2] = 0.0
    e.sort()
    u = np.linalg.qr(rng.normal(size=(n, n)))[0]
    v = u[:, 0] * 3 if seed % 4 == 0 else rng.normal(size=n) * 10.0 ** rng.integers(-6, 6)
    weight = float(rng.random() * 5 + 0.1)
    want = u @ np.diag(e) @ u.T + weight * np.outer(v, v)
    got, turn = whitening.updated(e, u, v, weight)
    scale = np.abs(want).max()
    assert np.abs(turn @ np.diag(got) @ turn.T - want).max() <= 1e-12 * scale
    assert np.abs(turn.T @ turn - np.eye(n)).max() <= 1e-12
    assert (np.diff(got) >= -1e-12 * scale).all()


def test_spectra_of_parts_join():
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(300, 12)) * 20).astype(np.int64)
    x[200:] += 50  # another mean
    x[:, 3] = x[:, 4]  # without full rank
    parts = []
    for rows in (x[:7], x[7:8], x[8:8], x[8:200], x[200:]):
        parts.append(whitening.Spectrum(0, rows.sum(axis=0)))
        for r in rows:
            parts[-1].add(r, 1)
        if not len(rows):
            parts[-1] = whitening.Spectrum(0, np.zeros(12, np.int64))
    first, *more = parts
    for p in more:
        first.join(p)
    c = x - x.mean(axis=0)
    assert first.n == 300 and (first.total == x.sum(axis=0)).all()
    assert np.abs((first.u * first.e) @ first.u.T - c.T @ c).max() < 1e-8 * np.abs(c.T @ c).max()
    weighted = whitening.Spectrum(0, np.zeros(12, np.int64))
    for row, times in zip(*np.unique(np.repeat(x[:50], 3, axis=0), axis=0, return_counts=True), strict=True):
        weighted.add(row, int(times))
    c = np.repeat(x[:50], 3, axis=0) - x[:50].mean(axis=0)
    assert np.abs((weighted.u * weighted.e) @ weighted.u.T - c.T @ c).max() < 1e-8 * np.abs(c.T @ c).max()


def plain(vectors, most=32):
    """Whole numbers, eigenvalues, trace, deviations and whitened rows, all at once on one machine."""
    x = np.floor(64 * np.asarray(vectors, float)).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    c = x - total / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1][:most], v[:, ::-1][:, :most]
    deviation = [sum((int(n) * int(a) - int(s)) ** 2 for a, s in zip(row, total, strict=True)) for row in x]
    return e, float(np.trace(c.T @ c / n)), deviation, c @ v / np.sqrt(e)


def compared(rows, ids, vectors, most=32):
    e, trace, deviation, white = plain(vectors, most)
    at = {k: j for j, k in enumerate(ids)}
    assert len(rows) == len(ids) * len(e)
    signs = {}
    for r in rows:
        j, k = at[r["vec_id"]], r["component"] - 1
        assert r["n"] == len(ids) and r["deviation"] == deviation[j] == int(r["deviation_wide"])
        assert abs(r["explained"] - e[k] / trace) <= 1e-10 * e[k] / trace
        assert r["identity_error"] < 1e-10
        if abs(white[j, k]) > 1e-3:
            assert signs.setdefault(k, np.sign(r["whitened"] * white[j, k])) == np.sign(r["whitened"] * white[j, k])
        assert abs(abs(r["whitened"]) - abs(white[j, k])) < 1e-7
    return rows


def test_query_equals_plain_computation(spark, small):
    t = pq.read_table(f"{small}/embeddings.parquet")
    compared(registry.QUERIES["op13_whitening"](spark, small).collect(), t["vec_id"].to_pylist(), t["embedding"].to_pylist())


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    good = [(k, list(map(float, v))) for k, v in enumerate(rng.normal(size=(60, 5)).round(3))]
    good += [(100 + k, good[0][1]) for k in range(40)]  # a hot vector
    nan, inf = float("nan"), float("inf")
    odd = [(200, None), (201, [1.0, None, 1.0, 1.0, 1.0]), (202, [nan] * 5), (203, [inf, 0.0, 0.0, 0.0, 0.0]), (204, []), (205, [1.0, 2.0]), (206, [2.0**60] * 5)]
    rows = [(k, v, "x", 1, 2) for k, v in good + odd]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string, n int, component int").repartition(9)
    got = compared(whitening.whitened(df).collect(), [k for k, _ in good], [v for _, v in good])
    assert len(got) == 500
    again = {(r["vec_id"], r["component"]): r["whitened"] for r in whitening.whitened(df.coalesce(1)).collect()}
    assert all(abs(again[r["vec_id"], r["component"]] - r["whitened"]) < 1e-9 for r in got)
    repeated = df.filter("vec_id < 3").unionByName(df.filter("vec_id < 3")).unionByName(df.filter("vec_id = 4").selectExpr("CAST(NULL AS long) AS vec_id", "embedding", "id", "n", "component"))
    got = whitening.whitened(repeated).collect()
    assert len(got) == 7 * 3 and sum(r["vec_id"] is None for r in got) == 3  # four different vectors span three directions


def test_nothing_to_whiten(spark):
    schema = "vec_id string, embedding array<float>"
    for rows in ([], [("a", None)], [("a", [1.0, 2.0])], [("a", [1.0, 2.0]), ("b", [1.0, 2.0])]):
        out = whitening.whitened(spark.createDataFrame(rows, schema))
        assert out.count() == 0 and "vec_id" in out.columns


def test_wide_deviation():
    x = np.array([[5, 7], [2**38, 1], [-(2**38), 3]], np.int64)
    total = x.sum(axis=0)
    assert whitening.deviations(x, 3, total) == [sum((3 * int(a) - int(s)) ** 2 for a, s in zip(r, total, strict=True)) for r in x]
