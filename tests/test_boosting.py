"""Histogram boosting against plain code, and its early stop."""

import numpy as np
import pytest

from marketloom.operators import boosting, ml


def plain(x, y, rounds, depth, rate, bins, least, l2):
    """The same trees row by row: every feature and cut tried on the rows of a node."""
    n, classes = len(y), 3
    counts = np.bincount(y, minlength=classes)
    w = (n / (classes * counts))[y]
    cuts = [sorted({float(np.quantile(c[~np.isnan(c)], i / bins)) for i in range(1, bins)}) for c in x.T]
    score = np.tile(np.log([1 / 3] * 3), (n, 1))

    def grow(rows, g, h, level):
        value = -rate * g[rows].sum() / (h[rows].sum() + l2)
        best = (0.0,)
        part = lambda r: g[r].sum() ** 2 / (h[r].sum() + l2)
        if level < depth:
            for f in range(x.shape[1]):
                for c in [-np.inf, *cuts[f]]:
                    left = rows[np.isnan(x[rows, f]) | (x[rows, f] <= c)]
                    right = np.setdiff1d(rows, left)
                    if len(left) >= least and len(right) >= least:
                        gain = round(part(left) + part(right) - part(rows), 5)
                        if gain > best[0]:
                            best = gain, left, right
        if best[0] <= 0:
            return [(rows, value)]
        return grow(best[1], g, h, level + 1) + grow(best[2], g, h, level + 1)

    for _ in range(rounds):
        p = np.exp(score) / np.exp(score).sum(axis=1, keepdims=True)
        for k in range(classes):
            for rows, value in grow(np.arange(n), w * (p[:, k] - (y == k)), w * p[:, k] * (1 - p[:, k]), 0):
                score[rows, k] += value
    return np.exp(score) / np.exp(score).sum(axis=1, keepdims=True)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(240, 3))
    x[::17, 1] = np.nan
    y = np.where(x[:, 0] > 0.5, 1, np.where(np.nan_to_num(x[:, 1]) < -0.5, 2, 0))
    rows = [(i, int(k), *(None if np.isnan(v) else float(v) for v in r)) for i, (k, r) in enumerate(zip(y, x))]
    return x, y, spark.createDataFrame(rows, "i int, label_code int, a double, b double, c double")


def test_trees_equal_plain_code_however_rows_are_spread(spark, table):
    x, y, df = table
    want = plain(x, y, 3, 2, 0.3, 8, 5, 1.0)
    for parts in (1, 5):
        model = boosting.fit(df.repartition(parts), ["a", "b", "c"], rounds=3, depth=2, bins=8)
        got = boosting.predict(df, model).orderBy("i").toPandas()
        np.testing.assert_allclose(got[list(boosting.NAMES)].to_numpy(), want, atol=2e-4)
        assert model.splits.sum() > 0 and model.gains[0] > model.gains[2]


def test_stop_on_the_validation_rows(spark, table):
    x, y, df = table
    noise = df.selectExpr("i", "cast(pmod(hash(i), 3) as int) as label_code", "a", "b", "c")
    model = boosting.fit(noise, ["a", "b", "c"], valid=noise.where("i < 0").unionByName(df), rounds=8, patience=2, depth=2)
    assert len(model.rounds) == int(np.argmin(model.losses)) < 8
    assert boosting.importances(spark, model).count() == 3


def test_odd_rows(spark, table):
    """No rows, one class, labels out of range and columns without values."""
    _, _, df = table
    none = boosting.fit(df.where("false"), ["a"], rounds=2)
    assert not none.rounds and boosting.predict(df, none).where("abs(p_long - 1e0 / 3) > 1e-9").count() == 0
    one = df.selectExpr("1 as label_code", "a", "cast(null as double) as b").unionByName(df.selectExpr("7 as label_code", "a", "b").limit(3))
    got = ml.fit_boosted(one, ["a", "b"], rounds=2, depth=2)(one).toPandas()
    assert (got.predicted == 1).all()
