import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from careerspark.functions.student_t import p_value, t_quantile
from careerspark.operators import stats


def xy(spark, xs, ys):
    return spark.createDataFrame([(float(a) if a is not None else None, float(b) if b is not None else None) for a, b in zip(xs, ys)], "x double, y double")


def test_correlation_and_line(spark):
    df = xy(spark, [1, 2, 3, None, 9], [2, 3, 5, 1, None])
    row = stats.pearson(df, "x", "y").first()
    assert row.n == 3 and (row.r, row.r2) == pytest.approx((.98198, .96429), abs=1e-5)
    assert row.t == pytest.approx(.98198 * math.sqrt(1 / (1 - .96429)), rel=1e-3)
    line = stats.ols(df, "x", "y").first()
    assert (line.slope, line.intercept) == pytest.approx((1.5, 1 / 3))


def test_perfect_and_hopeless_fits(spark):
    assert stats.pearson(xy(spark, [1, 2, 3, 4], [2, 4, 6, 8]), "x", "y").first().p == 0.0
    row = stats.pearson(xy(spark, [1, 2], [1, 3]), "x", "y").first()
    assert row.t is None and row.p is None
    assert stats.ols_band(xy(spark, [1, 2], [1, 3]), "x", "y").count() == 0


@pytest.mark.parametrize("t,dof,p", [(12.7062, 1, .05), (4.30265, 2, .05), (2.22814, 10, .05), (2.63, 90, .01004), (1.959964, 1e7, .05), (0.0, 5, 1.0), (6.31375, 1, .1)])
def test_t_distribution(spark, t, dof, p):
    row = spark.range(1).select(p_value(F.lit(t), F.lit(float(dof))).alias("p"), t_quantile(.05, F.lit(float(dof))).alias("q")).first()
    assert row.p == pytest.approx(p, rel=2e-3)
    if p == .05:
        assert row.q == pytest.approx(t, rel=1e-4)


def test_confidence_band(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 10, 60)
    y = 2 + .5 * x + rng.normal(size=60)
    band = stats.ols_band(xy(spark, x, y), "x", "y", grid=5).orderBy("point").collect()
    slope, intercept = np.polyfit(x, y, 1)
    s = math.sqrt(((y - intercept - slope * x) ** 2).sum() / 58)
    for b in band:
        half = 2.001717 * s * math.sqrt(1 / 60 + (b.x - x.mean()) ** 2 / ((x - x.mean()) ** 2).sum())
        assert (b.fit, b.lower, b.upper) == pytest.approx((intercept + slope * b.x, intercept + slope * b.x - half, intercept + slope * b.x + half), rel=1e-5)
    assert (band[0].x, band[-1].x) == pytest.approx((x.min(), x.max()))


def _quantiles(values):
    return np.quantile(values, [.1, .5, .75])


@pytest.mark.parametrize("cut", [False, True])
def test_exact_quantiles(spark, cut, request):
    if cut:
        request.getfixturevalue("small_groups")
    rng = np.random.default_rng(2)
    data = {"a": rng.normal(size=1500), "b": np.round(rng.normal(size=40), 1), "c": np.array([3.0])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in data.items() for v in vs] + [("a", None)], "g string, v double")
    for row in stats.exact_quantiles(df, "v", {"p10": .1, "p50": .5, "p75": .75}, ["g"]).collect():
        assert row[1:] == pytest.approx(tuple(_quantiles(data[row.g])))
    row = stats.exact_quantiles(df, "v", {"p10": .1, "p50": .5, "p75": .75}).first()
    assert tuple(row) == pytest.approx(tuple(_quantiles(np.concatenate(list(data.values())))))


def _density(values, at):
    q1, q3 = np.quantile(values, [.25, .75])
    h = .9 * min(statistics.stdev(values), (q3 - q1) / 1.34) * len(values) ** -.2
    return np.exp(-.5 * ((at[:, None] - values[None, :]) / h) ** 2).sum(axis=1) / (len(values) * h * math.sqrt(2 * math.pi))


def test_density_is_close_to_the_exact_sum_and_integrates_to_one(spark):
    rng = np.random.default_rng(3)
    data = {"a": rng.normal(0, .03, 400), "b": rng.normal(.02, .05, 100)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in data.items() for v in vs], "g string, v double")
    out = stats.kde(df, "v", ["g"]).toPandas()
    for g, values in data.items():
        one = out[out.g == g].sort_values("point")
        exact = _density(values, one.x.to_numpy())
        assert np.abs(one.density.to_numpy() - exact).max() < 1e-3 * exact.max()
    inside = stats.kde(df, "v", ["g"], limits=(-1.0, 1.0)).toPandas()
    for g in data:
        one = inside[inside.g == g].sort_values("point")
        assert np.trapezoid(one.density, one.x) == pytest.approx(1.0, abs=1e-3)


def test_a_far_outlier_does_not_spoil_the_density(spark):
    values = np.concatenate([np.random.default_rng(5).normal(0, .03, 300), [2.0]])
    out = stats.kde(spark.createDataFrame([(float(v),) for v in values], "v double"), "v").toPandas().sort_values("point")
    exact = _density(values, out.x.to_numpy())
    assert len(out) == 512 and np.abs(out.density.to_numpy() - exact).max() < 1e-3 * exact.max()
    far = stats.kde(spark.createDataFrame([(float(v),) for v in [*values, 1e6]], "v double"), "v").toPandas().sort_values("point")
    assert len(far) == 512 and far.density.iloc[-1] > 0 and (far.density.iloc[5:-5] == 0).all()


def test_density_drops_values_outside_the_limits_first(spark):
    df = spark.createDataFrame([(v,) for v in (-.1, 0.0, .1, 5.0)], "v double")
    a = stats.kde(df, "v", limits=(-.15, .15)).orderBy("point").collect()
    b = stats.kde(df.filter("v < 1"), "v", limits=(-.15, .15)).orderBy("point").collect()
    assert a == b and len(a) == 512


def test_constant_values_have_a_bandwidth(spark):
    df = spark.createDataFrame([(2.0,)] * 4, "v double")
    assert stats.bandwidth(df, "v").first().bw == pytest.approx(.9 * 2.0 * 4 ** -.2)
    assert stats.kde(df, "v").filter("density IS NULL").count() == 0


def test_tail_share_and_scatter(spark):
    df = xy(spark, [-.2, .05, .1, None], [1, 2, None, 3])
    assert stats.tail_share(df, "x", .1).first().tail_share == 2 / 3
    assert stats.scatter(df, "x", "y").count() == 2


@pytest.mark.parametrize("steps", [4, 32])
def test_densities_keep_the_error_that_they_state(spark, steps):
    rnd = random.Random(3)
    rows = [(k % 2, rnd.gauss(k % 2, 1 + k % 2)) for k in range(300)] + [(0, 1e8)]
    df = spark.createDataFrame(rows, "g int, v double")
    widths = stats.bandwidth(df, "v", ["g"])
    got = stats.kde(df, "v", ["g"], n=64, steps=steps, errors=True, grid=(-4.0, 5.0))
    met = got.join(stats.kernel_sums(df, "v", got.select("g", "point", "x"), ["g"], widths), ["g", "point"]).collect()
    assert len(met) == 128 and all(abs(r.density - r.exact) <= r.error for r in met) and any(abs(r.density - r.exact) > r.error / 50 for r in met)


def test_densities_read_their_table_once(spark, tmp_path):
    spark.createDataFrame([(k % 2, float(k % 17)) for k in range(100)], "g int, v double").write.parquet(str(tmp_path / "values"))
    df = spark.read.parquet(str(tmp_path / "values"))
    text = stats.kde(df, "v", ["g"])._jdf.queryExecution().executedPlan().toString()
    assert str(tmp_path) not in text and "FileScan" in text     # all but the first pass reads the counts
