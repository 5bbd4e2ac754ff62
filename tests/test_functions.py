"""Scans, quantiles and joins on skewed data against plain pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxfield.functions import geometry as G, quantile
from voxfield.functions.joins import lookup_join
from voxfield.functions.kernels import lower_envelope, sphere_bin
from voxfield.functions.quantile import exact_quantiles
from voxfield.functions.rng import normal, uniform
from voxfield.functions.scan import moving_average, ordered_row_numbers, running


@pytest.fixture(scope="module")
def skewed():
    """One group holds more than a third of the rows and one value a third of that group."""
    rng = np.random.default_rng(3)
    n = 3000
    group = np.where(rng.random(n) < 0.5, "hot", rng.choice(list("abc"), n))
    value = np.where(rng.random(n) < 0.3, 0.25, rng.exponential(1.0, n))
    frame = pd.DataFrame({"g": group, "v": value, "key": rng.permutation(n)})
    frame["pos"] = frame.sort_values("key").groupby("g").cumcount() + 1
    return frame


def test_row_numbers_follow_the_order_in_every_group(spark, skewed):
    out = ordered_row_numbers(spark.createDataFrame(skewed), ["g"], ["key"], "n").toPandas()
    assert len(out) == len(skewed)
    assert (out.n == out.pos).all()


def test_row_numbers_without_group(spark, skewed):
    out = ordered_row_numbers(spark.createDataFrame(skewed), [], ["key"], "n").toPandas()
    assert (out.n == out.key + 1).all()


@pytest.mark.parametrize("include", [True, False])
def test_running_maximum_over_blocks(spark, skewed, include):
    out = running(spark.createDataFrame(skewed), ["g"], "pos", "v", F.max, "m", include, block_rows=37).toPandas()
    out = out.sort_values(["g", "pos"])
    want = out.groupby("g").v.cummax()
    want = want if include else want.groupby(out.g).shift(1)
    assert np.allclose(out.m.astype(float), want, equal_nan=True)


def test_running_sum_over_blocks(spark, skewed):
    out = running(spark.createDataFrame(skewed), ["g"], "pos", "v", F.sum, "s", block_rows=50).toPandas().sort_values(["g", "pos"])
    assert np.allclose(out.s, out.groupby("g").v.cumsum())


@pytest.mark.parametrize("window,block", [(7, 20), (25, 10), (1, 5)])
def test_moving_average_across_blocks(spark, skewed, window, block):
    out = moving_average(spark.createDataFrame(skewed), ["g"], "pos", "v", window, "m", block_rows=block).toPandas()
    assert len(out) == len(skewed)
    out = out.sort_values(["g", "pos"])
    want = out.groupby("g").v.rolling(window, min_periods=1).mean().to_numpy()
    assert np.allclose(out.m, want)


@pytest.mark.parametrize("small_group", [10, 400, 100_000])
def test_quantiles_are_exact_on_both_paths(spark, skewed, small_group):
    probs = {"p1": 0.01, "p10": 0.1, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    out = exact_quantiles(spark.createDataFrame(skewed), ["g"], "v", probs, small_group=small_group).toPandas().set_index("g")
    assert set(out.index) == set(skewed.g)
    for group, rows in skewed.groupby("g"):
        for name, p in probs.items():
            assert out.loc[group, name] == pytest.approx(np.quantile(rows.v, p), abs=1e-12)


@pytest.mark.parametrize("small_group", [10, 100_000])
def test_nearest_rank_quantiles(spark, skewed, small_group):
    probs = {"p50": 0.5, "p99": 0.99}
    out = exact_quantiles(spark.createDataFrame(skewed), ["g"], "v", probs, "nearest", small_group).toPandas().set_index("g")
    for group, rows in skewed.groupby("g"):
        ordered = np.sort(rows.v.to_numpy())
        for name, p in probs.items():
            assert out.loc[group, name] == ordered[int(np.ceil(p * len(ordered))) - 1]


def test_quantile_of_everything(spark, skewed):
    out = exact_quantiles(spark.createDataFrame(skewed), [], "v", {"p50": 0.5}, small_group=100).collect()
    assert out[0].p50 == pytest.approx(skewed.v.median(), abs=1e-12)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_join_beyond_the_broadcast_size(spark, skewed, how):
    side = spark.createDataFrame([("hot", 1), ("a", 2)], "g string, w int")
    big = spark.createDataFrame(skewed)
    small, large = (lookup_join(big, side, ["g"], how, rows).toPandas() for rows in (100, 1))
    columns = sorted(small.columns)
    assert small[columns].sort_values("key").reset_index(drop=True).equals(large[columns].sort_values("key").reset_index(drop=True))


def test_draws_depend_on_their_key_only(spark):
    one = spark.range(2000).select("id", uniform(1, "a", F.col("id")).alias("u"), normal(1, F.col("id")).alias("z"))
    again = one.repartition(7).toPandas().sort_values("id")
    first = one.toPandas().sort_values("id")
    assert (first.u.to_numpy() == again.u.to_numpy()).all()
    assert 0.47 < first.u.mean() < 0.53 and first.u.between(0, 1, inclusive="left").all()
    assert abs(first.z.mean()) < 0.08 and 0.93 < first.z.std() < 1.07


def test_indicators_of_missing_and_extreme_values(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(nan,), (None,), (-1.0,), (0.0,), (0.025,), (9.0,), (inf,)], "c double")
    got = [r[0] for r in df.select(G.clearance_score(F.col("c"), 0.05)).collect()]
    assert got == [0.0, 0.0, 0.0, 0.0, 0.5, 1.0, 0.0]
    assert df.select(G.clearance_score(F.lit(0.05), 0.0)).first()[0] == pytest.approx(0.5)


def test_limit_margin(spark):
    limits = "array(named_struct('lo', -1D, 'hi', 1D), named_struct('lo', 2D, 'hi', 2D))"
    margin = lambda q, lim=limits: spark.range(1).select(G.limit_margin(F.expr(q), F.expr(lim))).first()[0]
    assert margin("array(0D, 2D)") == pytest.approx(0.5)
    assert margin("array(5D, 2D)") == 0.0
    assert margin("array()", "cast(array() as array<struct<lo:double,hi:double>>)") == 1.0


def test_singular_value_scores(spark):
    row = lambda e: spark.range(1).select(e).first()[0]
    sig = F.array(F.lit(2.0), F.lit(1.0), F.lit(0.5))
    assert row(G.manipulability(sig, F.lit(3), F.lit(4))) == pytest.approx(0.5)
    assert row(G.manipulability(sig, F.lit(6), F.lit(3))) == 0.0
    assert row(G.isotropy(sig)) == 0.25
    assert row(G.smallest_singular(sig)) == pytest.approx(0.5 / 0.6)
    assert row(G.isotropy(F.array().cast("array<double>"))) == 0.0


def test_segment_distances(spark):
    point = lambda *v: f"named_struct('x', {v[0]}D, 'y', {v[1]}D, 'z', {v[2]}D)"
    def gap(p0, p1, q0, q1, reach=0):
        pair = f"array(named_struct('p0', {point(*p0)}, 'p1', {point(*p1)}, 'q0', {point(*q0)}, 'q1', {point(*q1)}, 'reach', {reach}D))"
        return spark.range(1).select(G.segment_distances(F.expr(pair))[0]).first()[0]
    assert gap((0, 0, 0), (1, 0, 0), (0.5, -1, 2), (0.5, 1, 2)) == pytest.approx(2)
    assert gap((0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 1, 0), 0.25) == pytest.approx(0.75)
    assert gap((0, 0, 0), (0, 0, 0), (3, 4, 0), (3, 4, 0)) == pytest.approx(5)


def test_lower_envelope_equals_all_pairs():
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 40):
        f = np.where(rng.random((30, n)) < 0.3, np.inf, rng.random((30, n)) * rng.choice([0, 1, 50], (30, n)))
        step = rng.random(30) + 0.1
        gap = (np.arange(n)[:, None] - np.arange(n)[None, :]) ** 2
        want = (f[:, None, :] + gap[None] * step[:, None, None] ** 2).min(axis=2)
        assert np.allclose(lower_envelope(f, step), want)


def test_lower_envelope_of_a_long_line():
    line = np.full((1, 20_000), np.inf)
    line[0, [17, 12_345]] = 0
    at = np.arange(20_000)
    assert np.allclose(lower_envelope(line, np.array([0.5])), np.minimum(abs(at - 17), abs(at - 12_345)) ** 2 * 0.25)


def test_no_direction_has_no_bin(spark):
    rows = [(0.0, 0.0, 0.0), (None, 1.0, 0.0), (float("nan"), 1.0, 0.0), (float("inf"), 0.0, 1.0), (0.0, 1.0, 0.0)]
    out = spark.createDataFrame(rows, "x double, y double, z double").select(
        sphere_bin(F.col("x"), F.col("y"), F.col("z")).alias("b")).collect()
    assert [r["b"] for r in out[:4]] == [None] * 4 and out[4]["b"] == 0


@pytest.mark.parametrize("method", ["linear", "nearest"])
def test_a_wrong_bracket_is_widened(spark, monkeypatch, method):
    monkeypatch.setattr(quantile, "RANK_SLACK", -0.2)  # every bracket misses its rank
    values = np.random.default_rng(3).random(2_000).round(3)
    df = spark.createDataFrame(pd.DataFrame({"k": ["a"] * 2_000, "v": values}))
    got = exact_quantiles(df, ["k"], "v", {"p10": 0.1, "p50": 0.5, "p99": 0.99}, method, small_group=100).first()
    kind = "linear" if method == "linear" else "inverted_cdf"
    assert np.allclose([got.p10, got.p50, got.p99], np.quantile(values, [0.1, 0.5, 0.99], method=kind))


def test_singular_values_by_rotations(spark):
    """One-sided Jacobi against NumPy: wide, square, narrow, rank-deficient, repeated and empty matrices."""
    rng = np.random.default_rng(2)
    matrices = [rng.normal(size=(3, n)) for n in (1, 2, 3, 5, 9)] + [np.eye(3) * 2, np.zeros((3, 4)), np.ones((3, 4)),
                                                                     np.outer([1, 2, 3], [1, 1, 2, 5]), np.diag([1e-6, 1.0, 1e3])]
    frame = spark.createDataFrame([(k, m.astype(float).tolist()) for k, m in enumerate(matrices)] + [(99, [[], [], []])], "k int, m array<array<double>>")
    got = {r.k: r.s for r in frame.select("k", G.singular_values(F.col("m"), 3).alias("s")).collect()}
    assert got.pop(99) == []
    for k, m in enumerate(matrices):
        assert np.allclose(got[k], np.linalg.svd(m, compute_uv=False), atol=1e-9)
    six = rng.normal(size=(6, 7))
    rows = spark.createDataFrame([(six.tolist(),)], "m array<array<double>>").select(G.singular_values(F.col("m"), 6).alias("s")).first().s
    assert np.allclose(rows, np.linalg.svd(six, compute_uv=False), atol=1e-9)
