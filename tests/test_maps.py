"""Survey, convergence, field, split and batch properties on small frames."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxfield.functions.kernels import gaussian_pass
from voxfield.functions.store import listed, shared_folder
from voxfield.operators import (convergence as C, evaluation as J, fields as K, grid as V, quality as A, sampling as H, stats as T,
                                survey as S)


def dense(spark, shape, valid, res=(1.0, 1.0, 1.0), variant="v"):
    index = np.stack(np.meshgrid(*[np.arange(n) for n in shape], indexing="ij"), -1).reshape(-1, 3)
    frame = pd.DataFrame({"variant_id": variant, "ix": index[:, 0].astype("int32"), "iy": index[:, 1].astype("int32"),
                          "iz": index[:, 2].astype("int32"), "res_x": res[0], "res_y": res[1], "res_z": res[2], "valid": valid})
    return spark.createDataFrame(frame), index


def test_distance_transform_equals_brute_force(spark):
    shape, res = (7, 5, 6), (1.0, 0.5, 2.0)
    valid = np.random.default_rng(0).random(np.prod(shape)) < 0.9
    df, index = dense(spark, shape, valid, res)
    got = S.boundary_distance(df).toPandas().sort_values(["ix", "iy", "iz"])
    at = index * np.array(res)
    want = np.array([np.sqrt(((at[~valid] - p) ** 2).sum(1).min()) if ok else 0.0 for p, ok in zip(at, valid)])
    assert np.allclose(got.distance, want) and np.allclose(got.g_margin, want / want.max())


@pytest.mark.parametrize("copies", [1, 2])
def test_distance_transform_of_the_valid_cells_alone(spark, copies):
    shape, res = (7, 5, 6), (1.0, 0.5, 2.0)
    df, _ = dense(spark, shape, np.random.default_rng(0).random(np.prod(shape)) < 0.8, res)
    full, _ = dense(spark, (2, 3, 2), np.full(12, True), res, "full")
    df = df.unionByName(full)
    sides = spark.createDataFrame([("v", *shape, *res, copies), ("full", 2, 3, 2, *res, copies)], "variant_id string, nx int, ny int, nz int, "
                                  "res_x double, res_y double, res_z double, copies int")
    valid = df.filter("valid").select("variant_id", "ix", "iy", "iz", "valid")
    rows = lambda out: sorted(tuple(r) for r in out.select("variant_id", "ix", "iy", "iz", F.round("distance", 9), F.round("g_margin", 9)).collect())
    want = S.boundary_distance(df.withColumn("_c", F.explode(F.sequence(F.lit(1), F.lit(copies))))).join(valid, ["variant_id", "ix", "iy", "iz"])
    assert rows(S.boundary_distance(valid, sides)) == rows(want) and want.count() == copies * valid.count()


def test_a_map_writes_touched_cells_only(spark):
    """One of 60 cells passes in a, none of 12 in b; c has two families and so four rows a cell."""
    grids = spark.createDataFrame([(v, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, nx, 2, nz) for v, nx, nz in (("a", 5, 6), ("b", 2, 3), ("c", 1, 1))],
                                  "variant_id string, bmin_x double, bmin_y double, bmin_z double, res_x double, res_y double, res_z double, "
                                  "nx int, ny int, nz int")
    rows = [("a", 1, 2.5, 1.5, 3.5, 0.5), ("a", 2, 2.2, 1.2, 3.2, 0.0), ("a", 3, 4.5, 0.5, 0.5, 0.0), ("b", 1, 0.5, 0.5, 0.5, 0.0),
            ("b", 2, 9.0, 0.5, 0.5, 1.0), ("c", 1, 0.5, 0.5, 0.5, 1.0)]
    samples = spark.createDataFrame([(*r, [float(r[1])], 0.5, 0.25, 0.5, 0.5, 3) for r in rows], "variant_id string, sample_id bigint, x double, y double, "
                                    "z double, g_self double, q array<double>, g_lim double, g_man double, g_iso double, g_sigma double, sphere_bin int")
    families = spark.createDataFrame([("a", "f"), ("c", "g"), ("c", "h")], "variant_id string, family string")
    before = set(listed(spark, f"{shared_folder(spark)}/voxfield"))
    out = S.build_map(samples, 1.0, grids=grids, families=families)
    new = {n.rpartition("-")[0]: n for n in set(listed(spark, f"{shared_folder(spark)}/voxfield")) - before}
    assert spark.read.parquet(f"{shared_folder(spark)}/voxfield/{new['touched']}").count() == 4 and "dense-map" not in new
    rows = out.toPandas()
    assert rows.groupby("variant_id").cell_idx.agg(["size", "nunique", "max"]).to_numpy().tolist() == [[60, 60, 59], [12, 12, 11], [8, 2, 1]]
    assert (rows.cell_idx == (rows.ix * 2 + rows.iy) * rows.variant_id.map({"a": 6, "b": 3, "c": 1}) + rows.iz).all()
    hit = rows[rows.attempts > 0].sort_values("g_margin", ascending=False).drop_duplicates(["variant_id", "cell_idx"]).sort_values(["variant_id", "cell_idx"])
    assert list(zip(hit.variant_id, hit.cell_idx, hit.attempts, hit.sample_counts, hit.g_margin, hit.cx)) == [
        ("a", 33, 2, 1, 1.0, 2.5), ("a", 48, 1, 0, 0.0, 4.5), ("b", 0, 1, 0, 0.0, 0.5), ("c", 0, 1, 1, 1.0, 0.5)]
    assert hit.q_star.tolist()[0].tolist() == [1.0] and hit.q_star.isna().tolist() == [False, True, True, False]
    rest = rows[rows.attempts == 0]
    assert (rest[[c for c in rows if c.startswith("g_")]] == 0).all().all() and rest.q_star.isna().all()
    assert rows.groupby("variant_id").family.apply(lambda f: sorted(f.dropna().unique())).tolist() == [["f"], [], ["g", "h"]]


@pytest.mark.parametrize("state", [True, False])
def test_distance_transform_of_uniform_maps_is_zero(spark, state):
    df, _ = dense(spark, (3, 3, 3), np.full(27, state))
    assert S.boundary_distance(df).agg(F.max("g_margin")).first()[0] == 0.0


def test_bounds_ignore_non_finite_points_and_mark_empty_variants(spark):
    nan = float("nan")
    df = spark.createDataFrame([("a", 0.0, 0.0, 0.0), ("a", 2.0, 4.0, 6.0), ("a", nan, 1.0, 1.0), ("b", nan, nan, nan)],
                               "variant_id string, x double, y double, z double")
    rows = {r.variant_id: r for r in V.scout_bounds(df, 1.1).collect()}
    assert rows["b"].status == "no valid samples" and rows["a"].n_valid == 2
    assert rows["a"].bmin_x == pytest.approx(-0.1) and rows["a"].bmax_z == pytest.approx(6.3)
    grid = V.build_grid(V.scout_bounds(df, 1.1), (1.0, 2.0, 0.5)).collect()
    assert [(r.nx, r.ny, r.nz, r.n_cells) for r in grid] == [(3, 3, 14, 126)]
    assert V.build_grid(V.manual_bounds(df.select("variant_id").distinct(), (0, 0, 0), (0, 0, 0)), 1.0).first().n_cells == 1


def test_grid_inference_finds_the_grid_and_reports_gaps(spark):
    grid = V.build_grid(V.manual_bounds(spark.createDataFrame([("a",), ("b",)], "variant_id string"), (0, 0, 0), (3, 2, 2)), 0.5)
    cells = V.grid_cells(grid)
    holed = cells.filter((F.col("variant_id") == "a") | (F.col("cell_idx") != 5))
    rows = {r.variant_id: r for r in V.infer_grid(holed).collect()}
    assert rows["a"].status == "ok" and (rows["a"].nx, rows["a"].ny, rows["a"].nz) == (6, 4, 4)
    assert rows["a"].bmin_x == pytest.approx(0) and rows["a"].bmax_x == pytest.approx(3)
    assert rows["b"].status == "centres are not a full grid"


@pytest.fixture(scope="module")
def stream():
    rng = np.random.default_rng(5)
    frames = []
    for name, n in (("hot", 1500), ("cold", 180)):
        cell = np.where(rng.random(n) < 0.4, 1, rng.integers(0, 40, n)).astype(object)
        cell[rng.random(n) < 0.05] = None
        frames.append(pd.DataFrame({"variant_id": name, "sample_id": np.arange(1, n + 1), "cell_idx": cell,
                                    "passed": rng.random(n) < 0.8, "g_man": rng.random(n)}))
    return pd.concat(frames, ignore_index=True)


def replay(rows, window, every, improvement, n_cells, target, rate, strict):
    """The stop rule sample by sample."""
    best, recent, marks, stop = {}, [], [], None
    for r in rows.itertuples():
        ok = bool(r.passed) and r.cell_idx is not None
        flag = ok and (r.cell_idx not in best or r.g_man > best[r.cell_idx] * (1 + improvement))
        if ok:
            best[r.cell_idx] = max(best.get(r.cell_idx, 0.0), r.g_man)
        recent = (recent + [flag])[-window:]
        if r.sample_id % every == 0:
            heat, cover = sum(recent) / len(recent), len(best) / n_cells
            marks.append((r.sample_id, heat, cover))
            if stop is None and (ok or not strict) and cover >= target and len(recent) >= window and heat < rate:
                stop = r.sample_id
    return marks, stop


@pytest.mark.parametrize("strict", [True, False])
def test_checkpoint_aggregates_equal_the_sample_by_sample_rule(spark, stream, strict):
    window, every, target, rate = 120, 50, 0.5, 0.25
    events = spark.createDataFrame(stream.astype({"cell_idx": object}), "variant_id string, sample_id bigint, cell_idx bigint, passed boolean, g_man double")
    totals = spark.createDataFrame([("hot", 40), ("cold", 40)], "variant_id string, n_cells bigint")
    flags = C.significant_events(events, 0.02)
    heat, curve = C.update_heat(events, flags, window, every), C.coverage_curve(events, flags, totals, every)
    stops = {r.variant_id: r.stop_at for r in C.stop_points(events, heat, curve, target, window, rate, strict).collect()}
    got = heat.join(curve, ["variant_id", "checkpoint"]).toPandas()
    for name, rows in stream.groupby("variant_id"):
        marks, stop = replay(rows, window, every, 0.02, 40, target, rate, strict)
        mine = got[got.variant_id == name].sort_values("checkpoint")
        assert np.allclose(mine[["checkpoint", "heat", "coverage"]].to_numpy(), np.array(marks))
        assert stops[name] == stop


def test_smoothing_orders_by_step_and_shrinks_at_the_head(spark):
    df = spark.createDataFrame([("t", 30, 3.0), ("t", 10, 1.0), ("t", 20, 2.0)], "series string, step int, v double")
    out = C.smoothed_series(df, ["series"], "step", "v", 2, "m").orderBy("step").collect()
    assert [r.m for r in out] == [1.0, 1.5, 2.5]


def test_gaussian_filter_equals_direct_convolution(spark):
    line = np.random.default_rng(1).random(9)
    got = spark.createDataFrame([(line.tolist(),)], "v array<double>").select(gaussian_pass(F.col("v"), 1.5)).first()[0]
    padded = np.concatenate([line[::-1], line, line[::-1]])
    w = np.exp(-0.5 * (np.arange(-6, 7) / 1.5) ** 2)
    want = [(padded[9 + i - 6: 9 + i + 7] * w / w.sum()).sum() for i in range(9)]
    assert np.allclose(got, want)


def test_resampling_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame({"variant_id": "v", "cx": rng.random(40) * 3, "cy": rng.random(40), "cz": rng.random(40) * 2, "s": rng.random(40)})
    points = spark.createDataFrame(frame)
    lattice = K.lattices(points, 9, 0.05)
    got = K.dense_lattice(K.resampled_field(points, ["s"], lattice), lattice, ["s"]).toPandas().sort_values(["ix", "iy", "iz"])
    spot = lattice.first()
    axes = [getattr(spot, f"o_{a}") + np.arange(9) * getattr(spot, f"h_{a}") for a in "xyz"]
    at = np.stack(np.meshgrid(*axes, indexing="ij"), -1).reshape(-1, 3)
    d2 = ((at[:, None] - frame[["cx", "cy", "cz"]].to_numpy()[None]) ** 2).sum(-1)
    w = np.where(d2 <= spot.radius ** 2, np.exp(-4 * d2 / spot.radius ** 2), 0)
    want = np.where(w.sum(1) > 0, (w * frame.s.to_numpy()).sum(1) / np.maximum(w.sum(1), 1e-300), 0)
    assert len(got) == 729 and np.allclose(got.s, want)
    assert K.smoothed_field(K.dense_lattice(K.resampled_field(points, ["s"], lattice), lattice, ["s"]), "s").count() == 729


@pytest.mark.parametrize("few", [1, 100])
def test_nearest_cells_equal_brute_force(spark, few):
    variants = spark.createDataFrame([("a",), ("b",)], "variant_id string")
    grids = V.build_grid(V.manual_bounds(variants, (0, 0, 0), (3, 2, 2)), 0.5)
    labels = ["g_ws", "g_lim", "g_selfpass", "g_man", "g_iso", "g_sigma", "g_rot", "g_red", "g_margin", "sample_counts"]
    cells = V.grid_cells(grids).withColumns({k: F.lit(0.5) for k in labels})
    spots = np.random.default_rng(7).uniform(-1, 4, (12, 3))
    probes = spark.createDataFrame([(f"p{i}", *map(float, v)) for i, v in enumerate(spots)], "probe string, x double, y double, z double")
    got = K.nearest_cells(cells, grids, probes, 0.3, few).toPandas()
    centres = cells.filter("variant_id = 'a'").orderBy("cell_idx").select("cx", "cy", "cz").toPandas().to_numpy()
    assert len(got) == 24
    for r in got.itertuples():
        d = np.linalg.norm(centres - spots[int(r.probe[1:])], axis=1)
        assert r.cell_idx == d.argmin() and r.nearest_dist == pytest.approx(d.min())
        assert r.matched == (d.min() <= 0.3) and (r.g_man == 0.5 if r.matched else np.isnan(r.g_man))


def test_ratio_field_needs_both_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "g_self double, g_self_qstar double")
    assert K.ratio_field(df).first().ratio == pytest.approx(2.0, rel=1e-5)
    assert K.ratio_field(df.drop("g_self_qstar")).columns == ["g_self"]


def test_split_counts_of_four_strata_of_fifty_one(spark):
    ids = spark.range(204).select((F.col("id") % 4).alias("dof"), F.concat(F.lit("id"), "id").alias("variant_id"))
    out = H.stratified_split(ids, "dof").toPandas()
    assert out.variant_id.nunique() == 204
    assert out.groupby("split").size().to_dict() == {"train": 164, "val": 20, "test": 20}
    assert (out.groupby(["dof", "split"]).size().unstack()[["train", "val", "test"]] == [41, 5, 5]).all().all()


@pytest.fixture(scope="module")
def pool_cells(spark):
    rows = [(v, i, 1.0 if i < ws else 0.0) for v, n, ws in (("mixed", 30, 10), ("only_ws", 8, 8), ("none", 6, 0)) for i in range(n)]
    return spark.createDataFrame(rows, "variant_id string, cell_idx bigint, g_ws double")


def test_grouped_batches_cycle_through_their_pools(spark, pool_cells):
    out = H.grouped_batches(pool_cells, 40, 8, 0.5, 3).toPandas()
    assert len(out) == 320 and (out.groupby("batch_id").variant_id.nunique() == 1).all()
    assert (out.groupby("batch_id").slot.apply(sorted).map(list) == pd.Series([list(range(8))] * 40)).all()
    assert out[out.variant_id == "only_ws"].is_ws.all() and not out[out.variant_id == "none"].is_ws.any()
    uses = out.groupby(["variant_id", "is_ws", "cell_idx"]).size()
    assert all(g.max() - g.min() <= 1 for _, g in uses.groupby(level=[0, 1]) if len(g) > 1)


def test_balanced_draws_reach_every_cell_before_repeating(spark, pool_cells):
    out = H.balanced_draws(pool_cells, 200, 0.5, 1).toPandas()
    assert len(out) == 200 and 70 < out.is_ws.sum() < 130
    uses = out.groupby(["is_ws", "variant_id", "cell_idx"]).size()
    assert all(g.max() - g.min() <= 1 for _, g in uses.groupby(level=0))


def test_invalid_weights_count_as_one(spark):
    rows = [("a", 2.0), ("b", None), ("c", float("nan")), ("d", -1.0), ("e", 3.0)]
    out = H.variant_intervals(spark.createDataFrame(rows, "variant_id string, weight double")).orderBy("variant_id").collect()
    assert [(r.start, r.end) for r in out] == [(0, 2), (2, 3), (3, 4), (4, 5), (5, 8)]


def test_label_statistics_drop_non_finite_and_keep_missing_labels(spark):
    rows = [("a", 1.0, 0.5), ("a", 1.0, float("nan")), ("a", 0.0, 9.0), ("b", 1.0, 7.0), ("a", 1.0, 0.7)]
    cells = spark.createDataFrame(rows, "variant_id string, g_ws double, g_man double")
    train = spark.createDataFrame([("a",)], "variant_id string")
    out = {r.label: r for r in T.label_statistics(cells, train, ["g_ws", "g_man", "g_iso"]).collect()}
    assert [out[k]["count"] for k in ("g_ws", "g_man", "g_iso")] == [4, 2, 0]
    assert out["g_man"].mean == pytest.approx(0.6) and out["g_man"].p50 == pytest.approx(0.6) and out["g_iso"].mean is None
    near = T.label_statistics(cells, train, ["g_man"], approximate=True).first()
    assert near.p99 == 0.7


def test_metrics_of_merged_parts_equal_the_whole(spark):
    rng = np.random.default_rng(6)
    frame = pd.DataFrame({"ws_score": rng.normal(size=300), "g_ws": (rng.random(300) < 0.4).astype(float), "part": np.arange(300) % 3})
    df = spark.createDataFrame(frame)
    parts = df.groupBy("part").agg(*J.classification_counts())
    merged = J.classification_metrics(parts.agg(*[F.sum(c).alias(c) for c in ("tp", "tn", "fp", "fn")])).first()
    whole = J.classification_metrics(df.agg(*J.classification_counts())).first()
    assert merged == whole and whole.tp + whole.tn + whole.fp + whole.fn == 300


def test_fail_fast_keeps_rows_up_to_the_first_failure(spark):
    rows = spark.createDataFrame([("f", 1, "ok"), ("f", 2, "failed"), ("f", 3, "ok"), ("g", 1, "ok")], "family string, n int, status string")
    assert A.run_manifest(rows, "n").count() == 4
    assert sorted(tuple(r) for r in A.run_manifest(rows, "n", True).collect()) == [("f", 1, "ok"), ("f", 2, "failed"), ("g", 1, "ok")]


def test_empty_batches_are_reported(spark):
    rows = spark.createDataFrame([(1, "a", [0.0], [0.0]), (2, None, None, None)],
                                 "batch_id int, variant_id string, pose_feats array<double>, labels array<double>")
    out = {r.batch_id: r.violations for r in A.batch_violations(rows, 1, ["g_man"]).collect()}
    assert out == {1: ["no g_ws label"], 2: ["empty batch", "no g_ws label"]}
