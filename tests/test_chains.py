"""Chain poses, clearance, link graph and the whole pipeline on toy chains."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.toys import FOLDING, PLANAR, SLIDING, joint, spec
from voxfield.functions.store import listed, shared_folder
from voxfield.operators import collision as D, features as I, kernel as P, specs as X
from voxfield.plans import spec_queries
from voxfield.plans.pipelines import run_survey, summarised_survey, survey_specs
from voxfield.schemas import SPEC


@pytest.fixture(scope="module")
def chains(spark):
    rows = P.chains(spark.createDataFrame([PLANAR, FOLDING, SLIDING], SPEC))
    return {r.variant_id: r.asDict(recursive=True) for r in rows.collect()}


def poses(chain, q):
    return P.chain_poses(chain["steps"], chain["n_links"], chain["end_link"], np.asarray(q, dtype=float))


def test_planar_positions(chains):
    position, rotation, _ = poses(chains["planar2r"], [[0, 0], [math.pi / 2, 0], [0, math.pi / 2]])
    assert np.allclose(position[:, -1], [[1.5, 0, 0], [0, 1.5, 0], [1, 0.5, 0]])
    assert np.allclose(rotation[1], [[0, -1, 0], [1, 0, 0], [0, 0, 1]])


def test_prismatic_joint_moves_along_its_axis(chains):
    position, _, jacobian = poses(chains["slide"], [[0.0, 0.0], [0.7, 0.0]])
    assert np.allclose(position[1, -1] - position[0, -1], [0.7, 0, 0])
    assert np.allclose(jacobian[:, :, 0], [1, 0, 0, 0, 0, 0])


@pytest.mark.parametrize("name", ["planar2r", "fold3r", "slide"])
def test_jacobian_is_the_derivative_of_the_position(chains, name):
    q = np.random.default_rng(1).uniform(-1, 1, (5, len(chains[name]["limits"])))
    _, _, jacobian = poses(chains[name], q)
    for j in range(q.shape[1]):
        step = np.zeros(q.shape[1])
        step[j] = 1e-6
        ahead, behind = poses(chains[name], q + step)[0][:, -1], poses(chains[name], q - step)[0][:, -1]
        assert np.allclose(jacobian[:, :3, j], (ahead - behind) / 2e-6, atol=1e-6)


def test_singular_values_use_linear_rows_of_short_chains(chains):
    _, _, jacobian = poses(chains["planar2r"], [[0.1, math.pi / 2], [0.1, 0.0]])
    values, rows, cols = P.singular_values(jacobian)
    values = values.to_pylist()
    assert rows.tolist() == [3, 3] and cols.tolist() == [2, 2]
    assert len(values[0]) == 2 and np.prod(values[0]) == pytest.approx(0.5)
    assert min(values[1]) == pytest.approx(0, abs=1e-9)


def test_zero_columns_are_left_out():
    jacobian = np.zeros((2, 6, 7))
    jacobian[0] = np.random.default_rng(0).normal(size=(6, 7))
    jacobian[1, :, :6] = jacobian[0, :, :6]
    values, rows, cols = P.singular_values(jacobian)
    values = values.to_pylist()
    assert rows.tolist() == [6, 6] and cols.tolist() == [7, 6] and [len(v) for v in values] == [6, 6]
    assert np.allclose(values[1], np.linalg.svd(jacobian[0, :, :6], compute_uv=False))


def test_quaternions_describe_the_rotation():
    rng = np.random.default_rng(2)
    q = rng.normal(size=(200, 4))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    x, y, z, w = q.T
    r = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
                  [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
                  [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]]).transpose(2, 0, 1)
    assert np.allclose(np.abs((P._quaternions(r) * q).sum(axis=1)), 1)


def test_blocks_cover_every_sample_once_whatever_their_size(spark):
    chain_rows = P.chains(spark.createDataFrame([PLANAR, SLIDING], SPEC))
    small, large = (P.pose_samples(P.sample_blocks(chain_rows, 50, 9, block)).select("variant_id", "sample_id", "x", "y").toPandas()
                    .sort_values(["variant_id", "sample_id"]).reset_index(drop=True) for block in (7, 512))
    assert small.equals(large)
    assert small.groupby("variant_id").sample_id.apply(list).tolist() == [list(range(1, 51))] * 2


def clearance_of(spark, spec_doc, q, ignored=None, wanted=None):
    chain_rows = P.chains(spark.createDataFrame([spec_doc], SPEC))
    chain = chain_rows.first().asDict(recursive=True)
    position = poses(chain, [q])[0][0]
    points = [(float(x), float(y), float(z)) for x, y, z in position]
    rows = spark.createDataFrame([(chain["variant_id"], 1, points)],
                                 "variant_id string, sample_id bigint, points array<struct<x:double,y:double,z:double>>")
    segs = D.segments(chain_rows)
    pairs = D.listed_pairs(segs, wanted) if wanted is not None else D.segment_pairs(segs, ignored)
    return D.clearance(rows, pairs).first().clearance


def test_clearance_of_a_folding_chain(spark):
    open_, folded = [0.0, 0.0, 0.0], [0.0, math.pi / 2, math.pi]
    assert clearance_of(spark, FOLDING, open_) == pytest.approx(1 - 2 * 0.018)
    assert clearance_of(spark, FOLDING, [0.0, math.pi, 0.0]) == 0.0
    assert clearance_of(spark, FOLDING, folded) == 0.0
    ignored = spark.createDataFrame([("fold3r", "tip", "two"), ("fold3r", "one", "tip")], "variant_id string, link_a string, link_b string")
    assert clearance_of(spark, FOLDING, folded, ignored) > 0


def test_no_pair_to_test_is_missing(spark):
    short = spec("short", [joint("a", "revolute", "base", "one", (1, 0, 0))])
    assert math.isnan(clearance_of(spark, short, [0.0]))


def test_listed_pairs_and_unknown_links(spark):
    wanted = spark.createDataFrame([("fold3r", "base", "tip"), ("fold3r", "base", "ghost")], "variant_id string, link_a string, link_b string")
    got = clearance_of(spark, FOLDING, [0.0, 0.0, 0.0], wanted=wanted)
    assert got == pytest.approx(2 - 2 * 0.018)


def test_static_pairs_need_the_share_of_all_drawn_samples(spark):
    chain_rows = P.chains(spark.createDataFrame([FOLDING], SPEC))
    rows = P.link_points(P.pose_samples(P.sample_blocks(chain_rows, 40, 1)))
    pairs = D.segment_pairs(D.segments(chain_rows))
    touched = D.clearance(rows, pairs).filter("clearance = 0").count() / 40
    found = D.static_collisions(rows, pairs, 40, 0.0).agg(F.max("rate")).first()[0]
    assert 0 < found <= touched
    assert D.static_collisions(rows, pairs, 40, 0.95).count() == 0


def graph_rows(spark, *docs):
    return spark.createDataFrame(list(docs), SPEC).select(
        "meta.variant_id", F.col("chain.links").alias("links"), F.col("chain.joints").alias("joints"), "meta.base_link",
        "meta.ee_link", "morphology.actuated_joint_names")


def test_graph_of_a_branching_spec(spark):
    doc = spec("tree", [joint("a", "revolute", "base", "one", (1, 0, 0)), joint("b", "fixed", "one", "two", (0, 2, 0)),
                        joint("c", "revolute", "one", "three", (0, 0, 3))])
    doc["meta"]["base_link"] = "unknown"
    nodes = I.graph_nodes(graph_rows(spark, doc)).toPandas().set_index("name")
    assert nodes.depth.to_dict() == {"base": 0, "one": 1, "two": 2, "three": 2}
    assert nodes.path_length.to_dict() == {"base": 0.0, "one": 1.0, "two": 3.0, "three": 4.0}
    assert nodes.is_base.to_dict()["base"] == 1.0 and nodes.is_ee.to_dict()["three"] == 1.0
    assert nodes.is_actuated.to_dict() == {"base": 0.0, "one": 1.0, "two": 0.0, "three": 1.0}


def test_edges_without_joints_connect_consecutive_links(spark):
    doc = spec("bare", [joint("a", "fixed", "base", "one"), joint("b", "fixed", "one", "two")])
    doc["chain"]["joints"] = []
    both = I.graph_edges(graph_rows(spark, doc)).orderBy("edge_id").select("src", "dst", "direction", "is_fixed").collect()
    assert [tuple(r) for r in both] == [(0, 1, 1.0, 0.0), (1, 0, -1.0, 0.0), (1, 2, 1.0, 0.0), (2, 1, -1.0, 0.0)]
    assert I.graph_edges(graph_rows(spark, doc), bidirectional=False).count() == 2


def test_variants_stay_inside_the_base_limits(spark):
    base = spark.createDataFrame([PLANAR, SLIDING], SPEC)
    out = X.expand_variants(base, 20, 4)
    rows = out.select("meta", F.inline("chain.joints")).filter("is_actuated").toPandas()
    assert len(rows) == 80 and rows.meta.map(lambda m: m["parent_variant_id"]).isin(["planar2r", "slide"]).all()
    assert (rows.limit_upper - rows.limit_lower >= 1e-3 - 1e-12).all()
    assert (rows.limit_lower >= -math.pi).all() and (rows.limit_upper <= math.pi).all()
    scale = out.select(F.explode("morphology.length_scale").alias("s")).toPandas().s
    assert scale.between(0.7, 1.3).all() and scale.nunique() == 80


def test_survey_of_toy_specs(spark):
    specs = spark.createDataFrame([PLANAR, SLIDING, FOLDING], SPEC)
    out = survey_specs(specs, 600, 0.25, bounds_samples=500, seed=3).toPandas()
    labels = [c for c in out.columns if c.startswith("g_")]
    assert ((out[labels] >= 0) & (out[labels] <= 1 + 1e-12)).all().all()
    assert (out.sample_counts <= out.attempts).all()
    empty = out[out.g_ws == 0]
    assert (empty[["g_red", "g_self", "g_lim", "g_man", "g_rot", "g_margin"]] == 0).all().all()
    dense = out.groupby("variant_id").agg(n=("cell_idx", "size"), top=("cell_idx", "max"), hit=("attempts", "sum"))
    assert (dense.n == dense.top + 1).all() and (dense.hit > 500).all()
    assert out[(out.variant_id == "planar2r")].sample_counts.sum() == 0 or out[out.variant_id == "fold3r"].g_ws.sum() > 0


def test_map_has_the_representative_and_the_family(spark):
    specs = spark.createDataFrame([FOLDING], SPEC)
    out = survey_specs(specs, 800, 0.5, bounds_samples=300, seed=3).toPandas()
    assert (out.q_star.notna() == (out.sample_counts > 0)).all() and out.family.nunique() == 1
    assert out.q_star.dropna().map(len).eq(3).all()


def test_rounds_give_the_prefix_of_one_pass(spark):
    specs = spark.createDataFrame([PLANAR, FOLDING], SPEC)
    rule = dict(bounds_samples=300, target_coverage=0.02, window=150, every=50, min_rate=0.4)
    one = survey_specs(specs, 1200, 0.5, first_round=1200, **rule)
    rounds = survey_specs(specs, 1200, 0.5, first_round=170, **rule)
    columns = ["variant_id", "cell_idx", "attempts", "sample_counts", "g_margin", "q_star"]
    key = lambda df: sorted(map(tuple, df.select(*columns).withColumn("q_star", F.col("q_star").cast("string")).collect()), key=str)
    assert key(one) == key(rounds)
    total = lambda df: df.agg(F.sum("attempts")).first()[0]
    assert total(one) < total(survey_specs(specs, 1200, 0.5, bounds_samples=300))


def test_manual_bounds_listed_pairs_and_status(spark):
    broken = FOLDING | {"meta": FOLDING["meta"] | {"variant_id": "broken"}, "chain": {
        "links": FOLDING["chain"]["links"],
        "joints": [j | {"origin_xyz": [float("nan")] * 3} for j in FOLDING["chain"]["joints"]]}}
    specs = spark.createDataFrame([PLANAR, FOLDING, broken], SPEC)
    existing = spark.createDataFrame([("planar2r",)], "variant_id string")
    run = run_survey(specs, 200, 0.5, bounds_samples=100, existing=existing)
    status = {r["variant_id"]: (r["status"], r["reason"]) for r in run.status.collect()}
    assert status == {"planar2r": ("skipped", "map exists"), "fold3r": ("ok", None), "broken": ("failed", "no valid samples")}
    assert {r[0] for r in run.maps.select("variant_id").distinct().collect()} == {"fold3r"}
    links = [l["name"] for l in FOLDING["chain"]["links"]]
    pairs = spark.createDataFrame([("fold3r", links[0], links[-1])], "variant_id string, link_a string, link_b string")
    boxed = run_survey(spark.createDataFrame([FOLDING], SPEC), 200, 0.5, bounds=((-1, -1, -1), (1, 1, 1)), pairs=pairs)
    shape = boxed.maps.agg(F.max("ix"), F.max("iy"), F.max("iz"), F.sum("attempts")).first()
    assert tuple(shape)[:3] == (3, 3, 3) and 0 < shape[3] <= 200


def test_kernel_stages_agree(spark, chains):
    """With a grid, the pass drops outside samples and skips the singular values of touching ones, nothing else."""
    rows = spark.createDataFrame([FOLDING], SPEC)
    chain_rows = P.chains(rows)
    pairs = D.segment_pairs(D.segments(chain_rows))
    blocks = P.sample_blocks(chain_rows, 300, 4).join(pairs, "variant_id")
    box = F.struct(*[F.lit(v).alias(n) for a in "xyz" for n, v in ((f"bmin_{a}", -0.6), (f"res_{a}", 0.3), (f"n{a}", 4))])
    whole = P.pose_samples(blocks).toPandas().set_index("sample_id")
    staged = P.pose_samples(blocks.withColumn("grid", box)).toPandas().set_index("sample_id")
    inside = whole[(whole[["x", "y", "z"]] >= -0.6).all(axis=1) & (whole[["x", "y", "z"]] < 0.6).all(axis=1)]
    assert sorted(staged.index) == sorted(inside.index) and 0 < len(staged) < 300
    free = inside[inside.clearance > 0].index
    assert staged.loc[free].sigmas.map(list).equals(whole.loc[free].sigmas.map(list))
    assert staged.drop(free).sigmas.isna().all() and staged.loc[free].sphere_bin.equals(whole.loc[free].sphere_bin.astype(staged.sphere_bin.dtype))
    ends = P.positions(P.sample_blocks(chain_rows, 300, 4)).toPandas().set_index("sample_id")
    assert np.allclose(ends.loc[whole.index, ["x", "y", "z"]], whole[["x", "y", "z"]])


def renamed(doc, name, **joint_values):
    """A spec of the same shape under another name, with values replaced in every joint."""
    joints = [j | joint_values for j in doc["chain"]["joints"]]
    return doc | {"meta": doc["meta"] | {"variant_id": name}, "chain": doc["chain"] | {"joints": joints}}


def test_blocks_of_one_shape_are_walked_together(spark):
    docs = [renamed(doc, f"{kind}{k}", origin_xyz=[0.1 * k, 0.2, 0.3], origin_rpy=[0.05 * k, 0.1, 0.2], axis=[0.0, 0.1 * k, 0.0])
            for k in range(20) for kind, doc in (("fold", FOLDING), ("slide", SLIDING))]
    chain_rows = P.chains(spark.createDataFrame(docs, SPEC))
    blocks = P.sample_blocks(chain_rows, 10, 3).select(*P.BLOCK)
    batch = blocks.toArrow().combine_chunks().to_batches()[0]
    passes = list(P._passes(batch))
    assert batch.num_rows == 40 and len(passes) == 2 and sum(len(of) for _, _, of, _ in passes) == 400
    chains = {r.variant_id: r.asDict(recursive=True) for r in chain_rows.collect()}
    rows = P.pose_samples(blocks, with_jacobian=True).collect()
    assert len(rows) == 400
    for r in rows:
        position, _, jacobian = poses(chains[r.variant_id], [r.q])
        assert np.allclose(np.array([r.link_x, r.link_y, r.link_z]).T, position[0]) and np.allclose(r.jacobian, jacobian.ravel())


def test_chains_of_one_shape_keep_their_own_pairs_and_grids(spark):
    docs = [renamed(FOLDING, f"fold{k}", origin_xyz=[0.2 + 0.1 * k, 0.0, 0.05]) for k in range(3)]
    chain_rows = P.chains(spark.createDataFrame(docs, SPEC))
    number = F.substring("variant_id", 5, 1).cast("int")
    pairs = D.segment_pairs(D.segments(chain_rows)).withColumn("pairs", F.slice("pairs", F.lit(1), number))
    box = F.struct(*[v.alias(n) for a in "xyz" for n, v in (
        (f"bmin_{a}", -0.1 - 0.2 * number), (f"res_{a}", F.lit(0.2)), (f"n{a}", 1 + 2 * number))])
    blocks = P.sample_blocks(chain_rows, 60, 5).join(pairs, "variant_id")
    posed = P.pose_samples(blocks)
    plain = D.clearance(P.link_points(posed).drop("clearance"), pairs).toPandas().set_index(["variant_id", "sample_id"])
    whole = posed.toPandas().set_index(["variant_id", "sample_id"]).loc[plain.index]
    assert np.allclose(whole.clearance, plain.clearance, equal_nan=True)
    assert whole.clearance.isna().sum() == 60 and (whole.clearance > 0).any()
    half = whole.index.get_level_values(0).str[-1].astype(int).to_numpy() * 0.2 + 0.1
    inside = whole[((whole[["x", "y", "z"]].abs().to_numpy()) < half[:, None]).all(axis=1)]
    staged = P.pose_samples(blocks.withColumn("grid", box)).toPandas().set_index(["variant_id", "sample_id"])
    assert sorted(staged.index) == sorted(inside.index) and 0 < len(staged) < 180


def test_many_variants_have_their_own_ids_and_draws(spark):
    out = X.expand_variants(spark.createDataFrame([PLANAR], SPEC), 10_001, 1).select(
        "meta.variant_id", F.col("morphology.length_scale").cast("string").alias("s"))
    assert out.select("variant_id").distinct().count() == 10_001 and out.select("s").distinct().count() == 10_001


def test_listed_names_keep_their_draws(spark):
    names = ["ghost", *[j["name"] for j in PLANAR["chain"]["joints"]]]
    spec = PLANAR | {"morphology": PLANAR["morphology"] | {"actuated_joint_names": names}}
    out = X.expand_variants(spark.createDataFrame([spec], SPEC), 2, 1, perturb_fixed=True).collect()
    for r in out:
        m = r["morphology"]
        assert m["actuated_joint_names"] == names and len(m["length_scale"]) == len(names) and m["joint_limit_shift"][0] == 0
        assert m["notes"]["generated_from"] == "perturbation" and m["notes"]["length_scale_range"] == [0.7, 1.3]
        for old, new in zip(PLANAR["chain"]["joints"], r["chain"]["joints"]):
            scale = m["length_scale"][names.index(old["name"])]
            assert np.allclose(new["origin_xyz"], [v * scale for v in old["origin_xyz"]])


def test_survey_stops_at_the_stop_point(spark):
    specs = spark.createDataFrame([FOLDING], SPEC)
    full = survey_specs(specs, 2000, 1.0, bounds_samples=500).agg(F.sum("attempts")).first()[0]
    early = survey_specs(specs, 2000, 1.0, bounds_samples=500, target_coverage=0.01, window=200, every=100,
                         min_rate=0.5).agg(F.sum("attempts")).first()[0]
    assert early < full


def _kept(spark):
    return {name.rpartition("-")[0] + name[-8:] for name in listed(spark, f"{shared_folder(spark)}/voxfield")}


def test_batches_of_the_survey_give_one_survey_and_keep_the_summaries_only(spark):
    specs = spark.createDataFrame([FOLDING | {"meta": FOLDING["meta"] | {"variant_id": f"fold{k % 9}"}} for k in range(10)] + [PLANAR], SPEC)
    summary = lambda maps: maps.groupBy("variant_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("attempts").alias("a"), F.sum("g_ws").alias("g"), F.round(F.max("g_margin"), 9).alias("m"))
    want = sorted(summary(survey_specs(specs, 60, 0.5, bounds_samples=40)).collect())
    before, key = _kept(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(key, None)
    out = summarised_survey(specs, summary, 60, 0.5, batch_samples=400, bounds_samples=40)
    assert {name[:-8] for name in _kept(spark) - before} == {"survey-summary"} and spark.conf.get(key, None) == setting
    assert len(_kept(spark) - before) == 2 and sorted(out.collect()) == want and len(want) == 10


def test_survey_from_specs_leaves_no_samples_or_maps(spark, tmp_path):
    parts = [(k, f"Brand#{k % 3}", k % 5) for k in range(1, 13)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    before = _kept(spark)
    out = spec_queries.survey_from_specs(spark, str(tmp_path)).collect()
    assert {r.variant_id for r in out} == {f"part_{k}" for k, _, _ in parts} and all(r.attempts <= 64 for r in out)
    assert {name[:-8] for name in _kept(spark) - before} == {"base-specs", "survey-summary"}
