"""File sources, sinks and streams."""

import json
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F, types as T

from tests.toys import FOLDING, PLANAR, SLIDING
from voxfield.operators import convergence as C, grid as V, specs as X, survey as S
from voxfield.plans import QUERIES
from voxfield.sources import tables as A
from voxfield.sources.descriptions import scan_descriptions
from voxfield.streaming import jobs as L
from voxfield.streaming.snapshots import KeyedTable

XML = """<?xml version="1.0"?>
<robot name="{name}">
  <link name="base"><inertial><mass value="0"/><inertia ixx="1" iyy="1" izz="1" ixy="0" ixz="0" iyz="0"/></inertial></link>
  <link name="arm"><collision><geometry><cylinder radius="0.04"/></geometry></collision></link>
  <link name="hand"><inertial><mass value="2"/><inertia ixx="0.0004" iyy="0.01" izz="0.01" ixy="0" ixz="0" iyz="0"/></inertial><visual/></link>
  <link name="tool"/>
  <link/>
  <joint name="turn" type="continuous"><parent link="base"/><child link="arm"/><origin xyz="0 0 0.3" rpy="0 0 1"/><axis xyz="0 1 0"/></joint>
  <joint name="lift" type="prismatic"><parent link="arm"/><child link="hand"/><origin xyz="0.06 0"/><limit lower="-0.2" upper="0.4"/></joint>
  <joint name="weld" type="fixed"><parent link="hand"/><child link="tool"/></joint>
  <joint type="fixed"><parent link="tool"/><child link="base"/></joint>
</robot>
"""


@pytest.fixture
def xml_folder(tmp_path):
    for name in ("one", "two"):
        (tmp_path / "xml" / name).mkdir(parents=True)
        (tmp_path / "xml" / name / f"{name}.urdf").write_text(XML.format(name=name))
    return str(tmp_path / "xml")


def test_descriptions_become_specs(spark, xml_folder):
    raw = scan_descriptions(spark, xml_folder).withColumn("family", F.lit("toy"))
    docs = [r.asDict(recursive=True) for r in X.assemble_specs(raw).orderBy("meta.variant_id").collect()]
    assert [d["meta"]["variant_id"] for d in docs] == ["one", "two"]
    doc = docs[0]
    assert (doc["meta"]["base_link"], doc["meta"]["ee_link"], doc["meta"]["dof"]) == ("base", "tool", 2)
    assert doc["graph"] == {"num_nodes": 4, "edges": [[0, 1], [1, 2], [2, 3]]}
    turn, lift, weld = doc["chain"]["joints"]
    assert turn["limit_upper"] == pytest.approx(3.14159265) and turn["axis"] == [0, 1, 0]
    assert lift["origin_xyz"] == [0.06, 0, 0] and lift["axis"] == [0, 0, 1] and lift["limit_upper"] == 0.4
    assert weld["limit_lower"] is None and not weld["is_actuated"]
    assert [l["length_estimate"] for l in doc["chain"]["links"]] == pytest.approx([0, 0.3, 0.06, 0])


def test_radius_cascade_by_kind_of_evidence(spark, xml_folder):
    rows = X.collision_radii(scan_descriptions(spark, xml_folder)).filter("variant_id = 'one'").collect()
    got = {r["name"]: r["radius"] for r in rows}
    assert got["base"] == 0.0 and got["tool"] == 0.0
    assert got["arm"] == pytest.approx(0.024)
    assert got["hand"] == pytest.approx(0.02)


def test_an_end_that_is_not_connected_leaves_the_base_only(spark):
    link = "name string, mass string, ixx string, iyy string, izz string, ixy string, ixz string, iyz string, cylinder string, sphere string, has_collision boolean, has_visual boolean"
    joint = "name string, type string, parent string, child string, xyz string, rpy string, axis string, lower string, upper string"
    one = lambda n: (n,) + (None,) * 9 + (False, False)
    df = spark.createDataFrame([("v", "f", [one("a"), one("b"), one("c"), one("d")],
                                 [("j", "fixed", "a", "z") + (None,) * 5, ("k", "fixed", "c", "b") + (None,) * 5])],
                               f"variant_id string, family string, links array<struct<{link}>>, joints array<struct<{joint}>>".replace(" string", ":string").replace(" boolean", ":boolean").replace("variant_id:string, family:string", "variant_id string, family string"))
    out = X.chain_path(X.detect_ends(df)).first()
    assert (out.base_link, out.ee_link, out.path) == ("a", "b", ["a"])


def test_branched_paths_read_the_joints_once(spark):
    """The last joint with a parent leads to a link; cycles end. Every step is one expression over the joints."""
    made = {"twice": [("a", "b"), ("b", "d"), ("c", "d"), ("a", "c")], "cycle": [("a", "z"), ("c", "d"), ("d", "c"), ("d", "e")],
            "orphan": [("a", "b"), (None, "b"), ("", "b")]}
    rows = [(g, [(f"j{i}", p, c) for i, (p, c) in enumerate(js)]) for g, js in made.items()]
    df = spark.createDataFrame(rows, "g string, joints array<struct<name:string,parent:string,child:string>>")
    walked = X.main_chain(X.chain_path(X.detect_ends(df.withColumn("links", F.transform("joints", lambda j: F.struct(j["parent"].alias("name")))))))
    got = {r["g"]: (r["path"], [j["name"] for j in r["chain_joints"]]) for r in walked.collect()}
    assert got == {"twice": (["a", "c", "d"], ["j3", "j2"]), "cycle": (["a"], []), "orphan": (["a", "b"], ["j0"])}
    for plan in (walked, QUERIES["b6_branched_chain"](spark, "/root/testdata/sf0.001")):
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        assert text.count("aggregate(sequence(") == 1 and text.count(".child = element_at(") == 1


def test_specs_by_glob_exclusion_and_pattern(spark, tmp_path):
    for doc, name in ((PLANAR, "a_base.json"), (FOLDING, "a_v1.json"), (SLIDING, "b_v1.json")):
        folder = tmp_path / "specs" / name[0]
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(json.dumps(doc, indent=2))
    (tmp_path / "specs" / "a" / "notes.txt").write_text("no spec")
    root = str(tmp_path / "specs")
    ids = lambda **options: sorted(r[0] for r in A.scan_specs(spark, root, **options).select("meta.variant_id").collect())
    assert ids() == ["fold3r", "planar2r", "slide"]
    assert ids(glob="a*.json") == ["fold3r", "planar2r"]
    assert ids(exclude=("a_base.json",)) == ["fold3r", "slide"]
    assert ids(pattern=r"^[ab]_v\d+\.json$") == ["fold3r", "slide"]
    blank = A.scan_specs(spark, root, glob="a_base.json").withColumn(
        "meta", F.col("meta").withField("family", F.lit(" ")).withField("variant_id", F.lit(None).cast("string")).withField("dof", F.lit(None).cast("int")))
    row = X.identity(blank).first()
    assert (row.family, row.variant_id, row.dof) == ("unknown", "a_base", -1)


def test_id_lists_are_trimmed_and_sorted(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("b \n\n  a\n   \nc\n")
    assert sorted(r[0] for r in A.read_ids(spark, str(tmp_path / "ids.txt")).collect()) == ["a", "b", "c"]
    A.write_ids(spark.createDataFrame([("z",), ("x",), ("y",)], "variant_id string"), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text.split() == ["x", "y", "z"]


def test_json_lines_skip_blank_lines(spark, tmp_path):
    (tmp_path / "rows.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r.a for r in A.read_jsonl(spark, str(tmp_path / "rows.jsonl"), "a int").collect()) == [1, 2]


def test_csv_columns_are_the_first_seen_union(spark, tmp_path):
    one = spark.createDataFrame([(1, "x")], "a int, b string")
    two = spark.createDataFrame([(2, 0.5)], "a int, c double")
    A.write_csv([one, two], str(tmp_path / "csv"))
    rows = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert rows.columns == ["a", "b", "c"]
    assert sorted((r.a, r.b, r.c) for r in rows.collect()) == [("1", "x", None), ("2", None, "0.5")]


def test_metric_log_drops_single_bad_values(spark, tmp_path):
    fields = ["phase", "step", "loss/a", "loss/b"]
    rows = spark.createDataFrame([("train", "1", "0.5", "oops"), ("train", "x", "1", "1"), ("val", "2", "3", "4")],
                                 "phase string, step string, `loss/a` string, `loss/b` string")
    A.append_metrics(rows, str(tmp_path / "log"), fields)
    A.append_metrics(rows.drop("loss/b").limit(1), str(tmp_path / "log"), fields)
    got = sorted((r.step, r.series, r.value) for r in A.read_metrics(spark, str(tmp_path / "log"), fields, "train").collect())
    assert got == [(1, "loss/a", 0.5), (1, "loss/a", 0.5)]


def test_finished_variants_are_skipped(spark):
    specs = spark.createDataFrame([("a",), ("b",)], "variant_id string")
    done = spark.createDataFrame([("b", 1), ("b", 2)], "variant_id string, cell_idx int")
    assert [r[0] for r in A.without_existing(specs, done).collect()] == ["a"]


def test_heat_monitor_over_batches_equals_batch_and_counts_late_samples(spark, tmp_path):
    frame = pd.DataFrame({"variant_id": "v", "cell_idx": [i * 7 % 13 for i in range(90)], "sample_id": range(1, 91),
                          "passed": [i % 5 != 0 for i in range(90)], "g_man": [(i * 37 % 101) / 101 for i in range(90)]})
    events = spark.createDataFrame(frame, "variant_id string, cell_idx bigint, sample_id bigint, passed boolean, g_man double")
    source, path, offsets = (str(tmp_path / n) for n in ("source", "state", "offsets"))
    for part in (F.col("sample_id") <= 33, F.col("sample_id").between(34, 70), (F.col("sample_id") > 70) | (F.col("sample_id") == 5)):
        events.filter(part).write.mode("append").parquet(source)
        out = L.heat_monitor(spark.readStream.schema(events.schema).parquet(source), path, offsets, 20, 10)
    want = C.update_heat(events, C.significant_events(events), 20, 10).orderBy("checkpoint").collect()
    got = out.orderBy("checkpoint").collect()
    assert [(r.checkpoint, r.heat) for r in got] == [(r.checkpoint, r.heat) for r in want]
    assert {r.late for r in got} == {1}


def test_metric_stream_merges_its_batches(spark, tmp_path):
    rows = spark.createDataFrame([(2.0, 1.0, 0.5, 0.25), (-1.0, 1.0, 0.1, 0.1), (3.0, 0.0, 0.9, 0.4), (-2.0, 0.0, 0.0, 1.0)],
                                 "ws_score double, g_ws double, y_pred double, y_true double")
    source, path, offsets = (str(tmp_path / n) for n in ("source", "out", "offsets"))
    for part in (F.col("ws_score") > 0, F.col("ws_score") < 0):
        rows.filter(part).write.mode("append").parquet(source)
        out = L.metrics_stream(spark.readStream.schema(rows.schema).parquet(source), path, offsets)
    r = out.first()
    assert (r.tp, r.tn, r.fp, r.fn, r.ws_acc) == (1, 1, 1, 1, 0.5)
    assert r.mae == pytest.approx(0.125)


def test_series_stream_follows_the_log(spark, tmp_path):
    rows = spark.createDataFrame([("t", i, "loss/a", float(i)) for i in range(1, 7)], "phase string, step int, series string, value double")
    source, path, offsets = (str(tmp_path / n) for n in ("source", "out", "offsets"))
    for part in (F.col("step") % 2 == 0, F.col("step") % 2 == 1):
        rows.filter(part).write.mode("append").parquet(source)
        out = L.series_stream(spark.readStream.schema(rows.schema).parquet(source), path, offsets, 3)
    assert [r.smooth for r in out.orderBy("step").collect()] == [1.0, 1.5, 2.0, 3.0, 4.0, 5.0]


def test_series_stream_smooths_late_steps_only_where_they_count(spark, tmp_path):
    """Ranges of two series in no order, with gaps, overlaps and equal points; the rest isn't smoothed again."""
    schema = "phase string, step int, series string, value double"
    row = lambda i, s="a", k=0: ("t", i, s, float((i * 37 + k) % 11))
    batches = [[row(i) for i in range(200, 260)], [row(i) for i in [*range(100, 120), *range(400, 440)]] + [row(i, "b") for i in range(9)],
               [row(i) for i in range(300, 330)], [row(i) for i in (*range(1, 9), 210, 212, 212)], [row(i) for i in range(440, 450)] + [row(3, "b")],
               [row(216), row(216), row(217, k=1)], [row(264), row(120)], [row(i) for i in range(500, 900)], [row(498), row(499, "b")]]
    source, path, offsets = (str(tmp_path / n) for n in ("source", "out", "offsets"))
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        out = L.series_stream(spark.readStream.schema(schema).parquet(source), path, offsets, 4)
    want = []
    for series in "ab":
        points = sorted((r[1], r[3]) for rows in batches for r in rows if r[2] == series)
        want += [(series, *p, round(sum(v for _, v in points[max(0, k - 3):k + 1]) / len(points[max(0, k - 3):k + 1]), 9)) for k, p in enumerate(points)]
    assert sorted((r["series"], r["step"], r["value"], round(r["smooth"], 9)) for r in out.collect()) == sorted(want)
    again = spark.read.parquet(f"{path}/smooth").count() - len(want)
    assert again < 200  # 180, those between or just after late steps; late series as a whole make 1260


def test_survey_stream_keeps_bounded_snapshots(spark, tmp_path):
    rows = [("v", i, float(i % 4), float(i % 3), 0.0, (i * 37 % 101) / 101, i % 5 / 4) for i in range(60)]
    samples = spark.createDataFrame(rows, "variant_id string, sample_id bigint, x double, y double, z double, g_man double, g_self double")
    full = samples.selectExpr("*", "0.5D AS g_lim", "0.5D AS g_iso", "0.5D AS g_sigma", "cast(sample_id % 64 as int) AS sphere_bin")
    grids = spark.createDataFrame([("v", -0.5, -0.5, -0.5, 1.0, 1.0, 1.0, 4, 3, 1)],
                                  "variant_id string, bmin_x double, bmin_y double, bmin_z double, res_x double, res_y double, "
                                  "res_z double, nx int, ny int, nz int")
    source, path, offsets = (str(tmp_path / n) for n in ("source", "out", "offsets"))
    for part in range(5):
        full.filter(F.col("sample_id") % 5 == part).write.mode("append").parquet(source)
        out = L.survey_stream(spark.readStream.schema(full.schema).parquet(source), grids, lambda df: df, path, offsets)
    want = S.survey_cells(V.assign_cells(full, grids)).orderBy("cell_idx").collect()
    got = out.select(want[0].__fields__).orderBy("cell_idx").collect()
    close = lambda a, b: all(x == y or abs(x - y) < 1e-9 for x, y in zip(a[1:], b[1:]))
    assert len(got) == len(want) == 12 and all(map(close, got, want))
    assert sorted(n for n in os.listdir(f"{path}/manifest") if n[0] == "b") == ["batch=3", "batch=4"]
    assert {n[:8] for n in os.listdir(f"{path}/data")} == {"version="} and len(os.listdir(f"{path}/data")) <= 3


def test_keyed_table_over_many_batches(spark, tmp_path):
    """Ten batches, one of them repeated after the next had begun; files stay bounded."""
    schema = T.StructType.fromDDL("k bigint, n bigint")
    table = KeyedTable(spark, f"{tmp_path}/sums", schema, ["k"], {"n": F.sum("n")}, buckets=4)
    newest = KeyedTable(spark, f"{tmp_path}/last", schema, ["k"], buckets=4)
    rng, sums, last = random.Random(4), {}, {}
    for batch in range(10):
        rows = {rng.randrange(9): rng.randrange(100) for _ in range(4)}
        updates = spark.createDataFrame(list(rows.items()), schema)
        for _ in range(1 + (batch == 6)):
            table.merge(updates, batch)
            newest.merge(updates, batch)
        for k, n in rows.items():
            sums[k], last[k] = sums.get(k, 0) + n, n
    assert {r.k: r.n for r in table.read().collect()} == sums and {r.k: r.n for r in newest.read().collect()} == last
    folders = [d for d, _, _ in os.walk(f"{tmp_path}/sums/data") if "bucket=" in d]
    assert len(folders) <= 8 and len(os.listdir(f"{tmp_path}/sums/manifest")) <= 4


def test_heat_monitor_with_a_hot_key(spark, tmp_path):
    """Half of the samples lie outside the grid, most others in one cell; three batches equal one pass."""
    rows = [("v", None if i % 2 else i // 2 % 40 // 39, i, i % 3 != 0, (i * 7919 % 1009) / 1009) for i in range(1, 3001)]
    events = spark.createDataFrame(rows, "variant_id string, cell_idx bigint, sample_id bigint, passed boolean, g_man double")
    source, path, offsets = (str(tmp_path / n) for n in ("source", "state", "offsets"))
    for low, high in ((1, 900), (901, 2100), (2101, 3000)):
        events.filter(F.col("sample_id").between(low, high)).write.mode("append").parquet(source)
        out = L.heat_monitor(spark.readStream.schema(events.schema).parquet(source), path, offsets, 200, 100)
    want = C.update_heat(events, C.significant_events(events), 200, 100)
    assert sorted((r.checkpoint, r.heat, r.late) for r in out.collect()) == sorted((r.checkpoint, r.heat, 0) for r in want.collect())
    assert L._heat_tables(spark, path)["cells"].read().count() == 3
