import contextlib
import glob
import io
import re

import pytest
from pyspark.sql import functions as F

from voxfield.functions.store import shared_folder
from voxfield.operators import kernel as P, specs as X, stats as T
from voxfield.plans import QUERIES, bindings as B, spec_queries as S


@pytest.fixture
def lines(spark, tmp_path):
    """A folder with its own line items; two rows repeat."""
    rows = [(k // 3, k * 7 % 200, k * 5 % 10, k % 3 + 1, float(k % 50 + 1), 1000.0 + k, (k % 11) / 100, (k % 9) / 100, "ANR"[k % 3], "FO"[k % 2])
            for k in [*range(300), 4, 4]]
    df = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                               "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string")
    df.repartition(6).withColumn("l_comment", F.lit("c" * 40)).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def written(spark, name):
    return set(glob.glob(f"{shared_folder(spark)}/voxfield/{name}-*"))


def test_ordered_samples_store_the_line_columns_once(spark, lines):
    before = {name: written(spark, name) for name in ("ordered", "ordered-samples")}
    samples = B.ordered_samples(spark, lines)
    assert samples.count() == 302 and not written(spark, "ordered-samples") - before["ordered-samples"]
    stored, = {p for p in written(spark, "ordered") - before["ordered"] if "ordered-samples" not in p}
    assert set(spark.read.parquet(stored).columns) <= {*B.LINE_COLUMNS, "variant_id", "_place"} - {"l_orderkey", "l_linenumber"}
    numbers = samples.groupBy("variant_id").agg(F.sort_array(F.collect_list("sample_id")).alias("n"), F.count("*").alias("k")).collect()
    assert all(r["n"] == list(range(1, r["k"] + 1)) for r in numbers)
    assert B.ordered_samples(spark, lines) is samples


def test_stream_source_has_a_file_for_each_split(spark, lines):
    spark.conf.set("spark.sql.files.openCostInBytes", "200000000")  # every file its own split
    try:
        before = written(spark, "line-stream"), written(spark, "survey-stream-offsets")
        out = QUERIES["l1_survey_stream"](spark, lines)
        source, = written(spark, "line-stream") - before[0]
        offsets, = written(spark, "survey-stream-offsets") - before[1]
        assert len(glob.glob(f"{source}/*.parquet")) == 6 and len(glob.glob(f"{offsets}/commits/[0-9]*")) == 3
        assert "l_comment" not in spark.read.parquet(source).columns
        assert out.agg(F.sum("attempts")).first()[0] == 302
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_coverage_needs_one_row_for_a_variant(spark):
    variants = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("c", "y"), ("d", None), ("e", "y"), (None, "y")],
                                     "variant_id string, family string")
    draws = spark.createDataFrame([("a", 5), ("a", 3), ("b", None), ("b", 7), ("c", 9), ("c", 9), ("d", 1), ("z", 1), (None, 2)] +
                                  [("c", 10 + k) for k in range(200)], "variant_id string, step long")
    firsts = T.first_draws(variants, draws)
    assert sorted(map(str, ((r["family"], r["step"]) for r in firsts.collect()))) == sorted(
        map(str, [("x", 3), ("x", 3), ("x", None), ("y", 9), (None, 1)]))
    assert {r["family"]: r["seen_variants"] for r in T.seen_by_family(firsts).collect()} == {"x": 3, "y": 1, None: 1}
    rows = {(r["family"], r["step"]): (r["seen_variants"], round(r["coverage"], 6)) for r in T.coverage_over_steps(firsts, variants, draws).collect()}
    assert rows == {("x", None): (1, 0.333333), ("x", 3): (3, 1.0), ("x", 5): (3, 1.0), ("x", 7): (3, 1.0),
                    **{("y", s): (1, 0.333333) for s in range(9, 210)}}


def test_chain_places_and_texts(spark):
    names = spark.createDataFrame([(["a", "b", "a"], "b", "z"), (["a"], None, "a"), ([], "a", "a"), (None, "a", "a"), (["a", None], "a", "c")],
                                  "names array<string>, u string, v string")
    found = [r[0] for r in names.select(X.places("names", F.col("u"), F.col("v"))).collect()]
    assert found == [[1, -1], [None, 0], [-1, -1], [None, None], [0, -1]]
    joints = [("j1", "c", "d", 1), ("j2", "b", "c", 2), ("j3", "b", "x", 3), ("j4", None, "b", 4), ("j5", "b", "a", 5), ("j6", "a", None, 6)]
    chain = spark.createDataFrame([(["a", "b", "c", "d"], joints)], "path array<string>, joints array<struct<name string, parent string, child string, i int>>")
    assert [j["name"] for j in X.main_chain(chain).first()["chain_joints"]] == ["j2", "j5", "j1"]
    milli = spark.createDataFrame([(v,) for v in (0, 7, -7, 250, -300, 1999, -2499, None)], "v long").select(S._milli(F.col("v"))).collect()
    assert [r[0] for r in milli] == ["0.000", "0.007", "-0.007", "0.250", "-0.300", "1.999", "-2.499", None]


def test_chain_names_are_not_looked_up_by_struct_field(spark, tmp_path):
    """Such a lookup reads the field's type again for every element."""
    parts = spark.createDataFrame([(p, f"brand{p % 3}", p % 9) for p in range(40)], "p_partkey long, p_brand string, p_size int")
    parts.write.parquet(f"{tmp_path}/part.parquet")
    specs = X.assemble_specs(S.descriptions(spark, str(tmp_path)))
    for rows in specs, P.chains(specs):
        with contextlib.redirect_stdout(io.StringIO()) as text:
            rows.explain(True)
        assert not re.search(r"array_(contains|position)\(\w+#\d+, lambda \w+#\d+\.", text.getvalue().split("== Optimized Logical Plan ==")[1])
