"""Statistics, quality, split, batch, feature and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.store import materialize, new_path
from ..operators import evaluation as J, features as I, quality as A, sampling as H, stats as T
from ..schemas import AUDIT_LABELS, LABELS
from ..sources.tables import write_cells
from . import bindings as B, sql as Q
from .registry import query, r6, rounded
from .survey_queries import grids


def draw(key: str) -> str:
    """SQL of the counter-based uniform for a text key."""
    return f"(('0x' || substr(md5({key}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


# Statistics.

@query("e9_reachable_summary", Q.with_(Q.TO_CELLS, "SELECT variant_id, count(*) AS n_cells, count(*) FILTER (g_ws > 0.5) AS n_reachable, "
       + Q.r6("count(*) FILTER (g_ws > 0.5) / greatest(count(*), 1)", "coverage") + ", "
       + ", ".join(Q.r6(f"avg({k}) FILTER (g_ws > 0.5)", f"{k}_mean") for k in AUDIT_LABELS) + ", "
       + ", ".join(Q.r6(f"quantile_cont({k}, {p}) FILTER (g_ws > 0.5)", f"{k}_{n}")
                   for k in AUDIT_LABELS for n, p in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9)))
       + " FROM cells GROUP BY variant_id"))
def reachable_summary(spark, sf_dir):
    out = T.reachable_summary(B.cells(spark, sf_dir))
    return rounded(out, *[c for c in out.columns if c not in ("variant_id", "n_cells", "n_reachable")])


SPLIT_SQL = """
ids AS (SELECT DISTINCT l_returnflag || l_linestatus AS variant_id, l_linestatus AS stratum FROM lineitem),
splits AS (SELECT stratum, variant_id, CASE WHEN k <= round_even(n * 0.2, 0) THEN 'test'
    WHEN k <= round_even(n * 0.2, 0) * 2 THEN 'val' ELSE 'train' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('42:' || variant_id), variant_id) AS k,
    count(*) OVER (PARTITION BY stratum) AS n FROM ids))"""


def line_splits(spark, sf_dir):
    ids = B.table(spark, sf_dir, "lineitem").select(
        B.variant_of_line().alias("variant_id"), F.col("l_linestatus").alias("stratum")).distinct()
    return H.stratified_split(ids, "stratum", 0.2, 0.2, 42)


def _label_sql() -> str:
    parts = []
    for k in LABELS:
        where = "" if k == "g_ws" else "WHERE g_ws > 0.5"
        marks = ", ".join(Q.r6(f"quantile_cont({k}, {p / 100})", f"p{p}") for p in (1, 5, 50, 95, 99))
        parts.append(f"""SELECT '{k}' AS label, count({k}) AS count, {Q.r6(f'avg({k})', 'mean')}, {Q.r6(f'stddev_pop({k})', 'std')},
          {Q.r6(f'min({k})', 'min')}, {Q.r6(f'max({k})', 'max')}, {marks} FROM train {where}""")
    return "\nUNION ALL ".join(parts)


@query("e10_label_statistics", Q.with_(Q.TO_CELLS + "," + SPLIT_SQL + """,
train AS (SELECT c.* FROM cells c SEMI JOIN (SELECT variant_id FROM splits WHERE split = 'train') s USING (variant_id))""",
    _label_sql() + "\nUNION ALL SELECT 'g_extra', 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL"))
def label_statistics(spark, sf_dir):
    train = materialize(line_splits(spark, sf_dir), "splits").filter(F.col("split") == "train")
    out = T.label_statistics(B.cells(spark, sf_dir), train, [*LABELS, "g_extra"])
    return rounded(out, *[c for c in out.columns if c not in ("label", "count")])


def supplier_variants(spark, sf_dir):
    """Suppliers as variants with their number of line items as size."""
    lines = B.table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("num_cells"))
    suppliers = B.table(spark, sf_dir, "supplier")
    return suppliers.join(lines, suppliers.s_suppkey == lines.l_suppkey).select(
        F.col("s_name").alias("variant_id"), (F.col("s_nationkey") % 4).alias("dof"),
        F.col("s_nationkey").alias("family"), "num_cells")


SUPPLIERS = """
sup AS (SELECT s_name AS variant_id, s_nationkey % 4 AS dof, s_nationkey AS family, count(*) AS num_cells
  FROM supplier JOIN lineitem ON s_suppkey = l_suppkey GROUP BY ALL),
sup_split AS (SELECT dof, variant_id, num_cells, CASE WHEN k <= round_even(n * 0.1, 0) THEN 'test'
    WHEN k <= round_even(n * 0.1, 0) * 2 THEN 'val' ELSE 'train' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY dof ORDER BY md5('42:' || variant_id), variant_id) AS k,
    count(*) OVER (PARTITION BY dof) AS n FROM sup))"""


@query("e11_size_summary", Q.with_(SUPPLIERS + ", scoped AS (SELECT 'all' AS scope, num_cells FROM sup_split UNION ALL "
       "SELECT split, num_cells FROM sup_split)", f"""
SELECT scope, count(*) AS count, min(num_cells)::DOUBLE AS min, max(num_cells)::DOUBLE AS max, {Q.r6('avg(num_cells)', 'mean')},
  {Q.r6('coalesce(stddev_samp(num_cells), 0)', 'stdev')}, quantile_disc(num_cells, 0.5)::DOUBLE AS p50,
  quantile_disc(num_cells, 0.9)::DOUBLE AS p90, quantile_disc(num_cells, 0.95)::DOUBLE AS p95,
  quantile_disc(num_cells, 0.99)::DOUBLE AS p99 FROM scoped GROUP BY scope"""))
def size_summary(spark, sf_dir):
    sizes = supplier_variants(spark, sf_dir)
    splits = H.stratified_split(sizes, "dof").drop("dof")
    return rounded(T.size_summary(sizes.join(splits, "variant_id", "left")), "mean", "stdev")


def run_rows(spark, sf_dir):
    """Orders as rows of a run manifest."""
    status = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "skipped").otherwise("failed")
    return B.table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("family"), F.col("o_orderkey").alias("run_no"), status.alias("status"),
        F.when(status == "failed", F.concat(F.lit("error in "), F.col("o_orderkey").cast("string"))).alias("error"),
        (F.col("o_totalprice") / 1000).alias("elapsed_sec"))


RUNS = """
runs AS (SELECT o_orderpriority AS family, o_orderkey AS run_no,
  CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'skipped' ELSE 'failed' END AS status,
  CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'error in ' || o_orderkey END AS error, o_totalprice / 1000 AS elapsed_sec FROM orders)"""


@query("e12_run_summary", Q.with_(RUNS, """
SELECT family, count(*) AS total_specs, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'skipped') AS skipped,
  count(*) FILTER (status = 'failed') AS failed, round(sum(elapsed_sec), 3) AS elapsed_sec FROM runs GROUP BY family"""))
def run_summary(spark, sf_dir):
    return rounded(T.run_summary(run_rows(spark, sf_dir)), "elapsed_sec", digits=3)


@query("e13_coverage_summary", Q.with_(SUPPLIERS + """,
drawn AS (SELECT s_name AS variant_id, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY s_name),
parts AS (SELECT CASE WHEN grouping(family) = 1 THEN '(all)' ELSE family::VARCHAR END AS family, count(*) AS total_variants,
  count(n) AS seen_variants, coalesce(sum(n), 0)::BIGINT AS samples FROM sup LEFT JOIN drawn USING (variant_id) GROUP BY ROLLUP (family))""", f"""
SELECT family, total_variants, seen_variants, samples, {Q.r6('seen_variants / total_variants', 'coverage')},
  {Q.r6('samples / greatest(1, (SELECT sum(n) FROM drawn))', 'sample_share')} FROM parts"""))
def coverage_summary(spark, sf_dir):
    lines = B.table(spark, sf_dir, "lineitem")
    suppliers = B.table(spark, sf_dir, "supplier")
    seen = lines.join(suppliers, lines.l_suppkey == suppliers.s_suppkey).select(F.col("s_name").alias("variant_id"))
    variants = supplier_variants(spark, sf_dir).withColumn("family", F.col("family").cast("string"))
    return rounded(T.coverage_summary(variants, seen), "coverage", "sample_share")


DRAWN_STEPS = """,
firsts AS (SELECT family::VARCHAR AS family, variant_id, min(l_orderkey // 64) AS step FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
  JOIN sup ON sup.variant_id = s_name GROUP BY ALL),
steps AS (SELECT DISTINCT family::VARCHAR AS family, l_orderkey // 64 AS step FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
  JOIN sup ON sup.variant_id = s_name)"""


def drawn(spark, sf_dir):
    lines, suppliers = B.table(spark, sf_dir, "lineitem"), B.table(spark, sf_dir, "supplier")
    draws = lines.join(suppliers, lines.l_suppkey == suppliers.s_suppkey).select(
        F.col("s_name").alias("variant_id"), F.floor(F.col("l_orderkey") / 64).alias("step"))
    variants = supplier_variants(spark, sf_dir).withColumn("family", F.col("family").cast("string"))
    return variants, draws


@query("e13_seen_by_family", Q.with_(SUPPLIERS + DRAWN_STEPS, "SELECT family, count(*) AS seen_variants FROM firsts GROUP BY family"))
def seen_by_family(spark, sf_dir):
    return T.seen_by_family(T.first_draws(*drawn(spark, sf_dir)))


@query("e13_coverage_over_steps", Q.with_(SUPPLIERS + DRAWN_STEPS, f"""
SELECT s.family, s.step, count(f.variant_id) AS seen_variants, {Q.r6('count(f.variant_id) / any_value(n)', 'coverage')}
FROM steps s JOIN (SELECT family::VARCHAR AS family, count(*) AS n FROM sup GROUP BY 1) USING (family)
LEFT JOIN firsts f ON f.family = s.family AND f.step <= s.step GROUP BY s.family, s.step"""))
def coverage_over_steps(spark, sf_dir):
    variants, draws = drawn(spark, sf_dir)
    return rounded(T.coverage_over_steps(T.first_draws(variants, draws), variants, draws), "coverage")


@query("k6_smallest_largest", Q.with_(SUPPLIERS, """
(SELECT 'smallest' AS side, variant_id, num_cells FROM sup ORDER BY num_cells, variant_id LIMIT 10)
UNION ALL (SELECT 'largest', variant_id, num_cells FROM sup ORDER BY num_cells DESC, variant_id DESC LIMIT 10)"""))
def smallest_largest(spark, sf_dir):
    return T.smallest_and_largest(supplier_variants(spark, sf_dir), 10)


def tree(spark, sf_dir):
    """Regions, nations and suppliers as one graph per region: nodes with two dimensions, edges downwards."""
    region, nation, supplier = (B.table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    nations = nation.select(F.col("n_regionkey").alias("graph_id"), "n_nationkey")
    nodes = region.select(F.col("r_regionkey").alias("graph_id"), F.concat(F.lit("r"), F.col("r_regionkey")).alias("node_id"),
                          F.lit(1.0).alias("length"), F.lit(0.0).alias("radius"))
    nodes = nodes.unionByName(nations.select("graph_id", F.concat(F.lit("n"), F.col("n_nationkey")).alias("node_id"),
                                             F.lit(1.0).alias("length"), (F.col("n_nationkey") / 25).alias("radius")))
    leaves = supplier.join(nations, supplier.s_nationkey == nations.n_nationkey)
    nodes = nodes.unionByName(leaves.select("graph_id", F.concat(F.lit("s"), F.col("s_suppkey")).alias("node_id"),
                                            (F.abs("s_acctbal") / 1000).alias("length"), (F.col("s_suppkey") % 7 / 7).alias("radius")))
    edges = nations.select("graph_id", F.concat(F.lit("r"), F.col("graph_id")).alias("src"),
                           F.concat(F.lit("n"), F.col("n_nationkey")).alias("dst"))
    edges = edges.unionByName(leaves.select("graph_id", F.concat(F.lit("n"), F.col("n_nationkey")).alias("src"),
                                            F.concat(F.lit("s"), F.col("s_suppkey")).alias("dst")))
    return nodes, edges


TREE = """
nodes AS (SELECT r_regionkey AS graph_id, 'r' || r_regionkey AS node_id, 1.0::DOUBLE AS length, 0.0::DOUBLE AS radius FROM region
  UNION ALL SELECT n_regionkey, 'n' || n_nationkey, 1.0, n_nationkey / 25 FROM nation
  UNION ALL SELECT n_regionkey, 's' || s_suppkey, abs(s_acctbal) / 1000, s_suppkey % 7 / 7 FROM supplier JOIN nation ON s_nationkey = n_nationkey),
down AS (SELECT n_regionkey AS graph_id, 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation
  UNION ALL SELECT n_regionkey, 'n' || n_nationkey, 's' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey),
edges AS (SELECT * FROM down UNION ALL SELECT graph_id, dst, src FROM down)"""


@query("e14_segment_mean", Q.with_(TREE, f"""
SELECT graph_id, {Q.r6('avg(length)', 'length')}, {Q.r6('avg(radius)', 'radius')} FROM nodes GROUP BY graph_id"""))
def segment_mean(spark, sf_dir):
    return rounded(T.segment_mean(tree(spark, sf_dir)[0], ["length", "radius"]), "length", "radius")


@query("e14_neighbour_mean", Q.with_(TREE, f"""
SELECT n.graph_id, n.node_id, {Q.r6('coalesce(avg(s.length), 0)', 'length')}, {Q.r6('coalesce(avg(s.radius), 0)', 'radius')}
FROM nodes n LEFT JOIN edges e ON e.graph_id = n.graph_id AND e.dst = n.node_id
LEFT JOIN nodes s ON s.graph_id = e.graph_id AND s.node_id = e.src GROUP BY n.graph_id, n.node_id"""))
def neighbour_mean(spark, sf_dir):
    nodes, down = tree(spark, sf_dir)
    edges = down.unionByName(down.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst")))
    return rounded(T.neighbour_mean(nodes, edges, ["length", "radius"]), "length", "radius")


@query("i8_padded_sequences", Q.with_(TREE + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY node_id) AS k FROM nodes),
width AS (SELECT least(max(n), 16) AS w FROM (SELECT count(*) AS n FROM nodes GROUP BY graph_id))""", f"""
SELECT g.graph_id, i::INTEGER AS position, {Q.r6('coalesce(length, 0)', 'length')}, {Q.r6('coalesce(radius, 0)', 'radius')}, k IS NULL AS is_pad
FROM (SELECT DISTINCT graph_id FROM nodes) g, width, unnest(range(1, w + 1)) t(i)
LEFT JOIN ranked r ON r.graph_id = g.graph_id AND r.k = i"""))
def padded_sequences(spark, sf_dir):
    packed = I.padded_sequences(tree(spark, sf_dir)[0], ["length", "radius"], "node_id", 16)
    items = packed.select("graph_id", F.posexplode(F.arrays_zip("padded", "pad_mask")).alias("i", "e"))
    return items.select("graph_id", (F.col("i") + 1).alias("position"), r6(F.col("e.padded")[0]).alias("length"),
                        r6(F.col("e.padded")[1]).alias("radius"), F.col("e.pad_mask").alias("is_pad"))


# Manifest and audit.

def line_specs(spark, sf_dir):
    """Spec identities of the line-item variants, and of the nations, which have no map."""
    lines = B.table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_returnflag").alias("family"), B.variant_of_line().alias("variant_id")).agg(
        (F.count(F.lit(1)) / 1000).alias("morph_scale"))
    nations = B.table(spark, sf_dir, "nation").select(
        F.lit("nation").alias("family"), F.col("n_name").alias("variant_id"), F.lit(1.0).alias("morph_scale"))
    both = lines.unionByName(nations).withColumn("dof", F.lit(2))
    absolute = F.concat(F.lit("\\data\\root\\specs\\"), F.col("family"), F.lit("\\"), F.col("variant_id"), F.lit(".json"))
    mapped = F.concat(F.lit("/data/root/maps/"), F.col("family"), F.lit("/"), F.col("variant_id"))
    return both.withColumns({"spec_path": A.posix_relative(absolute, "/data/root"),
                             "cap_path": A.posix_relative(mapped, "/data/root")})


@query("g1_manifest", Q.with_(Q.TO_CELLS + ", scale AS (SELECT variant_id, count(*) / 1000 AS morph_scale FROM samples GROUP BY variant_id)", f"""
SELECT family, c.variant_id, 2 AS dof, 'specs/' || family || '/' || c.variant_id || '.json' AS spec_path,
  'maps/' || family || '/' || c.variant_id AS cap_path, count(*) AS num_cells, {Q.r6('avg(g_ws)', 'valid_ratio')},
  'cell_centers,g_iso,g_lim,g_man,g_margin,g_red,g_rot,g_self,g_selfpass,g_sigma,g_ws,sample_counts' AS cap_keys,
  nx, ny, nz, {Q.r6('bmin_x')}, {Q.r6('bmax_z')}, 1.0::DOUBLE AS res_y, {Q.r6('morph_scale')}
FROM cells c JOIN grids USING (variant_id) JOIN scale USING (variant_id) GROUP BY ALL ORDER BY family, c.variant_id"""))
def manifest(spark, sf_dir):
    accepted, _ = A.build_manifest(line_specs(spark, sf_dir), B.cells(spark, sf_dir))
    meta = lambda name, i: F.col(f"grid_meta.{name}")[i]
    return accepted.select(
        "family", "variant_id", "dof", "spec_path", "cap_path", "num_cells", r6("valid_ratio").alias("valid_ratio"),
        F.array_join("cap_keys", ",").alias("cap_keys"), *[meta("cell_shape", i).alias(n) for i, n in enumerate(("nx", "ny", "nz"))],
        r6(meta("bounds_min", 0)).alias("bmin_x"), r6(meta("bounds_max", 2)).alias("bmax_z"),
        r6(meta("resolution", 1)).alias("res_y"), r6("morph_scale").alias("morph_scale")).orderBy("family", "variant_id")


@query("g1_manifest_rejects", "SELECT 'nation' AS family, n_name AS variant_id, 'missing map' AS reason FROM nation")
def manifest_rejects(spark, sf_dir):
    return A.build_manifest(line_specs(spark, sf_dir), B.cells(spark, sf_dir))[1]


@query("g2_relative_paths", """
SELECT p_partkey, CASE WHEN p_size > 40 THEN 'other/' ELSE '' END || p_brand || '/' || p_name || '.json' AS rel FROM part""")
def relative_paths(spark, sf_dir):
    parts = B.table(spark, sf_dir, "part")
    path = F.concat(F.when(F.col("p_size") > 40, F.lit("other/")).otherwise(F.lit("\\data\\root\\")), F.col("p_brand"),
                    F.lit("\\"), F.col("p_name"), F.lit(".json"))
    return parts.select("p_partkey", A.posix_relative(path, "/data/root/").alias("rel"))


@query("g3_run_manifest_fail_fast", Q.with_(RUNS, """
SELECT family, run_no, status, error FROM runs r LEFT JOIN
  (SELECT family, min(run_no) AS stop FROM runs WHERE status = 'failed' GROUP BY family) USING (family) WHERE stop IS NULL OR run_no <= stop"""))
def run_manifest(spark, sf_dir):
    return A.run_manifest(run_rows(spark, sf_dir), "run_no", fail_fast=True).select("family", "run_no", "status", "error")


def part_cells(spark, sf_dir):
    """Parts as cells with the faults an audit looks for; one variant per brand."""
    size = F.col("p_size")
    part = B.table(spark, sf_dir, "part")
    good = (F.col("p_retailprice") / (F.col("p_retailprice") + 1000))
    return part.select(
        F.col("p_type").alias("family"), F.col("p_brand").alias("variant_id"), F.col("p_partkey").alias("cell_idx"),
        F.when((size != 1) | (F.col("p_partkey") % 2 == 0), size.cast("double")).alias("cx"), F.lit(0.0).alias("cy"), F.lit(0.0).alias("cz"),
        F.when(size == 25, F.lit(0.5)).otherwise((size > 10).cast("double")).alias("g_ws"),
        F.when(size == 50, F.lit(float("nan"))).otherwise(good).alias("g_man"),
        F.when(size > 2, good).alias("g_lim"),
        F.when(~F.col("p_brand").endswith("1"), good).alias("g_red"), size.cast("bigint").alias("sample_counts"))


def audit_manifest(spark, sf_dir):
    brands = B.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("variant_id")).agg(
        F.count(F.lit(1)).alias("n"))
    known = brands.select(F.lit("brand").alias("family"), "variant_id", (~F.col("variant_id").endswith("4")).alias("has_spec"),
                          F.lit(True).alias("has_map"), F.when(~F.col("variant_id").endswith("2"), F.lit(2)).alias("dof"),
                          F.lit(0.8).alias("valid_ratio"))
    nations = B.table(spark, sf_dir, "nation").select(
        F.lit("nation").alias("family"), F.col("n_name").alias("variant_id"), F.lit(True).alias("has_spec"),
        F.lit(False).alias("has_map"), F.lit(2).alias("dof"), F.lit(None).cast("double").alias("valid_ratio"))
    return known.unionByName(nations)


AUDIT_KEYS = ["cell_centers", "g_ws", "g_red", "g_man", "g_lim", "g_absent", "sample_counts"]
AUDIT_SQL = """
pc AS (SELECT p_brand AS variant_id, p_size AS s, CASE WHEN p_size <> 1 OR p_partkey % 2 = 0 THEN 1 END AS cx,
  CASE WHEN p_size = 25 THEN 0.5 ELSE (p_size > 10)::INTEGER END AS g_ws FROM part),
facts AS (SELECT variant_id, count(*) AS n, avg(g_ws) AS ratio, bool_or(cx IS NULL) AS bad, bool_or(g_ws = 0.5) AS nb,
  bool_or(s = 50) AS inf_man, count(*) FILTER (s > 2) AS n_lim, right(variant_id, 1) = '1' AS no_red FROM pc GROUP BY variant_id),
report AS (
  SELECT 'brand' AS family, variant_id, right(variant_id, 1) = '4' AS lost,
    CASE WHEN right(variant_id, 1) = '4' THEN ['missing spec_path'] ELSE list_filter([
      'map missing keys: ' || array_to_string(list_filter([CASE WHEN no_red THEN 'g_red' END, CASE WHEN n_lim = 0 THEN 'g_lim' END, 'g_absent'], lambda v: v IS NOT NULL), ','),
      CASE WHEN bad THEN 'cell_centers: bad shape' END, CASE WHEN n_lim > 0 AND n_lim < n THEN 'g_lim: length mismatch' END,
      CASE WHEN inf_man THEN 'g_man: contains non-finite values' END], lambda v: v IS NOT NULL) END AS errors,
    CASE WHEN right(variant_id, 1) = '4' THEN [] ELSE list_filter([
      CASE WHEN right(variant_id, 1) = '2' THEN 'dof missing' END, CASE WHEN nb THEN 'g_ws not binary' END], lambda v: v IS NOT NULL) END AS warnings,
    0.8::DOUBLE AS valid_ratio, n AS num_cells, CASE WHEN right(variant_id, 1) <> '4' THEN ratio END AS ratio FROM facts
  UNION ALL SELECT 'nation', n_name, true, ['missing cap_path'], [], NULL, NULL, NULL FROM nation)"""


def audit_report(spark, sf_dir):
    return A.audit(audit_manifest(spark, sf_dir), part_cells(spark, sf_dir), AUDIT_KEYS)


@query("g4_dataset_audit", Q.with_(AUDIT_SQL, f"""
SELECT family, variant_id, array_to_string(errors, '; ') AS errors, array_to_string(warnings, '; ') AS warnings, valid_ratio,
  num_cells, {Q.r6('ratio', 'valid_ratio_recomputed')} FROM report"""))
def dataset_audit(spark, sf_dir):
    out = audit_report(spark, sf_dir)
    return rounded(out.withColumns({c: F.array_join(c, "; ") for c in ("errors", "warnings")}), "valid_ratio_recomputed")


@query("g4_audit_totals", Q.with_(AUDIT_SQL, """
SELECT count(*) AS num_records, sum(len(errors))::BIGINT AS total_errors, sum(len(warnings))::BIGINT AS total_warnings FROM report"""))
def audit_totals(spark, sf_dir):
    return A.audit_totals(audit_report(spark, sf_dir))


@query("g4_observed_totals", Q.with_(AUDIT_SQL, """
SELECT count(*) AS num_records, sum(len(errors))::BIGINT AS total_errors, sum(len(warnings))::BIGINT AS total_warnings FROM report"""))
def observed_totals(spark, sf_dir):
    """The totals as a side result of writing the report."""
    return A.write_audit(audit_report(spark, sf_dir), new_path(spark, "audit"))


@query("g4_observed_map", Q.with_(Q.TO_FILLED, """
SELECT count(*) AS cells, count(*) FILTER (g_ws > 0.5) AS valid, 0::BIGINT AS bad_centres, count(*) FILTER (g_ws NOT IN (0, 1)) AS not_binary FROM filled"""))
def observed_map(spark, sf_dir):
    """What the audit counts in the cells, as a side result of writing the map."""
    cells = B.cells(spark, sf_dir)
    names = ("cells", "valid", "bad_centres", "not_binary")
    seen = write_cells(cells, new_path(spark, "checked-map"), checks=A.map_checks(cells))
    return spark.createDataFrame([tuple(seen[n] for n in names)], ", ".join(f"{n} bigint" for n in names))


@query("g5_label_conflicts", Q.with_(Q.TO_FILLED, """
SELECT variant_id, cell_idx, g_ws + 0.25::DOUBLE AS label_g_ws, g_ws AS map_g_ws FROM filled WHERE sample_counts = 1 AND attempts = 2"""))
def label_conflicts(spark, sf_dir):
    cells = B.cells(spark, sf_dir)
    odd = (F.col("sample_counts") == 1) & (F.col("attempts") == 2)
    labels = cells.select("variant_id", "cell_idx", (F.col("g_ws") + F.when(odd, 0.25).otherwise(0.000001)).alias("g_ws"))
    return A.label_conflicts(labels, cells)


@query("g6_batch_contract", """
SELECT batch_id, n, array_to_string(list_filter([CASE WHEN a <> b THEN 'mixed variants' END, CASE WHEN f THEN 'feature width' END,
  CASE WHEN l THEN 'label width' END], lambda v: v IS NOT NULL), '; ') AS violations
FROM (SELECT l_orderkey AS batch_id, count(*) AS n, min(l_returnflag) AS a, max(l_returnflag) AS b, bool_or(l_tax = 0.08) AS f,
  bool_or(l_discount = 0.1) AS l FROM lineitem GROUP BY l_orderkey) WHERE a <> b OR f OR l""")
def batch_contract(spark, sf_dir):
    nine, ten = F.array_repeat(F.lit(0.0), 9), F.array_repeat(F.lit(0.0), 10)
    rows = B.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("batch_id"), F.col("l_returnflag").alias("variant_id"),
        F.when(F.col("l_tax") == 0.08, F.slice(nine, 1, 6)).otherwise(nine).alias("pose_feats"),
        F.when(F.col("l_discount") == 0.1, nine).otherwise(ten).alias("labels"))
    out = A.batch_violations(rows, 9, LABELS)
    return out.withColumn("violations", F.array_join("violations", "; "))


@query("g7_width_check", """
SELECT l_returnflag || l_linestatus AS variant_id, l_linenumber AS width, count(*) AS n FROM lineitem WHERE l_linenumber <> 2 GROUP BY ALL""")
def width_check(spark, sf_dir):
    rows = B.table(spark, sf_dir, "lineitem").select(
        B.variant_of_line().alias("variant_id"), F.array_repeat("l_quantity", F.col("l_linenumber")).alias("q"))
    dofs = rows.select("variant_id").distinct().withColumn("dof", F.lit(2))
    return A.width_violations(rows, dofs).groupBy("variant_id", "width").agg(F.count(F.lit(1)).alias("n"))


# Splits and batches.

@query("h1_stratified_split", Q.with_(SUPPLIERS, "SELECT dof, variant_id, split FROM sup_split"))
def stratified_split(spark, sf_dir):
    return H.stratified_split(supplier_variants(spark, sf_dir), "dof")


@query("h2_flattened_index", Q.with_(Q.TO_GRIDS + "," + SPLIT_SQL, """
SELECT variant_id, cell_idx FROM grids, unnest(range(n_cells)) t(cell_idx) WHERE variant_id IN (SELECT variant_id FROM splits WHERE split = 'train')"""))
def flattened_index(spark, sf_dir):
    return H.flattened_index(B.cells(spark, sf_dir), materialize(line_splits(spark, sf_dir), "splits"), "train")


SEED, RATIO, BATCH = 7, 0.7, 64
POOLS = f"""
pool AS (SELECT variant_id, cell_idx, g_ws > 0.5 AS is_ws, row_number() OVER (PARTITION BY variant_id, g_ws > 0.5
    ORDER BY md5('{SEED}:' || variant_id || ':' || cell_idx), variant_id, cell_idx) - 1 AS position FROM filled),
sizes AS (SELECT variant_id, count(*) FILTER (is_ws) AS n_ws, count(*) FILTER (NOT is_ws) AS n_other FROM pool GROUP BY variant_id)"""


@query("h3_pools", Q.with_(Q.TO_FILLED + "," + POOLS, "SELECT variant_id, cell_idx, is_ws, position FROM pool"))
def pools(spark, sf_dir):
    return H.pools(B.cells(spark, sf_dir), SEED)


@query("h3_pool_sizes", Q.with_(Q.TO_FILLED + "," + POOLS, "SELECT variant_id, n_ws, n_other FROM sizes"))
def pool_sizes(spark, sf_dir):
    return H.pool_sizes(B.cells(spark, sf_dir))


@query("h4_balanced_draws", Q.with_(Q.TO_FILLED + f""",
pool AS (SELECT variant_id, cell_idx, g_ws > 0.5 AS is_ws, row_number() OVER (PARTITION BY g_ws > 0.5
    ORDER BY md5('{SEED}:' || variant_id || ':' || cell_idx), variant_id, cell_idx) - 1 AS position FROM filled),
sizes AS (SELECT count(*) FILTER (is_ws) AS n_ws, count(*) FILTER (NOT is_ws) AS n_other FROM pool),
draws AS (SELECT id AS draw_id, CASE WHEN {draw(f"'{SEED}:draw:' || id")} < {RATIO} AND n_ws > 0 THEN true WHEN n_other > 0 THEN false ELSE true END AS is_ws,
    n_ws, n_other FROM sizes, unnest(range(n_ws + n_other)) t(id)),
counted AS (SELECT *, (row_number() OVER (PARTITION BY is_ws ORDER BY draw_id) - 1) % (CASE WHEN is_ws THEN n_ws ELSE n_other END) AS position FROM draws)""",
    "SELECT draw_id, is_ws, position, variant_id, cell_idx FROM counted JOIN pool USING (is_ws, position)"))
def balanced_draws(spark, sf_dir):
    cells = B.cells(spark, sf_dir)
    return H.balanced_draws(cells, cells.count(), RATIO, SEED)


CHOSEN = f"""
spans AS (SELECT variant_id, sum(n_ws + n_other) OVER (ORDER BY variant_id) - (n_ws + n_other) AS a,
    sum(n_ws + n_other) OVER (ORDER BY variant_id) AS b, sum(n_ws + n_other) OVER () AS total FROM sizes),
batches AS (SELECT batch_id, variant_id FROM (SELECT max(total) AS t FROM spans), unnest(range(greatest(1, t // {BATCH})::BIGINT)) u(batch_id),
    spans WHERE {draw(f"'{SEED}:variant:' || batch_id")} * total >= a AND {draw(f"'{SEED}:variant:' || batch_id")} * total < b),
draws AS (SELECT batch_id, variant_id, slot::INTEGER AS slot, batch_id * {BATCH} + slot AS draw_id, n_ws, n_other,
    CASE WHEN {draw(f"'{SEED}:slot:' || (batch_id * {BATCH} + slot)")} < {RATIO} AND n_ws > 0 THEN true WHEN n_other > 0 THEN false ELSE true END AS is_ws
  FROM batches JOIN sizes USING (variant_id), unnest(range({BATCH})) t(slot)),
placed AS (SELECT *, (row_number() OVER (PARTITION BY variant_id, is_ws ORDER BY draw_id) - 1)
    % (CASE WHEN is_ws THEN n_ws ELSE n_other END) AS position FROM draws),
batch_rows AS (SELECT batch_id, variant_id, slot, is_ws, cell_idx FROM placed JOIN pool USING (variant_id, is_ws, position))"""


def batch_rows(spark, sf_dir):
    cells = B.cells(spark, sf_dir)
    return H.grouped_batches(cells, H.epoch_batches(cells.count(), BATCH), BATCH, RATIO, SEED)


@query("h5_grouped_batches", Q.with_(Q.TO_FILLED + "," + POOLS + "," + CHOSEN,
                                     "SELECT batch_id, variant_id, slot, is_ws, cell_idx FROM batch_rows"))
def grouped_batches(spark, sf_dir):
    return batch_rows(spark, sf_dir).select("batch_id", "variant_id", "slot", "is_ws", "cell_idx")


@query("h6_epoch_size", Q.with_(SUPPLIERS, "SELECT split, greatest(1, sum(num_cells) // 256)::BIGINT AS n_batches FROM sup_split GROUP BY split"))
def epoch_size(spark, sf_dir):
    sizes = supplier_variants(spark, sf_dir)
    splits = H.stratified_split(sizes, "dof").drop("dof")
    return sizes.join(splits, "variant_id").groupBy("split").agg(
        F.greatest(F.lit(1), F.floor(F.sum("num_cells") / 256)).alias("n_batches"))


def scale_manifest(spark, sf_dir):
    scale = B.table(spark, sf_dir, "lineitem").groupBy(B.variant_of_line().alias("variant_id")).agg(
        (F.count(F.lit(1)) / 1000).alias("morph_scale"))
    return materialize(grids(spark, sf_dir).join(scale, "variant_id"), "scale-manifest")


FEATURES = """
scale AS (SELECT variant_id, count(*) / 1000 AS morph_scale FROM samples GROUP BY variant_id),
feats AS (SELECT f.*, (cx - bmin_x) / (bmax_x - bmin_x) AS r0, (cy - bmin_y) / (bmax_y - bmin_y) AS r1,
    (cz - bmin_z) / (bmax_z - bmin_z) AS r2, cx / morph_scale AS m0, cy / morph_scale AS m1, cz / morph_scale AS m2
  FROM {cells} f JOIN grids USING (variant_id) JOIN scale USING (variant_id))"""
FEATURE_COLUMNS = ["r0", "r1", "r2", "2 * r0 - 1", "2 * r1 - 1", "2 * r2 - 1", "m0", "m1", "m2"]


@query("h7_batch_assembly", Q.with_(Q.TO_CELLS + "," + POOLS + "," + CHOSEN + "," + FEATURES.format(cells="cells"), f"""
SELECT batch_id, b.variant_id, count(*) AS n, string_agg(b.cell_idx::VARCHAR, ',' ORDER BY slot) AS cell_ids, count(*) FILTER (g_ws > 0.5) AS n_ws,
  {Q.r6('sum(r0)', 'sum_first_feat')}, {Q.r6('sum(g_sigma)', 'sum_last_label')}, 9 AS feat_width, 10 AS label_width
FROM batch_rows b JOIN feats f ON f.variant_id = b.variant_id AND f.cell_idx = b.cell_idx GROUP BY batch_id, b.variant_id"""))
def batch_assembly(spark, sf_dir):
    feats = I.labels_and_mask(I.point_features(B.cells(spark, sf_dir), scale_manifest(spark, sf_dir)))
    rows = batch_rows(spark, sf_dir).join(feats.select("variant_id", "cell_idx", "pose_feats", "labels", "ws_mask"),
                                          ["variant_id", "cell_idx"])
    s = F.col("samples")
    add = lambda pick: F.aggregate(s, F.lit(0.0), lambda a, e: a + pick(e))
    return H.assemble_batches(rows).select(
        "batch_id", "variant_id", F.size(s).cast("bigint").alias("n"),
        F.array_join(F.transform(s, lambda e: e["cell_idx"].cast("string")), ",").alias("cell_ids"),
        F.size(F.filter(s, lambda e: e["ws_mask"])).cast("bigint").alias("n_ws"),
        r6(add(lambda e: e["pose_feats"][0])).alias("sum_first_feat"), r6(add(lambda e: e["labels"][9])).alias("sum_last_label"),
        F.size(s[0]["pose_feats"]).alias("feat_width"), F.size(s[0]["labels"]).alias("label_width"))


# Features of cells.

@query("i1_point_features", Q.with_(Q.TO_FILLED + "," + FEATURES.format(cells="filled"), "SELECT variant_id, cell_idx, "
       + ", ".join(Q.r6(c, f"f{i}") for i, c in enumerate(FEATURE_COLUMNS)) + " FROM feats"))
def point_features(spark, sf_dir):
    out = I.point_features(B.cells(spark, sf_dir).select("variant_id", "cell_idx", "cx", "cy", "cz"), scale_manifest(spark, sf_dir))
    return out.select("variant_id", "cell_idx", *[r6(F.col("pose_feats")[i]).alias(f"f{i}") for i in range(9)])


@query("i2_labels_and_mask", Q.with_(Q.TO_CELLS, "SELECT variant_id, cell_idx, g_ws > 0.5 AS ws_mask, "
       + ", ".join(Q.r6(k, f"y{i}") for i, k in enumerate(LABELS)) + " FROM cells"))
def labels_and_mask(spark, sf_dir):
    out = I.labels_and_mask(B.cells(spark, sf_dir))
    return out.select("variant_id", "cell_idx", "ws_mask", *[r6(F.col("labels")[i]).alias(f"y{i}") for i in range(len(LABELS))])


def _waves(fn: str) -> list[str]:
    return [f"{fn}(2 * pi() * (({v}) * {float(2 ** k)}))" for v in ("cx / 10", "cy / 10") for k in range(3)]


@query("i7_fourier_features", Q.with_(Q.TO_FILLED, "SELECT variant_id, cell_idx, "
       + ", ".join(Q.r6(c, f"f{i}") for i, c in enumerate(["cx / 10", "cy / 10", *_waves("sin"), *_waves("cos")])) + " FROM filled"))
def fourier_features(spark, sf_dir):
    out = B.cells(spark, sf_dir).select("variant_id", "cell_idx", I.fourier(F.array(F.col("cx") / 10, F.col("cy") / 10), 3).alias("f"))
    return out.select("variant_id", "cell_idx", *[r6(F.col("f")[i]).alias(f"f{i}") for i in range(14)])


# Evaluation over predictions.

def predictions(spark, sf_dir):
    labels, docs = B.table(spark, sf_dir, "labels"), B.table(spark, sf_dir, "documents")
    return docs.select("doc_id", "n_chars").join(labels, "doc_id").select(
        F.col("doc_id").alias("sample_id"), (F.col("doc_id") % 16).alias("batch_id"),
        F.col("quality").cast("double").alias("g_ws"), ((F.col("n_chars") % 200 - 100) / 25.0).alias("ws_score"),
        F.col("toxic").cast("double").alias("toxic"), ((F.col("doc_id") * 37 % 100) / 100.0).alias("toxic_pred"),
        (1 + F.col("doc_id") % 3).cast("double").alias("weight"))


PREDS = """
preds AS (SELECT doc_id AS sample_id, doc_id % 16 AS batch_id, quality::DOUBLE AS g_ws, ((n_chars % 200) - 100) / 25.0::DOUBLE AS ws_score,
  toxic::DOUBLE AS toxic, (doc_id * 37 % 100) / 100.0::DOUBLE AS toxic_pred, (1 + doc_id % 3)::DOUBLE AS weight FROM documents JOIN labels USING (doc_id)),
counts AS (SELECT count(*) FILTER (h AND t) AS tp, count(*) FILTER (NOT h AND NOT t) AS tn, count(*) FILTER (h AND NOT t) AS fp,
  count(*) FILTER (NOT h AND t) AS fn FROM (SELECT 1 / (1 + exp(-ws_score)) > 0.5 AS h, g_ws > 0.5 AS t FROM preds)),
reg AS (SELECT 'toxic' AS head, sum(abs(toxic_pred - toxic) * g_ws) AS sa, sum((toxic_pred - toxic) * (toxic_pred - toxic) * g_ws) AS sq, sum(g_ws) AS sw FROM preds)"""


@query("j1_classification_metrics", Q.with_(PREDS, f"""
SELECT tp, tn, fp, fn, {Q.r6('(tp + tn) / (tp + tn + fp + fn)', 'ws_acc')}, {Q.r6('tp / greatest(tp + fp, 1e-8)', 'ws_precision')},
  {Q.r6('tp / greatest(tp + fn, 1e-8)', 'ws_recall')},
  {Q.r6('2 * (tp / greatest(tp + fp, 1e-8)) * (tp / greatest(tp + fn, 1e-8)) / greatest(tp / greatest(tp + fp, 1e-8) + tp / greatest(tp + fn, 1e-8), 1e-8)', 'ws_f1')}
FROM counts"""))
def classification_metrics(spark, sf_dir):
    counts = predictions(spark, sf_dir).agg(*J.classification_counts())
    return rounded(J.classification_metrics(counts), "ws_acc", "ws_precision", "ws_recall", "ws_f1")


def regression_rows(spark, sf_dir):
    return predictions(spark, sf_dir).select(
        "batch_id", F.lit("toxic").alias("head"), F.col("toxic_pred").alias("y_pred"), F.col("toxic").alias("y_true"), "g_ws")


@query("j2_masked_errors", Q.with_(PREDS, f"""
SELECT head, {Q.r6('sa / greatest(sw, 1e-8)', 'mae')}, {Q.r6('sqrt(sq / greatest(sw, 1e-8))', 'rmse')} FROM reg"""))
def masked_errors(spark, sf_dir):
    return rounded(J.regression_metrics(J.regression_sums(regression_rows(spark, sf_dir), [])).select("head", "mae", "rmse"), "mae", "rmse")


BCE = "greatest(ws_score, 0) - ws_score * g_ws + ln(1 + exp(-abs(ws_score)))"
BCE_POS = "(1 - g_ws) * ws_score + (1 + 1.5::DOUBLE * g_ws) * (ln(1 + exp(-abs(ws_score))) + greatest(-ws_score, 0))"
PROB = "least(greatest(1 / (1 + exp(-ws_score)), 1e-8::DOUBLE), 1 - 1e-8::DOUBLE)"


@query("j3_cross_entropy", Q.with_(PREDS, f"""
SELECT {Q.r6(f'avg(({BCE}) * weight)', 'logits')}, {Q.r6(f'avg(({BCE_POS}) * weight)', 'positive_weight')},
  {Q.r6(f'avg(-(g_ws * ln({PROB}) + (1 - g_ws) * ln(1 - {PROB})) * weight)', 'probabilities')} FROM preds"""))
def cross_entropy(spark, sf_dir):
    score, y, w = F.col("ws_score"), F.col("g_ws"), F.col("weight")
    return predictions(spark, sf_dir).agg(
        r6(F.avg(J.bce(score, y) * w)).alias("logits"), r6(F.avg(J.bce(score, y, pos_weight=2.5) * w)).alias("positive_weight"),
        r6(F.avg(J.bce(J.probability(score), y, with_logits=False) * w)).alias("probabilities"))


def loss_rows(spark, sf_dir):
    """Long prediction rows: the ws head, one supervised head and one head without labels."""
    heads = F.array(
        F.struct(F.lit("g_ws").alias("head"), F.col("ws_score").alias("y_pred"), F.col("g_ws").alias("y_true")),
        F.struct(F.lit("toxic").alias("head"), F.col("toxic_pred").alias("y_pred"), F.col("toxic").alias("y_true")),
        F.struct(F.lit("extra").alias("head"), F.col("toxic_pred").alias("y_pred"), F.lit(None).cast("double").alias("y_true")))
    return predictions(spark, sf_dir).select(
        "batch_id", "weight", (F.col("g_ws") > 0.5).alias("ws_mask"), F.explode(heads).alias("h")).select(
        "batch_id", "weight", "ws_mask", "h.*")


L1 = "CASE WHEN abs(toxic_pred - toxic) < 0.05 THEN 0.5 * (toxic_pred - toxic) * (toxic_pred - toxic) / 0.05 ELSE abs(toxic_pred - toxic) - 0.025 END"
LOSSES = f"""
loss AS (SELECT {{key}} 'g_ws' AS head, avg(({BCE}) * weight) AS loss, NULL::DOUBLE AS mask_den FROM preds {{by}}
  UNION ALL SELECT {{key}} 'toxic', sum(({L1}) * weight * g_ws) / greatest(sum(weight * g_ws), 1e-8), greatest(sum(weight * g_ws), 1e-8) FROM preds {{by}})"""
WEIGHTED = """CASE head WHEN 'g_ws' THEN 2.0::DOUBLE * loss ELSE loss END"""


@query("j4_head_losses", Q.with_(PREDS + "," + LOSSES.format(key="", by=""), f"SELECT head, {Q.r6('loss')}, {Q.r6('mask_den')} FROM loss"))
def head_losses(spark, sf_dir):
    return rounded(J.head_losses(loss_rows(spark, sf_dir), []), "loss", "mask_den")


TOTALS = f"""SELECT batch_id, {Q.r6('sum(loss)', 'raw_sum')}, {Q.r6(f'sum({WEIGHTED})', 'weighted_no_reg')},
  {Q.r6(f"sum({WEIGHTED} + CASE head WHEN 'g_ws' THEN -0.5 * ln(4.0) ELSE 0 END)", 'total')} FROM loss GROUP BY batch_id"""


@query("j5_weighted_totals", Q.with_(PREDS + "," + LOSSES.format(key="batch_id,", by="GROUP BY batch_id"), TOTALS))
def weighted_totals(spark, sf_dir):
    losses = J.head_losses(loss_rows(spark, sf_dir), ["batch_id"])
    return rounded(J.total_losses(losses, ["batch_id"], {"g_ws": 2.0}), "raw_sum", "weighted_no_reg", "total")


@query("j6_mean_over_batches", Q.with_(PREDS + "," + LOSSES.format(key="batch_id,", by="GROUP BY batch_id"), f"""
SELECT head, count(*) AS n_batches, {Q.r6('avg(loss)', 'loss')} FROM loss GROUP BY head"""))
def mean_over_batches(spark, sf_dir):
    losses = J.head_losses(loss_rows(spark, sf_dir), ["batch_id"])
    return rounded(J.mean_over_batches(losses, ["head"], ["loss"]), "loss")


@query("j7_named_labels", Q.with_(Q.TO_CELLS, "\nUNION ALL ".join(
    f"SELECT variant_id, '{k}' AS head, count(*) AS n, {Q.r6(f'sum({k})', 'total')} FROM cells GROUP BY variant_id" for k in LABELS)))
def named_labels(spark, sf_dir):
    cells = B.cells(spark, sf_dir)
    rows = cells.select("variant_id", "cell_idx", J.label_vectors(cells, LABELS).alias("labels"))
    long = J.named_labels(rows, ["variant_id", "cell_idx"], LABELS)
    return rounded(long.groupBy("variant_id", "head").agg(F.count(F.lit(1)).alias("n"), F.sum("y_true").alias("total")), "total")
