"""Description, spec, graph, sampling, pose and clearance queries over chains derived from the part table."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F

from ..functions import geometry as G
from ..functions.store import listed, materialize, new_path
from ..operators import collision as D, features as I, grid as V, kernel as P, sampling as H, specs as X
from ..sources import descriptions as XML, tables as A
from . import bindings as B, sql as Q
from .pipelines import stopped_samples, summarised_survey
from .registry import query, r6, rounded


def _milli(v: Column) -> Column:
    """Thousandths as decimal text."""
    return (v.cast("decimal(9,0)") * F.lit(Decimal("0.001"))).cast("string")


def descriptions(spark, sf_dir):
    """Every part as a chain of two to five joints with a side branch; missing attributes occur in all forms."""
    p, text = F.col("p_partkey"), lambda *vs: F.concat_ws(" ", *[_milli(v) for v in vs])
    none = F.lit(None).cast("string")

    def link(i):
        inertia = {"ixx": (p + i * 3) % 20, "iyy": (p * 2 + i) % 15, "izz": (p * 5 + i * 2) % 25}
        form = (p + i) % 8
        return F.struct(
            F.concat(F.lit("l"), i.cast("string")).alias("name"), F.when((p + i) % 7 != 3, _milli((p * 3 + i * 5) % 40)).alias("mass"),
            *[(F.when((p + i) % 10 != 4, _milli(v)) if k == "izz" else _milli(v)).alias(k) for k, v in inertia.items()],
            *[F.lit("0").alias(k) for k in ("ixy", "ixz", "iyz")],
            F.when(form == 5, _milli(10 + (p + i) % 60)).alias("cylinder"), F.when(form == 6, _milli(20 + (p + i) % 30)).alias("sphere"),
            (form >= 5).alias("has_collision"), ((p + i) % 3 != 0).alias("has_visual"))

    def joint(j):
        xyz = ((p * 7 + j * 131) % 900, (p * 3 + j * 17) % 400 - 200, (p + j * 29) % 300)
        kind, turn = (p + 3 * j) % 6, (p + j) % 5
        placed = (p + j) % 11 != 0
        return F.struct(
            F.concat(F.lit("j"), j.cast("string")).alias("name"),
            F.when(kind == 0, "fixed").when(kind == 1, "prismatic").when(kind == 2, "continuous").otherwise("revolute").alias("type"),
            F.concat(F.lit("l"), (j - 1).cast("string")).alias("parent"), F.concat(F.lit("l"), j.cast("string")).alias("child"),
            F.when(placed, F.when((p + j) % 13 == 0, text(*xyz[:2])).otherwise(text(*xyz))).alias("xyz"),
            F.when(placed, text((p + j) % 7 * 250, p * 0, (p + 2 * j) % 5 * -300)).alias("rpy"),
            F.when(turn == 1, "1 0 0").when(turn == 2, "0 1 0").when(turn == 3, "0 0 1").when(turn == 4, "0 -1 0").alias("axis"),
            F.when(((p + j) % 9 != 0) & ((p + j) % 17 != 0), _milli(-(500 + (p * 11 + j * 7) % 2000))).alias("lower"),
            F.when((p + j) % 9 != 0, _milli(400 + (p * 5 + j * 3) % 2200)).alias("upper"))
    rows = B.spread(B.table(spark, sf_dir, "part")).withColumn("_n", 2 + F.col("p_size") % 4)
    rows = rows.withColumns({
        "links": F.transform(F.sequence(F.lit(0), F.col("_n")), link), "joints": F.transform(F.sequence(F.lit(1), F.col("_n")), joint)})
    camera = lambda name: F.struct(F.lit(name).alias("name"), *[none.alias(k) for k in (
        "mass", "ixx", "iyy", "izz", "ixy", "ixz", "iyz", "cylinder", "sphere")],
        F.lit(False).alias("has_collision"), F.lit(False).alias("has_visual"))
    mount = lambda name: F.struct(
        F.lit(name).alias("name"), F.lit("fixed").alias("type"), F.lit("l1").alias("parent"), F.lit("z_cam").alias("child"),
        F.lit("0.1 0 0").alias("xyz"), F.lit("0 0 0").alias("rpy"), none.alias("axis"), none.alias("lower"), none.alias("upper"))
    return rows.select(
        F.concat(F.lit("part_"), p.cast("string")).alias("variant_id"), F.col("p_brand").alias("family"),
        F.concat("links", F.array(camera("z_cam"), camera(""))).alias("links"),
        F.concat(F.array(mount("cam_mount"), mount(None)), F.when(p % 2 == 1, F.reverse("joints")).otherwise(F.col("joints"))).alias("joints"))


def base_specs(spark, sf_dir):
    return B.stored_once(spark, sf_dir, "base-specs", lambda: X.assemble_specs(descriptions(spark, sf_dir)))


# The same chains in SQL: dl links, dj joints, np typed joints.
PARTS = """
chain AS (SELECT p_partkey AS p, 'part_' || p_partkey AS variant_id, p_brand AS family, 2 + p_size % 4 AS n FROM part),
dl AS (SELECT p, variant_id, i, 'l' || i AS name, n, CASE WHEN (p + i) % 7 <> 3 THEN ((p * 3 + i * 5) % 40) / 1000 END AS mass,
    ((p + i * 3) % 20) / 1000 AS ixx, ((p * 2 + i) % 15) / 1000 AS iyy, CASE WHEN (p + i) % 10 <> 4 THEN ((p * 5 + i * 2) % 25) / 1000 END AS izz,
    CASE (p + i) % 8 WHEN 5 THEN (10 + (p + i) % 60) / 1000 WHEN 6 THEN (20 + (p + i) % 30) / 1000 END AS primitive,
    (p + i) % 8 < 5 AND (p + i) % 3 = 0 AS bare
  FROM chain, unnest(range(n + 1)) t(i)),
dj AS (SELECT p, variant_id, n, j, 'j' || j AS name, 'l' || (j - 1) AS parent, 'l' || j AS child,
    CASE (p + 3 * j) % 6 WHEN 0 THEN 'fixed' WHEN 1 THEN 'prismatic' WHEN 2 THEN 'continuous' ELSE 'revolute' END AS type,
    CASE WHEN (p + j) % 11 <> 0 THEN ((p * 7 + j * 131) % 900) / 1000 ELSE 0 END AS x,
    CASE WHEN (p + j) % 11 <> 0 THEN ((p * 3 + j * 17) % 400 - 200) / 1000 ELSE 0 END AS y,
    CASE WHEN (p + j) % 11 <> 0 AND (p + j) % 13 <> 0 THEN ((p + j * 29) % 300) / 1000 ELSE 0 END AS z,
    CASE WHEN (p + j) % 11 <> 0 THEN ((p + j) % 7 * 250) / 1000 ELSE 0 END AS roll,
    CASE WHEN (p + j) % 11 <> 0 THEN ((p + 2 * j) % 5 * -300) / 1000 ELSE 0 END AS yaw,
    CASE WHEN (p + j) % 5 = 1 THEN 1 ELSE 0 END::DOUBLE AS ax, CASE (p + j) % 5 WHEN 2 THEN 1 WHEN 4 THEN -1 ELSE 0 END::DOUBLE AS ay,
    CASE WHEN (p + j) % 5 IN (0, 3) THEN 1 ELSE 0 END::DOUBLE AS az,
    CASE WHEN (p + j) % 9 <> 0 AND (p + j) % 17 <> 0 THEN -(500 + (p * 11 + j * 7) % 2000) / 1000 END AS lo0,
    CASE WHEN (p + j) % 9 <> 0 AND (p + j) % 17 <> 0 THEN (400 + (p * 5 + j * 3) % 2200) / 1000 END AS hi0, (p + j) % 11 <> 0 AS placed
  FROM chain, unnest(range(1, n + 1)) t(j)),
np AS (SELECT *, type <> 'fixed' AS moves, CASE WHEN type = 'fixed' THEN lo0 WHEN type = 'continuous' THEN -pi() ELSE coalesce(lo0, -pi()) END AS lo,
    CASE WHEN type = 'fixed' THEN hi0 WHEN type = 'continuous' THEN pi() ELSE coalesce(hi0, pi()) END AS hi,
    CASE WHEN sqrt(x*x + y*y + z*z) <= 1e-8 THEN 0 ELSE sqrt(x*x + y*y + z*z) END AS len FROM dj),
lr AS (SELECT dl.*, coalesce(len, 0) AS length, CASE WHEN izz IS NULL THEN 0.019 ELSE least(greatest(
      CASE WHEN coalesce(len, 0) > 1e-6 THEN least(CASE WHEN ixx + iyy + izz > 0 THEN sqrt((ixx + iyy + izz) / 3) ELSE 0.019 END, 0.5 * len)
      ELSE CASE WHEN ixx + iyy + izz > 0 THEN sqrt((ixx + iyy + izz) / 3) ELSE 0.019 END END, 0.003), 0.019) END::DOUBLE AS radius
  FROM dl LEFT JOIN np ON np.variant_id = dl.variant_id AND np.child = dl.name),
num AS (SELECT *, CASE WHEN moves THEN count(*) FILTER (moves) OVER (PARTITION BY variant_id ORDER BY j) - 1 END AS k FROM np)"""
PARTS = PARTS.replace("0.019", "0.019::DOUBLE").replace("0.003)", "0.003::DOUBLE)")


@query("b1_identity", """
SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'unknown' ELSE p_brand END AS family,
  CASE WHEN p_size % 5 = 0 THEN 'stem_' || p_partkey ELSE 'part_' || p_partkey END AS variant_id, CASE WHEN p_size % 3 = 0 THEN -1 ELSE p_size END AS dof FROM part""")
def identity(spark, sf_dir):
    size, key = F.col("p_size"), F.col("p_partkey").cast("string")
    meta = F.struct(F.when(size % 7 == 0, F.lit("  ")).otherwise(F.col("p_brand")).alias("family"),
                    F.when(size % 5 != 0, F.concat(F.lit(" part_"), key)).alias("variant_id"), F.when(size % 3 != 0, size).alias("dof"))
    path = F.concat(F.lit("specs/a/stem_"), key, F.lit(".json"))
    rows = B.table(spark, sf_dir, "part").select("p_partkey", meta.alias("meta"), path.alias("file_path"))
    return X.identity(rows).select("p_partkey", "family", "variant_id", F.col("dof").cast("int"))


@query("b2_chain_scale", Q.with_(PARTS, f"SELECT variant_id, {Q.r6('CASE WHEN sum(length) > 0 THEN sum(length) ELSE 1 END', 'scale')} FROM lr GROUP BY variant_id"))
def chain_scale(spark, sf_dir):
    return base_specs(spark, sf_dir).select(F.col("meta.variant_id").alias("variant_id"), r6(X.chain_scale(F.col("chain.links"))).alias("scale"))


@query("b3_exploded_links", Q.with_(PARTS, f"SELECT variant_id, i::INTEGER AS pos, name, {Q.r6('length', 'length_estimate')}, {Q.r6('radius', 'radius_estimate')} FROM lr"))
def exploded_links(spark, sf_dir):
    rows = base_specs(spark, sf_dir).select(F.col("meta.variant_id").alias("variant_id"), F.col("chain.links").alias("links"))
    out = X.exploded(rows, "links", ["variant_id"]).drop("index")
    return rounded(out, "length_estimate", "radius_estimate")


@query("b4_base_and_end", Q.with_(PARTS, "SELECT variant_id, 'l0' AS base_link, 'l' || n AS ee_link FROM chain"))
def base_and_end(spark, sf_dir):
    return X.detect_ends(X.named_only(descriptions(spark, sf_dir))).select("variant_id", "base_link", "ee_link")


@query("b5_chain_path", "WITH RECURSIVE " + PARTS + """,
climb AS (SELECT variant_id, 'l' || n AS link, 0 AS up FROM chain UNION ALL
  SELECT c.variant_id, j.parent, up + 1 FROM climb c JOIN dj j ON j.variant_id = c.variant_id AND j.child = c.link)
SELECT variant_id, string_agg(link, '>' ORDER BY up DESC) AS path FROM climb GROUP BY variant_id""")
def chain_path(spark, sf_dir):
    out = X.chain_path(X.detect_ends(X.named_only(descriptions(spark, sf_dir))))
    return out.select("variant_id", F.array_join("path", ">").alias("path"))


# Branched graphs with several bases and ends, some of which don't lead back to the chosen base: one for each order.
BRANCHED = """edge AS (SELECT l_orderkey AS g, 'n' || (l_partkey % 5) AS parent, 'n' || (l_partkey % 5 + 1 + l_suppkey % 3) AS child,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i FROM lineitem),
base AS (SELECT g, min(parent) AS base_link FROM edge e WHERE NOT EXISTS (SELECT 1 FROM edge c WHERE c.g = e.g AND c.child = e.parent) GROUP BY g),
tip AS (SELECT g, min(child) AS ee_link FROM edge e WHERE NOT EXISTS (SELECT 1 FROM edge c WHERE c.g = e.g AND c.parent = e.child) GROUP BY g)"""
CLIMB = BRANCHED + """,
above AS (SELECT g, child, arg_max(parent, i) AS parent FROM edge GROUP BY g, child),
climb AS (SELECT g, ee_link AS link, 0 AS up FROM tip UNION ALL
  SELECT c.g, a.parent, up + 1 FROM climb c JOIN base b ON b.g = c.g JOIN above a ON a.g = c.g AND a.child = c.link WHERE c.link <> b.base_link),
whole AS (SELECT g, link, row_number() OVER (PARTITION BY g ORDER BY up DESC) AS place FROM climb SEMI JOIN (
  SELECT c.g FROM climb c JOIN base b ON b.g = c.g AND b.base_link = c.link) ok USING (g)),
road AS (SELECT * FROM whole UNION ALL SELECT g, base_link, 1 FROM base WHERE g NOT IN (SELECT g FROM whole))"""


def branched(spark, sf_dir):
    first = F.col("l_partkey") % 5
    name = lambda at: F.concat(F.lit("n"), at.cast("string"))
    joint = F.struct(*B.LINE_ORDER[1:], name(first).alias("parent"), name(first + 1 + F.col("l_suppkey") % 3).alias("child"))
    rows = B.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("g")).agg(F.sort_array(F.collect_list(joint)).alias("joints"))
    rows = rows.withColumn("joints", F.transform("joints", lambda j, i: F.struct(
        F.concat(F.lit("j"), (i + 1).cast("string")).alias("name"), j["parent"].alias("parent"), j["child"].alias("child"))))
    return X.detect_ends(rows.withColumn("links", F.transform("joints", lambda j: F.struct(j["parent"].alias("name")))))


@query("b4_branched_ends", Q.with_(BRANCHED, "SELECT g, base_link, ee_link FROM base JOIN tip USING (g)"))
def branched_ends(spark, sf_dir):
    return branched(spark, sf_dir).select("g", "base_link", "ee_link")


@query("b5_branched_path", f"WITH RECURSIVE {CLIMB} SELECT g, string_agg(link, '>' ORDER BY place) AS path FROM road GROUP BY g")
def branched_path(spark, sf_dir):
    return X.chain_path(branched(spark, sf_dir)).select("g", F.array_join("path", ">").alias("path"))


@query("b6_branched_chain", f"""WITH RECURSIVE {CLIMB}
SELECT e.g, (row_number() OVER (PARTITION BY e.g ORDER BY p.place, e.i) - 1)::INTEGER AS pos, 'j' || e.i AS name
FROM edge e JOIN road p ON p.g = e.g AND p.link = e.parent JOIN road c ON c.g = e.g AND c.link = e.child""")
def branched_chain(spark, sf_dir):
    out = X.main_chain(X.chain_path(branched(spark, sf_dir)))
    return X.exploded(out, "chain_joints", ["g"]).select("g", "pos", "name")


@query("b6_main_chain", Q.with_(PARTS, "SELECT variant_id, (j - 1)::INTEGER AS pos, name, parent, child FROM dj"))
def main_chain(spark, sf_dir):
    df = X.main_chain(X.chain_path(X.detect_ends(X.named_only(descriptions(spark, sf_dir)))))
    return X.exploded(df, "chain_joints", ["variant_id"]).select("variant_id", "pos", "name", "parent", "child")


def chain_joint_rows(spark, sf_dir):
    return X.exploded(X.walked(descriptions(spark, sf_dir)), "records", ["variant_id"])


@query("b7_parsed_vectors", Q.with_(PARTS, "SELECT variant_id, name, x, y, z, roll, 0.0::DOUBLE AS pitch, yaw, ax, ay, az FROM dj"))
def parsed_vectors(spark, sf_dir):
    parts = {"origin_xyz": ("x", "y", "z"), "origin_rpy": ("roll", "pitch", "yaw"), "axis": ("ax", "ay", "az")}
    return chain_joint_rows(spark, sf_dir).select("variant_id", "name", *[
        (F.col(c)[i] + F.lit(0.0)).alias(n) for c, names in parts.items() for i, n in enumerate(names)])


@query("b8_joint_normalisation", Q.with_(PARTS, f"SELECT variant_id, name, type, moves AS is_actuated, {Q.r6('lo', 'limit_lower')}, {Q.r6('hi', 'limit_upper')} FROM np"))
def joint_normalisation(spark, sf_dir):
    out = chain_joint_rows(spark, sf_dir).select("variant_id", "name", "type", "is_actuated", "limit_lower", "limit_upper")
    return rounded(out, "limit_lower", "limit_upper")


@query("b8_urdf_limit_policy", Q.with_(PARTS, f"""
SELECT variant_id, name, {Q.r6("CASE WHEN type = 'fixed' THEN lo0 ELSE coalesce(lo0, CASE WHEN type = 'prismatic' THEN -1 ELSE -pi() END) END", 'limit_lower')},
  {Q.r6("CASE WHEN type = 'fixed' THEN hi0 ELSE coalesce(hi0, CASE WHEN type = 'prismatic' THEN 1 ELSE pi() END) END", 'limit_upper')} FROM dj"""))
def urdf_limit_policy(spark, sf_dir):
    df = X.main_chain(X.chain_path(X.detect_ends(X.named_only(descriptions(spark, sf_dir)))))
    out = X.exploded(X.joint_records(df, "urdf"), "records", ["variant_id"]).select("variant_id", "name", "limit_lower", "limit_upper")
    return rounded(out, "limit_lower", "limit_upper")


@query("b9_link_lengths", Q.with_(PARTS + """,
out_len AS (SELECT variant_id, parent AS name, max(sqrt(x*x + y*y + z*z)) AS v FROM (SELECT variant_id, parent, x, y, z FROM dj WHERE placed
  UNION ALL SELECT variant_id, 'l1', 0.1, 0, 0 FROM chain) GROUP BY ALL)""", f"""
SELECT lr.variant_id, lr.name, {Q.r6('length')}, {Q.r6('coalesce(v, 0)', 'outgoing')} FROM lr LEFT JOIN out_len USING (variant_id, name)"""))
def link_lengths(spark, sf_dir):
    df = X.walked(descriptions(spark, sf_dir))
    pairs = F.transform("lengths", lambda s: F.struct(s["name"].alias("name"), s["length"].alias("length"),
                                                      X.outgoing_length(F.col("joints"), s["name"]).alias("outgoing")))
    return rounded(df.select("variant_id", F.inline_outer(pairs)), "length", "outgoing")


@query("b10_inertia_radius", Q.with_(PARTS, f"SELECT variant_id, name, {Q.r6('radius')} FROM lr"))
def inertia_radius(spark, sf_dir):
    rows = X.walked(descriptions(spark, sf_dir)).select("variant_id", F.inline_outer("link_list"))
    return rows.select("variant_id", "name", r6("radius_estimate").alias("radius"))


@query("b11_radius_cascade", Q.with_(PARTS + """,
out_len AS (SELECT variant_id, parent AS name, max(sqrt(x*x + y*y + z*z)) AS v FROM (SELECT variant_id, parent, x, y, z FROM dj WHERE placed
  UNION ALL SELECT variant_id, 'l1', 0.1, 0, 0 FROM chain) GROUP BY ALL),
est AS (SELECT dl.variant_id, dl.name, bare, coalesce(v, 0) AS len, coalesce(primitive, CASE WHEN mass <= 1e-4 THEN 0
    WHEN greatest(ixx, iyy, coalesce(izz, 0)) > 1e-6 THEN least(greatest(sqrt(2 * least(CASE WHEN ixx > 1e-6 THEN ixx ELSE 9 END, CASE WHEN iyy > 1e-6 THEN iyy ELSE 9 END,
      CASE WHEN coalesce(izz, 0) > 1e-6 THEN izz ELSE 9 END) / mass), 0.005), 0.03) END) AS r
  FROM dl LEFT JOIN out_len USING (variant_id, name))""", f"""
SELECT variant_id, name, {Q.r6('''coalesce(CASE WHEN r > 0 AND len > 0.05 AND r > 0.4 * len THEN greatest(0.005, 0.4 * len) ELSE r END,
  CASE WHEN bare THEN 0 ELSE 0.03 END)::DOUBLE''', 'radius')} FROM est UNION ALL SELECT variant_id, 'z_cam', 0.0 FROM chain"""))
def radius_cascade(spark, sf_dir):
    return rounded(X.collision_radii(descriptions(spark, sf_dir)), "radius")


@query("b12_spec_assembly", Q.with_(PARTS, f"""
SELECT c.variant_id, family, count(*) FILTER (moves) AS dof, any_value(c.n) + 1 AS num_nodes, string_agg((j - 1) || '-' || j, ',' ORDER BY j) AS edges,
  coalesce(string_agg(name, ',' ORDER BY j) FILTER (moves), '') AS moving, {Q.r6('sum(len)', 'total_length')}
FROM chain c JOIN np USING (variant_id) GROUP BY c.variant_id, family"""))
def spec_assembly(spark, sf_dir):
    edge = F.transform("graph.edges", lambda e: F.concat(e[0].cast("string"), F.lit("-"), e[1].cast("string")))
    total = F.aggregate("chain.links", F.lit(0.0), lambda a, l: a + l["length_estimate"])
    return X.assemble_specs(descriptions(spark, sf_dir)).select(
        "meta.variant_id", "meta.family", F.col("meta.dof").cast("bigint").alias("dof"), F.col("graph.num_nodes").cast("bigint").alias("num_nodes"),
        F.array_join(edge, ",").alias("edges"), F.array_join("morphology.actuated_joint_names", ",").alias("moving"), r6(total).alias("total_length"))


@query("b13_actuated_order", Q.with_(PARTS, """
SELECT variant_id, coalesce(string_agg(name, ',' ORDER BY CASE WHEN p % 3 = 0 THEN -j ELSE j END) FILTER (moves), '') AS moving FROM np GROUP BY variant_id"""))
def actuated_order(spark, sf_dir):
    names = F.col("morphology.actuated_joint_names")
    number = F.substring("meta.variant_id", 6, 20).cast("bigint") % 3
    listed = F.when(number == 0, F.concat(F.array(F.lit("ghost")), F.reverse(names))).when(number == 1, names)
    rows = base_specs(spark, sf_dir).withColumn("morphology", F.col("morphology").withField("actuated_joint_names", listed))
    return X.actuated_order(rows).select("meta.variant_id", F.array_join(F.transform("ordered", lambda j: j["name"]), ",").alias("moving"))


N_VARIANTS, VARIANT_SEED = 3, 11


def _u(what: str, prefix: str) -> str:
    return f"(('0x' || substr(md5('{VARIANT_SEED}:' || {prefix} || ':' || name || ':{what}'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


VARIANTS = f"""
vj AS (SELECT *, variant_id || '_v000' || k3 AS vid FROM np, unnest(range(1, {N_VARIANTS + 1})) t(k3)),
drawn AS (SELECT *, CASE WHEN moves THEN 0.7::DOUBLE + {_u('length', 'vid')} * (1.3::DOUBLE - 0.7::DOUBLE) ELSE 1 END AS ls,
    CASE WHEN moves THEN 0.5::DOUBLE + {_u('limit', 'vid')} * 0.5::DOUBLE ELSE 1 END AS js,
    CASE WHEN moves AND hi - lo > 0 THEN sqrt(-2 * ln(1 - {_u('shift:r', 'vid')})) * cos(2 * pi() * {_u('shift:a', 'vid')}) * 0.2::DOUBLE * (hi - lo) ELSE 0 END AS shift FROM vj),
mid AS (SELECT *, greatest(lo, (lo + hi) / 2 + shift - greatest(0.0005, (hi - lo) / 2 * js)) AS a,
    least(hi, (lo + hi) / 2 + shift + greatest(0.0005, (hi - lo) / 2 * js)) AS b, greatest(lo, least(hi, (lo + hi) / 2 + shift)) AS c FROM drawn),
wide AS (SELECT *, CASE WHEN b - a < 0.001 THEN greatest(lo, c - 0.0005) ELSE a END AS a2, CASE WHEN b - a < 0.001 THEN least(hi, c + 0.0005) ELSE b END AS b2 FROM mid),
made AS (SELECT *, CASE WHEN NOT moves OR hi <= lo OR b2 <= a2 THEN lo ELSE a2 END AS nlo, CASE WHEN NOT moves OR hi <= lo OR b2 <= a2 THEN hi ELSE b2 END AS nhi FROM wide)"""


def variants(spark, sf_dir):
    return X.expand_variants(base_specs(spark, sf_dir), N_VARIANTS, VARIANT_SEED)


@query("b14_variant_joints", Q.with_(PARTS + "," + VARIANTS, f"""
SELECT vid AS variant_id, name, {Q.r6('nlo', 'limit_lower')}, {Q.r6('nhi', 'limit_upper')}, {Q.r6('x * ls', 'x')}, {Q.r6('y * ls', 'y')}, {Q.r6('z * ls', 'z')} FROM made"""))
def variant_joints(spark, sf_dir):
    rows = variants(spark, sf_dir).select(F.col("meta.variant_id").alias("variant_id"), F.inline_outer("chain.joints"))
    return rows.select("variant_id", "name", r6("limit_lower").alias("limit_lower"), r6("limit_upper").alias("limit_upper"),
                       *[r6(F.col("origin_xyz")[i]).alias(a) for i, a in enumerate("xyz")])


@query("b14_variant_links", Q.with_(PARTS + "," + VARIANTS, f"""
SELECT v.vid AS variant_id, lr.name, {Q.r6('length * coalesce(ls, 1)', 'length_estimate')}, {Q.r6('radius * coalesce(ls, 1)', 'radius_estimate')}
FROM (SELECT DISTINCT variant_id, vid FROM made) v JOIN lr USING (variant_id) LEFT JOIN made m ON m.vid = v.vid AND m.child = lr.name"""))
def variant_links(spark, sf_dir):
    rows = variants(spark, sf_dir).select(F.col("meta.variant_id").alias("variant_id"), F.inline_outer("chain.links"))
    return rounded(rows.select("variant_id", "name", "length_estimate", "radius_estimate"), "length_estimate", "radius_estimate")


@query("b14_parameters_only", Q.with_(PARTS + "," + VARIANTS, f"""
SELECT vid AS variant_id, name, {Q.r6('ls', 'length_scale')}, {Q.r6('js', 'limit_scale')}, {Q.r6('shift')} FROM made WHERE moves"""))
def parameters_only(spark, sf_dir):
    df = X.expand_variants(base_specs(spark, sf_dir), N_VARIANTS, VARIANT_SEED, materialize_chain=False)
    m = F.col("morphology")
    rows = df.select(F.col("meta.variant_id").alias("variant_id"), F.inline_outer(F.arrays_zip(
        m["actuated_joint_names"].alias("name"), m["length_scale"].alias("length_scale"), m["joint_limit_scale"].alias("limit_scale"),
        m["joint_limit_shift"].alias("shift")))).filter(F.col("name").isNotNull())
    return rounded(rows, "length_scale", "limit_scale", "shift")


@query("b15_lineage", Q.with_(PARTS, f"SELECT variant_id || '_v000' || k AS variant_id, variant_id AS parent_variant_id FROM chain, unnest(range(1, {N_VARIANTS + 1})) t(k)"))
def lineage(spark, sf_dir):
    return variants(spark, sf_dir).select("meta.variant_id", "meta.parent_variant_id")


# Link graph of the base specs.

def graph_specs(spark, sf_dir):
    return base_specs(spark, sf_dir).select(
        "meta.variant_id", F.col("chain.links").alias("links"), F.col("chain.joints").alias("joints"), "meta.base_link", "meta.ee_link",
        "morphology.actuated_joint_names")


NODES = """
walk AS (SELECT lr.*, sum(length) OVER (PARTITION BY lr.variant_id ORDER BY i) AS path_length,
    greatest(sum(length) OVER (PARTITION BY lr.variant_id), 0) AS t0, coalesce(moves, false) AS moves FROM lr LEFT JOIN np ON np.variant_id = lr.variant_id AND np.child = lr.name),
gn AS (SELECT *, CASE WHEN t0 > 1e-8 THEN t0 ELSE 1 END AS total FROM walk)"""


@query("i3_depth_and_path", Q.with_(PARTS + "," + NODES, f"SELECT variant_id, name, i::INTEGER AS depth, {Q.r6('path_length')} FROM gn"))
def depth_and_path(spark, sf_dir):
    return rounded(I.graph_nodes(graph_specs(spark, sf_dir)).select("variant_id", "name", "depth", "path_length"), "path_length")


NODE_FEATURES = {
    "length": "length", "radius": "radius", "index_norm": "i / n", "depth_norm": "i / n", "path_norm": "path_length / total",
    "depth_sin": "sin(2 * pi() * (i / n))", "depth_cos": "cos(2 * pi() * (i / n))", "path_sin": "sin(2 * pi() * (path_length / total))",
    "path_cos": "cos(2 * pi() * (path_length / total))", "is_base": "CASE WHEN i = 0 THEN 1.0 ELSE 0.0 END::DOUBLE",
    "is_ee": "CASE WHEN i = n THEN 1.0 ELSE 0.0 END::DOUBLE", "is_actuated": "CASE WHEN moves THEN 1.0 ELSE 0.0 END::DOUBLE"}


@query("i4_node_features", Q.with_(PARTS + "," + NODES, "SELECT variant_id, i::INTEGER AS node_id, "
       + ", ".join(Q.r6(v, k) for k, v in NODE_FEATURES.items()) + " FROM gn"))
def node_features(spark, sf_dir):
    return rounded(I.graph_nodes(graph_specs(spark, sf_dir)).select("variant_id", "node_id", *NODE_FEATURES), *NODE_FEATURES)


EDGE_FEATURES = {
    **{f"is_{t}": f"(type = '{t}')::INTEGER::DOUBLE" for t in ("revolute", "prismatic", "fixed", "continuous")},
    "axis_x": "ax", "axis_y": "ay", "axis_z": "az", "offset_x": "x / total", "offset_y": "y / total", "offset_z": "z / total",
    "turn_x": "roll / pi()", "turn_y": "0.0::DOUBLE", "turn_z": "yaw / pi()", "lower": "coalesce(lo, 0) / pi()", "upper": "coalesce(hi, 0) / pi()",
    "limit_range": "coalesce(hi, 0) / pi() - coalesce(lo, 0) / pi()", "limit_mid": "0.5 * (coalesce(hi, 0) / pi() + coalesce(lo, 0) / pi())",
    "actuated": "moves::INTEGER::DOUBLE", "direction": "dir::DOUBLE"}
EDGES = """ge AS (SELECT np.*, total, dir, (2 * (j - 1) + CASE WHEN dir = 1 THEN 0 ELSE 1 END)::INTEGER AS edge_id, CASE WHEN dir = 1 THEN j - 1 ELSE j END::INTEGER AS src,
  CASE WHEN dir = 1 THEN j ELSE j - 1 END::INTEGER AS dst FROM np JOIN (SELECT DISTINCT variant_id, total FROM gn) USING (variant_id), unnest([1, -1]) t(dir))"""
TO_EDGES = ",".join([PARTS, NODES, EDGES])


@query("i5_edges", Q.with_(TO_EDGES, "SELECT variant_id, edge_id, src, dst FROM ge"))
def edges(spark, sf_dir):
    return I.graph_edges(graph_specs(spark, sf_dir)).select("variant_id", "edge_id", "src", "dst")


@query("i6_edge_features", Q.with_(TO_EDGES, "SELECT variant_id, edge_id, " + ", ".join(Q.r6(v, k) for k, v in EDGE_FEATURES.items()) + " FROM ge"))
def edge_features(spark, sf_dir):
    return rounded(I.graph_edges(graph_specs(spark, sf_dir)).select("variant_id", "edge_id", *EDGE_FEATURES), *EDGE_FEATURES)


# Sampling, poses, singular values and clearance. Fixed test parameters.
N_SAMPLES, SAMPLE_SEED = 8, 5


def chain_rows(spark, sf_dir):
    return B.stored_once(spark, sf_dir, "chains", lambda: P.chains(base_specs(spark, sf_dir)))


def posed(spark, sf_dir):
    def build():
        return P.link_points(P.pose_samples(P.sample_blocks(chain_rows(spark, sf_dir), N_SAMPLES, SAMPLE_SEED)))
    return B.stored_once(spark, sf_dir, "poses", build)


_HASHED, _DRAWN = Q.draw(["_stream", "s", "k"])
_SAMPLES = f"""(SELECT *, s AS sample_id FROM (SELECT num.*, {Q.stream(f"'{SAMPLE_SEED}'", 'variant_id')} AS _stream FROM num),
      unnest(range(1, {N_SAMPLES + 1})) t(s))"""
JOINTS_Q = f"""
jq AS MATERIALIZED (SELECT * EXCLUDE (_stream, s, {', '.join(_HASHED)}), CASE WHEN moves THEN lo + {_DRAWN} * (hi - lo) ELSE 0 END AS q
  FROM {Q.with_columns(_SAMPLES, _HASHED)})"""


@query("c1_joint_samples", Q.with_(PARTS + "," + JOINTS_Q, f"SELECT variant_id, sample_id, k::INTEGER AS joint, {Q.r6('q')} FROM jq WHERE moves"))
def joint_samples(spark, sf_dir):
    rows = chain_rows(spark, sf_dir).select("variant_id", "limits").withColumn(
        "sample_id", F.explode(F.sequence(F.lit(1), F.lit(N_SAMPLES)).cast("array<bigint>")))
    out = H.sample_joints(rows, "limits", SAMPLE_SEED)
    return rounded(out.select("variant_id", "sample_id", F.posexplode("q").alias("joint", "q")), "q")


def _matrix() -> str:
    """Static rotation times joint rotation, entry by entry, and the step of the joint."""
    static = [["cos(yaw)", "-sin(yaw) * cos(roll)", "sin(yaw) * sin(roll)"], ["sin(yaw)", "cos(yaw) * cos(roll)", "-cos(yaw) * sin(roll)"],
              ["0.0::DOUBLE", "sin(roll)", "cos(roll)"]]
    names = ", ".join(f"{static[i][k]} AS s{i}{k}" for i in range(3) for k in range(3))
    a = "CASE WHEN type IN ('revolute', 'continuous') THEN q ELSE 0 END"
    axis, cross = ["ax", "ay", "az"], [["0", "-az", "ay"], ["az", "0", "-ax"], ["-ay", "ax", "0"]]
    turn = ", ".join(f"{'cos(' + a + ')' if i == k else '0'} + sin({a}) * ({cross[i][k]}) + (1 - cos({a})) * {axis[i]} * {axis[k]} AS t{i}{k}"
                     for i in range(3) for k in range(3))
    product = ", ".join("+".join(f"s{i}{m} * t{m}{k}" for m in range(3)) + f" AS m{i}{k}" for i in range(3) for k in range(3))
    direction = ", ".join("+".join(f"s{i}{m} * {axis[m]}" for m in range(3)) + f" AS d{i}" for i in range(3))
    slide = "CASE WHEN type = 'prismatic' THEN q ELSE 0 END"
    steps = ", ".join(f"{c} + {slide} * d{i} AS e{i}" for i, c in enumerate("xyz"))
    return f"""st AS (SELECT *, {names}, {turn} FROM jq), sd AS (SELECT *, {product}, {direction} FROM st), jm AS (SELECT *, {steps} FROM sd)"""


def _fold() -> str:
    rot = ", ".join("+".join(f"r{i}{m} * m{m}{k}" for m in range(3)) for i in range(3) for k in range(3))
    move = ", ".join(f"f.p{i} + " + "+".join(f"r{i}{m} * e{m}" for m in range(3)) for i in range(3))
    place = ", ".join(f"f.p{i} + " + "+".join(f"r{i}{m} * jm.{'xyz'[m]}" for m in range(3)) for i in range(3))
    way = ", ".join("+".join(f"r{i}{m} * d{m}" for m in range(3)) for i in range(3))
    unit = ", ".join(f"{1.0 if i == k else 0.0}::DOUBLE AS r{i}{k}" for i in range(3) for k in range(3))
    zero = ", ".join(f"0.0::DOUBLE AS {c}{i}" for c in ("p", "g", "w") for i in range(3))
    return f"""fk AS (SELECT variant_id, n, s AS sample_id, 0::BIGINT AS j, {unit}, {zero} FROM chain, unnest(range(1, {N_SAMPLES + 1})) t(s)
      UNION ALL SELECT f.variant_id, f.n, f.sample_id, f.j + 1, {rot}, {move}, {place}, {way}
      FROM fk f JOIN jm ON jm.variant_id = f.variant_id AND jm.sample_id = f.sample_id AND jm.j = f.j + 1),
    ends AS (SELECT * FROM fk WHERE j = n)"""


POSES = ",\n".join([PARTS, JOINTS_Q, _matrix(), _fold()])


def recursive(body: str, extra: str = "") -> str:
    return "WITH RECURSIVE " + POSES + extra + "\n" + body


@query("c2_end_pose", recursive(f"""SELECT variant_id, sample_id, {Q.r6('p0', 'x')}, {Q.r6('p1', 'y')}, {Q.r6('p2', 'z')},
  {Q.r6('r02', 'vx')}, {Q.r6('r12', 'vy')}, {Q.r6('r22', 'vz')} FROM ends"""))
def end_pose(spark, sf_dir):
    vx, vy, vz = G.approach_vector(*[F.col(c) for c in ("qx", "qy", "qz", "qw")])
    out = posed(spark, sf_dir).select("variant_id", "sample_id", "x", "y", "z", vx.alias("vx"), vy.alias("vy"), vz.alias("vz"))
    return rounded(out, "x", "y", "z", "vx", "vy", "vz")


@query("c2_link_positions", recursive(f"SELECT variant_id, sample_id, j::INTEGER AS link, {Q.r6('p0', 'x')}, {Q.r6('p1', 'y')}, {Q.r6('p2', 'z')} FROM fk"))
def link_positions(spark, sf_dir):
    rows = posed(spark, sf_dir).select("variant_id", "sample_id", F.posexplode("points").alias("link", "p"))
    return rounded(rows.select("variant_id", "sample_id", "link", "p.x", "p.y", "p.z"), "x", "y", "z")


JAC = """,
col AS (SELECT f.variant_id, f.sample_id, k,
    CASE WHEN type = 'prismatic' THEN f.w0 ELSE f.w1 * (e.p2 - f.g2) - f.w2 * (e.p1 - f.g1) END AS j0,
    CASE WHEN type = 'prismatic' THEN f.w1 ELSE f.w2 * (e.p0 - f.g0) - f.w0 * (e.p2 - f.g2) END AS j1,
    CASE WHEN type = 'prismatic' THEN f.w2 ELSE f.w0 * (e.p1 - f.g1) - f.w1 * (e.p0 - f.g0) END AS j2,
    CASE WHEN type = 'prismatic' THEN 0 ELSE f.w0 END AS j3, CASE WHEN type = 'prismatic' THEN 0 ELSE f.w1 END AS j4, CASE WHEN type = 'prismatic' THEN 0 ELSE f.w2 END AS j5
  FROM fk f JOIN num ON num.variant_id = f.variant_id AND num.j = f.j AND moves JOIN ends e ON e.variant_id = f.variant_id AND e.sample_id = f.sample_id),
gram AS (SELECT e.variant_id, e.sample_id, """ + ", ".join(f"coalesce(sum(j{a} * j{b}), 0) AS a{a}{b}" for a in range(3) for b in range(a, 3)) + """
  FROM ends e LEFT JOIN col USING (variant_id, sample_id) GROUP BY e.variant_id, e.sample_id),
det AS (SELECT *, a00 * (a11 * a22 - a12 * a12) - a01 * (a01 * a22 - a12 * a02) + a02 * (a01 * a12 - a11 * a02) AS d FROM gram)"""


@query("d8_jacobian", recursive(f"SELECT variant_id, sample_id, k::INTEGER AS joint, {', '.join(Q.r6(f'j{i}') for i in range(6))} FROM col", JAC))
def jacobian(spark, sf_dir):
    poses = P.pose_samples(P.sample_blocks(chain_rows(spark, sf_dir), N_SAMPLES, SAMPLE_SEED), with_jacobian=True)
    dof = F.size("q")
    rows = poses.select("variant_id", "sample_id", "jacobian", dof.alias("dof"),
                        F.explode(F.when(dof > 0, F.sequence(F.lit(0), dof - 1))).alias("joint"))
    return rows.select("variant_id", "sample_id", "joint", *[
        r6(F.get("jacobian", F.col("dof") * i + F.col("joint"))).alias(f"j{i}") for i in range(6)])


@query("d9_manipulability", recursive("SELECT variant_id, sample_id, round(CASE WHEN d > 1e-16 THEN sqrt(d) / (sqrt(d) + 1) ELSE 0 END, 5) + 0.0::DOUBLE AS g_man FROM det", JAC))
def manipulability(spark, sf_dir):
    g_man = G.manipulability(F.col("sigmas"), F.col("n_rows"), F.col("n_cols"), 1.0)
    return rounded(posed(spark, sf_dir).select("variant_id", "sample_id", g_man.alias("g_man")), "g_man", digits=5)


#: One-sided Jacobi rotations of the three linear rows: eight sweeps, each step turns the first two rows and moves the third
#: to the front, so that all pairs take turns.
SWEEPS = 8
VALUES = JAC + """,
lin AS (SELECT e.variant_id, e.sample_id, coalesce(list(j0 ORDER BY k) FILTER (used), []) AS a, coalesce(list(j1 ORDER BY k) FILTER (used), []) AS b,
    coalesce(list(j2 ORDER BY k) FILTER (used), []) AS c
  FROM ends e LEFT JOIN (SELECT *, j0*j0 + j1*j1 + j2*j2 + j3*j3 + j4*j4 + j5*j5 > 1e-12 AS used FROM col) USING (variant_id, sample_id)
  GROUP BY e.variant_id, e.sample_id),
jacobi AS (SELECT 0 AS step, * FROM lin UNION ALL
  SELECT step + 1, variant_id, sample_id, c AS a, list_transform(list_zip(a, b), lambda z: cs * z[1] - sn * z[2]) AS b,
    list_transform(list_zip(a, b), lambda z: sn * z[1] + cs * z[2]) AS c
  FROM (SELECT *, 1 / sqrt(1 + t * t) AS cs, t / sqrt(1 + t * t) AS sn FROM (
    SELECT *, CASE WHEN abs(pq) > 1e-300 THEN (CASE WHEN zeta < 0 THEN -1 ELSE 1 END) / (abs(zeta) + sqrt(1 + zeta * zeta)) ELSE 0 END AS t FROM (
      SELECT *, (qq - pp) / (2 * pq) AS zeta FROM (
        SELECT *, coalesce(list_sum(list_transform(a, lambda x: x * x)), 0) AS pp, coalesce(list_sum(list_transform(b, lambda x: x * x)), 0) AS qq,
          coalesce(list_sum(list_transform(list_zip(a, b), lambda z: z[1] * z[2])), 0) AS pq
        FROM jacobi WHERE step < """ + str(3 * SWEEPS) + """)))) ),
sv AS (SELECT variant_id, sample_id, list_slice(list_reverse_sort(list_transform([a, b, c], lambda r: sqrt(coalesce(list_sum(list_transform(r, lambda x: x * x)), 0)))), 1,
    least(3, len(a))) AS s FROM jacobi WHERE step = """ + str(3 * SWEEPS) + ")"


def linear_values(poses):
    """Singular values of the linear rows of each sample's Jacobian, without its zero columns."""
    dof = F.size("q")
    entry = lambda i, k: F.get("jacobian", dof * i + k)
    columns = F.filter(F.when(dof > 0, F.sequence(F.lit(0), dof - 1)).otherwise(F.array().cast("array<int>")), lambda k: sum(
        (entry(i, k) * entry(i, k) for i in range(6)), F.lit(0.0)) > P.ZERO_COLUMN ** 2)
    rows = poses.withColumn("_used", columns)
    row = lambda i: F.transform("_used", lambda k: entry(i, k))
    matrix = F.array(*[row(i) for i in range(3)])
    return rows.select("variant_id", "sample_id", G.singular_values(matrix, 3, SWEEPS).alias("sigmas"))


@query("d9_singular_values", recursive(f"SELECT variant_id, sample_id, len(s)::INTEGER AS n, {', '.join(Q.r6(f's[{i}]', f's{i}') for i in (1, 2, 3))} FROM sv", VALUES))
def singular_values(spark, sf_dir):
    """By rotations in Spark expressions; no chain of the part table has more than five moving joints."""
    poses = P.pose_samples(P.sample_blocks(chain_rows(spark, sf_dir), N_SAMPLES, SAMPLE_SEED), with_jacobian=True)
    out = linear_values(poses)
    return rounded(out.select("variant_id", "sample_id", F.size("sigmas").alias("n"), *[
        F.get("sigmas", F.lit(i - 1)).alias(f"s{i}") for i in (1, 2, 3)]), "s1", "s2", "s3")


@query("d10_sigma_from_poses", recursive(f"""SELECT variant_id, sample_id, {Q.r6('CASE WHEN s[-1] > 0 THEN s[-1] / (s[-1] + 0.1) ELSE 0 END', 'g_sigma')},
  {Q.r6('CASE WHEN s[1] > 0 THEN s[-1] / s[1] ELSE 0 END', 'g_iso')} FROM sv""", VALUES))
def sigma_from_poses(spark, sf_dir):
    out = posed(spark, sf_dir).select("variant_id", "sample_id", G.smallest_singular(F.col("sigmas")).alias("g_sigma"),
                                      G.isotropy(F.col("sigmas")).alias("g_iso"))
    return rounded(out, "g_sigma", "g_iso")


# Clearance between the capsules of the chain.
SEGMENTS = """,
seg AS (SELECT f.variant_id, f.sample_id, f.j AS child, 0.9::DOUBLE * radius AS r, a.p0 AS ax, a.p1 AS ay, a.p2 AS az, f.p0 AS bx, f.p1 AS by_, f.p2 AS bz
  FROM fk f JOIN fk a ON a.variant_id = f.variant_id AND a.sample_id = f.sample_id AND a.j = f.j - 1 JOIN lr ON lr.variant_id = f.variant_id AND lr.i = f.j),
duo AS (SELECT s.variant_id, s.sample_id, s.child AS c1, t.child AS c2, s.r + t.r AS reach, s.bx - s.ax AS ux, s.by_ - s.ay AS uy, s.bz - s.az AS uz,
    t.bx - t.ax AS vx, t.by_ - t.ay AS vy, t.bz - t.az AS vz, s.ax - t.ax AS wx, s.ay - t.ay AS wy, s.az - t.az AS wz
  FROM {left} s JOIN {right} t ON s.variant_id = t.variant_id AND s.sample_id = t.sample_id AND {on}),
dots AS (SELECT *, ux*ux + uy*uy + uz*uz AS a, ux*vx + uy*vy + uz*vz AS b, vx*vx + vy*vy + vz*vz AS c, ux*wx + uy*wy + uz*wz AS d, vx*wx + vy*wy + vz*wz AS e FROM duo),
st2 AS (SELECT *, CASE WHEN a*c - b*b > 1e-12 THEN least(greatest((b*e - c*d) / (a*c - b*b), 0), 1) ELSE 0 END AS s,
    CASE WHEN a*c - b*b > 1e-12 THEN least(greatest((a*e - b*d) / (a*c - b*b), 0), 1) WHEN c > 1e-12 THEN least(greatest(e / c, 0), 1) ELSE 0 END AS t FROM dots),
gap AS (SELECT variant_id, sample_id, c1, c2, sqrt((wx + s*ux - t*vx)*(wx + s*ux - t*vx) + (wy + s*uy - t*vy)*(wy + s*uy - t*vy) + (wz + s*uz - t*vz)*(wz + s*uz - t*vz)) AS center,
    sqrt((wx + s*ux - t*vx)*(wx + s*ux - t*vx) + (wy + s*uy - t*vy)*(wy + s*uy - t*vy) + (wz + s*uz - t*vz)*(wz + s*uz - t*vz)) - reach AS dist FROM st2)"""
ALL_PAIRS = SEGMENTS.format(left="seg", right="seg", on="t.child >= s.child + 2")


def segment_rows(spark, sf_dir):
    return B.stored_once(spark, sf_dir, "segments", lambda: D.segments(chain_rows(spark, sf_dir)))


def pairs(spark, sf_dir):
    return B.stored_once(spark, sf_dir, "segment-pairs", lambda: D.segment_pairs(segment_rows(spark, sf_dir)))


@query("d3_segments", recursive(f"""SELECT variant_id, sample_id, child::INTEGER AS child, {Q.r6('r', 'radius')}, {Q.r6('ax', 'x0')}, {Q.r6('bx', 'x1')},
  {Q.r6('az', 'z0')}, {Q.r6('bz', 'z1')} FROM seg""", ALL_PAIRS))
def segments(spark, sf_dir):
    rows = posed(spark, sf_dir).select("variant_id", "sample_id", "points")
    rows = D.lookup_join(rows, segment_rows(spark, sf_dir).select("variant_id", "segs"), ["variant_id"])
    rows = rows.select("variant_id", "sample_id", "points", F.inline_outer("segs"))
    point = lambda i: F.get("points", F.col(i))
    out = rows.select("variant_id", "sample_id", F.col("b").alias("child"), F.col("r").alias("radius"), point("a")["x"].alias("x0"),
                      point("b")["x"].alias("x1"), point("a")["z"].alias("z0"), point("b")["z"].alias("z1"))
    return rounded(out, "radius", "x0", "x1", "z0", "z1")


@query("d4_segment_distance", recursive(f"SELECT variant_id, sample_id, 'l' || c1 AS link_a, 'l' || c2 AS link_b, {Q.r6('dist')} FROM gap", ALL_PAIRS))
def segment_distance(spark, sf_dir):
    rows = D.pair_distances(posed(spark, sf_dir).select("variant_id", "sample_id", "points"), pairs(spark, sf_dir))
    each = rows.select("variant_id", "sample_id", F.explode_outer(F.arrays_zip("pairs", "gaps")).alias("e"))
    return each.filter(F.col("e").isNotNull()).select("variant_id", "sample_id", "e.pairs.link_a", "e.pairs.link_b", r6(F.col("e.gaps")).alias("dist"))


CLEAR = """SELECT e.variant_id, e.sample_id, min(dist) IS NOT NULL AS tested, round(greatest(min(dist), 0), 6) + 0.0::DOUBLE AS clearance
FROM ends e LEFT JOIN gap g ON g.variant_id = e.variant_id AND g.sample_id = e.sample_id GROUP BY e.variant_id, e.sample_id"""


def tested(rows):
    missing = F.isnan("clearance")
    return rows.select("variant_id", "sample_id", (~missing).alias("tested"), F.when(~missing, r6("clearance")).alias("clearance"))


@query("d5_minimum_clearance", recursive(CLEAR.replace("greatest(min(dist), 0)", "CASE WHEN min(dist) IS NOT NULL THEN greatest(min(dist), 0) END"), ALL_PAIRS))
def minimum_clearance(spark, sf_dir):
    rows = posed(spark, sf_dir).select("variant_id", "sample_id", "points")
    return tested(D.clearance(rows, pairs(spark, sf_dir)))


@query("d5_block_clearance", recursive(CLEAR.replace("greatest(min(dist), 0)", "CASE WHEN min(dist) IS NOT NULL THEN greatest(min(dist), 0) END"), ALL_PAIRS))
def block_clearance(spark, sf_dir):
    """The same clearance from the pass over sample blocks."""
    blocks = D.lookup_join(P.sample_blocks(chain_rows(spark, sf_dir), N_SAMPLES, SAMPLE_SEED), pairs(spark, sf_dir), ["variant_id"])
    return tested(P.pose_samples(blocks).select("variant_id", "sample_id", "clearance"))


@query("d6_listed_pairs", recursive(CLEAR.replace("greatest(min(dist), 0)", "CASE WHEN min(dist) IS NOT NULL THEN greatest(min(dist), 0) END")
       .replace("FROM ends e LEFT JOIN gap", "FROM ends e LEFT JOIN gap2"), SEGMENTS.format(
           left="seg", right="seg", on="s.child = 1 AND t.child >= s.n_end") .replace("seg AS (SELECT", "seg AS (SELECT f.n AS n_end,") + """,
gap2 AS (SELECT g.variant_id, g.sample_id, g.center - 0.9::DOUBLE * (a.radius + b.radius) AS dist FROM gap g JOIN lr a ON a.variant_id = g.variant_id AND a.i = 0
  JOIN lr b ON b.variant_id = g.variant_id AND b.i = b.n)"""))
def listed_pairs(spark, sf_dir):
    segs = segment_rows(spark, sf_dir)
    wanted = base_specs(spark, sf_dir).select("meta.variant_id", F.col("meta.base_link").alias("link_a"), F.col("meta.ee_link").alias("link_b"))
    ghost = wanted.withColumn("link_b", F.lit("ghost"))
    chosen = materialize(D.listed_pairs(segs, wanted.unionByName(ghost)), "listed-pairs")
    return tested(D.clearance(posed(spark, sf_dir).select("variant_id", "sample_id", "points"), chosen))


THRESHOLD = 0.6


@query("d7_static_collisions", recursive(f"""SELECT variant_id, 'l' || c1 AS link_a, 'l' || c2 AS link_b, {Q.r6(f'count(*) FILTER (dist <= 0) / {N_SAMPLES}', 'rate')}
FROM gap GROUP BY ALL HAVING count(*) FILTER (dist <= 0) / {N_SAMPLES} > {THRESHOLD}""", ALL_PAIRS))
def static_collisions(spark, sf_dir):
    out = D.static_collisions(posed(spark, sf_dir), pairs(spark, sf_dir), N_SAMPLES, THRESHOLD)
    return rounded(out, "rate")


@query("d7_calibrated_clearance", recursive(CLEAR.replace("greatest(min(dist), 0)", "CASE WHEN min(dist) IS NOT NULL THEN greatest(min(dist), 0) END")
       .replace("LEFT JOIN gap", "LEFT JOIN kept"), ALL_PAIRS + f""",
kept AS (SELECT g.* FROM gap g ANTI JOIN (SELECT variant_id, c1, c2 FROM gap GROUP BY ALL HAVING count(*) FILTER (dist <= 0) / {N_SAMPLES} > {THRESHOLD}) b USING (variant_id, c1, c2))"""))
def calibrated_clearance(spark, sf_dir):
    ignored = materialize(D.static_collisions(posed(spark, sf_dir), pairs(spark, sf_dir), N_SAMPLES, THRESHOLD), "ignored")
    kept = materialize(D.segment_pairs(segment_rows(spark, sf_dir), ignored), "kept-pairs")
    return tested(D.clearance(posed(spark, sf_dir).select("variant_id", "sample_id", "points"), kept))


@query("i8_whole_graphs", Q.with_(PARTS, f"""
SELECT v.variant_id, k::INTEGER AS position, {Q.r6('coalesce(length, 0)', 'length')}, i IS NULL AS is_pad
FROM (SELECT DISTINCT variant_id FROM lr) v, unnest(range(1, (SELECT max(n) FROM (SELECT count(*) AS n FROM lr GROUP BY variant_id)) + 1)) t(k)
LEFT JOIN lr ON lr.variant_id = v.variant_id AND lr.i = t.k - 1"""))
def whole_graphs(spark, sf_dir):
    """Link graphs padded to the longest of them; no node is cut."""
    nodes = I.graph_nodes(graph_specs(spark, sf_dir)).select(F.col("variant_id").alias("graph_id"), "node_id", "length")
    packed = I.padded_sequences(materialize(nodes, "graph-nodes"), ["length"], "node_id")
    items = packed.select("graph_id", F.posexplode(F.arrays_zip("padded", "pad_mask")).alias("k", "e"))
    return items.select(F.col("graph_id").alias("variant_id"), (F.col("k") + 1).alias("position"),
                        r6(F.col("e.padded")[0]).alias("length"), F.col("e.pad_mask").alias("is_pad"))


@query("i9_query_expansion", recursive(f"""SELECT e.variant_id, e.sample_id, i::INTEGER AS node_id, {Q.r6('p0', 'x')}, {Q.r6('length')}
FROM ends e JOIN lr ON lr.variant_id = e.variant_id"""))
def query_expansion(spark, sf_dir):
    nodes = materialize(I.graph_nodes(graph_specs(spark, sf_dir)).select("variant_id", "node_id", "length"), "nodes")
    return rounded(I.query_expansion(posed(spark, sf_dir).select("variant_id", "sample_id", "x"), nodes), "x", "length")


@query("survey_from_specs")
def survey_from_specs(spark, sf_dir):
    """Rows only: every part chain from spec to map (scout, grid, calibration, survey, boundary distance)."""
    totals = lambda maps: maps.groupBy("variant_id").agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum("attempts").alias("attempts"), F.sum("g_ws").alias("reachable"),
        r6(F.max("g_man")).alias("best_man"), r6(F.max("g_margin")).alias("best_margin"))
    return summarised_survey(base_specs(spark, sf_dir), totals, 64, 0.5, bounds_samples=64, calibration=32, chunk=64)


# The survey with early stop: every part chain, drawn in rounds.
BUDGET, ROUND_WINDOW, ROUND_EVERY, ROUND_TARGET, ROUND_RATE, REACH = 48, 12, 4, 0.02, 0.5, 3


def _budget(sql: str) -> str:
    return sql.replace(f"range(1, {N_SAMPLES + 1})", f"range(1, {BUDGET + 1})")


@query("f4_survey_rounds", _budget(recursive(f"""
SELECT ev.variant_id, max(stop_at) AS stop_at, count(*) AS attempts, count(*) FILTER (passed) AS passes,
  count(DISTINCT cell_idx) FILTER (passed) AS valid_cells, round(max(g_man) FILTER (passed), 5) + 0.0::DOUBLE AS best
FROM ev LEFT JOIN stops USING (variant_id) WHERE stop_at IS NULL OR sample_id <= stop_at GROUP BY ev.variant_id""", JAC + ALL_PAIRS + f""",
ev AS (SELECT e.variant_id, e.sample_id, floor(p0 + {REACH})::BIGINT * {4 * REACH * REACH} + floor(p1 + {REACH})::BIGINT * {2 * REACH} + floor(p2 + {REACH})::BIGINT AS cell_idx,
    coalesce(clearance > 0, false) AS passed, round(CASE WHEN d > 1e-16 THEN sqrt(d) / (sqrt(d) + 1) ELSE 0 END, 5) + 0.0::DOUBLE AS g_man
  FROM ends e JOIN det USING (variant_id, sample_id) LEFT JOIN (SELECT variant_id, sample_id, min(dist) AS clearance FROM gap GROUP BY ALL) USING (variant_id, sample_id)
  WHERE least(p0, p1, p2) >= -{REACH} AND greatest(p0, p1, p2) < {REACH}),
flagged AS (SELECT *, best_before IS NULL AS is_new, best_before IS NOT NULL AND g_man > best_before * 1.01::DOUBLE AS is_better FROM (
  SELECT *, max(g_man) OVER (PARTITION BY variant_id, cell_idx ORDER BY sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM ev WHERE passed)),
marks AS (SELECT variant_id, sample_id AS checkpoint FROM ev WHERE passed AND sample_id % {ROUND_EVERY} = 0 AND sample_id >= {ROUND_WINDOW}),
stops AS (SELECT variant_id, min(checkpoint) AS stop_at FROM (
  SELECT m.variant_id, m.checkpoint, count(*) FILTER (is_new) AS valid_cells,
    count(*) FILTER ((is_new OR is_better) AND f.sample_id > m.checkpoint - {ROUND_WINDOW}) / {ROUND_WINDOW}::DOUBLE AS heat
  FROM marks m JOIN flagged f ON f.variant_id = m.variant_id AND f.sample_id <= m.checkpoint GROUP BY ALL)
  WHERE valid_cells / {8 * REACH ** 3}::DOUBLE >= {ROUND_TARGET} AND heat < {ROUND_RATE} GROUP BY variant_id)""")))
def survey_rounds(spark, sf_dir):
    """Samples of every part chain up to its stop point; a chain that has stopped draws no further rounds."""
    chains = chain_rows(spark, sf_dir)
    low, high = (-REACH,) * 3, (REACH,) * 3
    grids = materialize(V.build_grid(V.manual_bounds(chains.select("variant_id"), low, high), 1.0), "grids")
    kept = stopped_samples(chains, grids, pairs(spark, sf_dir), BUDGET, SAMPLE_SEED, ROUND_TARGET, ROUND_WINDOW, ROUND_EVERY, 0.01,
                           ROUND_RATE, with_stops=True, digits=5)
    passed = F.col("g_self") > 0
    out = kept.groupBy("variant_id").agg(
        F.max("stop_at").alias("stop_at"), F.count(F.lit(1)).alias("attempts"), F.count_if(passed).alias("passes"),
        F.count_distinct(F.when(passed, F.col("cell_idx"))).alias("valid_cells"), F.max(F.when(passed, F.col("g_man"))).alias("best"))
    return rounded(out, "best", digits=5)


# Sources and sinks.

@query("a1_spec_scan", Q.with_(PARTS, f"""
SELECT variant_id, family, count(*) AS n_links, {Q.r6('sum(length)', 'total')} FROM lr JOIN (SELECT variant_id, family FROM chain) USING (variant_id) GROUP BY ALL"""))
def spec_scan(spark, sf_dir):
    path = new_path(spark, "specs-json")
    A.write_jsonl(base_specs(spark, sf_dir), path)
    specs = A.scan_specs(spark, path, one_per_file=False)
    total = F.aggregate("chain.links", F.lit(0.0), lambda a, l: a + l["length_estimate"])
    return specs.select("meta.variant_id", "meta.family", F.size("chain.links").cast("bigint").alias("n_links"), r6(total).alias("total"))


@query("a2_file_selection", "SELECT p_brand AS family, count(*) AS n FROM part WHERE p_brand LIKE '%1' OR p_brand LIKE '%5' GROUP BY p_brand")
def file_selection(spark, sf_dir):
    """Four folders of spec files: the glob leaves out the compressed ones, the exclusion those of one folder by name, the
    pattern those that are no JSON by name."""
    path = new_path(spark, "spec-files")
    specs = base_specs(spark, sf_dir)
    ending = F.col("meta.family").substr(-1, 1)
    specs.filter(ending.isin("1", "5")).write.json(f"{path}/kept")
    specs.filter(ending == "2").write.option("compression", "gzip").json(f"{path}/packed")
    specs.filter(ending == "3").write.json(f"{path}/listed")
    specs.filter(ending == "4").select(F.to_json(F.struct("*"))).write.text(f"{path}/notes")
    names = tuple(n for n in listed(spark, f"{path}/listed") if n.endswith(".json"))
    specs = A.scan_specs(spark, path, glob="*.{json,txt}", exclude=names, pattern=r"\.json$", one_per_file=False)
    return specs.groupBy(F.col("meta.family").alias("family")).agg(F.count(F.lit(1)).alias("n"))


def _xml(spark, sf_dir):
    """Descriptions as XML text, one element per line."""
    attr = lambda name, v: F.coalesce(F.concat(F.lit(f' {name}="'), v, F.lit('"')), F.lit(""))
    some = lambda tag, *attrs: F.concat(F.lit(f"<{tag}"), *attrs, F.lit("/>"))

    def link(l):
        inertia = some("inertia", *[attr(k, l[k]) for k in ("ixx", "iyy", "izz", "ixy", "ixz", "iyz")])
        inertial = F.when(l["ixx"].isNotNull(), F.concat(F.lit("<inertial>"), F.when(l["mass"].isNotNull(), some("mass", attr("value", l["mass"]))).otherwise(""), inertia, F.lit("</inertial>")))
        shape = F.when(l["cylinder"].isNotNull(), some("cylinder", attr("radius", l["cylinder"]))).when(
            l["sphere"].isNotNull(), some("sphere", attr("radius", l["sphere"]))).otherwise(F.lit("<mesh/>"))
        collision = F.when(l["has_collision"], F.concat(F.lit("<collision><geometry>"), shape, F.lit("</geometry></collision>")))
        visual = F.when(l["has_visual"], F.lit("<visual><geometry>box</geometry></visual>"))
        return F.concat(F.lit("<link"), attr("name", l["name"]), F.lit(">"), *[F.coalesce(c, F.lit("")) for c in (inertial, collision, visual)], F.lit("</link>"))

    def joint(j):
        origin = F.when(j["xyz"].isNotNull(), some("origin", attr("xyz", j["xyz"]), attr("rpy", j["rpy"])))
        axis = F.when(j["axis"].isNotNull(), some("axis", attr("xyz", j["axis"])))
        limit = F.when(j["upper"].isNotNull(), some("limit", attr("lower", j["lower"]), attr("upper", j["upper"])))
        return F.concat(F.lit("<joint"), attr("name", j["name"]), attr("type", j["type"]), F.lit(">"), some("parent", attr("link", j["parent"])),
                        some("child", attr("link", j["child"])), *[F.coalesce(c, F.lit("")) for c in (origin, axis, limit)], F.lit("</joint>"))
    body = F.concat(F.array_join(F.transform("links", link), ""), F.array_join(F.transform("joints", joint), ""))
    return descriptions(spark, sf_dir).select(F.concat(F.lit("<robot"), attr("name", F.col("variant_id")), F.lit(">"), body, F.lit("</robot>")).alias("value"))


@query("a3_description_scan", Q.with_(PARTS, f"""
SELECT variant_id, count(*) FILTER (moves) AS dof, {Q.r6('sum(len)', 'total')}, {Q.r6('sum(coalesce(lo, 0) + 2 * coalesce(hi, 0))', 'limits')},
  {Q.r6('sum(radius)', 'radii')} FROM np JOIN lr USING (variant_id, p) WHERE lr.name = np.child GROUP BY variant_id"""))
def description_scan(spark, sf_dir):
    path = new_path(spark, "descriptions-xml")
    _xml(spark, sf_dir).write.text(path)
    df = X.walked(XML.scan_descriptions(spark, path, one_per_line=True))
    add = lambda items, pick: F.aggregate(items, F.lit(0.0), lambda a, e: a + pick(e))
    tail = F.filter("link_list", lambda l, i: i > 0)
    return df.select(
        "variant_id", F.size(F.filter("records", lambda r: r["is_actuated"])).cast("bigint").alias("dof"),
        r6(add(F.col("lengths"), lambda e: e["length"])).alias("total"),
        r6(add(F.col("records"), lambda r: F.coalesce(r["limit_lower"], F.lit(0.0)) + 2 * F.coalesce(r["limit_upper"], F.lit(0.0)))).alias("limits"),
        r6(add(tail, lambda l: l["radius_estimate"])).alias("radii"))
