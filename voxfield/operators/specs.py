"""Chain specifications: from parsed descriptions to specs and perturbed variants.

A description is one row: variant_id, family, ``links`` (name, mass, ixx .. iyz, cylinder, sphere, has_collision,
has_visual) and ``joints`` (name, type, parent, child, xyz, rpy, axis, lower, upper), attributes as text. A chain has a
handful of links, so every step is an expression over the row's own arrays and nothing is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geometry import clip, finite
from ..functions.rng import normal, uniform_between
from ..schemas import ACTUATED_TYPES, NOTES

# Radius bounds of the inertia proxy and of the cascade.
PROXY_MIN, PROXY_MAX, PROXY_DEFAULT = 0.003, 0.019, 0.019
CASCADE_MIN, CASCADE_MAX, CASCADE_DEFAULT, MASSLESS, LENGTH_SHARE = 0.005, 0.03, 0.03, 1e-4, 0.4
SPEC_RADIUS_SCALE = 0.9


def first_of(items: Column) -> Column:
    return F.get(items, F.lit(0))


def places(names: str | Column, *of: Column) -> Column:
    """Places (from 0) of values in an array of names, -1 where it lacks one, null for a null value.

    As one small array: Spark looks up a lambda's variable much faster than the field of a struct.
    """
    return F.transform(F.array(*of), lambda n: (F.array_position(names, n) - 1).cast("int"))


def identity(df: DataFrame, meta: str = "meta", path: str = "file_path") -> DataFrame:
    """family (default unknown), variant_id (default file stem) and dof (default -1)."""
    filled = lambda name: F.nullif(F.trim(F.col(f"{meta}.{name}")), F.lit(""))
    stem = F.regexp_extract(F.col(path), r"([^/]+)\.json$", 1)
    return df.withColumns({"family": F.coalesce(filled("family"), F.lit("unknown")),
                           "variant_id": F.coalesce(filled("variant_id"), stem),
                           "dof": F.coalesce(F.col(f"{meta}.dof"), F.lit(-1))})


def chain_scale(links: Column) -> Column:
    """Sum of the length estimates; 1 when that is not finite and positive."""
    total = F.aggregate(links, F.lit(0.0), lambda a, l: a + F.coalesce(l["length_estimate"], F.lit(0.0)))
    return F.when(finite(total) & (total > 0), total).otherwise(F.lit(1.0))


def exploded(specs: DataFrame, part: str, keys: list[str]) -> DataFrame:
    """One row per link or joint in order.

    The outer form keeps Spark from pushing a size filter, with a copy of the array's whole expression, below.
    """
    items = specs.select(*keys, F.posexplode_outer(part).alias("pos", "_e")).filter(F.col("pos").isNotNull())
    return items.select(*keys, "pos", "_e.*")


def named_only(descriptions: DataFrame) -> DataFrame:
    """Drop links and joints without a name."""
    named = lambda e: F.coalesce(e["name"], F.lit("")) != ""
    return descriptions.withColumns({"links": F.filter("links", named), "joints": F.filter("joints", named)})


def detect_ends(df: DataFrame) -> DataFrame:
    """base_link: a parent that is never a child; ee_link: a child that is never a parent; smallest name of several."""
    side = lambda name: F.filter(F.transform("joints", lambda j: j[name]), lambda v: F.coalesce(v, F.lit("")) != "")
    parents, children = side("parent"), side("child")
    names = F.transform("links", lambda l: l["name"])
    return df.withColumns({
        "base_link": F.coalesce(F.array_min(F.array_except(parents, children)), first_of(names)),
        "ee_link": F.coalesce(F.array_min(F.array_except(children, parents)), F.element_at(names, -1))})


def chain_path(df: DataFrame) -> DataFrame:
    """path: links from base to end; only the base when the end does not lead back to it.

    Each step reads the joints once, in one expression: Spark evaluates a lambda's expression wherever it is written.
    """
    def climb(path: Column, _: Column) -> Column:
        head = F.element_at(path, 1)
        leads = lambda j: (j["child"] == head) & (F.coalesce(j["parent"], F.lit("")) != "")
        parent = F.aggregate("joints", F.lit(None).cast("string"), lambda last, j: F.when(leads(j), j["parent"]).otherwise(last))
        return F.when(head == F.col("base_link"), path).otherwise(F.concat(F.filter(F.array(parent), lambda v: v.isNotNull()), path))
    start = F.array(F.col("ee_link"))
    path = F.aggregate(F.sequence(F.lit(1), F.size("joints") + 1), start, climb)
    return (df.withColumn("path", path)
            .withColumn("path", F.when(F.element_at("path", 1) == F.col("base_link"), F.col("path"))
                        .otherwise(F.array("base_link"))))


def main_chain(df: DataFrame) -> DataFrame:
    """Keep the joints with both ends on the path, in path order of their parent."""
    placed = F.transform("joints", lambda j, i: F.struct(places("path", j["parent"], j["child"]).alias("at"), i.alias("i"), j.alias("j")))
    on_path = F.filter(placed, lambda s: (s["at"][0] >= 0) & (s["at"][1] >= 0))
    keyed = F.sort_array(F.transform(on_path, lambda s: F.struct(s["at"][0].alias("at"), s["i"].alias("i"), s["j"].alias("j"))))
    return df.withColumn("chain_joints", F.transform(keyed, lambda s: s["j"]))


def parse_vector(text: Column, default: str) -> Column:
    """Up to three numbers separated by blanks, padded with zeros; ``default`` when there is no text."""
    parts = F.split(F.trim(F.coalesce(text, F.lit(default))), r"\s+")
    numbers = F.transform(parts, lambda v: v.try_cast("double"))
    return F.slice(F.concat(numbers, F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))), 1, 3)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def joint_records(df: DataFrame, limit_policy: str = "spec") -> DataFrame:
    """Typed ``joints`` of the main chain with defaults.

    Missing limits of moving joints become +-pi, those of continuous joints always do. With ``limit_policy`` "urdf"
    prismatic joints get +-1 instead and continuous joints keep given limits.
    """
    parsed = F.transform("chain_joints", lambda j: F.struct(
        j.alias("j"), F.coalesce(j["type"], F.lit("revolute")).alias("type"),
        j["lower"].try_cast("double").alias("lo"), j["upper"].try_cast("double").alias("hi")))

    def record(s: Column) -> Column:
        j = s["j"]
        moving = s["type"].isin(ACTUATED_TYPES)
        both = s["lo"].isNotNull() & s["hi"].isNotNull()
        bound = F.lit(math.pi)
        if limit_policy == "urdf":
            keep = both | ~moving
            bound = F.when(s["type"] == "prismatic", F.lit(1.0)).otherwise(F.lit(math.pi))
        else:
            keep = (both & (s["type"] != "continuous")) | ~moving
        known = lambda v: F.when(both, v)
        return F.struct(
            j["name"].alias("name"), s["type"].alias("type"), j["parent"].alias("parent_link"),
            j["child"].alias("child_link"), parse_vector(j["xyz"], "0 0 0").alias("origin_xyz"),
            parse_vector(j["rpy"], "0 0 0").alias("origin_rpy"), parse_vector(j["axis"], "0 0 1").alias("axis"),
            F.when(keep, known(s["lo"])).otherwise(-bound).alias("limit_lower"),
            F.when(keep, known(s["hi"])).otherwise(bound).alias("limit_upper"), moving.alias("is_actuated"))
    return df.withColumn("records", F.transform(parsed, record))


def link_lengths(df: DataFrame) -> DataFrame:
    """lengths: (name, length) of the path links from the joint leading to each, below 1e-8 taken as 0."""
    length = lambda name: norm(F.try_element_at(F.filter("records", lambda r: r["child_link"] == name), F.lit(-1))["origin_xyz"])
    lengths = F.transform("path", lambda n: F.struct(n.alias("name"), F.coalesce(length(n), F.lit(0.0)).alias("raw")))
    return df.withColumn("lengths", F.transform(lengths, lambda s: F.struct(
        s["name"].alias("name"), F.when(s["raw"] <= 1e-8, F.lit(0.0)).otherwise(s["raw"]).alias("length"))))


def outgoing_length(joints: Column, name: Column) -> Column:
    """Largest distance from a link to the origin of a joint it carries, over all joints with a given origin."""
    carried = F.filter(joints, lambda j: (j["parent"] == name) & j["xyz"].isNotNull())
    return F.coalesce(F.array_max(F.transform(carried, lambda j: norm(parse_vector(j["xyz"], "0 0 0")))), F.lit(0.0))


def proxy_radius(link: Column, length: Column) -> Column:
    """Radius from the mean absolute principal inertia, at most half the length, within fixed bounds.

    The default applies unless all six inertia values are given.
    """
    values = [link[f"i{k}"].try_cast("double") for k in ("xx", "yy", "zz", "xy", "xz", "yz")]
    given = values[0].isNotNull()
    for v in values[1:]:
        given = given & v.isNotNull()
    mean = (F.abs(values[0]) + F.abs(values[1]) + F.abs(values[2])) / 3.0
    base = F.when(mean > 0, F.sqrt(mean)).otherwise(F.lit(PROXY_DEFAULT))
    base = F.when(length > 1e-6, F.least(base, 0.5 * length)).otherwise(base)
    return F.when(given, clip(base, PROXY_MIN, PROXY_MAX)).otherwise(F.lit(PROXY_DEFAULT))


def link_records(df: DataFrame) -> DataFrame:
    """``link_list``: index, name, length and radius of every path link."""
    link_of = lambda name: first_of(F.filter("links", lambda l: l["name"] == name))
    paired = F.transform("lengths", lambda s, i: F.struct(
        i.alias("index"), s["name"].alias("name"), s["length"].alias("length_estimate"), link_of(s["name"]).alias("l")))
    return df.withColumn("link_list", F.transform(paired, lambda s: F.struct(
        s["index"].alias("index"), s["name"].alias("name"), s["length_estimate"].alias("length_estimate"),
        F.coalesce(proxy_radius(s["l"], s["length_estimate"]), F.lit(PROXY_DEFAULT)).alias("radius_estimate"))))


def cascade_radius(link: Column, length: Column, min_radius: float = CASCADE_MIN, max_radius: float = CASCADE_MAX,
                   default: float = CASCADE_DEFAULT) -> Column:
    """Collision radius: explicit primitive, else inertia over mass within bounds, capped by the link's length.

    Massless links get 0; without any estimate a link with geometry gets the default and one without gets 0.
    """
    primitive = F.coalesce(link["cylinder"].try_cast("double"), link["sphere"].try_cast("double"))
    mass = link["mass"].try_cast("double")
    moments = F.filter(F.array(*[F.coalesce(link[f"i{k}"].try_cast("double"), F.lit(0.0)) for k in ("xx", "yy", "zz")]),
                       lambda v: v > 1e-6)
    solid = clip(F.sqrt(2.0 * F.array_min(moments) / mass), min_radius, max_radius)
    inertial = F.when(mass <= MASSLESS, F.lit(0.0)).when(F.size(moments) > 0, solid)
    radius = F.coalesce(primitive, inertial)
    cap = LENGTH_SHARE * length
    capped = F.when((radius > 0) & (length > 0.05) & (radius > cap), F.greatest(F.lit(min_radius), cap)).otherwise(radius)
    bare = ~F.coalesce(link["has_visual"], F.lit(False)) & ~F.coalesce(link["has_collision"], F.lit(False))
    return F.coalesce(capped, F.when(bare, F.lit(0.0)).otherwise(F.lit(default)))


def collision_radii(descriptions: DataFrame) -> DataFrame:
    """(variant_id, name, radius) of every link by the cascade."""
    pairs = F.transform("links", lambda l: F.struct(l.alias("l"), outgoing_length(F.col("joints"), l["name"]).alias("len")))
    rows = named_only(descriptions).select("variant_id", F.explode_outer(pairs).alias("e")).filter(F.col("e").isNotNull())
    link = F.col("e.l")
    return rows.select("variant_id", link["name"].alias("name"), cascade_radius(link, F.col("e.len")).alias("radius"))


def walked(descriptions: DataFrame) -> DataFrame:
    """Descriptions with ends, path, chain joints, typed records, lengths and link records."""
    df = main_chain(chain_path(detect_ends(named_only(descriptions))))
    return link_records(link_lengths(joint_records(df)))


def assemble_specs(descriptions: DataFrame) -> DataFrame:
    """Nested specs with meta, chain, graph and identity perturbation."""
    df = walked(descriptions)
    moving = F.transform(F.filter("records", lambda r: r["is_actuated"]), lambda r: r["name"])
    df = df.withColumn("_moving", moving).withColumn("_names", F.transform("link_list", lambda l: l["name"]))
    ends = F.transform("records", lambda r: places("_names", r["parent_link"], r["child_link"]))
    edges = F.filter(ends, lambda e: (e[0] >= 0) & (e[1] >= 0))
    none = F.lit(None).cast("string")
    fill = lambda v: F.transform("_moving", lambda _: F.lit(v))
    return df.select(
        F.struct(F.col("variant_id").alias("robot_name"), "family", "variant_id", none.alias("parent_variant_id"),
                 F.lit("real").alias("source"), none.alias("urdf_path"), F.size("_moving").alias("dof"),
                 "base_link", "ee_link").alias("meta"),
        F.struct(F.col("link_list").alias("links"), F.col("records").alias("joints")).alias("chain"),
        F.struct(F.size("link_list").alias("num_nodes"), edges.alias("edges")).alias("graph"),
        F.struct("variant_id", none.alias("parent_variant_id"), F.col("_moving").alias("actuated_joint_names"),
                 fill(1.0).alias("length_scale"), fill(1.0).alias("joint_limit_scale"),
                 fill(0.0).alias("joint_limit_shift"), none.alias("r_vector"),
                 F.lit(None).cast(NOTES).alias("notes")).alias("morphology"))


def actuated_order(specs: DataFrame) -> DataFrame:
    """``ordered``: joints to move in order, from the explicit name list or else the actuated chain joints.

    Listed names that are missing in the chain are dropped.
    """
    listed = F.transform("morphology.actuated_joint_names", lambda n: first_of(
        F.filter("chain.joints", lambda j: j["name"] == n)))
    found = F.filter(listed, lambda j: j.isNotNull())
    moving = F.filter("chain.joints", lambda j: F.coalesce(j["is_actuated"], F.lit(False)))
    given = F.coalesce(F.size("morphology.actuated_joint_names"), F.lit(0)) > 0
    return specs.withColumn("ordered", F.when(given, found).otherwise(moving))


def _narrowed(s: Column, min_width: float) -> Column:
    """Shrunk and shifted limits inside the old ones, at least ``min_width`` wide, else the old ones."""
    lo, hi = s["lo"], s["hi"]
    a, b = F.greatest(lo, s["mid"] - s["half"]), F.least(hi, s["mid"] + s["half"])
    centre = F.greatest(lo, F.least(hi, s["mid"]))
    thin = b - a < min_width
    a2 = F.when(thin, F.greatest(lo, centre - 0.5 * min_width)).otherwise(a)
    b2 = F.when(thin, F.least(hi, centre + 0.5 * min_width)).otherwise(b)
    return F.struct(F.when(b2 <= a2, lo).otherwise(a2).alias("lo"), F.when(b2 <= a2, hi).otherwise(b2).alias("hi"))


def expand_variants(specs: DataFrame, n_variants: int, seed: int, length_range: tuple[float, float] = (0.7, 1.3),
                    limit_range: tuple[float, float] = (0.5, 1.0), shift_fraction: float = 0.2,
                    min_width: float = 1e-3, materialize_chain: bool = True, perturb_fixed: bool = False) -> DataFrame:
    """``n_variants`` perturbed specs per base spec; the base id becomes the parent of each.

    Per moving joint, or per name of an explicit list, a length scale, a limit scale and a limit shift are drawn from
    (seed, variant, name) alone; a listed name that the chain lacks keeps its drawn values in the record. With
    ``perturb_fixed`` the origin of a listed fixed joint is scaled, too.
    """
    base = F.col("meta.variant_id")
    parts = int(specs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = actuated_order(specs).withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(n_variants))))
    df = df.repartition(parts, base, F.col("_k"))
    df = df.withColumn("_id", F.concat(base, F.lit("_v"), F.format_string("%04d", F.col("_k"))))
    width = lambda j: F.coalesce(j["limit_upper"] - j["limit_lower"], F.lit(0.0))
    key = lambda name, what: (seed, F.col("_id"), name, what)
    joint_of = lambda name: first_of(F.filter("chain.joints", lambda j: j["name"] == name))
    given = F.coalesce(F.size("morphology.actuated_joint_names"), F.lit(0)) > 0
    names = F.when(given, F.col("morphology.actuated_joint_names")).otherwise(F.transform("ordered", lambda j: j["name"]))
    sized = F.transform(names, lambda n: F.struct(n.alias("name"), width(joint_of(n)).alias("width")))
    drawn = F.transform(sized, lambda d: F.struct(
        d["name"].alias("name"), uniform_between(*length_range, *key(d["name"], "length")).alias("length"),
        uniform_between(*limit_range, *key(d["name"], "limit")).alias("limit"),
        F.when((d["width"] > 0) & F.lit(shift_fraction > 0), normal(*key(d["name"], "shift")) * (shift_fraction * d["width"]))
        .otherwise(F.lit(0.0)).alias("shift")))
    df = df.withColumn("_drawn", drawn)
    picked = lambda field: F.transform("_drawn", lambda d: d[field])
    morphology = F.struct(
        F.col("_id").alias("variant_id"), base.alias("parent_variant_id"),
        F.transform("_drawn", lambda d: d["name"]).alias("actuated_joint_names"),
        picked("length").alias("length_scale"), picked("limit").alias("joint_limit_scale"),
        picked("shift").alias("joint_limit_shift"), F.lit(None).cast("string").alias("r_vector"),
        F.struct(F.lit("perturbation").alias("generated_from"), F.lit(materialize_chain).alias("materialize_chain"),
                 *[F.array(*[F.lit(float(v)) for v in values]).alias(name) for name, values in (
                     ("length_scale_range", length_range), ("joint_limit_scale_range", limit_range))],
                 F.lit(float(shift_fraction)).alias("joint_limit_shift_fraction")).alias("notes"))
    meta = F.col("meta").withField("parent_variant_id", base).withField("variant_id", F.col("_id"))
    if not materialize_chain:
        return df.select(meta.alias("meta"), "chain", "graph", morphology.alias("morphology"))

    still = F.struct(F.lit(None).cast("string").alias("name"), F.lit(1.0).alias("length"), F.lit(1.0).alias("limit"),
                     F.lit(0.0).alias("shift"))
    draw_of = lambda name: F.coalesce(first_of(F.filter("_drawn", lambda d: d["name"] == name)), still)
    moving = lambda j: F.coalesce(j["is_actuated"], F.lit(False))
    scaled = lambda j: moving(j) | (F.lit(perturb_fixed) & F.coalesce(j["type"] == "fixed", F.lit(False)))
    paired = F.transform("chain.joints", lambda j: F.struct(j.alias("j"), draw_of(j["name"]).alias("d")))
    centred = F.transform(paired, lambda s: F.struct(
        s["j"].alias("j"), s["d"].alias("d"),
        F.struct(s["j"]["limit_lower"].alias("lo"), s["j"]["limit_upper"].alias("hi"),
                 (0.5 * (s["j"]["limit_lower"] + s["j"]["limit_upper"]) + s["d"]["shift"]).alias("mid"),
                 F.greatest(F.lit(0.5 * min_width), 0.5 * (s["j"]["limit_upper"] - s["j"]["limit_lower"]) * s["d"]["limit"])
                 .alias("half")).alias("w")))
    limited = F.transform(centred, lambda s: F.struct(
        s["j"].alias("j"), s["d"].alias("d"), _narrowed(s["w"], min_width).alias("n"),
        (moving(s["j"]) & (s["j"]["limit_upper"] > s["j"]["limit_lower"])).alias("use")))
    joints = F.transform(limited, lambda s: s["j"]
                         .withField("origin_xyz", F.when(scaled(s["j"]), F.transform(
                             s["j"]["origin_xyz"], lambda v: v * s["d"]["length"])).otherwise(s["j"]["origin_xyz"]))
                         .withField("limit_lower", F.when(s["use"], s["n"]["lo"]).otherwise(s["j"]["limit_lower"]))
                         .withField("limit_upper", F.when(s["use"], s["n"]["hi"]).otherwise(s["j"]["limit_upper"])))
    incoming = lambda link: first_of(F.filter("chain.joints", lambda j: (j["child_link"] == link["name"]) & moving(j)))
    grown = F.transform("chain.links", lambda l: F.struct(l.alias("l"), draw_of(incoming(l)["name"])["length"].alias("s")))
    links = F.transform(grown, lambda s: s["l"]
                        .withField("length_estimate", s["l"]["length_estimate"] * s["s"])
                        .withField("radius_estimate", s["l"]["radius_estimate"] * s["s"]))
    df = df.withColumn("_new", F.struct(links.alias("links"), joints.alias("joints")))
    return df.select(meta.alias("meta"), F.col("_new").alias("chain"), "graph", morphology.alias("morphology"))
