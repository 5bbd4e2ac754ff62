"""Point features, labels and link-graph features.

Specs are rows with ``links`` and ``joints`` arrays; a chain has a handful of links, so graph walks stay inside the row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geometry import finite
from ..functions.joins import lookup_join
from ..schemas import EDGE_TYPES, LABELS
from .grid import AXES

TWO_PI = 2.0 * math.pi


def point_features(cells: DataFrame, manifest: DataFrame, ratio: bool = True, centred: bool = True,
                   scaled: bool = True) -> DataFrame:
    """``pose_feats`` of every cell: position in its box, the same centred, and position over the chain's length.

    ``manifest``: variant_id, bmin_*, bmax_*, morph_scale. Without any flag the plain position is used.
    """
    side = manifest.select("variant_id", *[f"{n}_{a}" for n in ("bmin", "bmax") for a in AXES], "morph_scale")
    rows = lookup_join(cells, side, ["variant_id"])
    inside = [(F.col(f"c{a}") - F.col(f"bmin_{a}")) / F.greatest(F.col(f"bmax_{a}") - F.col(f"bmin_{a}"), F.lit(1e-8))
              for a in AXES]
    valid = finite(F.col("morph_scale")) & (F.col("morph_scale") > 0)
    scale = F.greatest(F.when(valid, F.col("morph_scale")).otherwise(F.lit(1.0)), F.lit(1e-8))
    parts = ([*inside] if ratio else []) + ([2 * p - 1 for p in inside] if centred else []) + (
        [F.col(f"c{a}") / scale for a in AXES] if scaled else [])
    feats = F.array(*(parts or [F.col(f"c{a}") for a in AXES]))
    return rows.withColumn("pose_feats", feats).drop(*side.columns[1:])


def labels_and_mask(cells: DataFrame, labels: list[str] = LABELS) -> DataFrame:
    """``labels`` vector in fixed order and ``ws_mask``."""
    return cells.withColumns({"labels": F.array(*[F.col(k).cast("double") for k in labels]),
                              "ws_mask": F.col("g_ws") > 0.5})


def fourier(x: Column, bands: int, include_input: bool = True, base: float = 2.0, scale: float = 1.0) -> Column:
    """[x, sin, cos] of 2*pi*base^k*x for every coordinate and band."""
    freqs = F.array(*[F.lit(float(base) ** k) for k in range(bands)])
    waves = lambda fn: F.flatten(F.transform(x, lambda v: F.transform(freqs, lambda f: fn(TWO_PI * (v * scale * f)))))
    out = F.concat(waves(F.sin), waves(F.cos))
    return F.concat(x, out) if include_input else out


def padded_sequences(nodes: DataFrame, dims: list[str], order: str, max_nodes: int | None = None) -> DataFrame:
    """Nodes of each graph as one array of the longest kept length, padded with zeros, with the pad mask.

    With ``max_nodes`` only the first nodes of a graph are kept.
    """
    rank = F.row_number().over(Window.partitionBy("graph_id").orderBy(order))
    kept = nodes.withColumn("_rank", rank)
    kept = kept if max_nodes is None else kept.filter(F.col("_rank") <= max_nodes)
    vec = F.array(*[F.col(d).cast("double") for d in dims])
    packed = kept.groupBy("graph_id").agg(
        F.array_sort(F.collect_list(F.struct("_rank", vec.alias("v")))).alias("_s"))
    longest = (nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
               .agg((F.max("n") if max_nodes is None else F.least(F.max("n"), F.lit(max_nodes))).cast("int")).scalar())
    packed = packed.select("graph_id", F.transform("_s", lambda s: s["v"]).alias("_v"), longest.alias("width"))
    pad = F.array_repeat(F.array(*[F.lit(0.0)] * len(dims)), F.col("width") - F.size("_v"))
    return packed.select("graph_id", "width", F.concat("_v", pad).alias("padded"),
                         F.transform(F.sequence(F.lit(1), F.col("width")), lambda i: i > F.size("_v")).alias("pad_mask"))


def query_expansion(samples: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every sample with every link of its variant."""
    return lookup_join(samples, nodes, ["variant_id"])


def ordered_links(links: Column) -> Column:
    """Links by explicit index when every link has one, else as given."""
    by_index = F.transform(
        F.array_sort(F.transform(links, lambda l, i: F.struct(l["index"].alias("k"), i.alias("i"), l.alias("l")))),
        lambda s: s["l"])
    return F.when(F.forall(links, lambda l: l["index"].isNotNull()), by_index).otherwise(links)


def _prepared(specs: DataFrame) -> DataFrame:
    """Adds ordered ``_links`` with safe numbers, their names, usable joints and the base link."""
    number = lambda c: F.when(finite(c), c).otherwise(F.lit(0.0))
    links = F.transform(ordered_links(F.col("links")), lambda l, i: F.struct(
        F.coalesce(l["name"], F.concat(F.lit("link_"), i.cast("string"))).alias("name"),
        F.coalesce(l["index"], i).alias("index"),
        number(l["length_estimate"]).alias("length"), number(l["radius_estimate"]).alias("radius")))
    df = specs.withColumn("_links", links)
    df = df.withColumn("_names", F.transform("_links", lambda l: l["name"]))
    known = lambda name: F.array_contains(F.col("_names"), name)
    df = df.withColumn("_joints", F.filter("joints", lambda j: F.coalesce(
        F.forall(F.array(j["parent_link"], j["child_link"]), known), F.lit(False))))
    roots = F.array_except("_names", F.transform("_joints", lambda j: j["child_link"]))
    base = (F.when(F.coalesce(known(F.col("base_link")), F.lit(False)), F.col("base_link"))
            .otherwise(F.coalesce(F.get(roots, F.lit(0)), F.get("_names", F.lit(0)))))
    return df.withColumn("_base", base)


def link_walk(specs: DataFrame) -> DataFrame:
    """Adds ``_walk``: (name, depth, path length) of every link reached from the base, level by level."""
    df = _prepared(specs)
    length = lambda name: F.coalesce(F.get(F.filter("_links", lambda l: l["name"] == name), F.lit(0))["length"], F.lit(0.0))
    entry = lambda name, depth, path: F.struct(name.alias("name"), depth.alias("depth"), path.alias("path"))
    start = F.array(entry(F.col("_base"), F.lit(0), length(F.col("_base"))))

    def level(state: Column, _: Column) -> Column:
        following = F.flatten(F.transform(state["last"], lambda n: F.transform(
            F.filter("_joints", lambda j: j["parent_link"] == n["name"]),
            lambda j: entry(j["child_link"], n["depth"] + 1, n["path"] + length(j["child_link"])))))
        return F.struct(F.concat(state["done"], following).alias("done"), following.alias("last"))
    walk = F.aggregate(F.sequence(F.lit(1), F.size("_links")),
                       F.struct(start.alias("done"), start.alias("last")), level, lambda s: s["done"])
    return df.withColumn("_walk", walk)


def graph_nodes(specs: DataFrame, use_index: bool = True) -> DataFrame:
    """Twelve features per link.

    ``specs``: variant_id, links, joints, base_link, ee_link, actuated_joint_names.
    """
    df = link_walk(specs)
    total = F.aggregate("_links", F.lit(0.0), lambda a, l: a + l["length"])
    df = df.withColumns({
        "_total": F.when(total > 1e-8, total).otherwise(F.lit(1.0)),
        "_deepest": F.greatest(F.array_max(F.transform("_walk", lambda w: w["depth"])), F.lit(1)),
        "_moved": F.transform(F.filter("_joints", lambda j: F.coalesce(j["is_actuated"], F.lit(False))
                                       | F.coalesce(F.array_contains("actuated_joint_names", j["name"]), F.lit(False))),
                              lambda j: j["child_link"])})
    df = df.select("*", F.posexplode_outer("_links").alias("node_id", "_l")).filter(F.col("node_id").isNotNull())
    reached = F.get(F.filter("_walk", lambda w: w["name"] == F.col("_l.name")), F.lit(0))
    df = df.withColumn("_w", reached)
    df = df.withColumns({
        "depth": F.coalesce(F.col("_w.depth"), F.lit(0)),
        "path_length": F.coalesce(F.col("_w.path"), F.col("_l.length"))})
    df = df.withColumns({"_d": F.col("depth") / F.col("_deepest"), "_p": F.col("path_length") / F.col("_total")})
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    index = F.col("_l.index") / F.greatest(F.size("_links") - 1, F.lit(1)) if use_index else F.lit(0.0)
    return df.select(
        "variant_id", "node_id", F.col("_l.name").alias("name"), "depth", "path_length",
        F.col("_l.length").alias("length"), F.col("_l.radius").alias("radius"), index.alias("index_norm"),
        F.col("_d").alias("depth_norm"), F.col("_p").alias("path_norm"),
        F.sin(TWO_PI * F.col("_d")).alias("depth_sin"), F.cos(TWO_PI * F.col("_d")).alias("depth_cos"),
        F.sin(TWO_PI * F.col("_p")).alias("path_sin"), F.cos(TWO_PI * F.col("_p")).alias("path_cos"),
        flag(F.col("_l.name") == F.col("_base")).alias("is_base"),
        flag(F.col("_l.name") == F.col("ee_link")).alias("is_ee"),
        flag(F.array_contains("_moved", F.col("_l.name"))).alias("is_actuated"))


def graph_edges(specs: DataFrame, bidirectional: bool = True) -> DataFrame:
    """Edges with nineteen features; consecutive links are connected when a spec has no joints at all."""
    df = _prepared(specs)
    at = lambda name: (F.array_position("_names", name) - 1).cast("int")
    joint_type = df.schema["joints"].dataType.elementType.simpleString()
    by_joint = F.transform("_joints", lambda j: F.struct(
        at(j["parent_link"]).alias("u"), at(j["child_link"]).alias("v"), j.alias("j")))
    chain = F.transform(F.sequence(F.lit(0), F.size("_links") - 2), lambda i: F.struct(
        i.alias("u"), (i + 1).alias("v"), F.lit(None).cast(joint_type).alias("j")))
    pairs = F.when(F.size("joints") > 0, by_joint).when(F.size("_links") > 1, chain)
    total = F.aggregate("_links", F.lit(0.0), lambda a, l: a + l["length"])
    df = df.select("variant_id", F.when(total > 1e-8, total).otherwise(F.lit(1.0)).alias("_total"),
                   F.posexplode_outer(pairs).alias("_k", "_e")).filter(F.col("_k").isNotNull())
    ways = [1, -1] if bidirectional else [1]
    df = df.select("*", F.explode(F.array(*[F.lit(w) for w in ways])).alias("dir"))
    joint = lambda name: F.col(f"_e.j.{name}")
    item = lambda name, i: F.coalesce(F.get(joint(name), F.lit(i)), F.lit(0.0))
    limit = lambda name: F.coalesce(F.when(finite(joint(name)), joint(name)), F.lit(0.0)) / math.pi
    forward = F.col("dir") == 1
    kind = F.lower(F.coalesce(joint("type"), F.lit("")))
    return df.select(
        "variant_id", (F.col("_k") * len(ways) + F.when(forward, 0).otherwise(1)).alias("edge_id"),
        F.when(forward, F.col("_e.u")).otherwise(F.col("_e.v")).alias("src"),
        F.when(forward, F.col("_e.v")).otherwise(F.col("_e.u")).alias("dst"),
        *[(kind == t).cast("double").alias(f"is_{t}") for t in EDGE_TYPES],
        *[item("axis", i).alias(f"axis_{a}") for i, a in enumerate(AXES)],
        *[(item("origin_xyz", i) / F.col("_total")).alias(f"offset_{a}") for i, a in enumerate(AXES)],
        *[(item("origin_rpy", i) / math.pi).alias(f"turn_{a}") for i, a in enumerate(AXES)],
        limit("limit_lower").alias("lower"), limit("limit_upper").alias("upper"),
        (limit("limit_upper") - limit("limit_lower")).alias("limit_range"),
        (0.5 * (limit("limit_upper") + limit("limit_lower"))).alias("limit_mid"),
        F.coalesce(joint("is_actuated"), F.lit(False)).cast("double").alias("actuated"),
        F.col("dir").cast("double").alias("direction"))
