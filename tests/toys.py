"""Tiny chains with results that can be worked out by hand."""

import math


def joint(name, kind, parent, child, xyz=(0, 0, 0), axis=(0, 0, 1), limits=(-math.pi, math.pi)):
    fixed = kind == "fixed"
    return {"name": name, "type": kind, "parent_link": parent, "child_link": child, "origin_xyz": [float(v) for v in xyz],
            "origin_rpy": [0.0, 0.0, 0.0], "axis": [float(v) for v in axis], "limit_lower": None if fixed else limits[0],
            "limit_upper": None if fixed else limits[1], "is_actuated": not fixed}


def spec(name, joints, radius=0.02):
    links = ["base"] + [j["child_link"] for j in joints]
    moving = [j["name"] for j in joints if j["is_actuated"]]
    length = {j["child_link"]: math.dist(j["origin_xyz"], (0, 0, 0)) for j in joints}
    return {
        "meta": {"robot_name": name, "family": "toy", "variant_id": name, "parent_variant_id": None, "source": "toy",
                 "urdf_path": None, "dof": len(moving), "base_link": "base", "ee_link": links[-1]},
        "chain": {"links": [{"index": i, "name": n, "length_estimate": length.get(n, 0.0), "radius_estimate": radius}
                            for i, n in enumerate(links)], "joints": joints},
        "graph": {"num_nodes": len(links), "edges": [[i, i + 1] for i in range(len(joints))]},
        "morphology": {"variant_id": name, "parent_variant_id": None, "actuated_joint_names": moving,
                       "length_scale": [1.0] * len(moving), "joint_limit_scale": [1.0] * len(moving),
                       "joint_limit_shift": [0.0] * len(moving), "r_vector": None}}


PLANAR = spec("planar2r", [
    joint("a", "revolute", "base", "one"), joint("b", "revolute", "one", "two", (1, 0, 0)),
    joint("tail", "fixed", "two", "tip", (0.5, 0, 0))])
FOLDING = spec("fold3r", [
    joint("a", "revolute", "base", "one", (0, 0, 0.2)), joint("b", "revolute", "one", "two", (1, 0, 0)),
    joint("c", "revolute", "two", "three", (1, 0, 0)), joint("tail", "fixed", "three", "tip", (1, 0, 0))])
SLIDING = spec("slide", [
    joint("s", "prismatic", "base", "cart", axis=(1, 0, 0), limits=(-1.0, 1.0)),
    joint("r", "revolute", "cart", "arm", (0, 0, 0.1)), joint("tail", "fixed", "arm", "tip", (0.3, 0, 0))])
