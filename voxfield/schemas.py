"""Declared schemas and the fixed label order."""

from __future__ import annotations

from pyspark.sql import types as T

# The ten per-cell indicators in their published order.
LABELS = [
    "g_ws", "g_red", "g_margin", "g_self", "g_selfpass",
    "g_lim", "g_rot", "g_man", "g_iso", "g_sigma",
]

# Indicators summarised by the family audit.
AUDIT_LABELS = ["g_lim", "g_selfpass", "g_man", "g_iso", "g_sigma", "g_rot", "g_red", "g_margin"]

# Joint types with a degree of freedom, and the one-hot order of edge features.
ACTUATED_TYPES = ["revolute", "continuous", "prismatic"]
EDGE_TYPES = ["revolute", "prismatic", "fixed", "continuous"]

LINK = T.StructType([
    T.StructField("index", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("length_estimate", T.DoubleType()),
    T.StructField("radius_estimate", T.DoubleType()),
])

JOINT = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("parent_link", T.StringType()),
    T.StructField("child_link", T.StringType()),
    T.StructField("origin_xyz", T.ArrayType(T.DoubleType())),
    T.StructField("origin_rpy", T.ArrayType(T.DoubleType())),
    T.StructField("axis", T.ArrayType(T.DoubleType())),
    T.StructField("limit_lower", T.DoubleType()),
    T.StructField("limit_upper", T.DoubleType()),
    T.StructField("is_actuated", T.BooleanType()),
])

# How a perturbed variant was made; null for a base spec.
NOTES = T.StructType([
    T.StructField("generated_from", T.StringType()),
    T.StructField("materialize_chain", T.BooleanType()),
    T.StructField("length_scale_range", T.ArrayType(T.DoubleType())),
    T.StructField("joint_limit_scale_range", T.ArrayType(T.DoubleType())),
    T.StructField("joint_limit_shift_fraction", T.DoubleType()),
])

SPEC = T.StructType([
    T.StructField("meta", T.StructType([
        T.StructField("robot_name", T.StringType()),
        T.StructField("family", T.StringType()),
        T.StructField("variant_id", T.StringType()),
        T.StructField("parent_variant_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("urdf_path", T.StringType()),
        T.StructField("dof", T.IntegerType()),
        T.StructField("base_link", T.StringType()),
        T.StructField("ee_link", T.StringType()),
    ])),
    T.StructField("chain", T.StructType([
        T.StructField("links", T.ArrayType(LINK)),
        T.StructField("joints", T.ArrayType(JOINT)),
    ])),
    T.StructField("graph", T.StructType([
        T.StructField("num_nodes", T.IntegerType()),
        T.StructField("edges", T.ArrayType(T.ArrayType(T.IntegerType()))),
    ])),
    T.StructField("morphology", T.StructType([
        T.StructField("variant_id", T.StringType()),
        T.StructField("parent_variant_id", T.StringType()),
        T.StructField("actuated_joint_names", T.ArrayType(T.StringType())),
        T.StructField("length_scale", T.ArrayType(T.DoubleType())),
        T.StructField("joint_limit_scale", T.ArrayType(T.DoubleType())),
        T.StructField("joint_limit_shift", T.ArrayType(T.DoubleType())),
        T.StructField("r_vector", T.StringType()),
        T.StructField("notes", NOTES),
    ])),
])

_PRIMITIVE = T.StructType([T.StructField("_radius", T.StringType())])

# One <robot> element of a description file; attributes stay strings until they are parsed.
DESCRIPTION_XML = T.StructType([
    T.StructField("_name", T.StringType()),
    T.StructField("link", T.ArrayType(T.StructType([
        T.StructField("_name", T.StringType()),
        T.StructField("inertial", T.StructType([
            T.StructField("mass", T.StructType([T.StructField("_value", T.StringType())])),
            T.StructField("inertia", T.StructType(
                [T.StructField(f"_{k}", T.StringType()) for k in ("ixx", "iyy", "izz", "ixy", "ixz", "iyz")])),
        ])),
        T.StructField("collision", T.StructType([
            T.StructField("geometry", T.StructType([
                T.StructField("cylinder", _PRIMITIVE),
                T.StructField("sphere", _PRIMITIVE),
            ])),
        ])),
        T.StructField("visual", T.StructType([
            T.StructField("geometry", T.StringType()),
        ])),
    ]))),
    T.StructField("joint", T.ArrayType(T.StructType([
        T.StructField("_name", T.StringType()),
        T.StructField("_type", T.StringType()),
        T.StructField("parent", T.StructType([T.StructField("_link", T.StringType())])),
        T.StructField("child", T.StructType([T.StructField("_link", T.StringType())])),
        T.StructField("origin", T.StructType([
            T.StructField("_xyz", T.StringType()),
            T.StructField("_rpy", T.StringType()),
        ])),
        T.StructField("axis", T.StructType([T.StructField("_xyz", T.StringType())])),
        T.StructField("limit", T.StructType([
            T.StructField("_lower", T.StringType()),
            T.StructField("_upper", T.StringType()),
        ])),
    ]))),
])
