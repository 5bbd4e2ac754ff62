"""Scan of robot descriptions in XML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schemas import DESCRIPTION_XML


def scan_descriptions(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """One row per <robot> element: variant_id, file_path, links and joints with their attributes as text.

    Files are parsed by Spark's XML source with a declared schema: one document per file, or one element per line,
    where large files are split.
    """
    raw = (spark.read.format("xml").option("rowTag", "robot").option("recursiveFileLookup", True)
           .option("multiLine", not one_per_line)
           .schema(DESCRIPTION_XML).load(path).withColumn("file_path", F.col("_metadata.file_path")))
    inertia = lambda l, k: l["inertial"]["inertia"][f"_{k}"].alias(k)
    links = F.transform("link", lambda l: F.struct(
        l["_name"].alias("name"), l["inertial"]["mass"]["_value"].alias("mass"),
        *[inertia(l, k) for k in ("ixx", "iyy", "izz", "ixy", "ixz", "iyz")],
        l["collision"]["geometry"]["cylinder"]["_radius"].alias("cylinder"),
        l["collision"]["geometry"]["sphere"]["_radius"].alias("sphere"),
        l["collision"].isNotNull().alias("has_collision"), l["visual"].isNotNull().alias("has_visual")))
    joints = F.transform("joint", lambda j: F.struct(
        j["_name"].alias("name"), j["_type"].alias("type"), j["parent"]["_link"].alias("parent"),
        j["child"]["_link"].alias("child"), j["origin"]["_xyz"].alias("xyz"), j["origin"]["_rpy"].alias("rpy"),
        j["axis"]["_xyz"].alias("axis"), j["limit"]["_lower"].alias("lower"), j["limit"]["_upper"].alias("upper")))
    return raw.select(F.col("_name").alias("variant_id"), "file_path", links.alias("links"), joints.alias("joints"))
