"""Manifest, audits and contract checks: every problem is a row, never an exception."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..functions.geometry import finite
from ..functions.joins import lookup_join
from ..schemas import LABELS
from .grid import AXES, infer_grid

REQUIRED = ["cell_centers", *LABELS, "sample_counts"]


def posix_relative(path: Column, root: str) -> Column:
    """Path with forward slashes relative to ``root``."""
    flat = F.translate(path, "\\", "/")
    prefix = root.replace("\\", "/").rstrip("/") + "/"
    return F.when(F.startswith(flat, F.lit(prefix)), F.substring(flat, len(prefix) + 1, 1 << 30)).otherwise(flat)


def map_keys(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Per variant: cell count, mean g_ws and the sorted list of keys that have any value."""
    def filled(key: str) -> Column:
        column = F.col("cx") if key == "cell_centers" else (F.col(key) if key in cells.columns else F.lit(None))
        return F.count(column) > 0
    ratio = F.avg("g_ws") if "g_ws" in cells.columns else F.lit(float("nan"))
    return cells.groupBy("variant_id").agg(
        F.count(F.lit(1)).alias("num_cells"), ratio.alias("valid_ratio"),
        F.array_sort(F.array_compact(F.array(*[F.when(filled(k), F.lit(k)) for k in keys]))).alias("cap_keys"))


def build_manifest(specs: DataFrame, cells: DataFrame, required: list[str] = REQUIRED,
                   decimals: int = 6) -> tuple[DataFrame, DataFrame]:
    """Accepted variants with grid metadata, and rejected ones with the reason.

    ``specs``: family, variant_id, dof, spec_path, cap_path, morph_scale.
    """
    keys = map_keys(cells, required)
    grid = infer_grid(cells, decimals).drop("num_cells")
    joined = specs.join(keys.join(grid, "variant_id"), "variant_id", "left")
    missing = F.array_except(F.array(*[F.lit(k) for k in required]), F.col("cap_keys"))
    reason = (F.when(F.col("num_cells").isNull(), F.lit("missing map"))
              .when(F.size(missing) > 0, F.concat(F.lit("missing keys: "), F.array_join(missing, ",")))
              .when(F.col("status") != "ok", F.col("status")))
    marked = joined.withColumn("reason", reason)
    axes = lambda name: F.array(*[F.col(f"{name}_{a}") for a in AXES])
    accepted = marked.filter(F.col("reason").isNull()).select(
        "family", "variant_id", "dof", "spec_path", "cap_path", "cap_keys", "num_cells", "valid_ratio",
        F.struct(axes("bmin").alias("bounds_min"), axes("bmax").alias("bounds_max"), axes("res").alias("resolution"),
                 F.array("nx", "ny", "nz").alias("cell_shape"), F.lit(decimals).alias("round_decimals")).alias("grid_meta"),
        "morph_scale")
    return accepted, marked.filter(F.col("reason").isNotNull()).select("family", "variant_id", "reason")


def run_manifest(results: DataFrame, order: str, fail_fast: bool = False) -> DataFrame:
    """Status rows of a run; with ``fail_fast`` nothing after a family's first failure."""
    if not fail_fast:
        return results
    first = results.filter(F.col("status") == "failed").groupBy("family").agg(F.min(order).alias("_stop"))
    return (lookup_join(results, first, ["family"], "left")
            .filter(F.col("_stop").isNull() | (F.col(order) <= F.col("_stop"))).drop("_stop"))


def audit(manifest: DataFrame, cells: DataFrame, required: list[str] = REQUIRED) -> DataFrame:
    """Errors and warnings per manifest record from one aggregate over the cells.

    ``manifest``: family, variant_id, has_spec, has_map, dof, valid_ratio.
    """
    scalars = [k for k in required if k != "cell_centers"]
    indicators = [k for k in scalars if k.startswith("g_")]
    has = lambda k: F.col(k) if k in cells.columns else F.lit(None).cast("double")
    whole = F.abs(F.round(F.col("g_ws"), 6)).isin(0.0, 1.0)
    facts = cells.groupBy("variant_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("cx").isNull() | F.col("cy").isNull() | F.col("cz").isNull()).alias("bad_centres"),
        F.avg("g_ws").alias("valid_ratio_recomputed"), F.count_if(~whole).alias("not_binary"),
        *[F.count(has(k)).alias(f"n_{k}") for k in scalars],
        *[F.count_if(has(k).isNotNull() & ~finite(has(k))).alias(f"inf_{k}") for k in indicators])
    joined = manifest.join(facts, "variant_id", "left")
    absent = F.array_compact(F.array(*[F.when(F.col(f"n_{k}") == 0, F.lit(k)) for k in scalars]))
    lost = (~F.col("has_spec")) | (~F.col("has_map")) | F.col("n").isNull()
    early = F.array_compact(F.array(
        F.when(~F.col("has_spec"), F.lit("missing spec_path")),
        F.when(~F.col("has_map") | F.col("n").isNull(), F.lit("missing cap_path"))))
    short = lambda k: (F.col(f"n_{k}") > 0) & (F.col(f"n_{k}") < F.col("n"))
    late = F.array_compact(F.array(
        F.when(F.size(absent) > 0, F.concat(F.lit("map missing keys: "), F.array_join(absent, ","))),
        F.when(F.col("bad_centres") > 0, F.lit("cell_centers: bad shape")),
        *[F.when(short(k), F.lit(f"{k}: length mismatch")) for k in scalars],
        *[F.when(F.col(f"inf_{k}") > 0, F.lit(f"{k}: contains non-finite values")) for k in indicators]))
    warnings = F.array_compact(F.array(
        F.when(F.col("dof").isNull(), F.lit("dof missing")),
        F.when(F.col("not_binary") > 0, F.lit("g_ws not binary")),
        F.when(F.col("n_g_ws") == 0, F.lit("missing g_ws"))))
    none = F.array().cast("array<string>")
    out = joined.withColumn("errors", F.when(lost, early).otherwise(late)).withColumn(
        "warnings", F.when(lost, none).otherwise(warnings))
    return out.select("family", "variant_id", "errors", "warnings", "valid_ratio", F.col("n").alias("num_cells"),
                      F.when(~lost, F.col("valid_ratio_recomputed")).alias("valid_ratio_recomputed"))


def _totals() -> list[Column]:
    return [F.count(F.lit(1)).alias("num_records"), F.sum(F.size("errors")).alias("total_errors"),
            F.sum(F.size("warnings")).alias("total_warnings")]


def audit_totals(report: DataFrame) -> DataFrame:
    return report.agg(*_totals())


def write_audit(report: DataFrame, path: str) -> DataFrame:
    """Write the report; its totals are observed by the plan that writes it, so nothing is read again for them."""
    seen = Observation("audit")
    report.observe(seen, *_totals()).write.mode("overwrite").parquet(path)
    names = ("num_records", "total_errors", "total_warnings")
    return report.sparkSession.createDataFrame([tuple(seen.get[n] for n in names)], ", ".join(f"{n} bigint" for n in names))


def map_checks(cells: DataFrame) -> list[Column]:
    """Counts of what the audit looks for in the cells of a map."""
    indicators = [c for c in cells.columns if c.startswith("g_")]
    return [
        F.count(F.lit(1)).alias("cells"), F.count_if(F.col("g_ws") > 0.5).alias("valid"),
        F.count_if(F.col("cx").isNull() | F.col("cy").isNull() | F.col("cz").isNull()).alias("bad_centres"),
        F.count_if(~F.abs(F.round("g_ws", 6)).isin(0.0, 1.0)).alias("not_binary"),
        *[F.count_if(F.col(c).isNotNull() & ~finite(F.col(c))).alias(f"inf_{c}") for c in indicators]]


def label_conflicts(labels: DataFrame, cells: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """Cells whose labelled g_ws differs from the map's."""
    both = labels.select("variant_id", "cell_idx", F.col("g_ws").alias("label_g_ws")).join(
        cells.select("variant_id", "cell_idx", F.col("g_ws").alias("map_g_ws")), ["variant_id", "cell_idx"])
    return both.filter(F.abs(F.col("label_g_ws") - F.col("map_g_ws")) > tolerance)


def batch_violations(rows: DataFrame, feature_width: int, label_keys: list[str]) -> DataFrame:
    """Batches that break the contract: mixed variants, wrong widths, no g_ws label, no rows.

    ``rows``: batch_id, variant_id, pose_feats, labels; a batch without rows is one row with null variant_id.
    """
    facts = rows.groupBy("batch_id").agg(
        F.count("variant_id").alias("n"), F.min("variant_id").alias("_a"), F.max("variant_id").alias("_b"),
        F.count_if(F.size("pose_feats") != feature_width).alias("_f"),
        F.count_if(F.size("labels") != len(label_keys)).alias("_l"))
    found = F.array_compact(F.array(
        F.when(F.col("n") == 0, F.lit("empty batch")),
        F.when(F.col("_a") != F.col("_b"), F.lit("mixed variants")),
        F.when(F.col("_f") > 0, F.lit("feature width")),
        F.when(F.col("_l") > 0, F.lit("label width")),
        F.when(F.lit("g_ws" not in label_keys), F.lit("no g_ws label"))))
    return facts.select("batch_id", "n", found.alias("violations")).filter(F.size("violations") > 0)


def width_violations(samples: DataFrame, dofs: DataFrame) -> DataFrame:
    """Samples whose joint vector length is not the variant's number of degrees of freedom."""
    return (lookup_join(samples, dofs.select("variant_id", "dof"), ["variant_id"])
            .withColumn("width", F.size("q")).filter(F.col("width") != F.col("dof")))
