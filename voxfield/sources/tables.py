"""Files in and out: specs, maps, samples, id lists, JSON lines, CSV logs and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions.joins import lookup_join
from ..functions.store import materialize
from ..schemas import SPEC


def scan_specs(spark: SparkSession, root: str, glob: str = "*.json", exclude: tuple[str, ...] = (),
               pattern: str | None = None, one_per_file: bool = True) -> DataFrame:
    """Nested specs below ``root`` with ``file_path``: by file glob, without excluded names, by name pattern."""
    specs = (spark.read.schema(SPEC).option("multiLine", one_per_file).option("recursiveFileLookup", True)
             .option("pathGlobFilter", glob).json(root)
             .select("*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("file_name")))
    if exclude:
        specs = specs.filter(~F.col("file_name").isin(*exclude))
    if pattern:
        specs = specs.filter(F.col("file_name").rlike(pattern))
    return specs


def write_cells(cells: DataFrame, path: str, mode: str = "overwrite", checks: list[Column] | None = None) -> dict[str, int]:
    """Maps by family, rows of a variant together, in as many files as the data needs.

    ``checks`` are aggregates over the cells; they are observed by the writing pass, behind its shuffle, and returned.
    """
    rows = (cells.repartitionByRange("family", "variant_id", "cell_idx").sortWithinPartitions("family", "variant_id", "cell_idx"))
    seen = Observation("cells")
    if checks:
        rows = rows.observe(seen, *checks)
    rows.write.partitionBy("family").mode(mode).parquet(path)
    return dict(seen.get) if checks else {}


def scan_cells(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def write_samples(samples: DataFrame, path: str, with_joints: bool = False, mode: str = "overwrite") -> None:
    """End positions and, if wanted, joint vectors."""
    samples.select("variant_id", "sample_id", "x", "y", "z", *(["q"] if with_joints else [])).write.mode(mode).parquet(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines; blank lines are skipped by the source."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def read_ids(spark: SparkSession, path: str, column: str = "variant_id") -> DataFrame:
    """One id per line, trimmed, blank lines dropped."""
    return spark.read.text(path).select(F.trim("value").alias(column)).filter(F.col(column) != "")


def write_ids(ids: DataFrame, path: str, column: str = "variant_id", mode: str = "overwrite") -> None:
    """Sorted id lists; with a ``split`` column one folder per split. The order runs over the part files."""
    if "split" in ids.columns:
        (ids.select("split", F.col(column).alias("value")).repartitionByRange("split", "value")
         .sortWithinPartitions("split", "value").write.mode(mode).partitionBy("split").text(path))
    else:
        ids.select(F.col(column).alias("value")).orderBy("value").write.mode(mode).text(path)


def union_of_rows(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts under the first-seen union of their columns; missing values are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def write_csv(parts: list[DataFrame], path: str, mode: str = "overwrite") -> None:
    union_of_rows(parts).write.mode(mode).option("header", True).csv(path)


def write_report(records: DataFrame, summary: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A JSON report: one document per record, nested lists kept, and the summary beside them."""
    records.write.mode(mode).option("ignoreNullFields", False).json(f"{path}/per_record")
    summary.write.mode(mode).json(f"{path}/summary")


def append_metrics(rows: DataFrame, path: str, fields: list[str]) -> None:
    """Append wide metric rows aligned to a fixed field list; a missing field stays empty."""
    aligned = [F.col(c).cast("string").alias(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in fields]
    rows.select(*aligned).write.mode("append").option("header", True).csv(path)


def metric_points(log: DataFrame, phase: str | None, prefix: str = "loss/") -> DataFrame:
    """(phase, step, series, value) of the loss columns; a value that is no number drops that point only."""
    series = sorted(c for c in log.columns if c.startswith(prefix))
    rows = log if not phase else log.filter(F.col("phase") == phase)
    rows = rows.withColumn("step", F.floor(F.col("step").try_cast("double"))).filter(F.col("step").isNotNull())
    long = rows.select("phase", "step", *[F.col(f"`{c}`").cast("string").alias(c) for c in series]).unpivot(
        ["phase", "step"], [F.col(f"`{c}`") for c in series], "series", "text")
    return long.withColumn("value", F.col("text").try_cast("double")).filter(F.col("value").isNotNull()).drop("text")


def read_metrics(spark: SparkSession, path: str, fields: list[str], phase: str | None = None) -> DataFrame:
    schema = ", ".join(f"`{c}` string" for c in fields)
    return metric_points(spark.read.schema(schema).option("header", True).csv(path), phase)


def without_existing(specs: DataFrame, finished: DataFrame) -> DataFrame:
    """Specs whose variant has no stored map yet."""
    done = materialize(finished.select("variant_id").distinct(), "finished")
    return lookup_join(specs, done, ["variant_id"], "left_anti")
