"""The incremental behaviours as Structured Streaming queries.

Results and state are keyed tables that batches merge into (``snapshots``); the metrics tail writes a folder for each
batch, named by the batch id. A batch repeated after a failure gives the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions.store import materialize, scratch
from ..operators import convergence as C, evaluation as J
from ..operators.grid import assign_cells
from ..operators.survey import CELL, survey_cells
from .snapshots import KeyedTable


def _run(stream: DataFrame, each, checkpoint: str, mode: str) -> None:
    """Process everything available and stop."""
    (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each)
     .trigger(availableNow=True).start().awaitTermination())


def _keep(stream: DataFrame, path: str, checkpoint: str, keys: list[str]) -> DataFrame:
    """Run an update-mode stream into a keyed table, in which new rows replace old ones, and read the table."""
    table = KeyedTable(stream.sparkSession, path, stream.schema, keys)
    _run(stream, table.merge, checkpoint, "update")
    return table.read()


def survey_stream(samples: DataFrame, grids: DataFrame, score: Callable[[DataFrame], DataFrame], path: str,
                  checkpoint: str) -> DataFrame:
    """Running survey of a sample stream against known grids: the same mergeable aggregates as the batch survey.

    ``score`` adds the per-sample indicators to the points that lie in a cell.
    """
    return _keep(survey_cells(score(assign_cells(samples, grids))), path, checkpoint, CELL)


def metrics_stream(predictions: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Running classification and regression sums of a prediction stream, then the metrics.

    ``predictions``: ws_score, g_ws, y_pred, y_true.
    """
    mask = (F.col("g_ws") > 0.5).cast("double")
    err = F.col("y_pred") - F.col("y_true")
    sums = predictions.groupBy().agg(
        *J.classification_counts(), F.sum(F.abs(err) * mask).alias("sum_abs"), F.sum(err * err * mask).alias("sum_sq"),
        F.sum(mask).alias("sum_w"))
    return J.regression_metrics(J.classification_metrics(_keep(sums, path, checkpoint, [])))


def windowed_metrics_stream(predictions: DataFrame, path: str, checkpoint: str, time: str = "ts",
                            window: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Classification metrics per tumbling window of event time; data later than ``delay`` is dropped."""
    counts = (predictions.withWatermark(time, delay).groupBy(F.window(time, window).alias("w"))
              .agg(*J.classification_counts()))
    counts = counts.select(F.col("w.start").alias("window_start"), "tp", "tn", "fp", "fn")
    return J.classification_metrics(_keep(counts, path, checkpoint, ["window_start"]))


POINT = "phase string, step int, series string, value double"
SERIES = ["phase", "series"]
RISING, FALLING = F.asc, F.desc


def _nearest(rows: DataFrame, order: Callable, count: int) -> DataFrame:
    """The first ``count`` points of each series in rising or falling order, equal ones with the last of them."""
    rank = F.rank().over(Window.partitionBy(*SERIES).orderBy(order("step"), order("value")))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") <= count).drop("_rank")


def _touched(late: DataFrame, path: str, batch_id: int, count: int) -> DataFrame:
    """Stored points of ``late`` series (with the steps of their new points, ``_first`` to ``_until``) around the new ones.

    Those from ``_first`` on whose smoothed values may change, and as ``_old`` ones the ``count`` points before. Of a batch
    whose steps of the series lie on one side of the new ones its edge points on that side will do; others are read.
    """
    spark, columns = late.sparkSession, [f.split(" ")[0] for f in POINT.split(", ")]
    stored = lambda name, more: spark.read.schema(f"{POINT}{more}, batch bigint").parquet(f"{path}/{name}").filter(F.col("batch") < batch_id)
    edges = stored("edges", ", at_end boolean, low int, high int").join(late, SERIES)
    apart = (F.col("high") < F.col("_first")) | (F.col("low") > F.col("_until"))
    mixed = materialize(edges.filter(~apart).select(*SERIES, "batch").distinct(), "mixed-batches")
    batches = [r[0] for r in mixed.select("batch").distinct().collect()]
    read = stored("points", "").filter(F.col("batch").isin(batches)).join(mixed, [*SERIES, "batch"], "left_semi")
    near = edges.filter(apart & (F.col("at_end") == (F.col("high") < F.col("_first"))))
    rows = materialize(near.select(*columns).unionByName(read.select(*columns)), "around-late").join(late, SERIES)
    before = _nearest(rows.filter(F.col("step") < F.col("_first")), FALLING, count)
    after = _nearest(rows.filter(F.col("step") > F.col("_until")), RISING, count)
    again = rows.filter(F.col("step").between(F.col("_first"), F.col("_until"))).unionByName(after)
    return again.withColumn("_old", F.lit(False)).unionByName(before.withColumn("_old", F.lit(True))).select(*columns, "_old")


def series_stream(points: DataFrame, path: str, checkpoint: str, window: int) -> DataFrame:
    """Tail of a metrics log: each batch adds its points and the smoothed values that they change.

    ``points``: phase, step, series, value. Between batches the last ``window`` - 1 points of each series are kept, all
    that points in order need. Where a series gets a step at or before its kept tail, the stored points between its new
    ones and ``window`` - 1 after them are smoothed again; the rest of the series is not.
    """
    spark, keys, count = points.sparkSession, SERIES, max(2, window) - 1
    columns = [f.split(" ") for f in POINT.split(", ")]

    def each(batch: DataFrame, batch_id: int) -> None:
        new = materialize(batch.select(*[F.col(name).cast(kind) for name, kind in columns]), "points")
        new.write.mode("overwrite").parquet(f"{path}/points/batch={batch_id}")
        span = materialize(new.groupBy(*keys).agg(F.min("step").alias("_first"), F.max("step").alias("_until")), "spans")
        edges = _nearest(new, RISING, count).withColumn("at_end", F.lit(False)).unionByName(
            _nearest(new, FALLING, count).withColumn("at_end", F.lit(True)))
        edges = edges.join(span, keys).withColumnsRenamed({"_first": "low", "_until": "high"})
        edges.write.mode("overwrite").parquet(f"{path}/edges/batch={batch_id}")
        newest = spark.read.schema(edges.schema).parquet(f"{path}/edges/batch={batch_id}").filter("at_end").drop("at_end", "low", "high")
        tail = spark.createDataFrame([], POINT)
        if batch_id:
            tail = spark.read.schema(POINT).parquet(f"{path}/tail/batch={batch_id - 1}")
        ends = tail.groupBy(*keys).agg(F.max("step").alias("_last"))
        late = materialize(span.join(ends, keys).filter(F.col("_first") <= F.col("_last")).drop("_last"), "late-series")
        ordered = new.withColumn("_old", F.lit(False)).unionByName(tail.withColumn("_old", F.lit(True)))
        rows = ordered
        if not late.isEmpty():
            rows = ordered.join(late, keys, "left_anti").unionByName(
                new.join(late, keys, "left_semi").withColumn("_old", F.lit(False))).unionByName(_touched(late, path, batch_id, count))
        smooth = C.smoothed_series(rows, keys, "step", "value", window, "smooth")
        smooth.filter(~F.col("_old")).drop("_old").write.mode("overwrite").parquet(f"{path}/smooth/batch={batch_id}")
        back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("step"), F.desc("value")))
        kept = tail.unionByName(newest).withColumn("_back", back).filter(F.col("_back") <= count)
        kept.select(*[name for name, _ in columns]).write.mode("overwrite").parquet(f"{path}/tail/batch={batch_id}")
    _run(points, each, checkpoint, "append")
    smooth = spark.read.parquet(f"{path}/smooth")
    newest = smooth.groupBy(*keys, "step", "value").agg(F.max("batch").alias("batch"))
    return smooth.join(newest, [*keys, "step", "value", "batch"]).drop("batch")


def _heat_tables(spark, path: str) -> dict[str, KeyedTable]:
    cell, marks = "variant_id string, cell_idx bigint, best double, last bigint", "variant_id string, checkpoint bigint, hits bigint"
    schema = lambda text: T.StructType.fromDDL(text)
    return {
        "cells": KeyedTable(spark, f"{path}/cells", schema(cell), CELL, {"best": F.max("best"), "last": F.max("last")}),
        "hits": KeyedTable(spark, f"{path}/hits", schema(marks), ["variant_id", "checkpoint"], {"hits": F.sum("hits")}),
        "progress": KeyedTable(spark, f"{path}/progress", schema("variant_id string, last_id bigint, late bigint"), ["variant_id"],
                               {"last_id": F.max("last_id"), "late": F.sum("late")})}


def heat_monitor(events: DataFrame, path: str, checkpoint: str, window: int, every: int,
                 improvement: float = 0.01) -> DataFrame:
    """Update heat of ordered sample streams, one row per variant and checkpoint reached.

    The state is a keyed table of the largest g_man and the last sample of each (variant, cell); samples outside the grid
    only have a last one. A batch finds its running maxima by a blocked scan that starts from the state, so a cell or
    variant that holds most of a batch spreads over blocks of samples, and its update is one row for each cell. Hits are
    added to the few checkpoints that they belong to. A sample that is not after the last one of its cell is late: it is
    counted and left out; of samples with equal numbers in a batch the largest stays.
    """
    spark, tables = events.sparkSession, _heat_tables(events.sparkSession, path)
    mark = F.lit(every).cast("bigint")
    named = events.select("variant_id", F.col("cell_idx").cast("bigint").alias("cell_idx"),
                          F.col("sample_id").cast("bigint").alias("sample_id"), "passed", F.col("g_man").cast("double").alias("g_man"))

    def each(batch: DataFrame, batch_id: int) -> None:
        with scratch(spark):
            known = tables["cells"].read(batch_id)
            once = batch.groupBy(*CELL, "sample_id").agg(F.max(F.struct("passed", "g_man")).alias("s"), F.count(F.lit(1)).alias("n"))
            old = known.select(F.col("variant_id").alias("_v"), F.col("cell_idx").alias("_c"), "last")
            seen = once.join(old, F.col("variant_id").eqNullSafe(F.col("_v")) & F.col("cell_idx").eqNullSafe(F.col("_c")), "left")
            seen = materialize(seen.select(*CELL, "sample_id", "s.passed", "s.g_man", "n", F.coalesce(
                F.col("sample_id") <= F.col("last"), F.lit(False)).alias("late")), "heat-samples")
            fresh = seen.filter("not late")
            scored = fresh.filter(F.col("g_man").isNotNull() & ~F.isnan("g_man"))
            flagged = C.significant_events(scored, improvement, known.filter("best is not null")).filter("significant")
            first, last = F.ceil(F.col("sample_id") / mark), F.floor((F.col("sample_id") + F.lit(window - 1)) / mark)
            hits = (flagged.withColumn("k", F.explode(F.when(last >= first, F.sequence(first, last))))
                    .groupBy("variant_id", (F.col("k") * mark).alias("checkpoint")).agg(F.count(F.lit(1)).alias("hits")))
            progress = seen.groupBy("variant_id").agg(
                F.max(F.when(~F.col("late"), F.col("sample_id"))).alias("last_id"),
                F.sum(F.when(F.col("late"), F.col("n")).otherwise(F.col("n") - 1)).alias("late"))
            inside = F.col("cell_idx").isNotNull() & F.col("passed") & ~F.isnan("g_man")
            cells = fresh.groupBy(*CELL).agg(F.max(F.when(inside, F.col("g_man"))).alias("best"), F.max("sample_id").alias("last"))
            for name, updates in (("hits", hits), ("progress", progress), ("cells", cells)):
                tables[name].merge(updates, batch_id)
    _run(named, each, checkpoint, "append")

    progress = tables["progress"].read()
    marks = progress.select("variant_id", "late", F.explode(F.when(F.col("last_id") >= every, F.sequence(
        mark, F.col("last_id"), mark))).alias("checkpoint"))
    return marks.join(tables["hits"].read(), ["variant_id", "checkpoint"], "left").select(
        "variant_id", "checkpoint", "late", (F.coalesce("hits", F.lit(0)) / F.least(F.lit(window), F.col("checkpoint"))).alias("heat"))
