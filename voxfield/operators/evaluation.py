"""Masked metrics and losses over prediction tables; every aggregate merges."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geometry import clip

EPS = 1e-8


def probability(score: Column, is_logit: bool = True) -> Column:
    return 1 / (1 + F.exp(-score)) if is_logit else score


def classification_counts(score: str = "ws_score", target: str = "g_ws", is_logit: bool = True) -> list[Column]:
    hat = probability(F.col(score), is_logit) > 0.5
    true = F.col(target) > 0.5
    return [F.count_if(hat & true).alias("tp"), F.count_if(~hat & ~true).alias("tn"),
            F.count_if(hat & ~true).alias("fp"), F.count_if(~hat & true).alias("fn")]


def classification_metrics(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 from summed counts."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    at_least = lambda c: F.greatest(c, F.lit(EPS))
    out = counts.withColumns({
        "ws_acc": (tp + tn) / at_least(tp + tn + fp + fn),
        "ws_precision": tp / at_least(tp + fp),
        "ws_recall": tp / at_least(tp + fn)})
    p, r = F.col("ws_precision"), F.col("ws_recall")
    return out.withColumn("ws_f1", 2 * p * r / at_least(p + r))


def regression_sums(rows: DataFrame, keys: list[str], mask_by_ws: bool = True) -> DataFrame:
    """Sums of absolute and squared errors and of the mask per head. ``rows``: head, y_pred, y_true, g_ws."""
    mask = (F.col("g_ws") > 0.5).cast("double") if mask_by_ws else F.lit(1.0)
    err = F.col("y_pred") - F.col("y_true")
    return rows.groupBy(*keys, "head").agg(
        F.sum(F.abs(err) * mask).alias("sum_abs"), F.sum(err * err * mask).alias("sum_sq"), F.sum(mask).alias("sum_w"))


def regression_metrics(sums: DataFrame) -> DataFrame:
    weight = F.greatest(F.col("sum_w"), F.lit(EPS))
    return sums.withColumns({"mae": F.col("sum_abs") / weight, "rmse": F.sqrt(F.col("sum_sq") / weight)})


def bce(score: Column, target: Column, with_logits: bool = True, pos_weight: float | None = None) -> Column:
    """Binary cross-entropy of one row, in the form that does not overflow for large logits."""
    y = clip(target, 0.0, 1.0)
    if not with_logits:
        p = clip(score, EPS, 1.0 - EPS)
        return -(y * F.log(p) + (1 - y) * F.log(1 - p))
    tail = F.log1p(F.exp(-F.abs(score)))
    if pos_weight is None:
        return F.greatest(score, F.lit(0.0)) - score * y + tail
    return (1 - y) * score + (1 + (pos_weight - 1) * y) * (tail + F.greatest(-score, F.lit(0.0)))


def smooth_l1(pred: Column, target: Column, beta: float = 0.05) -> Column:
    d = F.abs(pred - clip(target, 0.0, 1.0))
    return F.when(d < beta, 0.5 * d * d / beta).otherwise(d - 0.5 * beta)


def head_losses(rows: DataFrame, keys: list[str], ws_name: str = "g_ws", with_logits: bool = True,
                pos_weight: float | None = None, beta: float = 0.05, mask_by_ws: bool = True) -> DataFrame:
    """Loss per head: mean weighted cross-entropy for ``ws_name``, masked weighted smooth-L1 for the others.

    ``rows``: keys, head, y_pred, y_true (null: head without label, ignored), ws_mask, weight.
    """
    labelled = rows.filter(F.col("y_true").isNotNull())
    is_ws = F.col("head") == ws_name
    mask = F.col("ws_mask").cast("double") if mask_by_ws else F.lit(1.0)
    weight = F.when(is_ws, F.col("weight")).otherwise(F.col("weight") * mask)
    value = F.when(is_ws, bce(F.col("y_pred"), F.col("y_true"), with_logits, pos_weight)).otherwise(
        smooth_l1(F.col("y_pred"), F.col("y_true"), beta))
    sums = labelled.groupBy(*keys, "head").agg(
        F.sum(value * weight).alias("_num"), F.sum(weight).alias("_den"), F.count(F.lit(1)).alias("_n"))
    den = F.when(is_ws, F.col("_n")).otherwise(F.greatest(F.col("_den"), F.lit(EPS)))
    return sums.select(*keys, "head", (F.col("_num") / den).alias("loss"),
                       F.when(~is_ws, F.greatest(F.col("_den"), F.lit(EPS))).alias("mask_den"))


def total_losses(losses: DataFrame, keys: list[str], head_weights: dict[str, float]) -> DataFrame:
    """Raw sum, uncertainty-weighted sum and total (weighted sum plus log-sigmas) of the head losses.

    A head of weight w has the constant log-sigma -ln(2w)/2 (0 for w <= 0); a head without weight counts as it is.
    """
    table = [(h, -0.5 * math.log(2.0 * w) if w > 0 else 0.0) for h, w in head_weights.items()]
    sigma = losses.sparkSession.createDataFrame(table, "head string, log_sigma double")
    joined = losses.join(F.broadcast(sigma), "head", "left")
    weighted = F.when(F.col("log_sigma").isNull(), F.col("loss")).otherwise(
        0.5 * F.exp(-2 * F.col("log_sigma")) * F.col("loss"))
    return joined.groupBy(*keys).agg(
        F.sum("loss").alias("raw_sum"), F.sum(weighted).alias("weighted_no_reg"),
        F.sum(weighted + F.coalesce("log_sigma", F.lit(0.0))).alias("total"))


def mean_over_batches(per_batch: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Unweighted mean of per-batch values."""
    counted = [F.count(F.lit(1)).alias("n_batches"), *[F.avg(v).alias(v) for v in values]]
    return per_batch.groupBy(*keys).agg(*counted) if keys else per_batch.agg(*counted)


def named_labels(rows: DataFrame, keys: list[str], label_keys: list[str]) -> DataFrame:
    """Label vectors to (keys, head, y_true) rows in key order."""
    names = F.array(*[F.lit(k) for k in label_keys])
    return rows.select(*keys, F.explode(F.arrays_zip(names.alias("head"), F.col("labels").alias("y_true"))).alias("e")).select(
        *keys, "e.head", "e.y_true")


def label_vectors(rows: DataFrame, label_keys: list[str]) -> Column:
    """The label columns as one vector in key order."""
    return F.array(*[F.col(k).cast("double") for k in label_keys])
