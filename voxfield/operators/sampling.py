"""Counter-based joint sampling, stratified splits, balanced draws and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.joins import lookup_join
from ..functions.rng import block_digits, draw, hash_block, hash_key, stream, uniform
from ..functions.scan import BLOCK_ROWS, ordered_row_numbers, row_numbers, running
from ..functions.store import materialize


def sample_joints(rows: DataFrame, limits: str, seed: int) -> DataFrame:
    """Uniform joint vectors: ``q[j] = lo + u * (hi - lo)``.

    ``rows``: variant_id, sample_id and the array ``limits`` of struct<lo, hi>. The draw depends on
    (seed, variant, sample, joint) only.
    """
    q = F.transform(limits, lambda lim, j: lim["lo"] + draw(F.col("_stream"), F.col("sample_id"), j) * (lim["hi"] - lim["lo"]))
    return rows.withColumn("_stream", stream(seed, F.col("variant_id"))).withColumn("q", q).drop("_stream")


def stratified_split(variants: DataFrame, stratum: str, test_ratio: float = 0.1, val_ratio: float = 0.1,
                     seed: int = 42) -> DataFrame:
    """train / val / test per stratum by hash order; counts are rounded half to even."""
    keyed = variants.select(stratum, "variant_id").withColumn("_h", hash_key(seed, F.col("variant_id")))
    block = hash_block(F.col("_h"), block_digits(variants.count()))
    ranked = row_numbers(keyed, [stratum], ["_h", "variant_id"], "_rank", block=block)
    sizes = keyed.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    n_test = F.bround(F.col("_n") * test_ratio)
    n_val = F.bround(F.col("_n") * val_ratio)
    return lookup_join(ranked, sizes, [stratum]).select(
        stratum, "variant_id",
        F.when(F.col("_rank") <= n_test, F.lit("test")).when(F.col("_rank") <= n_test + n_val, F.lit("val"))
        .otherwise(F.lit("train")).alias("split"))


def flattened_index(cells: DataFrame, splits: DataFrame, split: str) -> DataFrame:
    """(variant, cell) keys of one split."""
    wanted = splits.filter(F.col("split") == split).select("variant_id")
    return lookup_join(cells.select("variant_id", "cell_idx"), wanted, ["variant_id"], "left_semi")


def pools(cells: DataFrame, seed: int, by: tuple[str, ...] = ("variant_id",), threshold: float = 0.5) -> DataFrame:
    """0-based position of every cell in the shuffled ws / non-ws pool of its group."""
    keyed = (cells.select("variant_id", "cell_idx", (F.col("g_ws") > threshold).alias("is_ws"))
             .withColumn("_h", hash_key(seed, F.col("variant_id"), F.col("cell_idx"))))
    block = hash_block(F.col("_h"), block_digits(cells.count()))
    ranked = row_numbers(keyed, [*by, "is_ws"], ["_h", "variant_id", "cell_idx"], "_r", block=block)
    return ranked.withColumn("position", (F.col("_r") - 1).cast("bigint")).drop("_r", "_h")


def pool_sizes(cells: DataFrame, by: tuple[str, ...] = ("variant_id",), threshold: float = 0.5) -> DataFrame:
    ws = F.col("g_ws") > threshold
    return cells.groupBy(*by).agg(F.count_if(ws).alias("n_ws"), F.count_if(~ws).alias("n_other"))


def _from_pool(draws: DataFrame, pool: DataFrame, sizes: DataFrame, by: list[str], ratio: float) -> DataFrame:
    """Turn draws (draw_id, u) into cells: choose a pool, count earlier picks from it, cycle through it.

    ``sizes`` is stored.
    """
    choice = (F.when((F.col("u") < ratio) & (F.col("n_ws") > 0), F.lit(True))
              .when(F.col("n_other") > 0, F.lit(False)).otherwise(F.lit(True)))
    chosen = lookup_join(draws, sizes, by, stored=True) if by else draws.crossJoin(F.broadcast(sizes))  # one row
    chosen = materialize(chosen.withColumn("is_ws", choice), "chosen")
    counted = row_numbers(chosen, [*by, "is_ws"], ["draw_id"], "_k",
                          block=F.floor(F.col("draw_id") / F.lit(BLOCK_ROWS)))
    size = F.when(F.col("is_ws"), F.col("n_ws")).otherwise(F.col("n_other"))
    placed = counted.withColumn("position", F.pmod(F.col("_k") - 1, size))
    return placed.drop("_k", "n_ws", "n_other", "u").join(pool, [*by, "is_ws", "position"])


def balanced_draws(cells: DataFrame, n_draws: int, ws_ratio: float, seed: int) -> DataFrame:
    """``n_draws`` cells over all variants, ws with probability ``ws_ratio``, each pool cycled in shuffled order."""
    draws = cells.sparkSession.range(n_draws).select(
        F.col("id").alias("draw_id"), uniform(seed, "draw", F.col("id")).alias("u"))
    return _from_pool(draws, pools(cells, seed, by=()), materialize(pool_sizes(cells, by=()), "pool-sizes"), [], ws_ratio)


def variant_intervals(weights: DataFrame) -> DataFrame:
    """Cumulative weight interval [start, end) of each variant in id order; invalid weights count as 1."""
    ok = F.col("weight").isNotNull() & ~F.isnan("weight") & (F.col("weight") > 0) & (F.col("weight") < float("inf"))
    rows = weights.select("variant_id", F.when(ok, F.col("weight").cast("double")).otherwise(F.lit(1.0)).alias("weight"))
    numbered = ordered_row_numbers(rows, [], ["variant_id"], "_at")
    summed = running(numbered, [], "_at", "weight", F.sum, "end")
    return summed.select("variant_id", (F.col("end") - F.col("weight")).alias("start"), "end")


def choose_variants(batches: DataFrame, intervals: DataFrame, seed: int) -> DataFrame:
    """Weighted choice per batch as a range join: both sides meet in equal-width buckets of the weight axis.

    ``intervals`` is stored. There are as many buckets as variants, so an interval covers two on average, and the few
    batches of a bucket meet the few intervals that reach into it.
    """
    whole, buckets = intervals.agg(F.max("end"), F.count("*")).first()
    if not buckets:
        return batches.select("batch_id", F.lit(None).cast("string").alias("variant_id")).limit(0)
    bucket = lambda at: F.least(F.lit(buckets - 1), F.floor(at / F.lit(whole) * buckets))
    spans = intervals.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("end")))))
    points = (batches.withColumn("_at", uniform(seed, "variant", F.col("batch_id")) * whole)
              .withColumn("_bucket", bucket(F.col("_at"))))
    met = points.join(spans, "_bucket")
    return met.filter((F.col("_at") >= F.col("start")) & (F.col("_at") < F.col("end"))).select("batch_id", "variant_id")


def grouped_batches(cells: DataFrame, n_batches: int, batch_size: int, ws_ratio: float, seed: int) -> DataFrame:
    """Batches of one variant each, the variant drawn by its number of cells, filled from its two pools.

    The position in a pool continues across the batches of a variant.
    """
    sizes = materialize(pool_sizes(cells), "pool-sizes")
    weights = sizes.select("variant_id", (F.col("n_ws") + F.col("n_other")).alias("weight"))
    batches = cells.sparkSession.range(n_batches).select(F.col("id").alias("batch_id"))
    chosen = choose_variants(batches, materialize(variant_intervals(weights), "intervals"), seed)
    draws = (chosen.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(batch_size - 1))))
             .withColumn("draw_id", F.col("batch_id") * batch_size + F.col("slot"))
             .withColumn("u", uniform(seed, "slot", F.col("draw_id"))))
    return _from_pool(draws, pools(cells, seed), sizes, ["variant_id"], ws_ratio)


def epoch_batches(n_cells: int, batch_size: int) -> int:
    """Nominal number of batches of an epoch."""
    return max(1, n_cells // max(1, batch_size))


def assemble_batches(rows: DataFrame, graphs: DataFrame | None = None) -> DataFrame:
    """One row per batch with its samples in slot order, and the variant's graph once per batch.

    ``rows``: batch_id, variant_id, slot, cell_idx, pose_feats, labels, ws_mask; a batch has a fixed size.
    """
    sample = F.struct("slot", "cell_idx", "pose_feats", "labels", "ws_mask")
    out = rows.groupBy("batch_id", "variant_id").agg(F.array_sort(F.collect_list(sample)).alias("samples"))
    return out if graphs is None else lookup_join(out, graphs, ["variant_id"], "left")
