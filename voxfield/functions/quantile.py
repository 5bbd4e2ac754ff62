"""Exact group quantiles that never hold a large group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import materialize

SMALL_GROUP = 100_000
RANK_SLACK = 0.002
SKETCH_ACCURACY = 2_000
SUB_BINS = 256


def _targets(n: Column, p: float, method: str) -> tuple[Column, Column, Column]:
    """0-based lower rank, upper rank and interpolation weight of quantile ``p`` in ``n`` sorted values."""
    if method == "linear":
        at = F.lit(float(p)) * (n - 1)
        low = F.floor(at)
        return low, F.ceil(at), at - low
    rank = F.greatest(F.lit(0), F.least(n - 1, F.ceil(F.lit(float(p)) * n) - 1)).cast("bigint")
    return rank, rank, F.lit(0.0)


def _builtin(value: str, p: float, method: str) -> Column:
    if method == "linear":
        return F.percentile(value, F.lit(float(p)))
    return F.expr(f"percentile_disc({float(p)}) WITHIN GROUP (ORDER BY `{value}`)").cast("double")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
                    method: str = "linear", small_group: int = SMALL_GROUP) -> DataFrame:
    """One row per group with a column per named probability; null values are ignored.

    ``method`` is "linear" (interpolating) or "nearest" (nearest rank). Groups up to ``small_group`` rows use the
    built-in aggregate. For larger ones a mergeable sketch brackets every wanted rank; one more scan counts the
    values below each bracket and shuffles only the few inside it, already counted per distinct value.
    """
    if not keys:
        whole = df.select(F.lit(1).alias("_all"), F.col(value))
        return exact_quantiles(whole, ["_all"], value, probs, method, small_group).drop("_all")
    data = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    sizes = materialize(data.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), "group-sizes")
    large = sizes.filter(F.col("_n") > small_group)
    if large.isEmpty():
        return _small(data, keys, probs, method)
    listed = large.select(*keys)
    stored = materialize(data.join(listed, keys, "left_semi"), "large-groups")
    return (_small(data.join(listed, keys, "left_anti"), keys, probs, method)
            .unionByName(_large(stored, _brackets(stored, keys, probs), keys, probs, method)))


def _brackets(data: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    """Size, ends and a bracket around every wanted rank of each group, in one aggregate."""
    names = list(probs)
    lows = [min(1.0, max(0.0, probs[c] - RANK_SLACK)) for c in names]
    highs = [max(0.0, min(1.0, probs[c] + RANK_SLACK)) for c in names]
    sketch = data.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", [*lows, *highs], SKETCH_ACCURACY).alias("_s"),
        F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    brackets = [F.struct(
        F.lit(c).alias("name"),
        (F.col("_min") if lows[i] == 0.0 else F.col("_s")[i]).alias("lo"),
        (F.col("_max") if highs[i] == 1.0 else F.col("_s")[len(names) + i]).alias("hi")) for i, c in enumerate(names)]
    return materialize(sketch.select(*keys, "_n", "_min", "_max", F.array(*brackets).alias("_b")), "quantile-brackets")


def _small(data: DataFrame, keys: list[str], probs: dict[str, float], method: str) -> DataFrame:
    return data.groupBy(*keys).agg(*[_builtin("_v", p, method).alias(c) for c, p in probs.items()])


def _inside(data: DataFrame, bounds: DataFrame, keys: list[str], names: list[str]) -> tuple[DataFrame, DataFrame]:
    """Per group and bracket: how many values lie below it, and the stored counts of the distinct values inside."""
    bounded = data.join(bounds.select(*keys, "_b"), keys)
    below = bounded.groupBy(*keys).agg(*[
        F.count_if(F.col("_v") < F.col("_b")[i]["lo"]).alias(f"_below{i}") for i in range(len(names))])
    below = below.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(c).alias("_name"), F.col(f"_below{i}").alias("_below")) for i, c in enumerate(names)
    ])).alias("_e")).select(*keys, "_e.*")

    hit = F.explode(F.filter("_b", lambda b: (F.col("_v") >= b["lo"]) & (F.col("_v") <= b["hi"])))
    inside = (bounded.select(*keys, "_v", hit.alias("_h"))
              .groupBy(*keys, F.col("_h.name").alias("_name"), F.col("_h.lo").alias("_lo"),
                       F.col("_h.hi").alias("_hi"), "_v").agg(F.count(F.lit(1)).alias("_c")))
    span = F.col("_hi") - F.col("_lo")
    bin_of = F.when(span > 0, F.least(F.lit(SUB_BINS - 1), F.floor((F.col("_v") - F.col("_lo")) / span * SUB_BINS)))
    inside = inside.withColumn("_bin", F.coalesce(bin_of, F.lit(0)).cast("int"))
    return materialize(below, "quantile-below"), materialize(inside, "quantile-inside")


def _missed(below: DataFrame, inside: DataFrame, sizes: DataFrame, keys: list[str], probs: dict[str, float],
            method: str) -> DataFrame:
    """Brackets that do not hold the ranks they were made for."""
    group = [*keys, "_name"]
    held = inside.groupBy(*group).agg(F.sum("_c").alias("_held"))
    known = below.join(sizes.select(*keys, "_n"), keys).join(held, group, "left").fillna(0, ["_held"])
    ok = F.lit(False)
    for c, p in probs.items():
        low, high, _ = _targets(F.col("_n"), p, method)
        ok = ok | ((F.col("_name") == c) & (low >= F.col("_below")) & (high < F.col("_below") + F.col("_held")))
    return materialize(known.filter(~ok).select(*group), "missed-brackets")


def _large(data: DataFrame, sizes: DataFrame, keys: list[str], probs: dict[str, float], method: str) -> DataFrame:
    names = list(probs)
    below, inside = _inside(data, sizes, keys, names)
    missed = _missed(below, inside, sizes, keys, probs, method)
    if not missed.isEmpty():  # the sketch was off: take the whole range for those
        wide = missed.groupBy(*keys).agg(F.collect_set("_name").alias("_wide"))
        sizes = sizes.join(wide, keys, "left").withColumn("_b", F.transform("_b", lambda b: F.when(
            F.array_contains("_wide", b["name"]),
            F.struct(b["name"].alias("name"), F.col("_min").alias("lo"), F.col("_max").alias("hi"))).otherwise(b))).drop("_wide")
        sizes = materialize(sizes, "quantile-brackets")
        below, inside = _inside(data, sizes, keys, names)

    group = [*keys, "_name"]
    bins = inside.groupBy(*group, "_bin").agg(F.sum("_c").alias("_t"))
    earlier = Window.partitionBy(*group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("_off", F.coalesce(F.sum("_t").over(earlier), F.lit(0))).drop("_t")
    upto = Window.partitionBy(*group, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (inside.join(bins, [*group, "_bin"]).join(below.join(sizes.select(*keys, "_n"), keys), group)
              .withColumn("_end", F.sum("_c").over(upto) + F.col("_off") + F.col("_below"))
              .withColumn("_start", F.col("_end") - F.col("_c")))

    picks = []
    for c in names:
        low, high, weight = _targets(F.col("_n"), probs[c], method)
        named = F.col("_name") == c
        at = lambda rank: F.max(F.when(named & (F.col("_start") <= rank) & (rank < F.col("_end")), F.col("_v")))
        picks.append((c, at(low), at(high), F.max(weight)))
    return ranked.groupBy(*keys).agg(*[(lo + (hi - lo) * w).alias(c) for c, lo, hi, w in picks])
