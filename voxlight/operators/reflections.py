"""Reflections: selection, factors applied to intensities, merging statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def slice_rows(df: DataFrame, low: int, up: int, key: str = "refl_id") -> DataFrame:
    """Rows low..up-1; up = -1 is the end."""
    return df.where((F.col(key) >= low) & (F.lit(up == -1) | (F.col(key) < up)))


def drop_excluded(df: DataFrame, mask: int, flags: str = "flags") -> DataFrame:
    return df.where(F.col(flags).bitwiseAND(mask) == 0)


def attach_factor(df: DataFrame, factors: DataFrame) -> DataFrame:
    return df.join(factors.select("refl_id", F.col("factor").alias("analytical_correction")), "refl_id")


def apply_factor(df: DataFrame, pairs: Sequence[tuple[str, str]], factor: str = "analytical_correction") -> DataFrame:
    """Each (value, variance) divided by the factor and by its square."""
    a = F.col(factor)
    return df.withColumns({k: v for value, variance in pairs for k, v in ((value, F.col(value) / a), (variance, F.col(variance) / (a * a)))})


def misaligned(a: DataFrame, b: DataFrame, key: str = "refl_id") -> DataFrame:
    """Keys that only one of the two has."""
    one, two = a.select(key), b.select(key)
    return one.join(two, key, "left_anti").withColumn("only_in", F.lit("left")).union(two.join(one, key, "left_anti").withColumn("only_in", F.lit("right")))


def assert_aligned(a: DataFrame, b: DataFrame, key: str = "refl_id") -> None:
    if odd := misaligned(a, b, key).limit(5).collect():
        raise ValueError(f"rows without a partner: {odd}")


def merging_stats(obs: DataFrame, *by: str, half: str = "half") -> DataFrame:
    """obs (by, h, k, l, sign, i, sigma, half 0 or 1): r_merge, i_over_sigma_mean, cc_anom and r_anom of each group, by the published formulas.

    Sums of unique reflections are formed first, so that the largest multiplicity is no large task.
    """
    key = [*by, "h", "k", "l"]
    w = 1 / (F.col("sigma") * F.col("sigma"))
    gaps = [(F.avg(F.when((F.col("sign") > 0) & (F.col(half) == k), F.col("i"))) - F.avg(F.when((F.col("sign") < 0) & (F.col(half) == k), F.col("i")))).alias(f"d{k}") for k in (0, 1)]
    per = obs.groupBy(*key).agg(F.avg("i").alias("mean"), F.count("*").alias("n"), (F.sum(F.col("i") * w) / F.sum(w)).alias("merged"), F.sqrt(1 / F.sum(w)).alias("merged_sigma"), F.avg(F.when(F.col("sign") > 0, F.col("i"))).alias("plus"), F.avg(F.when(F.col("sign") < 0, F.col("i"))).alias("minus"), *gaps)
    gap = F.abs(F.col("i") - F.col("mean"))
    spread = obs.join(per.where("n > 1").select(*key, "mean"), key).groupBy(*by).agg((F.sum(gap) / F.sum(F.col("i"))).alias("r_merge"))
    whole = per.groupBy(*by).agg(F.avg(F.col("merged") / F.col("merged_sigma")).alias("i_over_sigma_mean"), (F.sum(F.abs(F.col("plus") - F.col("minus"))) / F.sum(F.when(F.col("plus").isNotNull() & F.col("minus").isNotNull(), (F.col("plus") + F.col("minus")) / 2))).alias("r_anom"), F.corr("d0", "d1").alias("cc_anom"))
    return spread.join(whole, list(by)) if by else spread.crossJoin(whole)


def fill_from_anomalous(stats: DataFrame, obs: DataFrame, *by: str) -> DataFrame:
    """stats (by, figures...) with nulls filled from the anomalous statistics, which merge the two signs apart."""
    apart = merging_stats(obs.withColumn("l", F.col("l") * 2 + (F.col("sign") > 0).cast("int")), *by)
    figures = [c for c in stats.columns if c not in by and c in apart.columns]
    both = stats.join(apart.select(*by, *(F.col(c).alias(f"anomalous_{c}") for c in figures)), list(by), "left")
    return both.select(*(F.coalesce(c, f"anomalous_{c}").alias(c) if c in figures else c for c in stats.columns))


def factor_sensitivity(baseline: DataFrame, variants: DataFrame) -> DataFrame:
    """variants (variant, refl_id, factor): mean, largest and least absolute difference from the baseline."""
    gap = F.abs(F.col("factor") - F.col("base"))
    both = variants.join(baseline.select("refl_id", F.col("factor").alias("base")), "refl_id")
    return both.groupBy("variant").agg(F.avg(gap).alias("mean_gap"), F.max(gap).alias("max_gap"), F.min(gap).alias("min_gap"))
