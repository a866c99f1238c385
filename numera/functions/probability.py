"""Sample statistics with the bounds they justify."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def monte_carlo(df: DataFrame, by: list[str], x: str, low: float, high: float, alpha: float = 0.05) -> DataFrame:
    """(by..., n, mean, variance, epsilon, status): mean with Hoeffding's bound; the variance divides by n.

    The bound needs a finite support and 0 < alpha < 1, else the status is UNRESOLVED.
    """
    finite = abs(low) != float("inf") and abs(high) != float("inf") and low < high and 0 < alpha < 1
    n = F.count(x)
    eps = F.lit(high - low) * F.sqrt(F.log(F.lit(2.0 / alpha))) / F.sqrt(2.0 * n) if finite else F.lit(None).cast("double")
    status = F.lit("ENCLOSED_UNDER_ASSUMPTIONS" if finite else "UNRESOLVED")
    return df.groupBy(*by).agg(n.alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("variance"), eps.alias("epsilon")).withColumn("status", status)


def ecdf_distance(df: DataFrame, by: list[str], x: str, cdf: Column) -> DataFrame:
    """(by..., n, distance, supported): the largest gap between the empirical distribution and ``cdf`` of column ``x``."""
    w = Window.partitionBy(*by).orderBy(x)
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    i = F.row_number().over(w)
    gap = F.greatest(F.abs(i / n - cdf), F.abs((i - 1) / n - cdf))
    out = df.select(*by, gap.alias("g"), n.alias("n")).groupBy(*by).agg(F.max("n").alias("n"), F.max("g").alias("distance"))
    return out.withColumn("supported", F.col("distance") <= F.least(F.lit(0.2), 1.63 / F.sqrt("n")))


def mass_is_valid(p: Column) -> Column:
    """Whether a group of probabilities is non-negative and adds up to one."""
    return F.bool_and(p >= 0) & (F.abs(F.sum(p) - 1) <= 1e-9)
