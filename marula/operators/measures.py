"""Indicators over groups: h-index, growth, ranks, rank correlation."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def h_index(df: DataFrame, group: Sequence[str], cites: str) -> DataFrame:
    """Rows (group, h_index): the most papers h of the group with at least h citations each.

    Papers are first counted by their citations, capped at the group's number of
    papers, so a group of any size is a short list of counts before it is ordered.
    """
    counts = df.groupBy(*group, F.floor(F.coalesce(F.col(cites), F.lit(0.0))).cast("bigint").alias("_c")).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*group).orderBy(F.desc("_c")).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("_k", upto)
    return ranked.groupBy(*group).agg(F.max(F.least("_c", "_k")).alias("h_index"))


def numbered(df: DataFrame, group: Sequence[str], order: str, name: str, width: int = 1_000_000) -> DataFrame:
    """df with the row's number within its group, from 1, by a unique whole-number column.

    Rows are numbered within buckets of that column and raised by the sizes of the
    group's earlier buckets, so a group of any size is spread over many tasks.
    """
    b = df.withColumn("_bucket", F.floor(F.col(order) / width))
    sizes = b.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(*group, "_bucket", F.coalesce(earlier, F.lit(0)).alias("_offset"))
    within = F.row_number().over(Window.partitionBy(*group, "_bucket").orderBy(order))
    return b.withColumn("_k", within).join(offsets, [*group, "_bucket"]).withColumn(name, F.col("_k") + F.col("_offset")).drop("_bucket", "_k", "_offset")


def growth(first: Column, last: Column, years: int) -> Column:
    """Compound annual growth in per cent; null if either end isn't positive."""
    return F.when((first > 0) & (last > 0), (F.pow(last / first, F.lit(1.0 / years)) - 1) * 100)


def average_rank(group: Sequence[str], value: str) -> Column:
    """Rank within the group, ties sharing the mean of their ranks."""
    w = Window.partitionBy(*group)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*group, value)) - 1) / 2.0


def spearman(df: DataFrame, group: Sequence[str], x: str, y: str) -> DataFrame:
    """Rows (group, rho, n): rank correlation of the pairs without nulls; null if either side is constant."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = both.select(*group, average_rank(group, x).alias("_x"), average_rank(group, y).alias("_y"))
    rho = F.try_divide(F.covar_pop("_x", "_y"), F.stddev_pop("_x") * F.stddev_pop("_y"))
    return ranked.groupBy(*group).agg(rho.alias("rho"), F.count("*").alias("n"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by the modified Lentz scheme."""
    tiny = 1e-300
    c, d = 1.0, 1 / max(abs(1 - (a + b) * x / (a + 1)), tiny) * (1 if 1 - (a + b) * x / (a + 1) > 0 else -1)
    out = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            c = 1 + top / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def correlation_p(rho: float | None, n: int) -> float | None:
    """Two-sided p-value of a rank correlation by the t distribution with n - 2 degrees of freedom."""
    if rho is None or n < 3:
        return None
    if abs(rho) >= 1:
        return 0.0
    t2 = rho * rho * (n - 2) / (1 - rho * rho)
    return incomplete_beta((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))
