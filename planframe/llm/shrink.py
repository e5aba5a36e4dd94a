"""Shrinking group rates towards their parents' (beta-binomial empirical Bayes)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_RHO, MOST_RHO = 1e-4, 0.999


def strength(groups: DataFrame) -> DataFrame:
    """One row ``kappa``: the prior weight that the spread of the groups' rates supports.

    ``groups`` has ``n`` (outcomes), ``k`` (of these, hits) and ``m`` (the parent's rate).
    With a beta prior of mean m and weight kappa, n (k/n - m)**2 / (m (1 - m)) has mean
    1 + (n - 1) rho, rho = 1 / (kappa + 1); rho is its estimate by moments. Where no group
    has two outcomes, nothing is known and rho is the least.
    """
    excess = F.sum(F.col("n") * F.pow(F.try_divide("k", "n") - F.col("m"), F.lit(2)) / (F.col("m") * (1 - F.col("m"))) - 1)
    rho = F.greatest(F.lit(LEAST_RHO), F.least(F.lit(MOST_RHO), F.coalesce(F.try_divide(excess, F.sum(F.col("n") - 1)), F.lit(LEAST_RHO))))
    return groups.where("n > 0 and m > 0 and m < 1").agg((1 / rho - 1).alias("kappa"))


def posterior_mean(n: Column, k: Column, m: Column, kappa: Column) -> Column:
    return (k + kappa * m) / (n + kappa)
