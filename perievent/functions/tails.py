"""Tail probabilities of test statistics, in numpy: regularized incomplete gamma and beta by series and fractions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gamma_upper(a: float, x: float) -> float:
    """Q(a, x), the upper regularized incomplete gamma function."""
    if not x > 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return 1 - total * scale
    b, d = x + 1 - a, 1 / (x + 1 - a)
    c, h = 1e300, d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or 1e-300)
        c = (b + an / c) or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * scale


def beta_lower(a: float, b: float, x: float) -> float:
    """I_x(a, b), the regularized incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_lower(b, a, 1 - x)
    scale = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or 1e-300)
    h = d
    for m in range(1, 1000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or 1e-300)
            c = (1 + num / c) or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def p_value(kind: str, x: float, *dof: float) -> float:
    """The tail of chi2(dof) and F(df1, df2) above x, both tails of t(dof) and the normal beyond abs(x)."""
    if x is None or x != x:
        return math.nan
    if kind == "chi2":
        return gamma_upper(dof[0] / 2, x / 2)
    if kind == "f":
        return beta_lower(dof[1] / 2, dof[0] / 2, dof[1] / (dof[1] + dof[0] * max(x, 0.0)))
    if kind == "t":
        return beta_lower(dof[0] / 2, 0.5, dof[0] / (dof[0] + x * x))
    return math.erfc(abs(x) / math.sqrt(2))


def with_p(df: DataFrame, kind: str, *columns: str) -> DataFrame:
    """df with p, the tail of its statistic (first column) under its degrees of freedom (the others)."""

    arguments = F.struct(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])

    @F.pandas_udf("double")
    def tail(x: pd.DataFrame) -> pd.Series:
        return pd.Series([p_value(kind, *row) for row in x.itertuples(index=False)], dtype="float64")

    return df.withColumn("p", tail(arguments))
