"""Error rates of samples: intervals of shares, and tests across samples by position."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal_quantile(level: float) -> float:
    """z of a two-sided interval at a level of confidence."""
    return NormalDist().inv_cdf(0.5 + level / 2)


def interval(hits: Column, of: Column, method: str = "wilson", level: float = 0.95) -> tuple[Column, Column, Column]:
    """Share with the lower and upper ends of its interval; null where ``of`` is 0.

    wilson: the score interval. corrected: the same with correction for continuity (half a case, or the distance to half of
    ``of`` if that is less). logit: normal on the log odds; without hits (with hits only) the exact one-sided bounds.
    """
    z, rest = normal_quantile(level), (1 - level) / 2
    x, n = hits.cast("double"), of.cast("double")
    p = F.try_divide(x, n)
    if method == "logit":
        odds, half = F.log(x / (n - x)), z * F.sqrt(1 / (n * p * (1 - p)))
        lower = F.when(x == 0, 0.0).when(x == n, F.pow(F.lit(rest), 1 / n)).otherwise(1 / (1 + F.exp(-(odds - half))))
        upper = F.when(x == 0, 1 - F.pow(F.lit(rest), 1 / n)).when(x == n, 1.0).otherwise(1 / (1 + F.exp(-(odds + half))))
    elif method in ("wilson", "corrected"):
        moved = (F.least(F.lit(0.5), F.abs(x - n / 2)) if method == "corrected" else F.lit(0.0)) / n
        side = z * z / (2 * n)

        def end(sign: int) -> Column:
            c = p + sign * moved
            value = (c + side + sign * z * F.sqrt(c * (1 - c) / n + side / (2 * n))) / (1 + 2 * side)
            return F.when(c <= 0, 0.0).otherwise(value) if sign < 0 else F.when(c >= 1, 1.0).otherwise(value)

        if method == "corrected":
            lower, upper = F.greatest(F.lit(0.0), end(-1)), F.least(F.lit(1.0), end(1))
        else:
            lower, upper = ((p + side + s * z * F.sqrt(p * (1 - p) / n + side / (2 * n))) / (1 + 2 * side) for s in (-1, 1))
            lower, upper = F.when(x == 0, 0.0).otherwise(lower), F.when(x == n, 1.0).otherwise(upper)
    else:
        raise ValueError(f"no interval is called {method}")
    known = (n > 0) & x.isNotNull()
    return p, F.when(known, lower), F.when(known, upper)


def upper_tail(x: float, df: int) -> float:
    """Probability of a chi-square variable with ``df`` degrees of freedom to be x or more: a finite sum for any whole df."""
    if df % 2:
        term, total = math.sqrt(2 * x / math.pi) * math.exp(-x / 2), math.erfc(math.sqrt(x / 2))
        for k in range(3, df + 1, 2):
            total, term = total + term, term * x / k
        return total
    term = total = math.exp(-x / 2)
    for k in range(1, df // 2):
        term *= x / (2 * k)
        total += term
    return total


def fisher_p(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of the table ((a, b), (c, d)) with its margins: all tables that are no likelier, by logarithms of factorials."""
    row, col, n = a + b, a + c, a + b + c + d
    first, last = max(0, row + col - n), min(row, col)
    if first == last:
        return 1.0
    k = np.arange(first, last + 1)
    # ratios of neighbouring tables, summed: no factorial is needed but relative to the first table
    steps = np.log((row - k[:-1]) * (col - k[:-1]).astype(float)) - np.log((k[:-1] + 1.0) * (n - row - col + k[:-1] + 1.0))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    p = np.exp(logs - logs.max())
    return float(min(1.0, p[p <= p[a - first] * (1 + 1e-7)].sum() / p.sum()))


def error_rate_test(depth: DataFrame, samples: list[str], thresh: int, method: str = "chi", to: int | None = None) -> DataFrame:
    """Per position (pos) whether error rates differ across samples: pos, statistic, p_value.

    depth: source, pos, depth, errors. Positions count at which every sample is deeper than ``thresh``; with ``to`` depths are
    scaled down to that first. chi: chi-square of the table of depths and errors by sample, for two samples with Yates'
    correction; null where a margin is empty. fisher: exact, two samples; the statistic is null.
    """
    if method == "fisher" and len(samples) != 2:
        raise ValueError("the exact test is for two samples")
    d, e = F.col("depth"), F.col("errors")
    if to is not None:
        from .depth import downsample

        d, e = downsample(d, e, to)
    wide = depth.filter(F.col("source").isin(*samples)).select("source", "pos", F.col("depth").alias("_raw"), d.cast("long").alias("_d"), e.cast("long").alias("_e"))
    cells = [F.sum(F.when(F.col("source") == s, F.col(c))).alias(f"{c}{i}") for i, s in enumerate(samples) for c in ("_raw", "_d", "_e")]
    own = wide.groupBy("pos").agg(*cells).filter(F.least(*[F.col(f"_raw{i}") for i in range(len(samples))], F.lit(2**62)) > thresh)
    for i in range(len(samples)):
        own = own.filter(F.col(f"_raw{i}").isNotNull())
    ds, es = ([F.col(f"{c}{i}") for i in range(len(samples))] for c in ("_d", "_e"))
    if method == "fisher":

        @F.pandas_udf("double")
        def exact(a: pd.Series, b: pd.Series, c: pd.Series, x: pd.Series) -> pd.Series:
            return pd.Series([fisher_p(*map(int, t)) for t in zip(a, b, c, x)], dtype="float64")

        return own.select("pos", F.lit(None).cast("double").alias("statistic"), exact(ds[0], ds[1], es[0], es[1]).alias("p_value"))
    all_d, all_e = sum(ds[1:], ds[0]).cast("double"), sum(es[1:], es[0]).cast("double")
    n = all_d + all_e
    if len(samples) == 2:
        det = F.abs(ds[0] * es[1] - ds[1] * es[0]).cast("double")
        less = det - F.least(n / 2, det)
        stat = F.try_divide(n * less * less, (ds[0] + es[0]) * (ds[1] + es[1]).cast("double") * all_d * all_e)
    else:
        parts = [F.try_divide(F.pow(x - all_d * (x + y) / n, F.lit(2.0)), (x + y).cast("double")) for x, y in zip(ds, es)]
        stat = sum(parts[1:], parts[0]) * n * (F.try_divide(F.lit(1.0), all_d) + F.try_divide(F.lit(1.0), all_e))
    df = len(samples) - 1

    @F.pandas_udf("double")
    def tail(x: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(v) else upper_tail(max(v, 0.0), df) for v in x], dtype="float64")

    return own.select("pos", stat.alias("statistic"), tail(stat).alias("p_value"))
