"""Statistics of trades in R, one row for each run. Intervals that resample are a pandas function of a run's trades."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.study import wilson

FEWEST, RESAMPLES = 40, 10_000


def summary(trades: DataFrame, blocks: int = 1024) -> DataFrame:
    """(run, n, expectancy_r, win_rate with its score interval, profit_factor (null without losses), max_drawdown_r) of (run, at a number, r_net). Results of
    exactly 0 are losses. The drawdown is that of the cumulative result in time order, from 0 on.

    A run is cut into blocks of time. A block's state is its sum, its highest and lowest running sum, and its own largest fall; states of neighbours combine into one of the same kind, so
    a run's curve is never in one task, only a row for each of its blocks.
    """
    span = W.partitionBy("run")
    edges = trades.groupBy("run").agg(F.min("at").cast("double").alias("_lo"), F.max("at").cast("double").alias("_hi"))
    share = F.try_divide(F.col("at").cast("double") - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    cut = trades.join(edges, "run").withColumn("_block", F.floor(F.coalesce(share, F.lit(0.0)) * (blocks - 1)))
    w = W.partitionBy("run", "_block").orderBy("at")
    local = cut.withColumn("_c", F.sum("r_net").over(w.rowsBetween(W.unboundedPreceding, 0)))
    local = local.withColumn("_dd", F.max("_c").over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col("_c"))
    gains, losses = F.sum(F.when(F.col("r_net") > 0, F.col("r_net"))), F.sum(F.when(F.col("r_net") < 0, -F.col("r_net")))
    states = local.groupBy("run", "_block").agg(F.count(F.lit(1)).alias("n"), F.sum("r_net").alias("_sum"), F.max("_c").alias("_high"), F.min("_c").alias("_low"), F.max("_dd").alias("_fall"), F.count_if(F.col("r_net") > 0).alias("wins"), gains.alias("_gains"), losses.alias("_losses"))
    before = span.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    placed = states.withColumn("_from", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)))
    peaks = placed.withColumn("_peak", F.greatest(F.coalesce(F.max(F.col("_from") + F.col("_high")).over(before), F.lit(0.0)), F.lit(0.0)))
    fall = F.greatest(F.col("_fall"), F.col("_peak") - F.col("_from") - F.col("_low"))
    g = peaks.groupBy("run").agg(F.sum("n").alias("n"), (F.sum("_sum") / F.sum("n")).alias("expectancy_r"), F.sum("wins").alias("wins"), F.try_divide(F.coalesce(F.sum("_gains"), F.lit(0.0)), F.nullif(F.sum("_losses"), F.lit(0.0))).alias("profit_factor"), F.greatest(F.max(fall), F.lit(0.0)).alias("max_drawdown_r"))
    low, high = wilson("wins", "n")
    return g.withColumn("win_rate", F.col("wins") / F.col("n")).withColumn("win_low", low).withColumn("win_high", high)


def block_length(r: np.ndarray) -> float:
    """Mean block length by the automatic rule of Politis and White (2004, with the 2009 correction) for the stationary bootstrap; from 1 to n / 10."""
    n = len(r)
    x = r - r.mean()
    top = max(1.0, n / 10)
    if not np.any(x):
        return 1.0
    k = max(5, int(math.sqrt(math.log10(n))))
    most = min(n - 1, int(math.ceil(math.sqrt(n))) + k)
    cov = np.array([float(x[: n - j] @ x[j:]) / n for j in range(most + 1)])
    rho = cov[1:] / cov[0]
    bound = 2 * math.sqrt(math.log10(n) / n)
    m = next((j for j in range(len(rho) - k + 1) if np.all(np.abs(rho[j : j + k]) < bound)), None)
    m = m if m is not None else int(np.flatnonzero(np.abs(rho) >= bound).max(initial=0)) + 1
    reach = min(2 * max(m, 1), most)
    lag = np.arange(1, reach + 1)
    flat = np.clip(2 * (1 - lag / reach), 0, 1) if reach > 1 else np.ones(1)
    g = 2 * float(np.sum(flat * lag * cov[1 : reach + 1]))
    spectrum = float(cov[0] + 2 * np.sum(flat * cov[1 : reach + 1]))
    if spectrum <= 0 or g == 0:
        return 1.0
    return float(min(max(1.0, (2 * g * g / (2 * spectrum * spectrum)) ** (1 / 3) * n ** (1 / 3)), top))


def stationary_resamples(r: np.ndarray, mean_block: float, resamples: int, rng: np.random.Generator) -> np.ndarray:
    """Resampled series, one in each row: blocks of geometric length that wrap around the end."""
    n = len(r)
    new = rng.random((resamples, n)) < 1 / mean_block
    new[:, 0] = True
    start = rng.integers(0, n, (resamples, n))
    at = np.arange(n)
    last = np.maximum.accumulate(np.where(new, at, 0), axis=1)
    return r[(np.take_along_axis(start, last, 1) + at - last) % n]


def bca(values: np.ndarray, point: float, jack: np.ndarray, level: float = 0.95) -> tuple[float, float, str]:
    """The bias-corrected and accelerated interval, or the plain percentiles where it can't be computed."""
    from statistics import NormalDist

    z, tails = NormalDist(), ((1 - level) / 2, (1 + level) / 2)
    share = float((values < point).mean() + 0.5 * (values == point).mean())
    d = jack.mean() - jack
    spread = float((d**2).sum())
    if not 0 < share < 1 or spread == 0:
        low, high = np.percentile(values, [100 * t for t in tails])
        return float(low), float(high), "percentile"
    z0, a = z.inv_cdf(share), float((d**3).sum()) / (6 * spread**1.5)
    cut = [z.cdf(z0 + (z0 + z.inv_cdf(t)) / (1 - a * (z0 + z.inv_cdf(t)))) for t in tails]
    low, high = np.percentile(values, [100 * c for c in cut])
    return float(low), float(high), "bca"


def resampled(r: np.ndarray, seed: int, resamples: int = RESAMPLES) -> dict | None:
    """Expectancy interval and the drawdown's distribution of trades in time order; None below FEWEST trades: too few to say anything."""
    if len(r) < FEWEST:
        return None
    rng, length = np.random.default_rng(seed), block_length(r)
    means, drops = [], []
    chunk = max(1, 5_000_000 // len(r))
    for at in range(0, resamples, chunk):
        x = stationary_resamples(r, length, min(chunk, resamples - at), rng)
        means.append(x.mean(axis=1))
        c = np.cumsum(x, axis=1)
        drops.append((np.maximum(np.maximum.accumulate(c, axis=1), 0) - c).max(axis=1))
    means, drops = np.concatenate(means), np.concatenate(drops)
    low, high, how = bca(means, float(r.mean()), (r.sum() - r) / (len(r) - 1))
    return {"low": low, "high": high, "method": how, "block_length": length, "drawdown_median": float(np.median(drops)), "drawdown_p95": float(np.percentile(drops, 95))}


def intervals(trades: DataFrame, seed: int, resamples: int = RESAMPLES) -> DataFrame:
    """(run, n, low, high, method, block_length, drawdown_median, drawdown_p95) of (run long, at, r_net); nulls for runs of fewer than FEWEST trades."""
    names = ["low", "high", "method", "block_length", "drawdown_median", "drawdown_p95"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.sort_values("at")["r_net"].to_numpy(float)
        got = resampled(r, seed + int(pdf["run"].iloc[0]), resamples) or dict.fromkeys(names)
        return pd.DataFrame([{"run": int(pdf["run"].iloc[0]), "n": len(r), **got}])

    return trades.select("run", "at", "r_net").groupBy("run").applyInPandas(run, "run long, n long, low double, high double, method string, block_length double, drawdown_median double, drawdown_p95 double")


def sidak(runs: int, alpha: float = 0.05) -> float:
    """The level of each of so many runs for a family-wise level of alpha."""
    return 1 - (1 - alpha) ** (1 / runs)


def evidence_tier(n: int, low: float | None, beats_placebo: bool = True, robust: bool = False, stressed_low: float | None = None, good_years: float = 0.0, adjusted_low: float | None = None, validated: bool = False, held_out: bool = False) -> str:
    """What a result may be called, computed and never chosen."""
    if n < FEWEST or low is None or low <= 0 or not beats_placebo:
        return "NO EVIDENCE"
    if not (robust and (stressed_low or 0) > 0 and good_years >= 0.7 and (adjusted_low or 0) > 0):
        return "EXPLORATORY"
    return "HOLDOUT-SUPPORTED" if validated and held_out else "VALIDATION-SUPPORTED" if validated else "PROMISING"
