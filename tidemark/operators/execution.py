"""Order fills on ticks, and what trades are worth in R.

A buy trades on the ask and a sell on the bid, so the spread is paid by the prices themselves. A stop triggers when the market reaches its level and
fills at the level or worse; a limit triggers only when the market trades through its level and fills at the level. Each order looks at the ticks from its
own instant on. Orders and ticks meet by instrument and day, as arrays: the first tick that triggers is looked up in a tree of the best prices, so the work
grows with orders plus ticks and not with their pairs. The first of an order's days is taken by an aggregation.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import timex as T
from tidemark.operators.selection import quantiles

ORDERS = "order_id string, instrument string, kind string, side string, level double, from_ns long, until_ns long, slip double"
KINDS = ("market", "stop", "limit")
# Slippage in spreads for each role, how much more of it follows a gap, where its normal is cut off.
SLIPPAGE = {"market": 0.25, "stop": 0.50, "limit": 0.00}
GAP_MULTIPLIER, SIGMAS = 3.0, 3.0
# Acklam's rational approximation of the inverse of the normal distribution function (relative error below 1.2e-9).
_CENTRE = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_CENTRE_UNDER = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_TAIL = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_TAIL_UNDER = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
_TAIL_FROM = 0.97575
MARKET, STOP, LIMIT = range(3)


def fills(orders: DataFrame, ticks: DataFrame) -> DataFrame:
    """(order_id, fill_ns, fill_price, waited_gap): null where nothing triggers in [from_ns, until_ns). slip is taken off buyer and seller alike; a limit
    that slippage would put beyond its level goes on waiting. waited_gap: the fill's tick comes more than a minute after the one before it."""
    day = 86_400_000_000_000
    kind = F.when(F.col("kind") == "market", MARKET).when(F.col("kind") == "stop", STOP).when(F.col("kind") == "limit", LIMIT)
    o = orders.select("order_id", "instrument", kind.alias("kind"), F.coalesce(F.col("side") == "buy", F.lit(False)).alias("buy"), "level", F.coalesce("slip", F.lit(0.0)).alias("slip"), "from_ns", "until_ns")
    o = o.where("kind is not null and instrument is not null and from_ns < until_ns").withColumn("_d", F.explode(F.expr(f"sequence(from_ns div {day}, (until_ns - 1) div {day})")))
    t = ticks.select("instrument", "ts_utc_ns", "row_sequence", "bid", "ask").withColumn("_d", F.expr(f"ts_utc_ns div {day}"))
    schema = f"order_id {orders.schema['order_id'].dataType.simpleString()}, fill_ns long, row_sequence long, fill_price double, waited_gap boolean"
    seen = o.groupBy("instrument", "_d").cogroup(t.groupBy("instrument", "_d")).applyInPandas(_day_fills, schema)
    first = seen.groupBy("order_id").agg(F.min_by(F.struct("fill_ns", "fill_price", "waited_gap"), F.struct("fill_ns", "row_sequence")).alias("f"))
    return orders.select("order_id").join(first, "order_id", "left").select("order_id", "f.fill_ns", "f.fill_price", "f.waited_gap")


def _day_fills(o: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
    """Fills of one instrument's orders within a day."""
    t = t.sort_values(["ts_utc_ns", "row_sequence", "bid", "ask"])
    ts, seq = t["ts_utc_ns"].to_numpy("int64"), t["row_sequence"].to_numpy("int64")
    level, slip = o["level"].to_numpy(float), o["slip"].to_numpy(float)
    at = np.searchsorted(ts, o["from_ns"].to_numpy("int64"))
    fill = np.full(len(o), np.nan)
    for buy in (True, False):
        price, sign = t["ask" if buy else "bid"].to_numpy(float), 1.0 if buy else -1.0
        for kind in (MARKET, STOP, LIMIT):
            own = np.flatnonzero((o["kind"] == kind).to_numpy(bool) & (o["buy"] == buy).to_numpy(bool))
            if kind != MARKET:
                at[own] = _first_hit(price, at[own], level[own], slip[own], kind, sign)
            own = own[at[own] < len(ts)]
            p = price[at[own]]
            worse, better = (np.maximum, np.minimum) if buy else (np.minimum, np.maximum)
            fill[own] = (p if kind == MARKET else (worse if kind == STOP else better)(level[own], p)) + sign * slip[own]
    done = at < np.searchsorted(ts, o["until_ns"].to_numpy("int64"))
    gap = np.diff(ts, prepend=ts[:1]) > T.MINUTE
    k = at[done]
    return pd.DataFrame({"order_id": o["order_id"].to_numpy()[done], "fill_ns": ts[k], "row_sequence": seq[k], "fill_price": fill[done], "waited_gap": gap[k]})


def _first_hit(price: np.ndarray, start: np.ndarray, level: np.ndarray, slip: np.ndarray, kind: int, sign: float) -> np.ndarray:
    """For each order the first tick from start on that triggers it, or the number of ticks. If any tick of some triggers an order, then so does the one of
    the best price: a tree of best prices over 2, 4, 8 ticks tells which to skip."""
    high = (kind == STOP) == (sign > 0)
    best, none = (np.maximum, -np.inf) if high else (np.minimum, np.inf)
    tree = [np.where(np.isnan(price), none, price)]
    while len(tree[-1]) > 1:
        x = np.append(tree[-1], none) if len(tree[-1]) % 2 else tree[-1]
        tree.append(best(x[::2], x[1::2]))

    def hits(k: int, node: np.ndarray, who: np.ndarray) -> np.ndarray:
        inside = node < len(tree[k])
        p = np.where(inside, tree[k][np.minimum(node, len(tree[k]) - 1)], none) if len(tree[k]) else np.full(len(node), none)
        through = sign * (p - level[who])
        return inside & (through >= 0 if kind == STOP else (through < 0) & (sign * (p + sign * slip[who] - level[who]) <= 0))

    node, found, top = start.copy(), np.full(len(start), -1), len(tree) - 1
    for k in range(top + 1):  # up: a node that begins its parent's range is left to the parent
        who = np.flatnonzero((found < 0) & ((node % 2 == 1) | (k == top)))
        hit = hits(k, node[who], who)
        found[who[hit]] = k
        node[who[~hit]] += 1
        node[found < 0] //= 2
    for k in range(top, 0, -1):  # down to the first tick
        who = np.flatnonzero(found == k)
        left = node[who] * 2
        node[who] = np.where(hits(k - 1, left, who), left, left + 1)
        found[who] = k - 1
    return np.where(found == 0, node, len(price))


def _horner(coefficients: tuple[float, ...], x: str) -> str:
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


def half_normal(p: str) -> str:
    """The size of a normal number, cut off at SIGMAS, that a share p (an SQL expression, 0 to 1) of all sizes lies below. Spark and other engines read it alike."""
    from statistics import NormalDist

    u = f"(0.5 + ({p}) * {NormalDist().cdf(SIGMAS) - 0.5!r})"
    d, q = f"({u} - 0.5)", f"sqrt(-2.0 * ln(1.0 - {u}))"
    centre = f"{_horner(_CENTRE, f'({d} * {d})')} * {d} / ({_horner(_CENTRE_UNDER, f'({d} * {d})')} * ({d} * {d}) + 1.0)"
    tail = f"-({_horner(_TAIL, q)}) / ({_horner(_TAIL_UNDER, q)} * {q} + 1.0)"
    return f"case when {u} <= {_TAIL_FROM} then {centre} else {tail} end"


def slippage(orders: DataFrame, seed: int, spread: str = "spread_twa", role: str = "kind", of: str = "order_id", k: dict[str, float] = SLIPPAGE) -> DataFrame:
    """Adds slip, in price units: k of the order's role, times the spread of its bar, times the size of a normal number that seed, order and role decide. Another seed changes
    fills and never which orders there are."""
    text = F.concat_ws(":", F.lit(str(seed)), F.col(of).cast("string"), F.col(role))
    drawn = orders.withColumn("_u", F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52))
    factor = F.element_at(F.create_map(*(F.lit(x) for pair in k.items() for x in pair)), F.col(role))
    return drawn.withColumn("slip", factor * F.col(spread) * F.expr(half_normal("_u"))).drop("_u")


def fit_slippage(jumps: DataFrame, keys: list[str], jump: str = "jump", spread: str = "spread_twa", cells: int = 19) -> DataFrame:
    """(keys, n, k): the factor with which the model's quantiles match those of observed jumps beyond a level, in spreads: least squares over evenly spaced quantiles."""
    probs = [(c + 1) / (cells + 1) for c in range(cells)]
    sizes = [jumps.sparkSession.sql(f"select {half_normal(f"cast({p!r} as double)")} as z").first()["z"] for p in probs]  # constants: cells numbers
    q = quantiles(jumps.where(F.col(spread) > 0).withColumn("_x", F.col(jump) / F.col(spread)), keys, "_x", probs)
    fitted = sum((F.col("q")[c] * z for c, z in enumerate(sizes)), F.lit(0.0)) / sum(z * z for z in sizes)
    return q.select(*keys, "n", fitted.alias("k"))


def ambiguity(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """Of open trades (trade_id, instrument, side, stop, target, ts_utc_ns of a bar): whether stop and target both lie within that bar on the side that closes the trade."""
    b = bars.select("instrument", "ts_utc_ns", "bid_h", "bid_l", "ask_h", "ask_l")
    long = (F.col("bid_l") <= F.col("stop")) & (F.col("bid_h") >= F.col("target"))
    short = (F.col("ask_h") >= F.col("stop")) & (F.col("ask_l") <= F.col("target"))
    return trades.join(b, ["instrument", "ts_utc_ns"]).select("trade_id", F.when(F.col("side") == "buy", long).otherwise(short).alias("ambiguous"))


def resolve(trades: DataFrame, ticks: DataFrame) -> DataFrame:
    """(trade_id, outcome, resolved_by) of ambiguous bars: the first tick of the minute that reaches stop or trades through the target; without ticks
    the stop is taken to come first."""
    t = ticks.select("instrument", F.expr(T.minute_start("ts_utc_ns")).alias("minute"), F.col("ts_utc_ns").alias("at"), "row_sequence", "bid", "ask")
    x = trades.join(t, (trades["instrument"] == t["instrument"]) & (trades["ts_utc_ns"] == t["minute"]), "left").drop(t["instrument"])
    long = F.col("side") == "buy"
    stop = F.when(long, F.col("bid") <= F.col("stop")).otherwise(F.col("ask") >= F.col("stop"))
    target = F.when(long, F.col("bid") > F.col("target")).otherwise(F.col("ask") < F.col("target"))
    what = F.when(stop, "stop").when(target, "target")
    g = x.withColumn("_w", what).groupBy("trade_id").agg(F.min_by("_w", F.when(F.col("_w").isNotNull(), F.struct("at", "row_sequence"))).alias("first"), F.count("at").alias("n"))
    return g.select("trade_id", F.coalesce("first", F.when(F.col("n") == 0, "stop")).alias("outcome"), F.when(F.col("n") == 0, "pessimistic").otherwise("tick").alias("resolved_by"))


def r_multiples(trades: DataFrame, commission: float = 0.0) -> DataFrame:
    """Adds r_gross and r_net: result over the distance of entry and stop as they were at the signal, never over the fills'."""
    unit = F.nullif(F.abs(F.col("entry_reference") - F.col("stop_reference")), F.lit(0.0))
    gain = F.when(F.col("side") == "buy", F.col("exit_price") - F.col("entry_price")).otherwise(F.col("entry_price") - F.col("exit_price"))
    return trades.withColumn("r_gross", F.try_divide(gain, unit)).withColumn("r_net", F.col("r_gross") - F.try_divide(F.lit(2 * commission), unit))


def excursions(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """(trade_id, mae_r, mfe_r) over the bars of [entry_ns, exit_ns], on the side that closes the trade."""
    day = 86_400_000_000_000
    o = trades.withColumn("_d", F.explode(F.expr(f"sequence(entry_ns div {day}, exit_ns div {day})")))
    b = bars.select("instrument", "ts_utc_ns", "bid_h", "bid_l", "ask_h", "ask_l").withColumn("_d", F.expr(f"ts_utc_ns div {day}"))
    unit = F.nullif(F.abs(F.col("entry_reference") - F.col("stop_reference")), F.lit(0.0))
    x = o.join(b, ["instrument", "_d"]).where(f"ts_utc_ns >= entry_ns - pmod(entry_ns, {T.MINUTE}) and ts_utc_ns <= exit_ns")
    long = F.col("side") == "buy"
    worst = F.when(long, F.col("bid_l") - F.col("entry_price")).otherwise(F.col("entry_price") - F.col("ask_h"))
    best = F.when(long, F.col("bid_h") - F.col("entry_price")).otherwise(F.col("entry_price") - F.col("ask_l"))
    return x.groupBy("trade_id").agg(F.min(F.try_divide(worst, unit)).alias("mae_r"), F.max(F.try_divide(best, unit)).alias("mfe_r"))
