"""Lookahead-free features of bars, and the registry that computes them.

Session values are kept at day level: one row for each instrument, trading day and session. A bar sees the last session that is over: its own
day's if the bar is at or after the window's end, else that of the day before, filled forward over days without bars. A range is high less low
of one day, and is made visible once.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from tidemark.functions import timex as T
from tidemark.operators.sequence import SPAN, carry, numbered, trailing
from tidemark.operators.sessions import bounds, flagged
from tidemark.plans.config import FX_CORE, SessionSet

KEY = ["instrument"]


def _backwards(keys: list[str], *order: Column) -> WindowSpec:
    """The rows after a row, the nearest last: a running frame, which Spark carries on from row to row, where one that ends at the partition's end is walked anew for each."""
    return W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)


def _later_days() -> WindowSpec:
    return _backwards(["instrument", "session"], F.desc("day"))




def with_mid(bars: DataFrame) -> DataFrame:
    return bars.withColumn("mid", (F.col("bid_c") + F.col("ask_c")) / 2)


def with_day(bars: DataFrame) -> DataFrame:
    return bars.withColumn("day", F.expr(T.trading_day("ts_utc_ns")))


def _rows(bars: DataFrame) -> DataFrame:
    return bars if "rn" in bars.columns else numbered(bars, KEY)


def log_returns(bars: DataFrame, out: str = "ret") -> DataFrame:
    """ln(mid / previous mid); null on the first bar."""
    return trailing(_rows(with_mid(bars)), KEY, 1, lambda w: {out: F.log("mid") - F.log(F.lag("mid").over(w))})


def true_range(bars: DataFrame, out: str = "tr") -> DataFrame:
    """Of the bid: the largest of high less low and both distances to the previous close; high less low on the first bar."""
    return trailing(_rows(bars), KEY, 1, lambda w: {out: F.greatest(F.col("bid_h") - F.col("bid_l"), F.abs(F.col("bid_h") - F.lag("bid_c").over(w)), F.abs(F.col("bid_l") - F.lag("bid_c").over(w)))})


def wilder_atr(bars: DataFrame, n: int = 1440, out: str = "atr_bars", width_ns: int = T.MINUTE) -> DataFrame:
    """Wilder's average true range over present bars: the mean of the first n at row n - 1, then ((n - 1) previous + TR) / n. Adds rn too.

    The seed needs no pass of its own: the first n inputs are weighted up by what the recurrence will have taken off them at row n - 1. Series are cut into spans of
    time, short enough for the running sum of x / a**k to stay far from overflow; one row for each span carries its count and last close to the next, and one
    the recurrence, so bars are shuffled once. width_ns: the least time between two bars.
    """
    if n == 1:
        return true_range(bars, out)
    a = (n - 1) / n
    span = min(SPAN, max(1, int(280 / -math.log(a))) * width_ns)
    cut = bars.drop("rn").withColumn("_span", F.expr(f"ts_utc_ns - pmod(ts_utc_ns, {span})"))
    spans = W.partitionBy(*KEY).orderBy("_span")
    ends = cut.groupBy(*KEY, "_span").agg(F.count(F.lit(1)).alias("_n"), F.max_by("bid_c", "ts_utc_ns").alias("_last"))
    before = ends.select(*KEY, "_span", F.coalesce(F.sum("_n").over(spans.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.lag("_last").over(spans).alias("_close"))
    w = W.partitionBy(*KEY, "_span").orderBy("ts_utc_ns")
    rows = cut.join(before, [*KEY, "_span"]).withColumns({"_k": F.row_number().over(w) - 1, "_prev": F.coalesce(F.lag("bid_c").over(w), F.col("_close"))})
    rows = rows.withColumn("rn", F.col("_before") + F.col("_k"))
    tr = F.greatest(F.col("bid_h") - F.col("bid_l"), F.abs(F.col("bid_h") - F.col("_prev")), F.abs(F.col("bid_l") - F.col("_prev")))
    weight = F.when(F.col("rn") < n, F.pow(F.lit(a), F.col("rn") - (n - 1))).otherwise(1.0)
    local = rows.withColumn("_x", tr / n * weight).withColumn("_local", F.pow(F.lit(a), F.col("_k")) * F.sum(F.col("_x") * F.pow(F.lit(a), -F.col("_k"))).over(w))
    local = local.drop("_before", "_close", "_prev", "_x")
    carried = carry(local.groupBy(*KEY, "_span").agg(F.max_by("_local", "_k").alias("_end"), F.count(F.lit(1)).alias("_len")), KEY, "_span", a)
    value = F.col("_local") + F.col("_carry") * F.pow(F.lit(a), F.col("_k") + 1)
    return local.join(carried, [*KEY, "_span"]).withColumn(out, F.when(F.col("rn") >= n - 1, value)).drop("_span", "_k", "_local", "_carry")


def realised_volatility(bars: DataFrame, n: int = 60, gap_ns: int = 5 * T.MINUTE, out: str = "rv_60m") -> DataFrame:
    """Root of the sum of squared returns of the last n bars, from bar n on; null if one of them follows a gap longer than gap_ns. No known
    gap is no gap."""

    def make(w):
        last = w.rowsBetween(-(n - 1), 0)
        return {out: F.when((F.col("rn") >= n) & ~(F.coalesce(F.max("prev_gap_ns").over(last), F.lit(0)) > gap_ns), F.sqrt(F.sum(F.col("_ret") * F.col("_ret")).over(last)))}

    return trailing(log_returns(bars, "_ret"), KEY, n, make).drop("_ret", "mid")


def trailing_range(bars: DataFrame, n: int = 60, out: str = "range_60m") -> DataFrame:
    """Highest less lowest mid of the last n bars; null until there are n."""

    def make(w):
        last = w.rowsBetween(-(n - 1), 0)
        return {out: F.when(F.count("mid").over(last) == n, F.max("mid").over(last) - F.min("mid").over(last))}

    return trailing(_rows(with_mid(bars)), KEY, n, make)


def _first_value(column: str, when: Column | None = None) -> Column:
    """An aggregate: a double column's value in the first bar (of those that pass); NaN if it is null there, null if there is no bar. A struct would tell the two apart as well, but
    is nothing that a hash aggregation can hold."""
    at = F.col("ts_utc_ns") if when is None else F.when(when, F.col("ts_utc_ns"))
    return F.min_by(F.coalesce(F.col(column), F.lit(float("nan"))), at)


def _known(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def session_days(bars: DataFrame, sessions: SessionSet = FX_CORE, names: list[str] | None = None, anchor: tuple[str, str] | None = None) -> DataFrame:
    """(instrument, day, session, start_ns, end_ns, partial, high, low, range, n_bars, observed) for every day and session; without bars in the
    window the values are null. observed: the instrument has a bar at or after the window's end. anchor, (column of the bars, new name): adds what anchored does, in
    the same aggregation."""
    picked = [x for x in sessions.sessions if names is None or x.name in names]
    edges = {x.name: bounds(x, sessions) for x in picked}
    inside = {n: F.expr(f"ts_utc_ns >= {lo} and ts_utc_ns < {hi}") for n, (lo, hi) in edges.items()}
    # one aggregation by day for all sessions: the windows are expressions of the day
    stats = [f.alias(f"_{n}_{c}") for n, i in inside.items() for c, f in (("high", F.max(F.when(i, F.col("mid")))), ("low", F.min(F.when(i, F.col("mid")))), ("n_bars", F.count_if(i)))]
    extra = [] if anchor is None else [_first_value(anchor[0]).alias("_first"), *(_first_value(anchor[0], F.expr(f"ts_utc_ns >= {hi}")).alias(f"_{n}_at") for n, (_, hi) in edges.items())]
    by_day = with_day(with_mid(bars)).groupBy("instrument", "day").agg(*stats, *extra, F.min("ts_utc_ns").alias("_lo"), F.max("ts_utc_ns").alias("_hi"))
    # each day also stands for the days without bars until the next one, whose statistics are null
    w = W.partitionBy("instrument")
    filled = by_day.withColumns({"_last": F.max("_hi").over(w), "_next": F.lead("day").over(w.orderBy("day"))}).withColumn("_day", F.explode(F.expr("sequence(day, coalesce(date_sub(_next, 1), day))")))
    own = [c for c in by_day.columns if c not in ("instrument", "day")]
    spine = filled.select("instrument", "_last", F.col("_day").alias("day"), *(F.when(F.col("_day") == F.col("day"), F.col(c)).alias(c) for c in own))
    parts = F.array(*(F.struct(F.lit(n).alias("session"), F.expr(lo).alias("start_ns"), F.expr(hi).alias("end_ns"), *(F.col(f"_{n}_{c}").alias(c) for c in ("high", "low", "n_bars", *(["at"] if anchor else [])))) for n, (lo, hi) in edges.items()))
    kept = ["instrument", "day", "_last", *(["_first"] if anchor else [])]
    full = flagged(spine.select(*kept, F.explode(parts).alias("w")).select(*kept, "w.*"))
    full = full.withColumn("range", F.col("high") - F.col("low")).withColumn("n_bars", F.coalesce("n_bars", F.lit(0))).withColumn("observed", F.col("_last") >= F.col("end_ns"))
    if anchor:
        full = full.withColumn(anchor[1], F.when(F.col("n_bars") > 0, _known(F.coalesce("at", F.last("_first", True).over(_later_days()))))).drop("_first", "at")
    return full.drop("_last", "empty")


def range_percentile(days: DataFrame, n: int = 60) -> DataFrame:
    """Adds pct: the share of the n eligible days before whose range is smaller; null with fewer. Eligible: bars of its own, and over."""
    eligible = (F.col("n_bars") > 0) & F.col("observed")
    w = W.partitionBy("instrument", "session", "_eligible").orderBy("day")
    ranked = days.withColumn("_eligible", eligible).withColumn("_before", F.collect_list("range").over(w.rowsBetween(-n, -1)))
    pct = F.when(F.col("_eligible") & (F.size("_before") == n), F.size(F.filter("_before", lambda x: x < F.col("range"))) / F.lit(n))
    return ranked.withColumn("pct", pct).drop("_eligible", "_before")


def visible(bars: DataFrame, days: DataFrame, columns: list[tuple[str, str, str]]) -> DataFrame:
    """Adds day values to the bars that may see them: (session, column of days, new name). One row for each instrument and day says what
    its bars see before each window's end and from then on, so that all values take one join."""
    names = sorted({s for s, _, _ in columns})
    of = lambda s, c: F.max(F.when(F.col("session") == s, F.col(c)))
    one = days.where(F.col("session").isin(names)).groupBy("instrument", "day").agg(*(of(s, c).alias(new) for s, c, new in columns), *(of(s, "end_ns").alias(f"_end_{s}") for s in names))
    w = W.partitionBy("instrument").orderBy("day")
    filled = one.withColumns({new: F.last(new, True).over(w) for _, _, new in columns})
    both = filled.withColumns({new: F.struct(F.lag(new).over(w).alias("before"), F.col(new).alias("after")) for _, _, new in columns})
    joined = with_day(bars).join(both, ["instrument", "day"], "left")
    seen = {new: F.when(F.col("ts_utc_ns") >= F.col(f"_end_{s}"), F.col(new)["after"]).otherwise(F.col(new)["before"]) for s, _, new in columns}
    return joined.withColumns(seen).drop(*(f"_end_{s}" for s in names), *(["day"] if "day" not in bars.columns else []))


def anchored(days: DataFrame, rows: DataFrame, column: str, out: str, names: list[str], sessions: SessionSet = FX_CORE) -> DataFrame:
    """Adds to each day and session (of names) the value of a bar column at the first bar at or after the window's end, of that day or a later one; null
    for days without bars in the window. Works by day, in one aggregation: the first bar after each end on the day itself, else the first bar of the next
    day that has any."""
    ends = [_first_value(column, F.expr(f"ts_utc_ns >= {bounds(sessions[n], sessions)[1]}")).alias(f"_{n}") for n in names]
    by_day = with_day(rows).groupBy("instrument", "day").agg(_first_value(column).alias("_first"), *ends)
    full = days.join(by_day, ["instrument", "day"], "left").withColumn("_next", F.last("_first", True).over(_later_days()))
    own = F.coalesce(*(F.when(F.col("session") == n, F.col(f"_{n}")) for n in names))
    return full.withColumn(out, F.when(F.col("n_bars") > 0, _known(F.coalesce(own, F.col("_next"))))).drop("_first", "_next", *(f"_{n}" for n in names))


def first_at_or_after(left: DataFrame, at: str, right: DataFrame, when: str, keys: list[str], out: str, span: int = T.DAY) -> DataFrame:
    """As-of forward: adds the first time of right (column when) that is no earlier than left's, within keys; null if there is none.

    Both sides are cut by spans of time. Within a span one sort, latest first, and the last time of right seen so far; a row for each span with a time of right
    carries the first of the spans after it. No task has more than a span of a key, and no row is compared with more than its neighbours.
    """
    names, right = left.columns, right.where(F.col(when).isNotNull())
    cut = F.expr(f"_at - pmod(_at, {span})")
    rows = left.withColumns({"_at": F.col(at), "_right": F.lit(0)}).unionByName(right.select(*keys, F.col(when).alias("_at"), F.lit(1).alias("_right")), allowMissingColumns=True).withColumn("_span", cut)
    spans = rows.groupBy(*keys, "_span").agg(F.min(F.when(F.col("_right") == 1, F.col("_at"))).alias("_first"))
    carried = spans.withColumn("_next", F.last("_first", True).over(_backwards(keys, F.desc("_span")))).select(*(F.col(k).alias(f"_key_{k}") for k in keys), F.col("_span").alias("_of"), "_next")
    # a time of right equal to left's counts: it comes before it, latest first
    seen = rows.withColumn("_own", F.last(F.when(F.col("_right") == 1, F.col("_at")), True).over(_backwards([*keys, "_span"], F.desc("_at"), F.desc("_right")))).where("_right = 0")
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    return seen.join(carried, [*same, F.col("_span").eqNullSafe(F.col("_of"))], "left").withColumn(out, F.coalesce("_own", "_next")).select(*names, out)


class FeatureError(ValueError):
    """A feature that is unknown, defined twice or depends on itself."""


@dataclass(frozen=True)
class Feature:
    """compute(bars, sessions, params) returns the bars with the column ``name``; requires: features that are there before. day_value: instead, the
    session and the column of session_days whose visible value it is."""

    name: str
    compute: Callable[[DataFrame, SessionSet, dict], DataFrame] | None = None
    requires: tuple[str, ...] = ()
    params: dict = field(default_factory=dict)
    version: int = 1
    lookback: tuple[str, int] = ("bars", 0)
    leakage: str = "causal"
    day_value: tuple[str, str] | None = None


REGISTRY: dict[str, Feature] = {}


def register(feature: Feature) -> Feature:
    if feature.name in REGISTRY:
        raise FeatureError(f"{feature.name} is registered already")
    for r in feature.requires:
        if r not in REGISTRY:
            raise FeatureError(f"{feature.name} requires {r}, which is not registered")
    REGISTRY[feature.name] = feature
    return feature


def resolve(names: list[str]) -> list[str]:
    """The features asked for and what they require, each after its requirements."""
    order: list[str] = []
    open_: set[str] = set()

    def visit(name: str) -> None:
        if name in order:
            return
        if name not in REGISTRY:
            raise FeatureError(f"unknown feature {name}")
        if name in open_:
            raise FeatureError(f"{name} requires itself")
        open_.add(name)
        for r in REGISTRY[name].requires:
            visit(r)
        open_.discard(name)
        order.append(name)

    for n in names:
        visit(n)
    return order


def compute(names: list[str], bars: DataFrame, sessions: SessionSet = FX_CORE, params: dict[str, dict] | None = None) -> DataFrame:
    """(instrument, ts_utc_ns, one double column for each name asked for) for every bar."""
    order = [REGISTRY[n] for n in resolve(names)]
    given = {f.name: f.params | (params or {}).get(f.name, {}) for f in order}
    daily, rows = [f for f in order if f.day_value], bars
    if daily:  # one table of session days for all of them
        days = session_days(bars, sessions, sorted({f.day_value[0] for f in daily}))
        for f in daily:
            if f.day_value[1] == "pct":
                days = range_percentile(days, given[f.name]["n"])
        rows = visible(rows, days, [(*f.day_value, f.name) for f in daily])
    for f in order:
        if not f.day_value:
            rows = f.compute(rows, sessions, given[f.name])
    return rows.select("instrument", "ts_utc_ns", *(F.col(n).cast("double").alias(n) for n in names))


def null_counts(features: DataFrame) -> DataFrame:
    """(feature, n_null)."""
    names = [c for c in features.columns if c not in ("instrument", "ts_utc_ns", "year", "month")]
    counts = features.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in names))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("n_null")) for c in names))).alias("x")).select("x.*")


register(Feature("atr_bars", lambda b, s, p: wilder_atr(b, p["n"]), params={"n": 1440}, lookback=("bars", 1440)))
register(Feature("rv_60m", lambda b, s, p: realised_volatility(b, p["n"], p["gap_ns"]), params={"n": 60, "gap_ns": 5 * T.MINUTE}, lookback=("bars", 60)))
for _s in ("pre_london", "london", "new_york"):
    for _c in ("high", "low", "range"):
        register(Feature(f"{_s}_{_c}", lookback=("days", 1), leakage="session_terminal", day_value=(_s, _c)))
register(Feature("pre_london_range_pct", params={"n": 60}, lookback=("days", 60), leakage="session_terminal", day_value=("pre_london", "pct")))
