"""Strategies as a function that looks at one bar: scan(ctx) returns a candidate or None.

A day of an instrument is a group. The function sees its bars and features up to the current one and nothing after; what it may know of earlier days comes as columns that the bars
carry in (visible session values, yesterday's range). It is called twice for each bar, and both answers must agree: it keeps no state. ``replay`` proves the columns
too: signals up to an instant must be the same when every later bar is cut off before anything is computed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import date
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import timex as T
from tidemark.operators.features import with_day

LONG, SHORT = "long", "short"
CANDIDATES = "instrument string, day date, ts_utc_ns long, direction string, entry_reference double, stop_reference double, levels map<string,double>, tags map<string,string>, note string"


class LookaheadError(IndexError):
    """A look at a bar after the current one."""


class PurityError(RuntimeError):
    """Two calls with the same context that disagree."""


@dataclass(frozen=True)
class Candidate:
    direction: str
    entry_reference: float
    stop_reference: float
    levels: Mapping[str, float] = field(default_factory=dict)
    tags: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if self.direction not in (LONG, SHORT):
            raise ValueError(f"a direction is {LONG} or {SHORT}, not {self.direction}")
        if not all(math.isfinite(x) for x in (self.entry_reference, self.stop_reference)):
            raise ValueError("references must be finite")


class View:
    """Columns of a day up to a bar. view[name] is a read-only array that ends there; view.at(name, k) one value, of any earlier bar."""

    def __init__(self, columns: dict[str, np.ndarray], last: int):
        self._columns, self.last = columns, last

    def __getitem__(self, name: str) -> np.ndarray:
        return self._columns[name][: self.last + 1]

    def at(self, name: str, k: int) -> float:
        if not 0 <= k <= self.last:
            raise LookaheadError(f"bar {k} of {self.last + 1} that can be seen")
        return self._columns[name][k]


@dataclass(frozen=True)
class ScanContext:
    """i: the bar's number in its day. notes: what note() has gathered for the candidate of this call."""

    i: int
    ts_utc_ns: int
    instrument: str
    day: date
    bars: View
    features: View
    params: Mapping[str, float]
    notes: list[str] = field(default_factory=list)

    def note(self, text: str) -> None:
        self.notes.append(text)


ScanFn = Callable[[ScanContext], Candidate | None]


def scan_days(rows: DataFrame, scan: ScanFn, params: Mapping[str, float] | None = None, bars: tuple[str, ...] = ("bid_c", "ask_c", "mid"), features: tuple[str, ...] = ()) -> DataFrame:
    """CANDIDATES of bars (instrument, ts_utc_ns, the named columns of bars and features). A day has at most as many rows as minutes; an exception of scan ends the job."""
    given = dict(params or {})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts_utc_ns")
        columns = {c: pdf[c].to_numpy() for c in ("ts_utc_ns", *bars, *features)}
        for x in columns.values():
            x.setflags(write=False)
        own, seen = {c: columns[c] for c in ("ts_utc_ns", *bars)}, {c: columns[c] for c in features}
        instrument, day = pdf["instrument"].iloc[0], pdf["day"].iloc[0]
        out = []
        for i, ts in enumerate(columns["ts_utc_ns"].tolist()):
            first, again = (ScanContext(i, ts, instrument, day, View(own, i), View(seen, i), dict(given)) for _ in range(2))
            found = scan(first)
            if scan(again) != found or first.notes != again.notes:
                raise PurityError(f"two calls for {instrument} at {ts} disagree")
            if found is not None:
                out.append((instrument, day, ts, found.direction, found.entry_reference, found.stop_reference, dict(found.levels), dict(found.tags), "; ".join(first.notes)))
        return pd.DataFrame(out, columns=[c.split()[0] for c in CANDIDATES.split(", ")])

    return with_day(rows).select("instrument", "day", "ts_utc_ns", *bars, *features).groupBy("instrument", "day").applyInPandas(run, CANDIDATES)


def replay(bars: DataFrame, prepare: Callable[[DataFrame], DataFrame], signals: Callable[[DataFrame], DataFrame], cuts: list[int]) -> DataFrame:
    """(cut_ns, instrument, ts_utc_ns, direction, entry_reference, stop_reference, seen): signals before a cut that differ if the bars from the cut on were never there. seen: with all
    bars, or without the later ones. prepare: bars to the rows that signals reads, with everything computed from bars. Few cuts: each is a run of its own over what lies before it."""
    kept = ["instrument", "ts_utc_ns", "direction", "entry_reference", "stop_reference"]
    whole = signals(prepare(bars)).select(*kept)

    def differences(cut: int) -> DataFrame:
        with_all, without = whole.where(F.col("ts_utc_ns") < cut), signals(prepare(bars.where(F.col("ts_utc_ns") < cut))).select(*kept)
        one = with_all.exceptAll(without).withColumn("seen", F.lit("all bars"))
        return one.unionByName(without.exceptAll(with_all).withColumn("seen", F.lit("earlier bars"))).select(F.lit(cut).cast("long").alias("cut_ns"), "*")

    return reduce(DataFrame.unionByName, map(differences, cuts))


def refuse_leaks(bars: DataFrame, prepare: Callable[[DataFrame], DataFrame], signals: Callable[[DataFrame], DataFrame], cuts: list[int]) -> None:
    """LookaheadError if a signal depends on later bars."""
    if leak := replay(bars, prepare, signals, cuts).first():
        raise LookaheadError(f"a signal of {leak['instrument']} at {leak['ts_utc_ns']} depends on bars from {leak['cut_ns']} on")


def cut_points(bars: DataFrame, n: int = 3) -> list[int]:
    """n instants, a little after evenly spaced ones of the bars' time, for replay."""
    low, high = bars.agg(F.min("ts_utc_ns"), F.max("ts_utc_ns")).first()
    return [] if low is None else [low + (high - low) * (k + 1) // (n + 1) + T.MINUTE for k in range(n)]


def break_of_day(ctx: ScanContext) -> Candidate | None:
    """The day's highest or lowest mid so far, passed by a buffer: long above, short below, with the other end of the day's range as the stop. Wants a range of so many
    bars, and one that isn't wider than the day before's, which the bars carry in as a feature."""
    if ctx.i < ctx.params["least_bars"]:
        return None
    before, mid = ctx.bars["mid"][:-1], ctx.bars.at("mid", ctx.i)
    high, low = float(before.max()), float(before.min())
    allowed = ctx.features.at("prev_range", ctx.i)
    if not high - low <= allowed:
        return None
    if mid > high + ctx.params["buffer"]:
        ctx.note("above")
        return Candidate(LONG, float(ctx.bars.at("ask_c", ctx.i)), low, {"broken": high})
    if mid < low - ctx.params["buffer"]:
        ctx.note("below")
        return Candidate(SHORT, float(ctx.bars.at("bid_c", ctx.i)), high, {"broken": low})
    return None

