"""Trading days and session windows as small tables; bars are joined to them by day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import timex as T
from tidemark.plans.config import FX_CORE, ConfigError, Session, SessionSet


def day_spine(rows: DataFrame, ts: str = "ts_utc_ns", keys: tuple[str, ...] = ("instrument",)) -> DataFrame:
    """(keys, day): every calendar day from the first trading day of a key to its last, weekend labels too."""
    ends = rows.groupBy(*keys).agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    return ends.select(*keys, F.explode(F.expr(f"sequence({T.trading_day('lo')}, {T.trading_day('hi')})")).alias("day"))


def days_between(spark, start: str, end: str) -> DataFrame:
    """(day) for the dates from start to end, both included."""
    return spark.sql(f"select explode(sequence(date'{start}', date'{end}')) as day")


def bounds(s: Session, of: SessionSet) -> tuple[str, str]:
    """Start and end of a session as expressions of the column day: no join is needed to know whether a bar is inside."""
    if s.parents:
        parents = [bounds(of[p], of) for p in s.parents]
        start = f"greatest({', '.join(a for a, _ in parents)})"
        return start, f"greatest({start}, least({', '.join(b for _, b in parents)}))"
    return T.at_local("day", s.start, s.zone), T.at_local("day", s.end, s.zone)


def session_windows(days: DataFrame, sessions: SessionSet = FX_CORE, names: list[str] | None = None) -> DataFrame:
    """(days' columns, session, start_ns, end_ns, partial, empty): a row for each day and session.

    partial: the start, the last nanosecond or the middle is in the weekend gap. The boundaries of a session set must not fall on clock
    changes; validate_sessions checks that.
    """
    picked = [s for s in sessions.sessions if names is None or s.name in names]
    if names and {s.name for s in picked} != set(names):
        raise ConfigError(f"unknown sessions among {names}")
    parts = F.array(*(F.struct(F.lit(s.name).alias("session"), F.expr(a).alias("start_ns"), F.expr(b).alias("end_ns")) for s in picked for a, b in [bounds(s, sessions)]))
    return flagged(days.withColumn("w", F.explode(parts)).select(*days.columns, "w.*"))


def flagged(windows: DataFrame) -> DataFrame:
    gap = " or ".join(T.weekend_gap(x) for x in ("start_ns", "(end_ns - 1)", "(start_ns + (end_ns - start_ns) div 2)"))
    return windows.withColumn("empty", F.col("start_ns") >= F.col("end_ns")).withColumn("partial", F.expr(f"not empty and ({gap})"))


def membership(rows: DataFrame, windows: DataFrame, ts: str = "ts_utc_ns", id_cols: list[str] | None = None) -> DataFrame:
    """Adds sessions, the sorted names of all windows of a row's trading day that hold it. windows has one row for each day and session."""
    by_day = windows.groupBy("day").agg(F.collect_list(F.struct("session", "start_ns", "end_ns")).alias("_w"))
    inside = F.filter("_w", lambda w: (F.col(ts) >= w["start_ns"]) & (F.col(ts) < w["end_ns"]))
    joined = rows.withColumn("day", F.expr(T.trading_day(ts))).join(by_day, "day", "left")
    return joined.withColumn("sessions", F.array_sort(F.transform(F.coalesce(inside, F.array()), lambda w: w["session"])).cast("array<string>")).drop("_w")


def validate_sessions(spark, sessions: SessionSet = FX_CORE, start: str = "2007-01-01", end: str = "2026-12-31") -> DataFrame:
    """(day, session, reason) of the windows that are not inside their trading day, or whose boundary a clock change touches; none is good."""
    w = session_windows(days_between(spark, start, end), sessions).where("not empty")
    outside = w.where(F.expr(f"start_ns < {T.day_start('day')} or end_ns > {T.day_end('day')}")).withColumn("reason", F.lit("outside its trading day"))
    zones = {s.name: s for s in sessions.sessions if not s.parents}
    touched = None
    for name, s in zones.items():
        one = w.where(F.col("session") == name)
        for edge, hhmm in (("start_ns", s.start), ("end_ns", s.end)):
            off = one.where(F.expr(f"date_format({T.wall(edge, s.zone)}, 'HH:mm') <> '{hhmm}'")).withColumn("reason", F.lit(f"{edge} is not {hhmm} local"))
            touched = off if touched is None else touched.unionByName(off)
    return (outside if touched is None else outside.unionByName(touched)).select("day", "session", "reason")
