"""Time as SQL text. An instant is a long: nanoseconds since the epoch, UTC. Sessions must run with time zone UTC.

Every function takes and gives Spark SQL expressions, so that calendar logic stays inside code generation. Offsets come from the JVM's time
zone data; none is written here.
"""

from __future__ import annotations

import importlib.metadata
import zoneinfo
from datetime import UTC, datetime, timedelta, timezone
from pathlib import Path
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NEW_YORK, LONDON, TOKYO = "America/New_York", "Europe/London", "Asia/Tokyo"
MINUTE, HOUR, DAY = 60_000_000_000, 3_600_000_000_000, 86_400_000_000_000


class AmbiguousTimeError(ValueError):
    """A wall-clock time that occurs twice or not at all, under the policy 'raise'."""


def instant(ns: str) -> str:
    """As a timestamp; below a microsecond it is cut toward zero."""
    return f"timestamp_micros(({ns}) div 1000)"


def to_ns(ts: str) -> str:
    return f"(unix_micros({ts}) * 1000)"


def wall(ns: str, zone: str) -> str:
    """The wall clock of a zone, as a timestamp whose fields are the local ones."""
    return f"from_utc_timestamp({instant(ns)}, '{zone}')"


def at_local(day: str, hhmm: str, zone: str) -> str:
    """Instant of a wall-clock time on a day. For times that a clock change touches use resolve_local."""
    hour, minute = map(int, hhmm.split(":"))
    return to_ns(f"to_utc_timestamp(cast({day} as timestamp) + make_interval(0, 0, 0, 0, {hour}, {minute}, 0), '{zone}')")


def trading_day(ns: str) -> str:
    """The day that ends at 17:00 New York: from then on it is the next day's."""
    return f"to_date({wall(ns, NEW_YORK)} + interval 7 hours)"


def day_start(day: str) -> str:
    return at_local(f"date_sub({day}, 1)", "17:00", NEW_YORK)


def day_end(day: str) -> str:
    return at_local(day, "17:00", NEW_YORK)


def trading_week(day: str) -> str:
    """ISO year and week of the week's Wednesday, as yyyy-Www; weekend labels belong to the week after."""
    wednesday = f"date_add({day}, case when weekday({day}) <= 4 then 2 - weekday({day}) else 9 - weekday({day}) end)"
    return f"format_string('%04d-W%02d', extract(yearofweek from {wednesday}), weekofyear({wednesday}))"


def weekend_gap(ns: str) -> str:
    """From Friday 17:00 to Sunday 17:00 in New York."""
    w = wall(ns, NEW_YORK)
    return f"(weekday({w}) = 5 or (weekday({w}) = 4 and hour({w}) >= 17) or (weekday({w}) = 6 and hour({w}) < 17))"


def iso_weekday(ns: str, zone: str = LONDON) -> str:
    return f"(weekday({wall(ns, zone)}) + 1)"


def local_hour(ns: str, zone: str = LONDON) -> str:
    return f"hour({wall(ns, zone)})"


def utc_year(ns: str) -> str:
    return f"year({instant(ns)})"


def month_key(ns: str) -> str:
    return f"date_format({instant(ns)}, 'yyyy-MM')"


def minute_start(ns: str) -> str:
    return f"(({ns}) - pmod({ns}, {MINUTE}))"


def check_utc(spark: SparkSession) -> None:
    if spark.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC"):
        raise ValueError("set spark.sql.session.timeZone to UTC: calendar expressions depend on it")


def transitions(zone: str, first_year: int = 1990, last_year: int = 2040) -> list[tuple[int, int, int]]:
    """(start_ns, end_ns, offset_s): each spell of one offset, at most three a year, found by bisection between days."""
    info = ZoneInfo(zone)

    def offset(second: int) -> int:
        return int(info.utcoffset(datetime.fromtimestamp(second, UTC).astimezone(info)).total_seconds())

    at, stop = int(datetime(first_year, 1, 1, tzinfo=UTC).timestamp()), int(datetime(last_year + 1, 1, 1, tzinfo=UTC).timestamp())
    spells, start, current = [], at, offset(at)
    while at < stop:
        after = at + 86_400
        if offset(after) != current:
            low, high = at, after
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if offset(middle) == current else (low, middle)
            spells.append((start, high, current))
            start, current = high, offset(high)
        at = after
    spells.append((start, stop, current))
    return [(s * 10**9, e * 10**9, o) for s, e, o in spells]


def offset_spells(spark: SparkSession, zones: list[str], first_year: int = 1990, last_year: int = 2040) -> DataFrame:
    """(zone, start_ns, end_ns, offset_s), a few hundred rows."""
    return spark.createDataFrame([(z, *x) for z in zones for x in transitions(z, first_year, last_year)], "zone string, start_ns long, end_ns long, offset_s int")


def resolve_local(df: DataFrame, wall_ns: str, zone: str, out: str, policy: str = "later", first_year: int = 1990, last_year: int = 2040) -> DataFrame:
    """Adds the instant of a wall-clock time (nanoseconds as if the clock were UTC).

    A time that occurs twice is its first or second occurrence (earlier, later). One that never occurs is the first instant after the gap
    (later) or the last nanosecond before it (earlier). Policy 'raise' fails on both. The spells of offsets are literals of the plan.
    """
    if policy not in ("raise", "earlier", "later"):
        raise ValueError(f"unknown policy {policy!r}")
    spells = transitions(zone, first_year, last_year)
    table = F.array(*(F.struct(F.lit(s).alias("s"), F.lit(e).alias("e"), F.lit(o * 10**9).alias("o")) for s, e, o in spells))
    w = F.col(wall_ns)
    fits = F.transform(F.filter(table, lambda x: (w - x["o"] >= x["s"]) & (w - x["o"] < x["e"])), lambda x: w - x["o"])
    # in a gap: between the wall clock at a spell's end and at the next one's start
    gap = F.element_at(F.transform(F.filter(table, lambda x: w - x["o"] >= x["e"]), lambda x: x["e"]), -1)
    if policy == "raise":
        say = F.concat(F.lit(f"not a unique time in {zone}: "), w.cast("string"))
        value = F.when(F.size(fits) == 1, F.get(fits, 0)).otherwise(F.raise_error(say).cast("long"))
    elif policy == "later":
        value = F.when(F.size(fits) > 0, F.array_max(fits)).otherwise(gap)
    else:
        value = F.when(F.size(fits) > 0, F.array_min(fits)).otherwise(gap - 1)
    return df.withColumn(out, F.when(w.isNotNull(), value))


def _fitting(wall_ns: str, zone: str, first_year: int, last_year: int) -> Column:
    """How many instants a wall-clock time has."""
    table = F.array(*(F.struct(F.lit(s).alias("s"), F.lit(e).alias("e"), F.lit(o * 10**9).alias("o")) for s, e, o in transitions(zone, first_year, last_year)))
    w = F.col(wall_ns)
    return F.size(F.filter(table, lambda x: (w - x["o"] >= x["s"]) & (w - x["o"] < x["e"])))


def is_ambiguous(wall_ns: str, zone: str, first_year: int = 1990, last_year: int = 2040) -> Column:
    """Whether a wall-clock time occurs twice."""
    return _fitting(wall_ns, zone, first_year, last_year) > 1


def is_nonexistent(wall_ns: str, zone: str, first_year: int = 1990, last_year: int = 2040) -> Column:
    """Whether a clock change skips a wall-clock time."""
    return _fitting(wall_ns, zone, first_year, last_year) == 0


def tzdata_versions(spark: SparkSession | None = None) -> dict[str, str]:
    """The versions of the zone data in use, for lineage entries: Python's, and the JVM's, which decides in plans."""
    found = {"python": "unknown"}
    try:
        found["python"] = importlib.metadata.version("tzdata")
    except importlib.metadata.PackageNotFoundError:
        for folder in zoneinfo.TZPATH:
            head = Path(folder, "tzdata.zi")
            if head.exists():
                with head.open(encoding="ascii") as f:
                    found["python"] = f.readline().removeprefix("# version").strip() or "unknown"
                break
    if spark is not None:
        found["jvm"] = str(spark._jvm.java.time.zone.ZoneRulesProvider.getVersions("UTC").lastKey())
    return found


def local_to_ns(wall_time: datetime, zone: str, policy: str = "later") -> int:
    """The same for one naive time, on the driver."""
    if wall_time.tzinfo is not None:
        raise ValueError("a wall-clock time has no zone of its own")
    w = int((wall_time.replace(tzinfo=UTC) - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1)) * 1000
    spells = transitions(zone, wall_time.year - 1, wall_time.year + 1)
    fits = [w - o * 10**9 for s, e, o in spells if s <= w - o * 10**9 < e]
    if len(fits) != 1 and policy == "raise":
        raise AmbiguousTimeError(f"{wall_time} in {zone} occurs {len(fits)} times")
    if fits:
        return max(fits) if policy == "later" else min(fits)
    end = [e for s, e, o in spells if w - o * 10**9 >= e][-1]
    return end if policy == "later" else end - 1


def utc_ns(moment: datetime) -> int:
    if moment.tzinfo is None:
        raise ValueError("an instant needs a zone")
    return int((moment - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1)) * 1000
