"""Month files of quote ticks (headerless CSV, binary hours) to UTC ticks.

A month's file is the unit: which column is the bid, and which daylight-saving calendar its stamps follow, is read from the file as a whole, and the
hour that an autumn change repeats is told apart by file position alone. A month has about a million rows, so one task may take one file (Spark's
binaryFile keeps it whole) and its work is arrays. Files that are larger come in pieces, and what is read from a file as a whole is put together from its pieces.

Stamps follow New York's clock (us_dst), or a clock of New York's winter and summer hours that changes when London does, at 00:00 UTC of the Monday after (eu_dst).
"""

from __future__ import annotations

import lzma
import pickle
import re
import zipfile
from calendar import monthrange
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta, timezone
from pathlib import Path
from typing import NamedTuple
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import timex as T
from tidemark.functions.timex import DAY, HOUR, LONDON, NEW_YORK, transitions
from tidemark.sources.ticks import TICKS, IntegrityError

# Names and lines of the source's files.
CSV_NAME = re.compile(r"DAT_ASCII_(?P<instrument>[A-Z]{6})_T_(?P<year>\d{4})(?P<month>\d{2})\.csv$")
ZIP_NAME = re.compile(r"HISTDATA_COM_ASCII_(?P<instrument>[A-Z]{6})_T(?P<year>\d{4})(?P<month>\d{2})\.zip$")
STAMP = r"\d{8} \d{9}"
GAP_LINE = r"Gap of \d+s found between"

# Shares of rows that decide the column order; hours without ticks that make a weekend; how near a clock change must be.
LOW, HIGH = 0.01, 0.99
WEEKEND_NS, MOST_WEEKENDS = 40 * HOUR, 6
NEAR_NS = 300 * 10**9
FEW_INSIDE = 10
MILLISECOND = 10**6
FAR = 2**62

SLICE = 1000  # bytes of a piece in one row; workers get batches of 10,000 rows


class LineError(IntegrityError):
    """Of a line, counted from 0."""

    def __init__(self, line: int, what: str):
        super().__init__(what)
        self.line = line


class Day(NamedTuple):
    """Of lines of one day: how many there are, in how many the first price is larger; the first line in which it is, and in which the second is."""

    day: int
    n: int
    more: int
    first_more: int | None
    first_less: int | None


@dataclass
class Stamps:
    """What consecutive stamps tell of their clock. back: steps down, and the first one's line and ends; wide: steps of weekend length, and the ends of
    as many as a month may have and one more; inside, below, below_last, above_first: those in the hour that eu_dst skips in spring, and those around its end."""

    n: int
    first: int
    last: int
    back: int = 0
    back_at: int = 0
    back_from: int = 0
    back_to: int = 0
    wide: int = 0
    wides: list[tuple[int, int]] = field(default_factory=list)
    inside: int = 0
    below: int = 0
    below_last: int = -FAR
    above_first: int = FAR
    days: list[int] = field(default_factory=list)


class Summary(NamedTuple):
    """Of some consecutive lines: their days and stamps, blank lines at the end, and the first line that is no tick."""

    days: list[Day] = []
    stamps: Stamps | None = None
    blank: int = 0
    wrong: tuple[int, str] | None = None


def _offset(day: date, zone: str) -> int:
    return int(datetime(day.year, day.month, day.day, 12, tzinfo=ZoneInfo(zone)).utcoffset().total_seconds()) * 10**9


def eu_offset(day: date) -> int:
    """Of the eu_dst clock at noon: London's, five hours on."""
    return _offset(day, LONDON) - 5 * HOUR


def divergent(day: date) -> bool:
    """Whether the two clocks read differently on this date."""
    return _offset(day, NEW_YORK) != eu_offset(day)


def clocks_differ(day: str = "day") -> Column:
    """Whether New York and London are not five hours apart at noon of a date."""
    noon = f"cast({day} as timestamp) + interval 12 hours"
    off = lambda zone: f"unix_seconds(cast({day} as timestamp)) + 43200 - unix_seconds(to_utc_timestamp({noon}, '{zone}'))"
    return F.expr(f"{off(NEW_YORK)} <> {off(LONDON)} - 18000")


def divergent_dates(spark: SparkSession, start: str, end: str) -> DataFrame:
    """(day) of all dates on which the clocks differ."""
    return spark.sql(f"select explode(sequence(date'{start}', date'{end}')) as day").where(clocks_differ())


def eu_switches(year: int) -> tuple[int, int]:
    """Instants of the eu_dst clock's spring and autumn changes: 00:00 UTC of the Mondays after London's."""
    out = []
    for start, _, _ in transitions(LONDON, year, year)[1:]:
        sunday = (datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=start // 1000)).date()
        monday = sunday + timedelta(days=1)
        out.append(int((datetime(monday.year, monday.month, monday.day) - datetime(1970, 1, 1)).total_seconds()) * 10**9)
    if len(out) != 2:
        raise IntegrityError(f"London has {len(out)} clock changes in {year}")
    return out[0], out[1]


def switches_of(years: DataFrame) -> DataFrame:
    """(year, spring_ns, autumn_ns) of distinct years (year long)."""

    def run(batches):
        for rows in batches:
            found = [eu_switches(int(y)) for y in rows["year"]]
            yield rows.assign(spring_ns=[a for a, _ in found], autumn_ns=[b for _, b in found])

    return years.mapInPandas(run, "year long, spring_ns long, autumn_ns long")


def switch_stamps(year: int, month: int) -> list[tuple[str, int, int]]:
    """(kind, stamp before, stamp after) of the eu_dst changes whose stamp before is in the month."""
    found = []
    for kind, at, before, after in zip(("spring", "autumn"), eu_switches(year), (-5, -4), (-4, -5)):
        stamp = _date(at + before * HOUR)
        if (stamp.year, stamp.month) == (year, month):
            found.append((kind, at + before * HOUR, at + after * HOUR))
    return found


def _date(ns: int) -> date:
    return (datetime(1970, 1, 1) + timedelta(microseconds=int(ns) // 1000)).date()


def column_order(a: np.ndarray, b: np.ndarray) -> str | None:
    """bid_ask or ask_bid by the share of rows in which the first is larger; None in between."""
    if not len(a):
        raise IntegrityError("no rows")
    return _order_of(int((a > b).sum()), len(a))


def _order_of(more: int, n: int) -> str | None:
    return "bid_ask" if more / n <= LOW else "ask_bid" if more / n >= HIGH else None


def column_orders(rows: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys, n, share, column_order) by the share of rows in which the first price is larger; a null order in between."""
    g = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(a) > F.col(b)).cast("int")).alias("share"))
    return g.withColumn("column_order", F.when(F.col("share") <= LOW, "bid_ask").when(F.col("share") >= HIGH, "ask_bid"))


def swapped_days(days: list[Day]) -> tuple[list[int], str]:
    """The days whose columns are ask and bid, and how that was told: for the file, or else by day with one change over a weekend."""
    whole = _order_of(sum(d.more for d in days), sum(d.n for d in days))
    if whole:
        return [d.day for d in days] if whole == "ask_bid" else [], f"whole file: {whole}"
    orders = [_order_of(d.more, d.n) for d in days]
    if None in orders:
        raise IntegrityError(f"{_date(days[orders.index(None)].day * DAY)}: column order is inconsistent within the day")
    changes = [k for k in range(1, len(days)) if orders[k] != orders[k - 1]]
    if len(changes) != 1:
        raise IntegrityError(f"column order changes {len(changes)} times within the month")
    before, after = (_date(days[changes[0] + j].day * DAY) for j in (-1, 0))
    if not (before.weekday() == 4 and after.weekday() in (5, 6, 0) and (after - before).days <= 3):
        raise IntegrityError(f"column order changes between {before} and {after}, which is no weekend")
    return [d.day for d, o in zip(days, orders) if o == "ask_bid"], f"by day, changing over the weekend of {before}"


def stamp_clock(stamps: np.ndarray, year: int, month: int) -> tuple[str | None, str]:
    """us_dst or eu_dst, and the evidence; None if the file has no tick on a date on which they differ."""
    return _clock(_stamps(stamps, year, month), year, month)


def _stamps(stamps: np.ndarray, year: int, month: int) -> Stamps:
    steps = np.diff(stamps)
    back, wide = np.flatnonzero(steps < 0), np.flatnonzero(steps >= WEEKEND_NS)
    s = Stamps(len(stamps), int(stamps[0]), int(stamps[-1]), len(back), days=np.unique(stamps // DAY).tolist())
    if len(back):
        s.back_at, s.back_from, s.back_to = int(back[0]), int(stamps[back[0]]), int(stamps[back[0] + 1])
    s.wide, s.wides = len(wide), [(int(stamps[k]), int(stamps[k + 1])) for k in wide[: MOST_WEEKENDS + 1].tolist()]
    for kind, before, after in switch_stamps(year, month):
        if kind == "spring":
            below = stamps < after
            s.inside = int(((stamps > before + NEAR_NS) & (stamps < after - NEAR_NS)).sum())
            s.below, s.below_last, s.above_first = int(below.sum()), int(stamps[below].max(initial=-FAR)), int(stamps[~below].min(initial=FAR))
    return s


def _joined(s: Stamps, t: Stamps) -> Stamps:
    """Of the stamps of s and, after them, those of t."""
    step = (s.last, t.first)
    downs = [x for x in ((s.back_at, s.back_from, s.back_to) if s.back else None, (s.n - 1, *step) if t.first < s.last else None, (s.n + t.back_at, t.back_from, t.back_to) if t.back else None) if x]
    far = t.first - s.last >= WEEKEND_NS
    out = Stamps(s.n + t.n, s.first, t.last, s.back + t.back + (t.first < s.last), *(downs[0] if downs else ()))
    out.wide, out.wides = s.wide + far + t.wide, [*s.wides, *([step] if far else []), *t.wides][: MOST_WEEKENDS + 1]
    out.inside, out.below, out.below_last, out.above_first = s.inside + t.inside, s.below + t.below, max(s.below_last, t.below_last), min(s.above_first, t.above_first)
    out.days = sorted({*s.days, *t.days})
    return out


def _clock(s: Stamps, year: int, month: int) -> tuple[str | None, str]:
    seen: dict[str, list[str]] = {"us_dst": [], "eu_dst": []}
    for kind, before, after in switch_stamps(year, month):
        low, high = sorted((before, after))
        if s.n < 2 or not (s.first < low and s.last > high):
            continue
        if kind == "spring":
            seen["us_dst" if s.inside >= FEW_INSIDE else "eu_dst"].append(f"{s.inside} ticks in the hour that eu_dst skips")
        elif not s.back:
            seen["us_dst"].append("no step back at the autumn change of eu_dst")
        elif s.back == 1 and _near_step(s.back_from, s.back_to, before, after):
            seen["eu_dst"].append("the step back of the autumn change")
    if s.wide > MOST_WEEKENDS:
        raise IntegrityError(f"{s.wide} gaps of weekend length in one month")
    for friday, sunday in s.wides:
        for ns, weekday, hours in ((friday, 4, {16: "us_dst", 15: "eu_dst"}), (sunday, 6, {17: "us_dst", 16: "eu_dst"})):
            day = _date(ns)
            changing = weekday == 6 and _offset(day, LONDON) != _offset(day - timedelta(days=1), LONDON)
            if day.weekday() == weekday and divergent(day) and not changing and (clock := hours.get(ns % DAY // HOUR)):
                seen[clock].append(f"weekend edge of {day} in hour {ns % DAY // HOUR}")
    found = [c for c, e in seen.items() if e]
    if len(found) == 2:
        raise IntegrityError(f"stamps of two clocks in one file: {seen}")
    if found:
        return found[0], "; ".join(seen[found[0]])
    differing = [d for d in s.days if divergent(_date(d * DAY))]
    if differing:
        raise IntegrityError(f"{len(differing)} dates on which the clocks differ, and nothing that tells them apart")
    return None, "no tick on a date on which the clocks differ"


def _near_step(a: int, b: int, before: int, after: int) -> bool:
    return abs(a - before) <= NEAR_NS and abs(b - after) <= NEAR_NS


def check_order(stamps: np.ndarray, clock: str | None, year: int, month: int) -> None:
    """Stamps ascend, but for the one step back of an eu_dst autumn."""
    _check_order(_stamps(stamps, year, month), clock, year, month)


def _check_order(s: Stamps, clock: str | None, year: int, month: int) -> None:
    autumn = [x for x in switch_stamps(year, month) if x[0] == "autumn"]
    if s.back and not (clock == "eu_dst" and s.back == 1 and autumn and _near_step(s.back_from, s.back_to, *autumn[0][1:])):
        raise IntegrityError(f"stamps step back {s.back} times, first at line {s.back_at + 2}")


def to_utc(stamps: np.ndarray, clock: str | None, year: int, month: int) -> np.ndarray:
    """UTC of wall-clock stamps in file order."""
    return _utc(stamps, 0, _offsets(_stamps(stamps, year, month), clock, year, month))


def _offsets(s: Stamps, clock: str | None, year: int, month: int) -> list[tuple[int, int]]:
    """(line, offset from it on) of an eu_dst file; none of others, whose offsets follow from the stamps."""
    if clock != "eu_dst":
        return []
    out = [(0, eu_offset(date(year, month, 1)))]
    for kind, before, after in switch_stamps(year, month):
        new = (-4 if kind == "spring" else -5) * HOUR
        low, high = sorted((before, after))
        if s.last <= low:
            continue
        if s.first >= high:
            out = [(0, new)]
            continue
        if kind == "autumn" and s.back != 1:
            raise IntegrityError(f"an autumn file of eu_dst steps back once, this one {s.back} times")
        at, *step = (s.below, s.below_last, s.above_first) if kind == "spring" else (s.back_at + 1, s.back_from, s.back_to)
        if not _near_step(*step, before, after):
            raise IntegrityError(f"the {kind} change is not where the clock's rule puts it")
        out.append((at, new))
    return out


def _utc(stamps: np.ndarray, line: int, offsets: list[tuple[int, int]]) -> np.ndarray:
    """Of consecutive stamps from a line of their file on."""
    if offsets:
        at, ns = np.array(offsets, "int64").T
        return stamps - ns[np.searchsorted(at, line + np.arange(len(stamps)), "right") - 1]
    days = stamps // DAY
    out = np.empty_like(stamps)
    for d in np.unique(days).tolist():
        day, of = _date(d * DAY), days == d
        if len(transitions_on(day)):
            out[of] = _later(stamps[of], transitions(NEW_YORK, day.year - 1, day.year + 1))
        else:
            out[of] = stamps[of] - _offset(day, NEW_YORK)
    return out


def _later(stamps: np.ndarray, spells: list[tuple[int, int, int]]) -> np.ndarray:
    """local_to_ns of many stamps: of two instants the later, and in a skipped hour its end."""
    out, fits = np.empty_like(stamps), np.zeros(len(stamps), bool)
    for start, end, offset in spells:  # ascending, so the later overwrites
        at = stamps - offset * 10**9
        here, past = (start <= at) & (at < end), ~fits & (at >= end)
        out[past], out[here] = end, at[here]
        fits |= here
    return out


def transitions_on(day: date) -> list[int]:
    """New York's clock changes on a date."""
    return [s for s, _, _ in transitions(NEW_YORK, day.year, day.year)[1:] if _date(s) == day]


def _parse(content: bytes, year: int, month: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Stamps and both prices of consecutive lines, and how many blank ones follow. A line that is not a tick of that month fails, with its number."""
    if found := _parse_plain(content, year, month):
        return *found, 0
    lines = content.decode().removesuffix("\n").split("\n")
    n = len(lines)
    while lines and not lines[-1].strip():
        lines.pop()
    if not lines:
        none = np.zeros(0)
        return none.astype("int64"), none, none, n
    raw = pd.Series(lines).str.rstrip("\r").str.split(",", expand=True)
    if raw.shape[1] != 4 or raw.isna().any(axis=None):
        raise LineError(int(np.flatnonzero(np.array([x.count(",") != 3 for x in lines]))[0]), "four fields are needed")
    fits = raw[0].str.fullmatch(STAMP).to_numpy(bool)
    prices = [pd.to_numeric(raw[k], errors="coerce").to_numpy(float) for k in (1, 2)]
    when = pd.to_datetime(raw[0].where(fits), format="%Y%m%d %H%M%S%f", errors="coerce")
    wrong = ~fits | when.isna().to_numpy() | ~np.isfinite(prices[0]) | ~np.isfinite(prices[1])
    if wrong.any():
        raise LineError(k := int(np.flatnonzero(wrong)[0]), f"not a tick: {lines[k]!r}")
    outside = ((when.dt.year != year) | (when.dt.month != month)).to_numpy()
    if outside.any():
        raise LineError(int(np.flatnonzero(outside)[0]), f"not of {year}-{month:02d}")
    return when.astype("datetime64[ns]").astype("int64").to_numpy(), *prices, n - len(lines)


def _parse_plain(content: bytes, year: int, month: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """The same without blank lines, by whole arrays; None where anything is out of the ordinary."""
    kinds = {"stamp": pa.string(), "a": pa.float64(), "b": pa.float64(), "v": pa.string()}
    if not content or b"\r" in content or not content.isascii():
        return None
    try:
        t = csv.read_csv(pa.BufferReader(content), csv.ReadOptions(use_threads=False, column_names=[*kinds]), csv.ParseOptions(quote_char=False, ignore_empty_lines=False), csv.ConvertOptions(column_types=kinds, null_values=[]))
    except pa.ArrowInvalid:
        return None
    stamp = t["stamp"].combine_chunks()
    if pc.min_max(pc.binary_length(stamp)).as_py() != {"min": 18, "max": 18} or len(t) != content.count(b"\n") + (content[-1:] != b"\n"):
        return None
    digits = np.frombuffer(stamp.cast(pa.binary(18)).buffers()[1], np.uint8)[: 18 * len(t)].reshape(-1, 18).astype("int64") - 48
    number = np.delete(digits, 8, axis=1)
    if (digits[:, 8] != ord(" ") - 48).any() or (number < 0).any() or (number > 9).any():
        return None
    y, mo, d, h, mi, s, ms = (number[:, i:j] @ 10 ** np.arange(j - i)[::-1] for i, j in ((0, 4), (4, 6), (6, 8), (8, 10), (10, 12), (12, 14), (14, 17)))
    a, b = t["a"].to_numpy(), t["b"].to_numpy()
    if not ((y == year) & (mo == month) & (d >= 1) & (d <= monthrange(year, month)[1]) & (h < 24) & (mi < 60) & (s < 60) & np.isfinite(a) & np.isfinite(b)).all():
        return None
    return (date(year, month, 1) - date(1970, 1, 1)).days * DAY + (d - 1) * DAY + h * HOUR + (mi * 60 + s) * 10**9 + ms * MILLISECOND, a, b


def _summary(content: bytes, year: int, month: int) -> Summary:
    """What the reading of a file needs to know of some of its lines."""
    try:
        stamps, a, b, blank = _parse(content, year, month)
    except LineError as e:
        return Summary(wrong=(e.line, str(e)))
    if not len(stamps):
        return Summary(blank=blank)
    days, more, less = stamps // DAY, a > b, a < b
    each = []
    for d in np.unique(days).tolist():
        of = days == d
        first = [int(np.argmax(of & x)) if (of & x).any() else None for x in (more, less)]
        each.append(Day(d, int(of.sum()), int((of & more).sum()), *first))
    return Summary(each, _stamps(stamps, year, month), blank)


def _plan(summaries: list[Summary], year: int, month: int) -> tuple[list[int], dict]:
    """The first line of each piece of a file, and how the file is read: the swapped days, the clock's offsets and what was seen."""
    days: dict[int, Day] = {}
    stamps, blank, lines = None, 0, []
    for s in summaries:
        n = stamps.n if stamps else 0
        lines.append(n)
        if blank and (s.wrong or s.stamps):
            raise IntegrityError(f"line {n + 1}: four fields are needed")
        if s.wrong:
            raise IntegrityError(f"line {n + s.wrong[0] + 1}: {s.wrong[1]}")
        blank += s.blank
        for d in s.days:
            here = Day(d.day, d.n, d.more, *(None if x is None else n + x for x in (d.first_more, d.first_less)))
            days[d.day] = here if d.day not in days else Day(d.day, days[d.day].n + d.n, days[d.day].more + d.more, *(x if x is not None else y for x, y in zip(days[d.day][3:], here[3:])))
        stamps = _joined(stamps, s.stamps) if stamps and s.stamps else s.stamps or stamps
    if not stamps:
        raise IntegrityError("the file is empty")
    swapped, order = swapped_days([days[d] for d in sorted(days)])
    crossed = [x for d in days.values() if (x := d.first_less if d.day in swapped else d.first_more) is not None]
    if crossed:
        raise IntegrityError(f"line {min(crossed) + 1}: bid above ask after ordering the columns")
    clock, evidence = _clock(stamps, year, month)
    _check_order(stamps, clock, year, month)
    offsets = _offsets(stamps, clock, year, month)
    return lines, {"swapped": swapped, "offsets": offsets, "n_rows": stamps.n, "column_order": order, "stamp_clock": clock or "either", "evidence": evidence}


def _ticks(content: bytes, year: int, month: int, line: int, swapped: list[int], offsets: list[tuple[int, int]]) -> pd.DataFrame:
    """Ticks of the lines of a file from a line on, read as the file's plan says."""
    stamps, a, b, _ = _parse(content, year, month)
    swap = np.isin(stamps // DAY, np.array(swapped, "int64"))
    return pd.DataFrame({"ts_utc_ns": _utc(stamps, line, offsets), "bid": np.where(swap, b, a), "ask": np.where(swap, a, b), "bid_volume": None, "ask_volume": None, "row_sequence": line + np.arange(len(stamps))})


def parse_month(text: str, year: int, month: int) -> tuple[pd.DataFrame, dict[str, str]]:
    """Ticks of one month's file and how it was read. Any line that is not a tick of that month fails, with its number."""
    content = text.encode()
    _, plan = _plan([_summary(content, year, month)], year, month)
    return _ticks(content, year, month, 0, plan["swapped"], plan["offsets"]), {k: plan[k] for k in ("column_order", "stamp_clock", "evidence")}


HOW = "instrument string, year int, month int, n_rows long, column_order string, stamp_clock string, evidence string"


PLAN = f"path string, part long, line long, swapped array<long>, offsets array<array<long>>, instrument string, {HOW.split(', ', 1)[1]}"
MONTH_TICKS = TICKS + ", instrument string, year int, month int"


def _name(path: str) -> tuple[str, int, int]:
    if not (m := CSV_NAME.search(path)):
        raise IntegrityError(f"{path}: no month in the name")
    return m["instrument"], int(m["year"]), int(m["month"])


def _months(files: DataFrame, schema: str, make) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                instrument, year, month = _name(path)
                try:
                    ticks, how = parse_month(bytes(content).decode("ascii"), year, month)
                except (IntegrityError, UnicodeDecodeError) as e:
                    raise IntegrityError(f"{path}: {e}") from e
                yield make(ticks, how, instrument, year, month)

    return files.select("path", "content").mapInPandas(run, schema)


def _sliced(pieces: DataFrame) -> DataFrame:
    """Pieces (path, part, content, ...) in rows of 1000 bytes, in order: (path, part, k, slice), and what else there is, at the first slice only; the last slice is shorter, or
    empty. Spark fills a batch for a worker with rows until it has 64 MB, and a worker has it as Arrow and as objects: slices make it 10 MB."""
    more = [F.expr(f"if(k = 0, {c}, null)").alias(c) for c in pieces.columns if c not in ("path", "part", "content")]
    # the content is a variable, and needed for nothing else: the column would be copied out of its row for each slice, or into the slice's row
    slices = F.expr(f"transform(array(content), whole -> transform(sequence(0, coalesce(length(whole), 0), {SLICE}), at -> substring(whole, at + 1, {SLICE})))[0]")
    return pieces.select(*[c for c in pieces.columns if c != "content"], F.posexplode(slices).alias("k", "slice")).select("path", "part", "k", "slice", *more)


def _whole(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """The first row of each piece, and its content, of the rows of _sliced; one piece is held at a time."""
    held: list[bytes] = []
    for pdf in batches:
        for x in pdf.itertuples(index=False):
            if x.slice is None:
                raise IntegrityError(f"{x.path}: no content")
            if x.k != len(held):
                raise IntegrityError(f"{x.path}: slices of a piece out of order")
            if not held:
                first = x
            held.append(x.slice)
            if len(x.slice) < SLICE:
                yield first, b"".join(held)
                held = []
    if held:
        raise IntegrityError(f"{first.path}: a piece without its last slice")


def month_plans(pieces: DataFrame) -> DataFrame:
    """How files are read that come in pieces (path, part, content): PLAN, a row for each piece. Pieces are whole lines, in the order of part; a task
    holds one at a time, and what it says of the file (counts by day, steps of the stamps) is put together by file. A line break at a piece's end ends its last line."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x, content in _whole(batches):
            _, year, month = _name(x.path)
            try:
                content.decode("ascii")
            except UnicodeDecodeError as e:
                raise IntegrityError(f"{x.path}: {e}") from e
            yield pd.DataFrame([{"path": x.path, "part": x.part, "summary": pickle.dumps(_summary(content, year, month))}])

    def plan(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part", ignore_index=True)
        instrument, year, month = _name(key[0])
        try:
            if pdf["part"].duplicated().any():
                raise IntegrityError("two pieces of one number")
            lines, how = _plan([pickle.loads(x) for x in pdf["summary"]], year, month)
        except IntegrityError as e:
            raise IntegrityError(f"{key[0]}: {e}") from e
        each = {"instrument": instrument, "year": year, "month": month, **how}
        return pd.DataFrame([{"path": key[0], "part": part, "line": line, **each} for part, line in zip(pdf["part"], lines)])

    return _sliced(pieces.select("path", "part", "content")).mapInPandas(look, "path string, part long, summary binary").groupBy("path").applyInPandas(plan, PLAN)


def month_ticks(files: DataFrame, plans: DataFrame | None = None) -> DataFrame:
    """Ticks of month files (path, content binary), one task for each file at most; a file that can't be read without guessing fails the job.
    Files of any size come in pieces (path, part, content), see month_plans; plans: theirs, where they are at hand."""
    if "part" not in files.columns:
        return _months(files, MONTH_TICKS, lambda ticks, how, instrument, year, month: ticks.assign(instrument=instrument, year=year, month=month).astype({"bid_volume": float, "ask_volume": float}))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x, content in _whole(batches):
            instrument, year, month = _name(x.path)
            ticks = _ticks(content, year, month, int(x.line), list(x.swapped), [tuple(o) for o in x.offsets])
            yield ticks.assign(instrument=instrument, year=year, month=month).astype({"bid_volume": float, "ask_volume": float})

    plans = (month_plans(files) if plans is None else plans).select("path", "part", "line", "swapped", "offsets")
    return _sliced(files.select("path", "part", "content").join(F.broadcast(plans), ["path", "part"])).mapInPandas(read, MONTH_TICKS)  # a plan is a row for each piece


def month_readings(files: DataFrame, plans: DataFrame | None = None) -> DataFrame:
    """How each month file was read: HOW. Files may come in pieces, as for month_ticks."""
    if "part" in files.columns:
        names = [x.split()[0] for x in HOW.split(", ")]
        first = (month_plans(files) if plans is None else plans).groupBy("path").agg(F.min_by(F.struct(*names), "part").alias("how"))
        return first.select("how.*")
    return _months(files, HOW, lambda ticks, how, instrument, year, month: pd.DataFrame([{"instrument": instrument, "year": year, "month": month, "n_rows": len(ticks), **how}]))


def read_month_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Ticks of all month files below the paths."""
    return month_ticks(spark.read.format("binaryFile").option("pathGlobFilter", "DAT_ASCII_*_T_*.csv").load(paths))


def gap_reports(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, n_gaps) of the status texts beside month files."""
    return count_gaps(spark.read.text(paths, pathGlobFilter="DAT_ASCII_*.txt").withColumn("path", F.input_file_name()))


def count_gaps(lines: DataFrame) -> DataFrame:
    """(path, n_gaps) of lines (path, value)."""
    return lines.groupBy("path").agg(F.sum(F.regexp_count("value", F.lit(GAP_LINE))).cast("long").alias("n_gaps"))


def month_files(source: str | Path, staging: str | Path, instruments: list[str] | None = None, skip: set[tuple[str, int, int]] = frozenset()) -> list[Path]:
    """Month files of a zip of zips, a folder of zips or a folder of CSVs. Only what is wanted, by name, is unpacked (to staging): Spark can't split a zip."""
    source, staging = Path(source), Path(staging)

    def wanted(m: re.Match | None) -> bool:
        return bool(m) and (instruments is None or m["instrument"] in instruments) and (m["instrument"], int(m["year"]), int(m["month"])) not in skip

    def unpack(inner: zipfile.ZipFile) -> Iterator[Path]:
        for name in inner.namelist():
            if CSV_NAME.search(name) or name.endswith(".txt"):
                target = staging / Path(name).name
                target.parent.mkdir(parents=True, exist_ok=True)
                target.write_bytes(inner.read(name))
                if CSV_NAME.search(name):
                    yield target

    if source.is_file() and source.suffix == ".zip":
        with zipfile.ZipFile(source) as outer:
            names = sorted(n for n in outer.namelist() if wanted(ZIP_NAME.search(n)))
            out = []
            for n in names:
                with outer.open(n) as f, zipfile.ZipFile(f) as inner:
                    out += unpack(inner)
        return out
    if not source.is_dir():
        raise FileNotFoundError(f"{source} is neither a zip nor a folder")
    zips = sorted(p for p in source.glob("*.zip") if wanted(ZIP_NAME.search(p.name)))
    if zips:
        out = []
        for p in zips:
            with zipfile.ZipFile(p) as inner:
                out += unpack(inner)
        return out
    return sorted(p for p in source.glob("*.csv") if wanted(CSV_NAME.search(p.name)))


HOUR_RECORD = np.dtype([("ms", ">u4"), ("ask", ">u4"), ("bid", ">u4"), ("ask_volume", ">f4"), ("bid_volume", ">f4")])


def parse_hour(blob: bytes, hour_ns: int, point: float = 1e-5) -> pd.DataFrame:
    """Ticks of a compressed hour of 20-byte records; no bytes are an hour without ticks."""
    if not blob:
        data = np.zeros(0, HOUR_RECORD)
    else:
        try:
            raw = lzma.decompress(blob)
        except lzma.LZMAError as e:
            raise IntegrityError(f"not an LZMA stream: {e}") from e
        if len(raw) % HOUR_RECORD.itemsize:
            raise IntegrityError(f"{len(raw)} bytes are no whole number of records")
        data = np.frombuffer(raw, HOUR_RECORD)
    return pd.DataFrame({"ts_utc_ns": hour_ns + data["ms"].astype(np.int64) * MILLISECOND, "bid": data["bid"].astype(float) * point, "ask": data["ask"].astype(float) * point, "bid_volume": data["bid_volume"].astype(float), "ask_volume": data["ask_volume"].astype(float), "row_sequence": np.arange(len(data))})


_HOUR_PATH = re.compile(r"(?P<instrument>[A-Z]{6})/(?P<year>\d{4})/(?P<month>\d{2})/(?P<day>\d{2})/(?P<hour>\d{2})h_ticks\.bi5$")


def hour_ticks(files: DataFrame, point: float = 1e-5) -> DataFrame:
    """(instrument, ticks..., error) of hour files (path, content binary); a file that can't be read is one row with an error and its hour."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                m, hour_ns = _HOUR_PATH.search(path), None
                try:
                    if not m:
                        raise IntegrityError("no hour in the path")
                    at = datetime(int(m["year"]), int(m["month"]), int(m["day"]), int(m["hour"]))
                    hour_ns = int((at - datetime(1970, 1, 1)).total_seconds()) * 10**9
                    yield parse_hour(bytes(content), hour_ns, point).assign(instrument=m["instrument"], error=None)
                except (IntegrityError, ValueError) as e:
                    yield pd.DataFrame([{"instrument": m["instrument"] if m else None, "ts_utc_ns": hour_ns, "error": f"{path}: {e}"}]).reindex(columns=[f.split()[0] for f in (TICKS + ", instrument string, error string").split(", ")])

    return files.select("path", "content").mapInPandas(run, TICKS + ", instrument string, error string")


def read_hours(spark: SparkSession, root: str, point: float = 1e-5) -> DataFrame:
    """Ticks and errors of all hour files below a folder."""
    return hour_ticks(spark.read.format("binaryFile").option("pathGlobFilter", "*.bi5").option("recursiveFileLookup", "true").load(root), point)


HOUR_BASE = "https://datafeed.dukascopy.com/datafeed"


def hour_addresses(hours: DataFrame, root: str, base: str = HOUR_BASE) -> DataFrame:
    """Adds url and path of (instrument, hour_ns); months count from 0 in the address, and only there."""
    at = T.instant("hour_ns")
    parts = [F.expr(f"year({at})"), F.expr(f"month({at})"), F.expr(f"day({at})"), F.expr(f"hour({at})")]
    name = "%s/%s/%04d/%02d/%02d/%02dh_ticks.bi5"
    return hours.withColumns({"url": F.format_string(name, F.lit(base), "instrument", parts[0], parts[1] - 1, *parts[2:]), "path": F.format_string(name, F.lit(root.rstrip("/")), "instrument", *parts)})


def hour_url(instrument: str, hour: datetime, base: str = HOUR_BASE) -> str:
    """Months count from 0 in the address, and only there."""
    _aligned(hour)
    return f"{base}/{instrument}/{hour.year:04d}/{hour.month - 1:02d}/{hour.day:02d}/{hour.hour:02d}h_ticks.bi5"


def hour_path(root: str, instrument: str, hour: datetime) -> str:
    _aligned(hour)
    return f"{root.rstrip('/')}/{instrument}/{hour.year:04d}/{hour.month:02d}/{hour.day:02d}/{hour.hour:02d}h_ticks.bi5"


def _aligned(hour: datetime) -> None:
    if hour.tzinfo is None or hour.utcoffset() or hour.minute or hour.second or hour.microsecond:
        raise ValueError("a whole hour in UTC is needed")


def fetch_status(code: int, size: int, attempt: int, retry_after: str | None = None) -> tuple[str, float | None]:
    """(status, seconds to wait before the next attempt or None): fetched, empty, rate_limited or failed. Waits double; after
    429 they start at a minute, end at a quarter of an hour and follow a whole-number Retry-After."""
    if code == 200:
        return ("fetched" if size else "empty"), None
    if code == 404:
        return "empty", None
    if code == 429:
        asked = float(retry_after) if retry_after and retry_after.strip().isdigit() else None
        return "rate_limited", asked if asked is not None else min(900.0, 60.0 * 2 ** (attempt - 1))
    return "failed", 2.0 ** (attempt - 1)


def fetch_outcome(code: str = "code", size: str = "size", attempt: str = "attempt", retry_after: str = "retry_after") -> Column:
    """fetch_status of columns: a struct (status, wait_s)."""
    c, k = F.col(code), F.col(attempt)
    asked = F.when(F.trim(retry_after).rlike("^[0-9]+$"), F.trim(retry_after).cast("double"))
    status = F.when(c == 200, F.when(F.col(size) > 0, "fetched").otherwise("empty")).when(c == 404, "empty").when(c == 429, "rate_limited").otherwise("failed")
    wait = F.when(c == 429, F.coalesce(asked, F.least(F.lit(900.0), 60.0 * F.pow(F.lit(2.0), k - 1)))).when(~c.isin(200, 404), F.pow(F.lit(2.0), k - 1))
    return F.struct(status.alias("status"), wait.alias("wait_s"))


CALENDAR = "date date, event_type string, source_note string"
EVENT_TYPES = ("nfp", "fomc", "boe_mpc")  # fixed values


def release_calendar(rows: DataFrame) -> DataFrame:
    """(date, event_types): the sorted kinds of scheduled releases of each date. Missing dates or kinds, and kinds that aren't known, fail."""
    if not {"date", "event_type"} <= set(rows.columns):
        raise IntegrityError("a calendar needs date and event_type")
    known = F.col("event_type").isin(*EVENT_TYPES)
    sure = F.when(F.col("date").isNotNull() & F.col("event_type").isNotNull() & known, F.col("event_type")).otherwise(F.raise_error(F.concat(F.lit("not a scheduled release: "), F.coalesce("event_type", F.lit("null")))))
    return rows.groupBy("date").agg(F.array_sort(F.collect_set(sure)).alias("event_types"))


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    return release_calendar(spark.read.schema(CALENDAR).option("header", True).option("mode", "FAILFAST").csv(path))


LOG = "hour_ns long, status string, attempts int, byte_count long, recorded_utc string, error string"


def merge_fetch_log(existing: DataFrame, new: DataFrame) -> DataFrame:
    """By hour, the newer entry wins; hours that were skipped since they were there are no entries."""
    from tidemark.sources.ticks import latest

    both = existing.withColumn("_g", F.lit(0)).unionByName(new.where("status <> 'skipped_existing'").withColumn("_g", F.lit(1)))
    return latest(both, ["hour_ns"], F.desc("_g")).drop("_g")
