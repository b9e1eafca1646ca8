"""Instruments, periods and session sets: as Python values, or from YAML files of the same form."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import date
from pathlib import Path
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError


class ConfigError(ValueError):
    """A configuration that contradicts itself."""


@dataclass(frozen=True)
class Session:
    """A daily window in a zone, or (parents) the intersection of others."""

    name: str
    zone: str | None = None
    start: str | None = None
    end: str | None = None
    parents: tuple[str, ...] = ()


@dataclass(frozen=True)
class SessionSet:
    name: str
    sessions: tuple[Session, ...]
    version: int = 1
    exclude_partial: bool = True
    thin_day_threshold: float = 0.60
    nonexistent: str = "later"
    ambiguous: str = "later"

    def __post_init__(self) -> None:
        names = [s.name for s in self.sessions]
        if len(set(names)) != len(names):
            raise ConfigError("session names repeat")
        if "raise" in (self.nonexistent, self.ambiguous):
            raise ConfigError("a session boundary can't fail: the policy must be earlier or later")
        if not 0 < self.thin_day_threshold < 1:
            raise ConfigError("thin_day_threshold must be between 0 and 1")
        for s in self.sessions:
            if s.parents:
                if len(s.parents) < 2:
                    raise ConfigError(f"{s.name}: an intersection needs two sessions at least")
                for p in s.parents:
                    if p not in names or self[p].parents:
                        raise ConfigError(f"{s.name}: {p} is no session with a window of its own")
                continue
            if not all(re.fullmatch(r"([01]\d|2[0-3]):[0-5]\d", x or "") for x in (s.start, s.end)):
                raise ConfigError(f"{s.name}: start and end must be HH:MM")
            if s.end <= s.start:
                raise ConfigError(f"{s.name}: end must be after start")
            try:
                ZoneInfo(s.zone or "")
            except (ZoneInfoNotFoundError, ValueError) as e:
                raise ConfigError(f"{s.name}: unknown zone {s.zone!r}") from e

    def __getitem__(self, name: str) -> Session:
        for s in self.sessions:
            if s.name == name:
                return s
        raise ConfigError(f"no session {name!r}")


# The sessions of the foreign-exchange day.
FX_CORE = SessionSet(
    "fx_core",
    (
        Session("tokyo", "Asia/Tokyo", "09:00", "15:00"),
        Session("pre_london", "Europe/London", "00:00", "08:00"),
        Session("london", "Europe/London", "08:00", "16:30"),
        Session("london_open_window", "Europe/London", "08:00", "11:00"),
        Session("new_york", "America/New_York", "08:00", "17:00"),
        Session("overlap_london_ny", parents=("london", "new_york")),
    ),
)


@dataclass(frozen=True)
class Instrument:
    name: str
    point_scale: float = 1e-5
    digits: int = 5


@dataclass(frozen=True)
class Period:
    name: str
    start: date
    end: date | None  # last day, itself included; None: open


@dataclass(frozen=True)
class Periods:
    periods: tuple[Period, ...] = field(default=(Period("development", date(2007, 1, 1), date(2018, 12, 31)), Period("validation", date(2019, 1, 1), date(2022, 12, 31)), Period("holdout", date(2023, 1, 1), None)))

    def __post_init__(self) -> None:
        for a, b in zip(self.periods, self.periods[1:]):
            if a.end is None or (b.start - a.end).days != 1:
                raise ConfigError(f"{b.name} doesn't start the day after {a.name} ends")
        if any(p.end is not None and p.end < p.start for p in self.periods):
            raise ConfigError("a period ends before it starts")


def _yaml(path: str | Path) -> dict:
    import yaml

    try:
        loaded = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    except (OSError, yaml.YAMLError) as e:
        raise ConfigError(f"{path}: {e}") from e
    if not isinstance(loaded, dict):
        raise ConfigError(f"{path}: not a mapping")
    return loaded


def load_instruments(path: str | Path) -> dict[str, Instrument]:
    out = {}
    for name, x in _yaml(path).items():
        if not isinstance(x, dict) or not {"point_scale", "digits"} <= x.keys():
            raise ConfigError(f"{name}: point_scale and digits are needed")
        out[name] = Instrument(name, float(x["point_scale"]), int(x["digits"]))
    if not out:
        raise ConfigError("no instrument")
    return out


def load_periods(path: str | Path) -> Periods:
    def day(x: object) -> date | None:
        return x if isinstance(x, date) or x is None else date.fromisoformat(str(x))

    return Periods(tuple(Period(k, day(v["start"]), day(v.get("end"))) for k, v in _yaml(path).items()))


def load_session_set(path: str | Path) -> SessionSet:
    raw = _yaml(path)
    sessions = []
    for name, x in raw.get("sessions", {}).items():
        parents = x.get("intersection_of") or x.get("intersection") or x.get("parents")
        sessions.append(Session(name, parents=tuple(parents)) if parents else Session(name, x.get("tz") or x.get("timezone") or x.get("zone"), str(x.get("start")), str(x.get("end"))))
    fold = raw.get("fold_policy") or {}
    return SessionSet(str(raw.get("name") or Path(path).stem), tuple(sessions), int(raw.get("version", 1)), bool(raw.get("exclude_partial", True)), float(raw.get("thin_day_threshold", 0.60)), str(fold.get("nonexistent", "later")), str(fold.get("ambiguous", "later")))
