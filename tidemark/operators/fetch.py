"""Hours of a range from a server into files, on the driver: a few threads, one pace for all of them, and a stop when the server keeps refusing.

The request is a function that is handed in, (url, timeout) to (code, body, Retry-After), so that nothing here needs a network.
"""

from __future__ import annotations

import os
import threading
import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from pathlib import Path

from tidemark.functions.timex import HOUR
from tidemark.operators.ingest import fetch_status, hour_path, hour_url
from tidemark.sources.ticks import IntegrityError

Request = Callable[[str, float], tuple[int, bytes, str | None]]


@dataclass(frozen=True)
class Fetched:
    hour_ns: int
    status: str  # fetched, empty, rate_limited, missing or skipped_existing
    attempts: int = 0
    byte_count: int = 0
    error: str | None = None


class Pace:
    """Lets requests of all threads start no nearer to each other than a gap."""

    def __init__(self, gap: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.clock, self.sleep = gap, clock, sleep
        self.lock, self.free_at = threading.Lock(), float("-inf")

    def wait(self) -> None:
        with self.lock:
            at = max(self.clock(), self.free_at)
            self.free_at = at + self.gap
        if (delay := at - self.clock()) > 0:
            self.sleep(delay)


def moment(hour_ns: int) -> datetime:
    return datetime(1970, 1, 1, tzinfo=UTC) + timedelta(seconds=hour_ns // 10**9)


def fetch_hour(root: str | Path, instrument: str, hour_ns: int, request: Request, pace: Pace, attempts: int = 3, timeout: float = 30.0, most_wait: float = 900.0, again: bool = False, sleep: Callable[[float], None] = time.sleep) -> Fetched:
    """One hour's file, written aside and renamed. An hour that is there is skipped without a request; an hour without ticks is an empty file."""
    path = Path(hour_path(str(root), instrument, moment(hour_ns)))
    if path.exists() and not again:
        return Fetched(hour_ns, "skipped_existing", byte_count=path.stat().st_size)
    status, said = "failed", None
    for k in range(1, attempts + 1):
        pace.wait()
        try:
            code, body, retry_after = request(hour_url(instrument, moment(hour_ns)), timeout)
            said = f"status {code}"
        except OSError as e:
            code, body, retry_after, said = 0, b"", None, str(e)
        status, wait = fetch_status(code, len(body), k, retry_after)
        if status in ("fetched", "empty"):
            path.parent.mkdir(parents=True, exist_ok=True)
            aside = path.with_name(f"{path.name}.{threading.get_ident()}.new")
            aside.write_bytes(body if status == "fetched" else b"")
            os.replace(aside, path)
            return Fetched(hour_ns, status, k, path.stat().st_size)
        if k < attempts:
            sleep(min(wait or 0.0, most_wait))
    return Fetched(hour_ns, "rate_limited" if status == "rate_limited" else "missing", attempts, 0, said)


def fetch_range(root: str | Path, instrument: str, start_ns: int, end_ns: int, request: Request, threads: int = 4, gap: float = 0.25, most_refused: int = 10, log: Callable[[Fetched], None] = lambda _: None, sleep: Callable[[float], None] = time.sleep, **hour) -> list[Fetched]:
    """All hours of [start, end), in order. log is told of each hour that went to the server as soon as it is done, one at a time. After most_refused hours
    in a row (in the order in which they were answered) that ended in 429 the range stops with an error; what was fetched stays."""
    if start_ns % HOUR or end_ns % HOUR or start_ns >= end_ns:
        raise ValueError("a range begins and ends on whole hours, and begins first")
    pace, lock, stop, refused = Pace(gap, sleep=sleep), threading.Lock(), threading.Event(), [0, 0]  # in a row now, and in a row when it was enough
    hours = range(start_ns, end_ns, HOUR)
    todo, done = iter(hours), {}

    def work() -> None:
        while not stop.is_set():
            with lock:
                hour_ns = next(todo, None)
            if hour_ns is None:
                return
            try:
                got = fetch_hour(root, instrument, hour_ns, request, pace, sleep=sleep, **hour)
            except BaseException:
                stop.set()
                raise
            with lock:
                done[hour_ns] = got
                if got.status == "skipped_existing":
                    continue
                log(got)
                refused[0] = refused[0] + 1 if got.status == "rate_limited" else 0
                if refused[0] >= most_refused:
                    refused[1] = refused[0]
                    stop.set()

    with ThreadPoolExecutor(max(1, threads)) as pool:
        for job in [pool.submit(work) for _ in range(max(1, threads))]:
            job.result()
    if refused[1]:
        raise IntegrityError(f"{refused[1]} hours in a row were refused with 429: try again later, with a longer gap between requests")
    if lost := [h for h in hours if h not in done]:
        raise IntegrityError(f"{len(lost)} of {len(hours)} hours have no result, first {moment(lost[0])}")
    return [done[h] for h in hours]


def tally(results: Iterable[Fetched]) -> dict[str, int]:
    """Hours by status, and the bytes of all."""
    out = dict.fromkeys(("fetched", "empty", "missing", "skipped_existing", "rate_limited"), 0) | {"bytes": 0}
    for r in results:
        out[r.status] += 1
        out["bytes"] += r.byte_count
    return out
