"""Fetching with a server that is a function, and the zone data's versions."""

import lzma
import threading

import pytest

from tidemark.functions import timex as T
from tidemark.operators import ingest as I
from tidemark.operators.fetch import Pace, fetch_hour, fetch_range, moment, tally
from tidemark.sources.ticks import IntegrityError

H0 = 1_704_672_000_000_000_000  # 2024-01-08 00:00 UTC
FULL = lzma.compress(bytes(40))


class Server:
    """Answers by hour: a list of codes for each, the last one for good."""

    def __init__(self, codes=None, default=200):
        self.codes, self.default, self.asked, self.lock = codes or {}, default, [], threading.Lock()

    def __call__(self, url, timeout):
        with self.lock:
            self.asked.append(url)
            hour = int(url.rsplit("/", 1)[1][:2])
            left = self.codes.get(hour)
            code = self.default if not left else left.pop(0) if len(left) > 1 else left[0]
        if code == "drop":
            raise OSError("connection reset")
        return code, FULL if code == 200 else b"", "3" if code == 429 else None


def test_hours_of_a_range(tmp_path):
    server, waits, told = Server({1: [404], 2: [500, 200], 3: ["drop", "drop", "drop"], 4: [429, 200]}), [], []
    got = fetch_range(tmp_path, "GBPUSD", H0, H0 + 8 * T.HOUR, server, gap=0, log=told.append, sleep=waits.append)
    assert [r.status for r in got] == ["fetched", "empty", "fetched", "missing", "fetched", "fetched", "fetched", "fetched"] and [r.hour_ns for r in got] == [H0 + k * T.HOUR for k in range(8)]
    assert [r.attempts for r in got[:5]] == [1, 1, 2, 3, 2] and got[3].error == "connection reset" and sorted(waits) == [1.0, 1.0, 2.0, 3.0]
    assert tally(got) == {"fetched": 6, "empty": 1, "missing": 1, "skipped_existing": 0, "rate_limited": 0, "bytes": 6 * len(FULL)} and len(told) == 8
    assert "/2024/00/08/05h_ticks.bi5" in " ".join(server.asked) and (tmp_path / "GBPUSD/2024/01/08/05h_ticks.bi5").read_bytes() == FULL
    assert not list(tmp_path.rglob("*.new"))
    again = Server()
    got = fetch_range(tmp_path, "GBPUSD", H0, H0 + 8 * T.HOUR, again, gap=0, log=told.append)
    assert [r.status for r in got].count("skipped_existing") == 7 and len(again.asked) == 1 and len(told) == 9
    assert fetch_hour(tmp_path, "GBPUSD", H0, again, Pace(0), again=True).status == "fetched"


@pytest.mark.parametrize("threads", [1, 4])
def test_a_server_that_refuses_stops_the_range(tmp_path, threads):
    server, told = Server({0: [200], 1: [404]}, default=429), []
    with pytest.raises(IntegrityError, match="429"):
        fetch_range(tmp_path, "GBPUSD", H0, H0 + 200 * T.HOUR, server, threads=threads, gap=0, attempts=1, log=told.append, sleep=lambda _: None)
    refused = [r for r in told if r.status == "rate_limited"]
    assert 10 <= len(refused) < 10 + threads + 20 and len(server.asked) < 60 and any(r.status == "fetched" for r in told)


def test_refusals_between_answers_do_not_stop(tmp_path):
    server = Server({k: [429] for k in range(24) if k % 3}, default=200)
    got = fetch_range(tmp_path, "GBPUSD", H0, H0 + 24 * T.HOUR, server, threads=1, gap=0, attempts=1, most_refused=3, sleep=lambda _: None)
    assert tally(got)["rate_limited"] == 16 and tally(got)["fetched"] == 8


def test_one_pace_for_all_threads():
    now, slept = [0.0], []
    pace = Pace(0.25, clock=lambda: now[0], sleep=slept.append)
    for _ in range(4):
        pace.wait()
    assert slept == [0.25, 0.5, 0.75]
    now[0] = 9.0
    pace.wait()
    assert len(slept) == 3


def test_ranges_are_whole_hours(tmp_path):
    for a, b in ((H0 + 1, H0 + T.HOUR), (H0, H0), (H0, H0 + 5)):
        with pytest.raises(ValueError):
            fetch_range(tmp_path, "GBPUSD", a, b, Server())
    assert moment(H0).isoformat() == "2024-01-08T00:00:00+00:00"


def test_outcome_columns_agree_with_the_function(spark):
    rows = [(c, n, k, a) for c in (200, 404, 429, 500, 0) for n in (0, 7) for k in (1, 3, 6) for a in (None, "5", " 7 ", "x", "")]
    got = spark.createDataFrame(rows, "code int, size int, attempt int, retry_after string").select("*", I.fetch_outcome().alias("o")).collect()
    assert all((r["o"]["status"], r["o"]["wait_s"]) == I.fetch_status(r["code"], r["size"], r["attempt"], r["retry_after"]) for r in got)


def test_versions_of_zone_data(spark):
    found = T.tzdata_versions(spark)
    assert set(found) == {"python", "jvm"} and found["jvm"][:2] == "20" and found["python"]
