"""Command line: python -m tidemark.cli COMMAND. Exit codes: 0 done, 1 wrong use, 2 data that can't be trusted, 3 a gate not passed, 4 output failed."""

from __future__ import annotations

import argparse
import sys
from datetime import UTC, datetime

from pyspark.sql import SparkSession

from tidemark import report
from tidemark.functions import timex as T
from tidemark.functions.timex import HOUR, utc_ns
from tidemark.operators import describe as D
from tidemark.operators import events as E
from tidemark.operators import features as X
from tidemark.operators import ingest as I
from tidemark.operators import quality as Q
from tidemark.operators.bars import resample, with_gaps
from tidemark.sources import ticks as S

# The range of the descriptive reports.
DESCRIBED = ("2007-01-01T00:00:00Z", "2015-01-01T00:00:00Z")


def parse_hour(text: str) -> int:
    """An ISO instant on a whole hour, in UTC."""
    try:
        at = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError as e:
        raise ValueError(f"{text!r} is no ISO time") from e
    ns = utc_ns(at if at.tzinfo else at.replace(tzinfo=UTC))
    if ns % HOUR:
        raise ValueError(f"{text!r} is not on a whole hour")
    return ns


def parse_month(text: str) -> tuple[int, int]:
    at = datetime.strptime(text, "%Y-%m")
    return at.year, at.month


def session() -> SparkSession:
    spark = SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return spark


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    ranged = argparse.ArgumentParser(add_help=False)
    ranged.add_argument("--data", required=True, help="folder of the tables")
    ranged.add_argument("--instrument", default="GBPUSD")
    ranged.add_argument("--start", default=DESCRIBED[0])
    ranged.add_argument("--end", default=DESCRIBED[1])
    ranged.add_argument("--out", default="reports")
    i = sub.add_parser("import", parents=[ranged], help="month files to ticks")
    i.add_argument("--source", required=True)
    i.add_argument("--staging", required=True, help="folder that all executors see")
    r = sub.add_parser("resample", parents=[ranged], help="ticks to bars")
    r.add_argument("--allow-incomplete", action="store_true")
    sub.add_parser("validate", parents=[ranged], help="the data-quality battery")
    f = sub.add_parser("features", parents=[ranged], help="features of bars")
    f.add_argument("--name", action="append", required=True)
    d = sub.add_parser("describe", parents=[ranged], help="R1, R2 or R5")
    d.add_argument("--report", choices=("R1", "R2", "R5"), required=True)
    g = sub.add_parser("probe", parents=[ranged], help="events and the gate")
    g.add_argument("--widen", choices=("range_pct_max", "break_buffer_atr"))
    return p


def run(args: argparse.Namespace) -> int:
    lo, hi = parse_hour(args.start), parse_hour(args.end)
    E.guard_holdout(hi)
    spark = session()
    roots = {k: f"{args.data.rstrip('/')}/{k}" for k in ("tick", "bars_1m", "features")}
    of = [args.instrument]
    ticks = lambda: S.read_ticks(spark, roots["tick"], lo, hi, of)
    bars = lambda: S.read_bars(spark, roots["bars_1m"], lo, hi, of)
    if args.command == "import":
        have = {(r["instrument"], r["year"], r["month"]) for r in S.read_ticks(spark, roots["tick"]).select("instrument", "year", "month").distinct().collect()}
        files = I.month_files(args.source, args.staging, of, have)
        if files:
            S.write_ticks(I.read_month_files(spark, [f"file://{p.resolve()}" for p in files]), roots["tick"])
        print(f"{len(files)} months imported")
    elif args.command == "resample":
        t = ticks()
        holes = S.require_complete(S.missing_months(spark, t, lo, hi, of), args.allow_incomplete)
        S.write_bars(with_gaps(resample(t)), roots["bars_1m"])
        print(f"{bars().count()} bars, {len(holes)} months missing")
    elif args.command == "validate":
        samples = Q.check_samples(ticks(), bars()).persist()
        report.quality_report(f"{args.out}/quality.md", samples, f"{args.instrument} {args.start} to {args.end}")
        if not Q.sealable(Q.findings(samples)):
            return 3
    elif args.command == "features":
        made = X.compute(args.name, bars())
        S.with_month(made).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").options(**S.ZSTD).partitionBy("instrument", "year", "month").parquet(f"{roots['features']}/v1")
        print(report.grid(X.null_counts(made).collect(), ["feature", "n_null"]))
    elif args.command == "describe":
        b = bars().persist()
        if args.report == "R5":
            cells = D.r5_by_hour(b).orderBy("instrument", "weekday", "hour")
            report.write_report(f"{args.out}/r5.md", "Spread and range by hour of the week", [("By hour", report.cells(cells.collect(), cells.columns, ["median_spread", "median_range", "ratio"])), ("By year", report.grid(D.r5_by_year(b).collect(), ["instrument", "year", "n", "median_spread"]))], D.r5_intervals(b).unionByName(D.r5_year_intervals(b), allowMissingColumns=True))
        elif args.report == "R1":
            ratios = D.session_ratios(b).persist()
            m = D.r1_marginals(ratios).orderBy("instrument", "session", "grouping", "key")
            shown = [c for c in m.columns if c[:2] in ("q1", "me", "q3")]
            report.write_report(f"{args.out}/r1.md", "Session ranges", [("By year and weekday", report.cells(m.collect(), m.columns, shown))], D.r1_intervals(ratios))
        else:
            days = D.r2_days(b).persist()
            t = D.r2_buckets(days).orderBy("instrument", "year", "bucket")
            report.write_report(f"{args.out}/r2.md", "London after quiet and busy mornings", [("Buckets", report.cells(t.collect(), t.columns, ["q1_ratio", "median_ratio", "q3_ratio"]))], D.r2_intervals(days))
    elif args.command == "probe":
        p = E.widened(E.Params(), args.widen) if args.widen else E.Params()
        b = bars().persist()
        events = E.detect(b, p).persist()
        months = S.with_month(b).select("instrument", "year", "month").distinct()
        admissible = E.admissible_years(months, Q.run_checks(ticks(), b))
        counts = E.counts_by_year(events, months.select("instrument", "year").distinct())
        decision = E.gate(counts, admissible, bool(args.widen)).first()
        settings = {k: v for k, v in vars(p).items()}
        report.record_widening(f"{args.out}/lineage.json", {"decision": decision["decision"], "settings": settings, "widened_from": args.widen, "at": report.now(), "tzdata": T.tzdata_versions(spark)})
        report.gate_report(f"{args.out}/gate.md", decision, counts, E.eligible_days(b, p).groupBy("instrument").count(), events.drop("detail"), settings, args.widen)
        print(decision["decision"])
        if decision["decision"] not in (E.PROCEED, E.UNSTABLE):
            return 3
    return 0


def main(argv: list[str] | None = None) -> int:
    try:
        return run(parser().parse_args(argv))
    except (S.IntegrityError, report.LogError) as e:
        print(f"data: {e}", file=sys.stderr)
        return 2
    except OSError as e:
        print(f"output: {e}", file=sys.stderr)
        return 4
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
