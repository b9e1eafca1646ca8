"""Forward records against theory, and reads that are fenced by what a query is for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import timex as T
from tidemark.operators.events import HOLDOUT_NS, VaultError
from tidemark.operators.features import realised_volatility, session_days, with_day, with_mid
from tidemark.operators.sessions import bounds
from tidemark.plans.config import FX_CORE, SessionSet
from tidemark.sources.ticks import read_bars

# Tolerances of the classifier.
SIZE, OF_SPREAD, R = 0.10, 0.10, 0.05
RECORD = "opportunity_id string, noticed boolean, taken boolean, intended_risk_r double, intended_entry double, actual_entry double, intended_stop double, actual_stop double, spread_at_fill double, rule_violations array<string>, actual_r double, theoretical_r double"


def cause(size: float = SIZE, of_spread: float = OF_SPREAD, r: float = R) -> Column:
    """What made a record differ from theory: the first that holds of off-plan, missed, declined, wrong size, entry, moved stop, broken rule, delay; else variance.
    A null comparison doesn't hold."""
    differs = lambda a, b, by: F.abs(F.col(a) - F.col(b)) > by
    return (
        F.when(F.col("opportunity_id").isNull(), "strategy")
        .when(~F.col("noticed"), "behavioural")
        .when(F.col("noticed") & ~F.col("taken"), "behavioural")
        .when(F.abs(F.col("intended_risk_r") - 1.0) > size, "risk")
        .when(differs("actual_entry", "intended_entry", of_spread * F.col("spread_at_fill")), "execution")
        .when(differs("actual_stop", "intended_stop", 0), "risk")
        .when(F.size(F.coalesce("rule_violations", F.array().cast("array<string>"))) > 0, "behavioural")
        .when(differs("actual_r", "theoretical_r", r), "execution")
        .otherwise("variance")
    )


def reconcile(records: DataFrame, **tolerances: float) -> DataFrame:
    """The records (RECORD and whatever else) with their cause."""
    return records.withColumn("cause", cause(**tolerances))


def causes(records: DataFrame) -> DataFrame:
    """(cause, n, lost_r): records by cause, and what they are short of theory."""
    return reconcile(records).groupBy("cause").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("theoretical_r") - F.col("actual_r")).alias("lost_r"))


# Where development ends and what each kind of query may read up to (exclusive); None: everything, with an unlock record.
DEVELOPMENT_END_NS = 1_420_070_400_000_000_000  # 2015-01-01 UTC
READS_UNTIL = {"DESCRIPTIVE_PRE_VAULT": HOLDOUT_NS, "DEVELOPMENT": DEVELOPMENT_END_NS, "VALIDATION": HOLDOUT_NS, "HOLDOUT": None}


@dataclass
class GatedReader:
    """Reads bars for one kind of query. A range beyond what the kind may read fails and is never cut. audit is told of each reader and each violation."""

    spark: SparkSession
    root: str
    kind: str
    family: str | None = None
    unlocked: frozenset[str] = frozenset()
    registered: frozenset[str] = frozenset()
    audit: object = None

    def __post_init__(self) -> None:
        self._tell("reader")
        if self.kind not in READS_UNTIL:
            self._refuse(f"no query is of the kind {self.kind!r}")
        if self.kind == "HOLDOUT" and self.family not in self.unlocked:
            self._refuse(f"no unlock record for {self.family!r}")
        if self.kind == "VALIDATION" and self.family not in self.registered:
            self._refuse(f"no live preregistration for {self.family!r}")

    def _tell(self, what: str) -> None:
        if self.audit:
            self.audit({"what": what, "kind": self.kind, "family": self.family})

    def _refuse(self, why: str) -> None:
        self._tell(f"violation: {why}")
        raise VaultError(why)

    def bars(self, start_ns: int, end_ns: int, instruments: list[str] | None = None) -> DataFrame:
        until = READS_UNTIL[self.kind]
        if until is not None and end_ns > until:
            self._refuse(f"{self.kind} may read until {until}, not until {end_ns}")
        return read_bars(self.spark, self.root, start_ns, end_ns, instruments)


def regime_check(bars: DataFrame, atr: DataFrame, sessions: SessionSet = FX_CORE, names: tuple[str, ...] = ("pre_london", "london", "new_york"), rv_n: int = 60, gap_ns: int = 5 * T.MINUTE) -> DataFrame:
    """The only aggregates of held-out bars: (instrument, year, session, n_days, quartile range and median of the session's range in price and in ATRs and of rv, median
    spread). One row for a year and session, by nothing else. atr: (instrument, day, session, atr) at the session's end."""
    iqr = lambda c, name: [F.percentile(c, F.lit(0.5)).alias(f"median_{name}"), (F.percentile(c, F.lit(0.75)) - F.percentile(c, F.lit(0.25))).alias(f"iqr_{name}")]
    days = session_days(bars, sessions, list(names)).where("n_bars > 0 and observed").join(atr, ["instrument", "day", "session"], "left").withColumn("ratio", F.try_divide("range", F.nullif("atr", F.lit(0.0))))
    ranges = days.groupBy("instrument", F.year("day").alias("year"), "session").agg(F.count(F.lit(1)).alias("n_days"), *iqr("range", "range"), *iqr("ratio", "ratio"))
    rows = with_day(with_mid(realised_volatility(bars, rv_n, gap_ns)))
    inside = F.array_compact(F.array(*(F.when(F.expr(f"ts_utc_ns >= {lo} and ts_utc_ns < {hi}"), F.lit(x.name)) for x in sessions.sessions if x.name in names for lo, hi in [bounds(x, sessions)])))
    each = rows.withColumn("session", F.explode(inside)).groupBy("instrument", F.year("day").alias("year"), "session").agg(*iqr("rv_60m", "rv"), F.percentile("spread_twa", F.lit(0.5)).alias("median_spread"))
    return ranges.join(each, ["instrument", "year", "session"], "left")
