"""Reports of small results: Markdown for people, Parquet beside it for programs, JSON logs, box plots as SVG. All on the driver."""

from __future__ import annotations

import html
import json
import os
import subprocess
from collections.abc import Iterable
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, Row

from tidemark.functions.canonical import canonical_json, sha256_file
from tidemark.operators.describe import MARKED, SUPPRESSED
from tidemark.operators.quality import findings, first_samples, ordered

SCHEMA_VERSION = 1


class LogError(RuntimeError):
    """A side log that can't be read as what it should be."""


def put(path: str | Path, text: str) -> Path:
    """Writes aside and renames, so that readers see the old file or the new one."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    aside = path.with_name(path.name + ".new")
    aside.write_text(text, encoding="utf-8")
    os.replace(aside, path)
    return path


def code_version(folder: str | Path = ".") -> str:
    try:
        sha = subprocess.run(["git", "-C", str(folder), "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10)
        return sha.stdout.strip() if sha.returncode == 0 else "unknown"
    except (OSError, subprocess.TimeoutExpired):
        return "unknown"


def now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def number(x: object, digits: int = 6) -> str:
    return "-" if x is None else f"{x:.{digits}f}" if isinstance(x, float) else str(x)


def grid(rows: Iterable[Row], columns: list[str]) -> str:
    out = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    for r in rows:
        cells = []
        for c in columns:
            v = r[c]
            cells.append(number(v) if not isinstance(v, list) else ", ".join(map(str, v)))
        out.append("| " + " | ".join(x.replace("|", "\\|") for x in cells) + " |")
    return "\n".join(out)


def cells(rows: Iterable[Row], columns: list[str], shown: list[str]) -> str:
    """Like grid, but the shown columns of cells of fewer than SUPPRESSED rows are left out and those of fewer than MARKED are marked."""
    kept = []
    for r in rows:
        d = r.asDict()
        if d["n"] < SUPPRESSED:
            d |= dict.fromkeys(shown)
        d["note"] = "suppressed" if d["n"] < SUPPRESSED else "small sample" if d["n"] < MARKED else ""
        kept.append(Row(**d))
    return grid(kept, [*columns, "note"])


def write_report(path: str | Path, title: str, sections: list[tuple[str, str]], sidecar: DataFrame | None = None, settings: dict | None = None) -> Path:
    """A Markdown report with its settings and code version; sidecar: all rows, as Parquet in a folder of the same name."""
    head = [f"# {title}", "", f"Made {now()} by {code_version()}.", ""]
    if settings:
        head += ["Settings: `" + canonical_json(settings) + "`", ""]
    text = "\n".join(head) + "\n".join(f"\n## {name}\n\n{body}\n" for name, body in sections)
    if sidecar is not None:
        sidecar.write.mode("overwrite").option("compression", "zstd").parquet(str(Path(path).with_suffix(".parquet")))
    return put(path, text)


def quality_report(path: str | Path, samples: DataFrame, label: str, shown: int = 10) -> Path:
    """Findings by severity, with at most so many samples each. Beside the report: all findings, and all samples, a row for each."""
    found = ordered(findings(samples))
    rows = found.collect()  # a few for each check, instrument and year
    first = {(r["instrument"], r["check_id"], r["year"]): r["sample"] for r in first_samples(samples, shown).collect()}
    brief = [Row(**(r.asDict() | {"sample": first.get((r["instrument"], r["check_id"], r["year"]), [])})) for r in rows]
    tally = {s: sum(r["severity"] == s and r["count"] > 0 for r in rows) for s in ("ERROR", "WARNING", "INFO")}
    sections = [("Outcome", f"{'not ' if tally['ERROR'] else ''}sealable; " + ", ".join(f"{n} {s}" for s, n in tally.items())), ("Findings", grid(brief, ["check_id", "check_name", "severity", "instrument", "year", "count", "detail", "sample"]) if brief else "none")]
    samples.write.mode("overwrite").option("compression", "zstd").parquet(str(Path(path).with_suffix(".samples.parquet")))
    return write_report(path, f"Data quality, {label}", sections, found)


def gate_report(path: str | Path, decision: Row, counts: DataFrame, eligible: DataFrame, events: DataFrame, settings: dict, widened_from: str | None = None) -> Path:
    """The events' counts by year and what the gate says."""
    by_year = counts.groupBy("instrument", "year").pivot("context").sum("n").orderBy("instrument", "year")
    sections = [
        ("Scope", f"instrument {decision['instrument']}"), ("Settings", f"`{canonical_json(settings)}`"), ("Widening", widened_from or "none"),
        ("Counts by year", grid(by_year.collect(), by_year.columns)), ("Eligible days", grid(eligible.collect(), eligible.columns)),
        ("Years", f"{decision['n_years']} admissible"), ("Arithmetic", f"narrowest {decision['narrowest']}: median {number(decision['median'], 2)}, tenth percentile {number(decision['p10'], 2)}"), ("Decision", decision["decision"]),
    ]
    return write_report(path, "Event counts and gate", sections, events, settings)


def read_log(path: str | Path) -> list | dict | None:
    """None if there is no log; one that is malformed or of another schema version fails."""
    path = Path(path)
    if not path.exists():
        return None
    try:
        data = json.loads(path.read_text(encoding="utf-8"))
    except ValueError as e:
        raise LogError(f"{path}: {e}") from e
    if not isinstance(data, dict) or "entries" not in data:
        raise LogError(f"{path}: no entries")
    if data.get("schema_version") != SCHEMA_VERSION:
        raise LogError(f"{path}: schema version {data.get('schema_version')!r}")
    return data["entries"]


def append_log(path: str | Path, entry: dict) -> Path:
    entries = read_log(path) or []
    return put(path, canonical_json({"schema_version": SCHEMA_VERSION, "entries": [*entries, entry]}))


def record_widening(path: str | Path, entry: dict) -> Path:
    """Adds a run to the lineage; contexts are widened once, a second time is refused."""
    if entry.get("widened_from") and any(e.get("widened_from") for e in read_log(path) or []):
        raise LogError("the contexts have been widened before")
    return append_log(path, entry)


def import_entry(csv: str | Path, how: dict, rows: int) -> dict:
    """Where a month's ticks come from: the file, its digest, how its columns and clock were told."""
    return {"file": Path(csv).name, "sha256": sha256_file(csv), "rows": rows, "imported_utc": now(), **how}


def box_plot(panels: list[tuple[str, list[dict]]], width: int = 220, height: int = 240) -> str:
    """Panels (title, boxes) side by side, each with a scale of its own. A box: label, low, q1, median, q3, high, outliers."""
    parts = []
    for p, (title, boxes) in enumerate(panels):
        values = [v for b in boxes for v in (b["low"], b["high"], *b.get("outliers", []))]
        lo, hi = (min(values), max(values)) if values else (0.0, 1.0)
        span, top, left = (hi - lo) or 1.0, 30, p * width
        y = lambda v: top + (height - 60) * (1 - (v - lo) / span)  # noqa: B023, E731
        parts.append(f'<text x="{left + 8}" y="18" font-size="12">{html.escape(title)}</text>')
        parts += [f'<text x="{left + 2}" y="{y(v):.1f}" font-size="8">{v:.4g}</text>' for v in (lo, hi)]
        step = (width - 50) / max(1, len(boxes))
        for k, b in enumerate(boxes):
            x, w = left + 45 + k * step, max(4.0, step * 0.6)
            mid = x + w / 2
            parts.append(f'<line x1="{mid:.1f}" x2="{mid:.1f}" y1="{y(b["low"]):.1f}" y2="{y(b["high"]):.1f}" stroke="black"/>')
            parts.append(f'<rect x="{x:.1f}" y="{y(b["q3"]):.1f}" width="{w:.1f}" height="{max(0.5, y(b["q1"]) - y(b["q3"])):.1f}" fill="lightgrey" stroke="black"/>')
            parts.append(f'<line x1="{x:.1f}" x2="{x + w:.1f}" y1="{y(b["median"]):.1f}" y2="{y(b["median"]):.1f}" stroke="black" stroke-width="2"/>')
            parts += [f'<circle cx="{mid:.1f}" cy="{y(v):.1f}" r="1.5"/>' for v in b.get("outliers", [])]
            parts.append(f'<text x="{mid:.1f}" y="{height - 12}" font-size="9" text-anchor="middle">{html.escape(str(b["label"]))}</text>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width * max(1, len(panels))}" height="{height}">' + "".join(parts) + "</svg>"
