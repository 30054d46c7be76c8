"""Rounding and layout of small results on the driver; engines keep full precision."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame


def rounded(value: float | None, digits: int = 4) -> float | None:
    """As Python rounds: half to even on the exact binary value."""
    return None if value is None else round(value, digits)


def cell(value: object) -> str:
    return "—" if value is None else f"{value:.4f}" if isinstance(value, float) else str(value)


def markdown_table(rows: DataFrame, columns: list[str]) -> str:
    """A small result as a Markdown table."""
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    lines += ["| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in rows.select(*columns).collect()]
    return "\n".join(lines)


def summary(groups: DataFrame, faith: DataFrame, drift: DataFrame, deltas: DataFrame) -> dict:
    """The summary of runs as one nested value, rounded."""
    clean = lambda r: {k: rounded(v) if isinstance(v, float) else v for k, v in r.asDict().items()}
    rows = [clean(r) for r in groups.orderBy("mode", "deletion_size").collect()]
    by_metric: dict[str, dict] = {}
    for r in drift.collect():
        by_metric.setdefault(r["metric"], {})[r["mode"]] = rounded(r["r"])
    return {
        "n_total_runs": sum(r["n_total"] for r in rows),
        "groups": rows,
        "faithfulness_by_mode": {r["mode"]: rounded(r["r"]) for r in faith.collect()},
        "drift_faithfulness": by_metric,
        "baseline_vs_agent": [clean(r) for r in deltas.orderBy("deletion_size").collect()],
    }


def summary_json(value: dict) -> str:
    return json.dumps(value, indent=2, sort_keys=True)


def section(title: str, rows: DataFrame) -> str:
    """A titled block of text with one line per row."""
    body = ["  " + "  ".join(cell(v) for v in r) for r in rows.collect()]
    return "\n".join(["", title, "-" * 60, *body])
