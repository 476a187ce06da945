"""Reports of audits: JSON and Markdown files from results of a few rows, written by the driver."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame

#: Rows of one table that a report takes; an audit's results are aggregates, and a larger one is an error, not cut short.
MOST_ROWS = 10_000


def _rows(df: DataFrame) -> list[dict[str, Any]]:
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a report takes at most {MOST_ROWS} rows; aggregate first")
    return [r.asDict(recursive=True) for r in rows]


def write_json(path: str, **tables: DataFrame) -> None:
    Path(path).write_text(json.dumps({n: _rows(df) for n, df in tables.items()}, indent=2, ensure_ascii=False, default=str), encoding="utf-8")


def write_markdown(path: str, title: str, **tables: DataFrame) -> None:
    parts = [f"# {title}"]
    for name, df in tables.items():
        head = f"| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}"
        body = "\n".join("| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in row.values()) + " |" for row in _rows(df))
        parts.append(f"## {name.replace('_', ' ').capitalize()}\n\n{head}\n{body}")
    Path(path).write_text("\n\n".join(parts) + "\n", encoding="utf-8")
