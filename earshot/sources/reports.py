"""Summaries at the edge: JSON, Markdown tables, the data behind figures, and tables by name. Inputs are small aggregates."""

from __future__ import annotations

import json
import math
from pathlib import Path

from pyarrow import fs as pafs
from pyspark.sql import DataFrame


def _write(path: str, text: str) -> None:
    system, inner = pafs.FileSystem.from_uri(path if "://" in path else Path(path).absolute().as_uri())
    with system.open_output_stream(inner) as out:
        out.write(text.encode())


def nested(rows: DataFrame, *keys: str) -> dict:
    """Rows as dictionaries within dictionaries by the keys."""
    out: dict = {}
    for r in rows.collect():
        at = out
        for k in keys:
            at = at.setdefault(str(r[k]), {})
        at |= {c: None if isinstance(r[c], float) and math.isnan(r[c]) else r[c] for c in rows.columns if c not in keys}
    return out


def write_json(rows: DataFrame, path: str, *keys: str) -> None:
    """A summary as JSON, by the keys."""
    _write(path, json.dumps(nested(rows, *keys), indent=2, sort_keys=True, default=str))


def markdown(title: str, tables: dict[str, DataFrame], digits: int = 4) -> str:
    """A report of a table under a heading each."""

    def cell(x) -> str:
        return "-" if x is None else f"{x:.{digits}f}" if isinstance(x, float) else str(x)

    out = [f"# {title}"]
    for name, rows in tables.items():
        lines = sorted(tuple(map(cell, r)) for r in rows.collect())
        out += ["", f"## {name}", "", "| " + " | ".join(rows.columns) + " |", "|" + "-|" * len(rows.columns), *("| " + " | ".join(r) + " |" for r in lines)]
    return "\n".join(out) + "\n"


def write_report(path: str, title: str, tables: dict[str, DataFrame]) -> None:
    _write(path, markdown(title, tables))


def write_tables(folder: str, tables: dict[str, DataFrame]) -> None:
    """Each table as zstd Parquet under its name."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{name}.parquet")


def svg_line(points: list[tuple[float, float]], title: str, width: int = 480, height: int = 320) -> str:
    """A line through the points, scaled to the frame."""
    xs, ys = [p[0] for p in points] or [0.0], [p[1] for p in points] or [0.0]
    dx, dy = max(xs) - min(xs) or 1.0, max(ys) - min(ys) or 1.0
    at = " ".join(f"{20 + (x - min(xs)) / dx * (width - 40):.1f},{height - 20 - (y - min(ys)) / dy * (height - 60):.1f}" for x, y in points)
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"><text x="20" y="24">{title}</text><polyline fill="none" stroke="black" points="{at}"/></svg>'


def write_figure(rows: DataFrame, x: str, y: str, path: str, title: str) -> None:
    """A line of two columns as SVG."""
    _write(path, svg_line([(float(r[0]), float(r[1])) for r in rows.select(x, y).orderBy(x).collect()], title))
