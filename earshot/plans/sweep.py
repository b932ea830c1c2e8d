"""Timed runs over a grid of settings, and percentiles of their times."""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame


def latencies(seconds: Iterable[float]) -> dict[str, float]:
    """Median and 95th percentile by nearest rank."""
    s = sorted(seconds)
    if not s:
        return {}
    mid = len(s) // 2
    return {"p50": s[mid] if len(s) % 2 else (s[mid - 1] + s[mid]) / 2, "p95": s[min(len(s) - 1, int(len(s) * 0.95))]}


def sweep(run: Callable[..., DataFrame], grid: Mapping[str, Iterable], calls: int = 1) -> list[dict]:
    """The settings, the rows and the times of `run` for each combination of the grid's values."""
    out = []
    for values in itertools.product(*grid.values()):
        settings, times, rows = dict(zip(grid, values, strict=True)), [], []
        for _ in range(calls):
            began = time.perf_counter()
            rows = [tuple(r) for r in run(**settings).collect()]
            times.append(time.perf_counter() - began)
        out.append({"settings": settings, "rows": rows} | latencies(times))
    return out


def overlap(a: Iterable, b: Iterable) -> float:
    """Jaccard similarity of two lists as sets; 1 if both are empty."""
    x, y = set(a), set(b)
    return len(x & y) / len(x | y) if x | y else 1.0
