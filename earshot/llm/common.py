"""What the operators of this subpackage share: inputs, scratch tables, packaging and connected components."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.plans.scratch import discard, gathered, ship  # noqa: F401
from earshot.plans.scratch import new_path as scratch  # noqa: F401
from earshot.plans.scratch import written as cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, read by Spark alone, so any store that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow(function, kind: str):
    """An Arrow function over columns; marked so that the optimizer never evaluates it twice for a row."""
    return F.arrow_udf(function, kind).asNondeterministic()


_lean: list[bool] = []


def lean() -> None:
    """In a Python worker: has freed Arrow and NumPy memory go back to the system, since idle workers stay alive."""
    if not _lean:
        _lean.append(True)
        pa.set_memory_pool(pa.system_memory_pool())
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).mallopt(-3, 1 << 18)  # M_MMAP_THRESHOLD, which otherwise rises with use


def free_name(columns: Iterable[str], stem: str) -> str:
    """stem, with underscores in front until no column is called so, in either case."""
    taken = {c.lower() for c in columns}
    while stem.lower() in taken:
        stem = "_" + stem
    return stem


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph, as rows (node, root) with root the smallest node.

    Alternates large-star and small-star steps. A step is two joins on min() aggregates, so a node with many
    neighbours is never gathered in one task; each step's edges are a table in the shared folder. Only nodes
    that have an edge to another node are returned.
    """
    x, y = F.col(a), F.col(b)
    e = cut(
        edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(),
        "edges",
    )
    mark = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark or now[0] == 0:
            break
        mark = now
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
        large = cut(e.join(low, "v").select("u", F.col("m").alias("v")).distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(low, "u")
        small = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, e = e, cut(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "small")
        discard(before, large)
    out = e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
    out._scratch_path = e._scratch_path
    return out
