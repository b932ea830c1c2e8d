"""Frames and queries by name.

A frame is a function that gives its SELECT (its argument has the expressions that frames share); it may read input tables and other frames by name. A query is
such a function too. Rendering puts the frames that a query needs, and those they need, in front of it; Catalyst then
prunes columns, pushes filters into the scans and reuses exchanges across the common parts.

A kept frame is planned once: it is written as a table in the shared folder when a query first needs it, and read from
there by all queries of the application, as long as the files of its input tables stay the same. A built frame is a kept
one that a function of (spark, folder of tables) makes, for what SQL has no words for.

oracle(name) is SQL for DuckDB with the same rows: the text of earshot.plans.oracles, which shares nothing with the frames.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from earshot.functions.dialect import SPARK
from earshot.plans.scratch import discard, gathered, written

Text = Callable[[object], str]
Maker = Callable[[SparkSession, str], DataFrame]

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")
FRAMES: dict[str, Text] = {}
QUERIES: dict[str, Text] = {}
KEPT: set[str] = set()
BUILT: dict[str, tuple[Maker, tuple[str, ...]]] = {}

#: Views of written frames, by application, folder, frame and state of the input files.
_views: dict[tuple, tuple[str, str]] = {}


def frame(f: Text) -> Text:
    """Registers a frame under its function's name."""
    FRAMES[f.__name__] = f
    return f


def kept(f: Text) -> Text:
    """Registers a frame that is written when it is first needed."""
    KEPT.add(f.__name__)
    return frame(f)


def built(*tables: str) -> Callable[[Maker], Maker]:
    """Registers a frame that a function makes from these input tables."""

    def register(f: Maker) -> Maker:
        BUILT[f.__name__] = f, tables
        return f

    return register


def query(f: Text) -> Text:
    """Registers a query under its function's name."""
    QUERIES[f.__name__] = f
    return f


def words(sql: str) -> list[str]:
    return re.findall(r"[a-z_][a-z0-9_]*", sql)


def needed(body: str, stop: Callable[[str], bool] = lambda _: False) -> Iterator[tuple[str, str]]:
    """Names and texts of the frames that a body needs, those they need first; no further than names to stop at."""
    seen: set[str] = set()

    def need(sql: str) -> Iterator[tuple[str, str]]:
        for name in words(sql):
            if name not in seen and (name in FRAMES or stop(name)):
                seen.add(name)
                text = "" if stop(name) else FRAMES[name](SPARK)
                yield from need(text)
                yield name, text

    yield from need(body)


def render(body: str, given: dict[str, str] | None = None) -> str:
    """The SQL of a body with the frames it needs in front; those in `given` as they are there."""
    given = given or {}
    out = [f"{n} AS ({given.get(n) or text})" for n, text in needed(body, given.__contains__)]
    return ("WITH " + ",\n".join(out) + "\n" if out else "") + body


def tables_of(body: str) -> set[str]:
    """Input tables that a body reads, through whatever frames."""
    texts = [body] + [text for _, text in needed(body, BUILT.__contains__)]
    names = {w for t in texts for w in words(t)}
    return names & set(TABLES) | {t for n in names & set(BUILT) for t in BUILT[n][1]}


def state_of(spark: SparkSession, sf_dir: str, tables: set[str]) -> tuple:
    """What changes when the files of input tables do."""
    out = []
    for t in sorted(tables):
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{t}.parquet")
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        status = fs.getFileStatus(at) if fs.exists(at) else None
        out.append((t, status and (status.getModificationTime(), status.getLen())))
    return tuple(out)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def view_of(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A view, under a name that nothing else uses, of an input table or of a kept frame, which is written if it isn't yet."""
    app = spark.sparkContext.applicationId
    if name in TABLES:
        key: tuple = (app, sf_dir, name, state_of(spark, sf_dir, {name}))
    else:
        uses = set(BUILT[name][1]) if name in BUILT else tables_of(FRAMES[name](SPARK))
        key = (app, sf_dir, name, state_of(spark, sf_dir, uses))
    if key not in _views or not _exists(spark, _views[key][1]) or not spark.catalog.tableExists(_views[key][0]):
        if name in TABLES:
            path = f"{sf_dir}/{name}.parquet"
            df = spark.read.parquet(path)
        else:
            rows = run_sql(spark, sf_dir, FRAMES[name](SPARK)) if name in FRAMES else None
            with gathered() as made:
                rows = BUILT[name][0](spark, sf_dir) if rows is None else rows
                df = written(rows, name)
            # what a frame was built from and isn't a frame itself
            held = {p for _, p in _views.values()}
            discard(*[t for t in made if t is not df and t._scratch_path not in held])
            path = df._scratch_path
        view = f"earshot_{name}_{uuid.uuid4().hex}"
        df.createOrReplaceTempView(view)
        _views[key] = view, path
    return _views[key][0]


def run_sql(spark: SparkSession, sf_dir: str, body: str) -> DataFrame:
    """A body over the tables of a folder."""

    def whole(name: str) -> bool:
        return name in KEPT or name in BUILT or name in TABLES

    given = {n: f"SELECT * FROM {view_of(spark, sf_dir, n)}" for n, _ in list(needed(body, whole)) if whole(n) and (n not in TABLES or _exists(spark, f"{sf_dir}/{n}.parquet"))}
    return spark.sql(render(body, given))


def run(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The query over the tables of a folder."""
    return run_sql(spark, sf_dir, QUERIES[name](SPARK))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A frame or input table as a DataFrame."""
    return run_sql(spark, sf_dir, f"SELECT * FROM {name}")


def oracle(name: str) -> str:
    """DuckDB SQL with the same rows as the query."""
    from earshot.plans.oracles import ORACLES

    return ORACLES[name]
