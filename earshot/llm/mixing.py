"""Operator 3: mixing overlapping sources to target weights by a minimum-cost flow.

Documents are aggregated by membership pattern (the set of sources that hold them). Capacity flows from each pattern to
its sources' quotas: a document's first reading costs nothing, each repetition costs more than the one before (convex),
so the cheapest flow repeats as little as it can. The flow has one node per pattern and source, however many documents
there are. Each pattern's words then stand in one seeded order (md5 of seed and doc_id, then doc_id, then size); every
flow takes an interval of that line, and a document's share is the overlap with its own words.

Cases: a null or empty text has size 0 and is taken 0 times; a null source is a source of its own, last in order;
ties and repeated rows are ordered by doc_id and size, equal rows among themselves alike; an empty table gives no rows;
other columns, whatever their names, are ignored by `mix` and kept by `mixed_docs`.
"""

from __future__ import annotations

from collections import deque
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.llm.common import cut

SEED = "mix.v1"
WEIGHTS = (3, 1, 2)
SHARE = Fraction(3, 2)
REPEATS = 2
#: Parts that the seeded order of a pattern is dealt into; a window sorts one part.
PARTS_HEX = 3
#: Most patterns and sources that the driver solves a flow for. It is an error to have more, not a cut.
MOST_NODES = 10_000


def words(text: str = "text") -> Column:
    """Number of words of a text column; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: dict, order: list, weights: tuple = WEIGHTS, share: Fraction = SHARE, most: int = REPEATS) -> dict:
    """Quota of each source: a weighted share of all sizes; what exceeds `most` times a size is shared again by weight."""
    w = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(order)}
    left, out, free = share * sum(sizes.values()), {}, [s for s in order if sizes[s]]
    out = {s: Fraction(0) for s in order}
    while free:
        unit = left / sum(w[s] for s in free)
        full = [s for s in free if unit * w[s] >= most * sizes[s]]
        if not full:
            out |= {s: unit * w[s] for s in free}
            break
        for s in full:
            out[s] = Fraction(most * sizes[s])
            left -= out[s]
        free = [s for s in free if s not in set(full)]
    return out


def flow(capacity: dict, members: dict, quota: dict, repeats: int = REPEATS) -> dict:
    """Minimum-cost flow {(pattern, layer, source): words}; layer k is the (k+1)th reading, which costs k a word.

    Successive shortest paths: costs are only on the arcs into patterns and rise with the layer, so paths of one cost
    are exhausted (by breadth-first augmentation) before the next layer opens.
    """
    sources = list(quota)
    sent: dict[tuple, int] = {}
    room = dict(quota)
    at: dict = {s: [] for s in sources}
    for p, m in members.items():
        for s in m:
            at[s].append(p)
    for layer in range(repeats):
        spare = dict(capacity)
        for p in capacity:
            while spare[p]:
                # a path: pattern -> source [-> pattern that sends there -> its other source ...] with room left
                came: dict = {("p", p): None}
                todo, end = deque([("p", p)]), None
                while todo and end is None:
                    kind, x = node = todo.popleft()
                    if kind == "p":
                        for s in members[x]:
                            if ("s", s) not in came:
                                came["s", s] = node
                                if room[s]:
                                    end = ("s", s)
                                    break
                                todo.append(("s", s))
                    else:
                        for q in at[x]:
                            if ("p", q) not in came and any(sent.get((q, k, x)) for k in range(repeats)):
                                came["p", q] = node
                                todo.append(("p", q))
                if end is None:
                    break
                path = [end]
                while came[path[-1]] is not None:
                    path.append(came[path[-1]])
                path.reverse()
                give = min(spare[p], room[end[1]])
                moves = [(path[i][1], path[i + 1][1]) for i in range(2, len(path) - 1, 2)]
                backs = [(path[i + 1][1], path[i][1]) for i in range(1, len(path) - 1, 2)]
                for q, s in backs:
                    give = min(give, sum(sent.get((q, k, s), 0) for k in range(repeats)))
                sent[p, layer, path[1][1]] = sent.get((p, layer, path[1][1]), 0) + give
                for (q, s), (_, to) in zip(backs, moves, strict=True):
                    need = give
                    for k in range(repeats):
                        x = min(need, sent.get((q, k, s), 0))
                        if x:
                            sent[q, k, s] -= x
                            sent[q, k, to] = sent.get((q, k, to), 0) + x
                            need -= x
                spare[p] -= give
                room[end[1]] -= give
        if not any(room.values()):
            break
    return {k: v for k, v in sent.items() if v}


def mix(docs: DataFrame, sources: Column, size: Column, doc_id: str = "doc_id", extra: tuple[str, ...] = (), seed: str = SEED, weights: tuple = WEIGHTS, share: Fraction = SHARE, repeats: int = REPEATS) -> tuple[DataFrame, dict]:
    """Rows (doc_id, *extra, sources, size, taken, copies) and the targets by source.

    sources: an array column of the sources that hold the document (a null element is a source too). taken: words the
    mix takes, repeats counted; copies: taken as whole readings, to the nearest.
    """
    spark = docs.sparkSession
    h = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
    base = cut(
        docs.select(
            F.col(doc_id).alias("id"), *[F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(extra)], F.array_sort(F.array_distinct(sources)).alias("pattern"), size.cast("bigint").alias("size"), h.alias("h")
        ).withColumn("part", F.substring("h", 1, PARTS_HEX)).withColumn("key", F.to_json(F.struct(F.col("pattern").alias("p")), {"ignoreNullFields": "false"})),
        "mix",
    )
    parts = cut(base.groupBy("key", "part").agg(F.first("pattern").alias("pattern"), F.sum("size").alias("size")), "parts")
    totals = parts.groupBy("key").agg(F.first("pattern").alias("pattern"), F.sum("size").alias("size")).limit(MOST_NODES + 1).collect()
    if len(totals) > MOST_NODES:
        raise ValueError(f"over {MOST_NODES} membership patterns; group sources first")
    members = {r["key"]: list(r["pattern"]) for r in totals}
    capacity = {r["key"]: r["size"] for r in totals}
    order = sorted({s for m in members.values() for s in m}, key=lambda s: (s is None, s or ""))
    held = dict.fromkeys(order, 0)
    for k, m in members.items():
        for s in m:
            held[s] += capacity[k]
    goal = targets(held, order, weights, share, repeats)
    sent = flow(capacity, members, {s: int(goal[s]) for s in order}, repeats)
    spans = []
    for k in sorted(capacity):
        for layer in range(repeats):
            at = 0
            for s in order:
                if n := sent.get((k, layer, s)):
                    spans.append((k, at, at + n))
                    at += n
    taken_of = spark.createDataFrame(spans, "key string, a bigint, b bigint").groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    before = parts.select("key", "part", (F.sum("size").over(Window.partitionBy("key").orderBy("part")) - F.col("size")).alias("before")).join(taken_of, "key", "left")
    seeded = Window.partitionBy("key", "part").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("before") + F.sum("size").over(seeded)
    out = base.join(before, ["key", "part"]).withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))
    overlap = F.aggregate(
        F.coalesce(F.col("spans"), F.array().cast("array<struct<a:bigint,b:bigint>>")),
        F.lit(0).cast("bigint"),
        lambda n, x: n + F.greatest(F.lit(0).cast("bigint"), F.least(F.col("end"), x["b"]) - F.greatest(F.col("start"), x["a"])),
    )
    out = out.withColumn("taken", overlap)
    copies = F.when(F.col("size") > 0, F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size")))).otherwise(0).cast("bigint")
    return out.select(F.col("id").alias(doc_id), *[F.col(f"x{i}").alias(c) for i, c in enumerate(extra)], "pattern", "size", "taken", copies.alias("copies")), goal | {"held": held}


def mix_sources(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, taken, copies) of the contract."""
    rows, goal = mix(docs.select("doc_id", "source", "text"), F.array("source"), words())
    held = goal.pop("held")
    dims = docs.sparkSession.createDataFrame([(s, int(held[s]), float(goal[s])) for s in held], "source string, source_size bigint, target double")
    return rows.withColumn("s", F.col("pattern")[0]).join(dims, F.col("s").eqNullSafe(F.col("source"))).select("doc_id", "source", "size", "source_size", "target", "taken", "copies")


def mixed_docs(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix reads it (in whole copies), with docs' own columns.

    A row is found again by a digest of all its columns; equal rows share their copies.
    """
    names = docs.columns
    tmp = [f"c{i}" for i in range(len(names))]
    at = dict(zip(names, tmp, strict=True))
    plain = docs.select(*[F.col(f"`{c}`").alias(t) for c, t in at.items()])
    own = [F.coalesce(F.col(at[c]).cast("string"), F.lit("")) for c in ("doc_id", "source", "text")]
    row = plain.withColumn("rid", F.concat(F.md5(F.concat_ws("\x01", *own)), F.hex(F.xxhash64(*tmp))))
    sizes = row.select("rid", F.col(at["doc_id"]).alias("doc_id"), F.col(at["source"]).alias("source"), F.col(at["text"]).alias("text"))
    got, _ = mix(sizes, F.array("source"), words(), extra=("rid",))
    copies = got.groupBy(F.col("rid").alias("r")).agg(F.sum("copies").alias("n")).where("n > 0")
    both = row.dropDuplicates(["rid"]).join(copies, F.col("rid") == F.col("r"))
    again = both.withColumn("i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))
    return again.select(*[F.col(t).alias(c) for c, t in at.items()])


def oracle() -> str:
    """The same rows in DuckDB SQL."""
    return rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w
  FROM d GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS k FROM s WHERE source_size > 0
), lines AS (
  SELECT *, (1.5e0 * sum(source_size) OVER ()
             - coalesce(sum(2 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unit
  FROM ranked
), level AS (
  SELECT min(k) AS k, min_by(unit, k) AS unit FROM lines WHERE unit * w < 2 * source_size
), t AS (
  SELECT s.source, s.source_size,
         CASE WHEN s.source_size = 0 THEN 0e0 WHEN ranked.k < level.k THEN 2e0 * s.source_size ELSE level.unit * s.w END AS target
  FROM s LEFT JOIN ranked ON s.source IS NOT DISTINCT FROM ranked.source, level
), line AS (
  SELECT d.*, t.source_size, t.target, CAST(floor(t.target + 1e-6) AS BIGINT) AS q,
         CAST(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS b
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), got AS (
  SELECT *, greatest(0, least(b, least(q, source_size)) - (b - size)) + greatest(0, least(b, q - source_size) - (b - size)) AS taken
  FROM line
)
SELECT doc_id, source, size, source_size, CAST(target AS DOUBLE) AS target, CAST(taken AS BIGINT) AS taken,
       CAST(CASE WHEN size > 0 THEN (2 * taken + size) // (2 * size) ELSE 0 END AS BIGINT) AS copies
FROM got
"""
