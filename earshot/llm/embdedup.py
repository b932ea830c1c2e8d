"""Operator 8: near-duplicate vectors by PCA-ordered tiled comparison.

Vectors are normalised in double precision; equal ones are one node with a weight. The second-moment matrix (one small
sum per task) gives an orthonormal basis; coordinates in descending eigenvalue order put most of a product into the
first few. Nodes are dealt into leaves by their leading coordinates, and leaves into tiles; a tile is one packed row with
its box. Tile pairs whose boxes allow the threshold meet; of their blocks, leaf by leaf, those whose boxes do are
compared: the product is accumulated over growing runs of leading dimensions, and a pair
of vectors is dropped as soon as what it has plus the product of its suffix norms stays below the threshold. Pairs that
survive are decided by the cosine of the given vectors in double precision. A tile pair emits, per node, a count of
links, and a spanning forest of them, so a dense group of m vectors gives rows in proportion to m per pair of tiles.

Cases: null, zero or non-finite vectors (or with null components) link with nothing and are components of their own;
vectors of different lengths never link; a repeated vec_id is one vector if its rows are equal, else as many as it has
rows, all under the one id and with their links added up; ties cannot arise; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import components, cut, ship

THRESHOLD = 0.9
#: Nodes in a tile, on average, and in a leaf. What is shuffled falls with the size of a tile, what is compared with
#: that of a leaf.
TILE, LEAF = 16384, 1024
#: Most tiles, whose boxes (2 x dimensions x 8 bytes each) are broadcast; more vectors make larger tiles.
MOST_TILES = 20_000
#: Leading dimensions after which pairs are dropped.
RUNS = (8, 16, 32)
#: Room for rounding in the bounds; the decision itself has none.
SLACK = 1e-6


def usable(v: str = "embedding"):
    """The vector in doubles, or null if it can't link."""
    x = F.transform(F.col(v), lambda c: c.cast("double"))
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)
    return F.when(F.col(v).isNotNull() & good, x)


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.empty((0, 0))


def scaled(x: np.ndarray) -> np.ndarray:
    """The vectors times powers of two that bring their largest components to about 1, so squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) if len(x) else x


def _unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def basis(nodes: DataFrame, dim: int) -> np.ndarray:
    """Orthonormal columns in descending order of the second moment; one dim x dim sum per task."""

    def moments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            u = _unit(_matrix(batch.column(0)))
            total += u.T @ u if len(u) else 0
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    rows = nodes.select("x").mapInArrow(moments, "i int, row array<double>")
    summed = rows.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    m = np.zeros((dim, dim))
    for r in summed:
        m[r["i"], r["j"]] = r["v"]
    return np.linalg.eigh((m + m.T) / 2)[1][:, ::-1].copy()


def cuts(nodes: DataFrame, turn: np.ndarray, n: int, tile: int) -> list[tuple[int, float]]:
    """A median tree over leading coordinates, fitted on a bounded sample: inner nodes in level order as (axis, cut)."""
    depth = max(0, int(np.ceil(np.log2(max(1, n / tile)))))
    sample = nodes.orderBy(F.xxhash64("node")).limit(min(20_000, max(1, 64 << depth))).select("x").collect() if depth else []
    if not depth:
        return []
    x = _unit(np.array([r["x"] for r in sample])) @ turn
    out: list[tuple[int, float]] = []
    groups = [x]
    for level in range(depth):
        axis = level % x.shape[1]
        after = []
        for g in groups:
            at = float(np.median(g[:, axis])) if len(g) else 0.0
            out.append((axis, at))
            after += [g[g[:, axis] < at], g[g[:, axis] >= at]]
        groups = after
    return out


def leaf(y: np.ndarray, tree: list[tuple[int, float]]) -> np.ndarray:
    """Leaf of each row of coordinates."""
    at = np.zeros(len(y), np.int64)
    depth = (len(tree) + 1).bit_length() - 1
    if not depth:
        return at
    axis, place = np.array([a for a, _ in tree]), np.array([c for _, c in tree])
    for level in range(depth):
        inner = (1 << level) - 1 + at
        at = 2 * at + (y[np.arange(len(y)), axis[inner]] >= place[inner])
    return at


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of a spanning forest among the pairs (a[i], b[i]): the larger root hooks onto the smaller, in rounds."""
    if not len(a):
        return np.empty(0, np.int64)
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label, left, out = np.arange(len(names)), np.arange(len(a)), []
    while True:
        high, low = np.maximum(label[x[left]], label[y[left]]), np.minimum(label[x[left]], label[y[left]])
        open_ = high != low
        left, high, low = left[open_], high[open_], low[open_]
        if not len(left):
            return np.sort(np.concatenate(out)) if out else np.empty(0, np.int64)
        order = np.lexsort((low, high))
        hooked, first = np.unique(high[order], return_index=True)
        out.append(left[order[first]])
        label_of = np.arange(len(names))
        label_of[hooked] = low[order[first]]
        while (further := label_of[label_of]).tolist() != label_of.tolist():
            label_of = further
        label = label_of[label]


def surviving(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of two blocks of rotated unit vectors that the bounds can't drop."""
    dim = a.shape[1]
    low = threshold - SLACK
    runs = [r for r in RUNS if r < dim]
    fa, fb = a.astype(np.float32), b.astype(np.float32)
    first = runs[0] if runs else dim
    part = fa[:, :first] @ fb[:, :first].T
    if first < dim:
        rest_a = np.sqrt((fa[:, first:] ** 2).sum(axis=1))
        rest_b = np.sqrt((fb[:, first:] ** 2).sum(axis=1))
        i, j = np.nonzero(part >= np.float32(low - 1e-4) - rest_a[:, None] * rest_b[None, :])
    else:
        i, j = np.nonzero(part >= np.float32(low - 1e-4))
    held = part[i, j].astype(np.float64)
    for at, upto in zip(runs, [*runs[1:], dim] if runs else [], strict=True):
        if not len(i):
            break
        if len(i) > 0.05 * part.size:
            # too many for gathering: a whole product of the next run
            part = part + fa[:, at:upto] @ fb[:, at:upto].T
            held = part[i, j].astype(np.float64)
        else:
            held = held + np.einsum("ij,ij->i", a[i, at:upto], b[j, at:upto])
        rest = np.sqrt((a[:, upto:] ** 2).sum(axis=1))[i] * np.sqrt((b[:, upto:] ** 2).sum(axis=1))[j]
        keep = held + rest >= low - 1e-4
        i, j, held = i[keep], j[keep], held[keep]
    return i, j


def apart(a: list[tuple[np.ndarray, np.ndarray]], b: list[tuple[np.ndarray, np.ndarray]], far: float) -> np.ndarray:
    """For each box (low, high) of one list and of another, whether they are too far apart for a link."""
    low, high = (np.array([x[k] for x in a])[:, None] for k in range(2))
    low_b, high_b = (np.array([x[k] for x in b])[None] for k in range(2))
    gap = np.maximum(0, np.maximum(low - high_b, low_b - high))
    return (gap * gap).sum(axis=2) > far


def _compare(threshold: float, turn: np.ndarray, step: int = LEAF):
    """Links between the vectors of tile pairs: rows (kind 0, node, links, 0) and forest edges (kind 1, a, 0, b)."""

    dim = turn.shape[0]

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = [np.frombuffer(r[k], np.int64) for k in ("ids_a", "ids_b")]
                weight = [np.frombuffer(r[k], np.int64) for k in ("w_a", "w_b")]
                given = [scaled(np.frombuffer(r[k], np.float64).reshape(-1, dim)) for k in ("x_a", "x_b")]
                turned = [_unit(x) @ turn for x in given]
                same = r["a"] == r["b"]
                links = [np.zeros(len(i), np.int64) for i in ids]
                ea, eb = [], []
                boxes = [[(y[k : k + step].min(axis=0), y[k : k + step].max(axis=0)) for k in range(0, len(y), step)] for y in turned]
                skip = apart(*boxes, 2 - 2 * threshold + SLACK)
                for s in range(0, len(ids[0]), step):
                    for t in range(s if same else 0, len(ids[1]), step):
                        if skip[s // step, t // step]:
                            continue
                        i, j = surviving(turned[0][s : s + step], turned[1][t : t + step], threshold)
                        i, j = i + s, j + t
                        if same:
                            keep = i < j
                            i, j = i[keep], j[keep]
                        for k in range(0, len(i), 1 << 18):
                            p, q = i[k : k + (1 << 18)], j[k : k + (1 << 18)]
                            x, y = given[0][p], given[1][q]
                            cosine = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
                            good = cosine >= threshold
                            p, q = p[good], q[good]
                            np.add.at(links[0], p, weight[1][q])
                            np.add.at(links[1], q, weight[0][p])
                            tree = _forest(ids[0][p], ids[1][q])
                            ea.append(ids[0][p][tree])
                            eb.append(ids[1][q][tree])
                a, b = (np.concatenate(e) if e else np.empty(0, np.int64) for e in (ea, eb))
                tree = _forest(a, b)
                a, b = a[tree], b[tree]
                hit = [np.flatnonzero(x) for x in links]
                node = np.concatenate([ids[0][hit[0]], ids[1][hit[1]], a])
                count = np.concatenate([links[0][hit[0]], links[1][hit[1]], np.zeros(len(a), np.int64)])
                kind = np.concatenate([np.zeros(len(node) - len(a), np.int32), np.ones(len(a), np.int32)])
                to = np.concatenate([np.zeros(len(node) - len(a), np.int64), b])
                if len(node):
                    yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(node), pa.array(count), pa.array(to)], names=["kind", "node", "links", "other"])

    return compare


def _pack(turn: np.ndarray, tree: list[tuple[int, float]], tile: int):
    """Rows of packed vectors from rows (tile, leaf, node, w, x) sorted by tile and leaf: at most 2 x tile in one."""
    dim = turn.shape[0]

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, now, part = 0, None, 0

        def close() -> pa.RecordBatch:
            ids, w, x = (np.concatenate([h[k] for h in held]) for k in range(3))
            y = _unit(x) @ turn
            row = {"leaf": [now], "n": [len(ids)], "ids": [ids.tobytes()], "w": [w.tobytes()], "x": [x.tobytes()], "low": [y.min(axis=0).tolist()], "high": [y.max(axis=0).tolist()]}
            held.clear()
            return pa.RecordBatch.from_pydict(row, schema=_TILE)

        for batch in batches:
            leaves = batch.column(0).to_numpy()
            ends = [*(np.flatnonzero(np.diff(leaves)) + 1).tolist(), len(leaves)] if len(leaves) else []
            at = 0
            for end in ends:
                if now is not None and leaves[at] != now and held:
                    yield close()
                    size = 0
                now = int(leaves[at])
                for s in range(at, end, tile):
                    rows = batch.slice(s, min(tile, end - s))
                    held.append((rows.column(2).to_numpy(), rows.column(3).to_numpy(), _matrix(rows.column(4))))
                    size += rows.num_rows
                    if size >= tile:
                        yield close()
                        size = 0
                at = end
        if held:
            yield close()

    return pack


_TILE = pa.schema([("leaf", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("w", pa.binary()), ("x", pa.binary()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))])
TILE_TYPE = "leaf bigint, n bigint, ids binary, w binary, x binary, low array<double>, high array<double>"


def links(nodes: DataFrame, dim: int, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """Rows (kind, node, links, other) of all tile pairs, from nodes (node, w, x) of one dimension."""
    spark = nodes.sparkSession
    n = nodes.count()
    tile = max(tile, -(-n // MOST_TILES))
    turn = basis(nodes, dim)
    tree = cuts(nodes, turn, n, min(LEAF, tile))
    # so many levels of the tree, from its leaves up, are one tile
    up = max(0, min((len(tree) + 1).bit_length() - 1, int(np.log2(tile / min(LEAF, tile)))))

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2))
            at = leaf(_unit(x) @ turn, tree) if len(x) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> up, pa.int64()), pa.array(at, pa.int64()), *batch.columns], names=["tile", "leaf", "node", "w", "x"])

    found = nodes.select("node", "w", "x").mapInArrow(find, "tile bigint, leaf bigint, node bigint, w bigint, x array<double>")
    # a tile's place with more nodes than two tiles hold (one dense group) is dealt out over several tasks
    crowds = found.groupBy("tile").agg(F.count("*").alias("k")).select("tile", F.ceil(F.col("k") / F.lit(2 * tile)).cast("int").alias("parts"))
    dealt = found.join(crowds, "tile").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    dealt = dealt.repartition(F.col("tile"), F.col("part")).sortWithinPartitions("tile", "leaf").select("tile", "leaf", "node", "w", "x")
    tiles = cut(dealt.mapInArrow(_pack(turn, tree, tile), TILE_TYPE), "tiles")
    boxes = [(r["path"], r["low"], r["high"]) for r in tiles.select(F.md5("ids").alias("path"), "low", "high").collect()]
    boxes.sort()
    low, high = (np.array([b[k] for b in boxes]).reshape(len(boxes), dim) for k in (1, 2))
    far = 2 - 2 * threshold + SLACK
    shared = spark.sparkContext.broadcast(([b[0] for b in boxes], low, high))

    def peers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, lows, highs = shared.value
        place = {name: i for i, name in enumerate(names)}
        for batch in batches:
            for name in batch.column(0).to_pylist():
                i = place[name]
                gap = np.maximum(0, np.maximum(lows[i:] - highs[i], lows[i] - highs[i:]))
                near = np.flatnonzero((gap * gap).sum(axis=1) <= far) + i
                # every other pair is turned round, so no tile is the second one much more often than others
                yield pa.RecordBatch.from_pydict({"a": [names[j] if (i + j) % 2 else name for j in near], "b": [name if (i + j) % 2 else names[j] for j in near]})

    keyed = tiles.withColumn("name", F.md5("ids")).drop("low", "high", "leaf", "n")
    pairs = keyed.select("name").mapInArrow(peers, "a string, b string")
    one, two = ([F.col(c).alias(f"{c}_{s}") for c in ("ids", "w", "x")] for s in ("a", "b"))
    both = pairs.join(keyed.select(F.col("name").alias("a"), *one), "a").join(keyed.select(F.col("name").alias("b"), *two), "b")
    return cut(both.mapInArrow(_compare(threshold, turn), "kind int, node bigint, links bigint, other bigint"), "links")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept) of all vectors."""
    ship(vectors.sparkSession)
    rows = vectors.select("vec_id", usable().alias("x"))
    # equal vectors are one node, named by the smallest vec_id that has it
    own = cut(rows.where(F.col("x").isNotNull() & F.col("vec_id").isNotNull()).withColumn("h", F.sha2(F.to_json("x"), 256)), "vectors")
    nodes = cut(own.groupBy("h").agg(F.min("vec_id").alias("node"), F.countDistinct("vec_id").alias("w"), F.first("x").alias("x")), "nodes")
    found = None
    for r in nodes.select(F.size("x").alias("d")).distinct().collect():
        part = links(nodes.where(F.size("x") == r["d"]), r["d"], threshold, tile)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return vectors.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    counts = found.where("kind = 0").groupBy("node").agg(F.sum("links").alias("more"))
    roots = components(found.where("kind = 1").select(F.col("node").alias("a"), F.col("other").alias("b")))
    of = nodes.select("h", "node", "w").join(counts, "node", "left").join(roots, "node", "left")
    of = of.select("h", (F.col("w") - 1 + F.coalesce("more", F.lit(0))).alias("n"), F.coalesce("root", "node").alias("root"))
    per_id = own.select("vec_id", "h").distinct().join(of, "h").groupBy("vec_id").agg(F.max("n").alias("n"), F.min("root").alias("root"))
    out = vectors.select("vec_id").join(per_id.withColumnRenamed("vec_id", "v"), F.col("vec_id") == F.col("v"), "left")
    root = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), root.alias("component_id"), F.coalesce(F.col("vec_id") == root, F.lit(True)).alias("kept"))
