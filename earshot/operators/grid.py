"""Products of user and item vectors, in blocks.

Scoring every user against every item is a matrix product, which SQL has no words for: a lambda over two arrays is
interpreted per component. Here vectors are packed into blocks of bounded size, each block of users meets each block of
items in one of the tasks that hold a copy of it, and one matrix product gives the scores of the two. Only what can enter a
user's list leaves a block, so rows are users x blocks x k instead of users x items.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earshot.plans.scratch import released, ship, written

#: Vectors in a block of users and of items; blocks of users that a copy of a block of items is sent to, and tasks at least.
USERS, ITEMS = 32, 65536
GROUPS, TASKS = 512, 6
#: Bytes of items, with eight a component, up to which they are broadcast.
SHARED = 1 << 26


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The rows of a list column, all of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def packed(rows: DataFrame, key: str, size: int, name: str, n: int) -> DataFrame:
    """One row per block of about `size` of the n rows (key, v, ...): name, the keys, the vectors and the other columns on end."""
    blocks = max(1, -(-n // size))
    block = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by(key)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema) as out:
            out.write_table(t)
        return pa.table({name: pa.array([t.column(name)[0].as_py()], pa.int32()), f"{name}_rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    return rows.withColumn(name, block).groupBy(name).applyInArrow(pack, f"{name} int, {name}_rows binary")


def slices(n_users: int, blocks: int = 1) -> int:
    """Into how many slices users are dealt: GROUPS blocks each, fewer where there would be less than TASKS tasks."""
    groups = max(1, -(-n_users // USERS))
    return max(-(-groups // GROUPS), min(groups, -(-TASKS // blocks)))


def read(rows: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(rows.as_buffer()).read_all()


def opened_as(t: pa.Table, x: np.ndarray) -> pa.Table:
    """The items of a block with these vectors."""
    return pa.table({"item": t.column("item"), "v": pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))})


def divided(*by: str) -> Callable[[pa.Scalar], pa.Table]:
    """What opens a block of items with their vectors divided by these columns, one after the other: vectors as narrow as they are given take less to send."""

    def opened(rows: pa.Scalar) -> pa.Table:
        t = read(rows)
        x = matrix(t.column("v"))
        for c in by:
            x = x / t.column(c).to_numpy()[:, None]
        return opened_as(t, x)

    return opened


def streamed(users: DataFrame, items: DataFrame, keys: list[str], tasks: int, schema: str, run: Callable[[Iterator[tuple[int, int, bool, pa.Scalar]]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """What run makes of packed rows (slice, block, grp_rows) and (slice, block, block_rows), dealt out by the keys.

    It gets (slice, block, whether of users, rows) ordered by slice, then by block, a block of items before the users that meet
    it: so a block of items is sent once to each slice and not to each block of users, and a task holds one at a time.
    """
    both = items.select("slice", "block", F.lit(False).alias("of_users"), F.col("block_rows").alias("packed")).unionAll(users.select("slice", "block", F.lit(True).alias("of_users"), F.col("grp_rows").alias("packed")))

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, bool, pa.Scalar]]:
        for batch in batches:
            yield from zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True)

    return both.repartition(min(4096, tasks), *keys).sortWithinPartitions("slice", "block", "of_users").mapInArrow(lambda batches: run(each(batches)), schema)


def blocks_of(n_items: int) -> int:
    return max(1, -(-n_items // ITEMS))


def cells(users: DataFrame, items: DataFrame, kernel: Callable[[pa.Table, pa.Table], pa.RecordBatch | None], schema: str, opened: Callable[[pa.Scalar], pa.Table] = read) -> DataFrame:
    """What the kernel makes of each block of users (usr, v, ...) and block of items (item, ...), as rows.

    A task holds one block of items, once opened, and cuts the users that are sent to it into blocks as they come, so users are
    shuffled once for each block of items and not packed first.
    """
    ship(users.sparkSession)
    n_users, n_items = users.count(), items.count()
    blocks = blocks_of(n_items)
    n = slices(n_users, blocks)
    u = users.select(F.pmod(F.xxhash64("usr"), F.lit(n)).cast("int").alias("slice"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.struct(*users.columns).alias("row"))
    i = packed(items, "item", ITEMS, "block", n_items).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    both = i.select("slice", "block", F.lit(None).cast(u.schema["row"].dataType).alias("row"), F.col("block_rows").alias("packed")).unionAll(u.select("slice", "block", "row", F.lit(None).cast("binary").alias("packed")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, right = None, None
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(2)), batch.column(2).is_null().to_pylist(), strict=True))
            a = 0
            while a < len(keys):
                if keys[a][2]:
                    at, right = keys[a][:2], opened(batch.column(3)[a])
                    a += 1
                    continue
                b = a + 1
                while b < len(keys) and b < a + USERS and keys[b] == keys[a]:
                    b += 1
                if keys[a][:2] == at:
                    out = kernel(pa.Table.from_struct_array(batch.column(2)[a:b]), right)
                    if out is not None and out.num_rows:
                        yield out
                a = b

    return both.repartitionById(min(4096, n * blocks), F.col("slice") * blocks + F.col("block")).sortWithinPartitions("slice", "block", F.col("row").isNotNull()).mapInArrow(run, schema)


def room(items: DataFrame) -> tuple[int, int]:
    """The number of items and about the bytes of them."""
    kinds = {T.ArrayType: lambda c: 8 * F.size(c), T.BinaryType: F.octet_length}
    each = sum((F.coalesce(kinds.get(type(f.dataType), lambda c: F.lit(8))(F.col(f.name)), F.lit(0)) for f in items.schema), F.lit(0))
    n, size = items.agg(F.count("*"), F.sum(each.cast("bigint"))).first()
    return n, size or 0


def shared(users: DataFrame, items: DataFrame, kernel: Callable[[pa.Table, pa.Table], pa.RecordBatch | None], schema: str, opened: Callable[[pa.Scalar], pa.Table] = read) -> DataFrame:
    """What cells gives, with all items as one block, for items of bounded size: they are broadcast, so neither users nor copies of items are shuffled.

    Where they are more than ITEMS, fewer users meet them at once, so products take no more memory. Users are dealt out anew only if they lie in fewer partitions than TASKS; they are best given as a written table.
    """
    ship(users.sparkSession)
    sink = pa.BufferOutputStream()
    block = items.toArrow().sort_by("item")
    with pa.ipc.new_stream(sink, block.schema) as out:
        out.write_table(block)
    step = max(1, min(USERS, USERS * ITEMS // max(1, len(block))))
    packed_rows = users.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())
    if users.rdd.getNumPartitions() < TASKS:
        users = users.repartition(TASKS, "usr")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right = None
        for batch in batches:
            right = opened(pa.scalar(packed_rows.value, pa.binary())) if right is None else right
            for a in range(0, batch.num_rows if right.num_rows else 0, step):
                out = kernel(pa.Table.from_batches([batch.slice(a, step)]), right)
                if out is not None and out.num_rows:
                    yield out

    return users.mapInArrow(run, schema)


def padded(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of a list column of any lengths with 0 after their end and for null, which components there are, and which aren't null."""
    column = column.combine_chunks()
    long, flat = column.value_lengths().to_numpy(zero_copy_only=False), column.flatten()
    row = np.repeat(np.arange(len(long)), long)
    pos = np.arange(len(row)) - np.repeat(np.cumsum(long) - long, long)
    x, there, known = (np.zeros((len(long), long.max(initial=0))) for _ in range(3))
    known[row, pos] = flat.is_valid().to_numpy(zero_copy_only=False)
    x[row, pos] = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
    there[row, pos] = 1.0
    return x, there, known


def by_item(items: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    """The items and their padded vectors, those of equal items summed up."""
    item, at = np.unique(items.column("item").to_numpy(), return_inverse=True)
    out = []
    for x in padded(items.column("v")):
        total = np.zeros((len(item), x.shape[1]))
        np.add.at(total, at, x)
        out.append(total)
    return item, out


def centres(scores: DataFrame, items: DataFrame, plain: float) -> DataFrame:
    """Rows (usr, v): the mean vector of a user's items, weighted by the scores (usr, item, score > 0), and a share of their plain mean.

    The items (item, v) that have scores are sent in blocks to each slice of users, and a slice holds the sums of its users; so
    no row is made for a score's vector, let alone for each of its components.
    """
    ship(scores.sparkSession)
    scores = written(scores.where("item IS NOT NULL"), "scores")
    items = written(items.where("v IS NOT NULL").join(scores.select("item").distinct(), "item", "left_semi").select("item", "v"), "items")
    n_users, n_items = scores.select("usr").distinct().count(), items.count()
    blocks, groups, n = max(1, -(-n_items // ITEMS)), max(1, -(-n_users // USERS)), slices(n_users)
    i = packed(items, "item", ITEMS, "block", n_items).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    def pack(t: pa.Table) -> pa.Table:
        sink = pa.BufferOutputStream()
        rows = t.select(["usr", "item", "score"]).sort_by("usr")
        with pa.ipc.new_stream(sink, rows.schema) as out:
            out.write_table(rows)
        return pa.table({"slice": pa.array([t.column("grp")[0].as_py() % n], pa.int32()), "block": t.column("block")[:1].combine_chunks(), "grp_rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    def dealt(key: str, parts: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")

    u = scores.withColumn("grp", dealt("usr", groups)).withColumn("block", dealt("item", blocks)).groupBy("grp", "block").applyInArrow(pack, "slice int, block int, grp_rows binary")

    def ended(sums: dict[int | None, np.ndarray]) -> Iterator[pa.RecordBatch]:
        users = list(sums)
        for k in range(0, len(users), USERS):
            vectors = []
            for usr in users[k : k + USERS]:
                s, w, x, m = sums[usr]
                with np.errstate(invalid="ignore", divide="ignore"):
                    v = (1.0 - plain) * s / w + plain * x / m
                vectors.append(pa.array(v, mask=(w == 0) | (m == 0)))
            offsets = pa.array(np.cumsum([0] + [len(v) for v in vectors]), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(users[k : k + USERS], pa.int64()), pa.ListArray.from_arrays(offsets, pa.concat_arrays(vectors))], names=["usr", "v"])

    def run(rows: Iterator[tuple[int, int, bool, pa.Scalar]]) -> Iterator[pa.RecordBatch]:
        sums: dict[int | None, np.ndarray] = {}
        now, at = None, None
        for part, block, of_users, content in rows:
            if part != now:
                yield from ended(sums)
                sums, now = {}, part
            if not of_users:
                at, (item, (x, there, known)) = (part, block), by_item(read(content))
            elif at == (part, block):
                add(sums, read(content), item, x, there, known)
        yield from ended(sums)

    return streamed(u, i, ["slice"], n, "usr bigint, v array<double>", run)


def add(sums: dict[int | None, np.ndarray], scores: pa.Table, item: np.ndarray, x: np.ndarray, there: np.ndarray, known: np.ndarray) -> None:
    """Adds a block's part to each user's sums: of weighted components and their weights, of components and their number."""
    scores = scores.combine_chunks()
    usr = scores.column("usr").to_pylist()
    ids, weight = scores.column("item").to_numpy(), scores.column("score").to_numpy()
    at = np.minimum(np.searchsorted(item, ids), len(item) - 1)
    here = item[at] == ids
    starts = [k for k in range(len(usr)) if not k or usr[k] != usr[k - 1]]
    for a, b in zip(starts, [*starts[1:], len(usr)], strict=True):
        chosen, w = at[a:b][here[a:b]], weight[a:b][here[a:b]]
        if not len(chosen):
            continue
        # scores without a value have no weight
        scored = ~np.isnan(w)
        mine = np.stack([w[scored] @ x[chosen[scored]], w[scored] @ there[chosen[scored]], x[chosen].sum(axis=0), known[chosen].sum(axis=0)])[:, there[chosen].any(axis=0)]
        before = sums.get(usr[a])
        if before is not None:
            short, mine = sorted((before, mine), key=lambda s: s.shape[1])
            mine[:, : short.shape[1]] += short
        sums[usr[a]] = mine


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of the k largest of each row, the first columns at ties."""
    if scores.shape[1] <= k:
        i, j = np.indices(scores.shape)
        return i.ravel(), j.ravel()
    least = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
    over = scores > least
    # of those that tie with the last only as many as there is room for
    tie = (scores == least) & (np.cumsum(scores == least, axis=1) <= k - over.sum(axis=1, keepdims=True))
    return np.nonzero(over | tie)


def scored(users: pa.Table, items: pa.Table) -> np.ndarray:
    return matrix(users.column("v")) @ matrix(items.column("v")).T


def ranks(row: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Place from 0 of each score among those of its row, the largest first, the first ones at ties; rows are in order."""
    order = np.lexsort((-score, row))
    out = np.empty(len(row), np.int32)
    out[order] = np.arange(len(row)) - np.searchsorted(row, row)
    return out


def listed(rows: DataFrame, k: int, key: str = "usr") -> DataFrame:
    """The k best rows of each key, with their rank from 0; the window's limit is applied before the shuffle."""
    order = Window.partitionBy(key).orderBy(F.desc("score"), "item")
    return rows.withColumn("rank0", F.row_number().over(order) - 1).where(F.col("rank0") < k)


def top_scores(users: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """Rows (usr, item, score, rank0) of the k items of the largest product with each user's vector, to nine digits."""

    def kernel(u: pa.Table, i: pa.Table) -> pa.RecordBatch:
        s = np.round(scored(u, i), 9) + 0.0
        row, col = best(s, k)
        usr, item = u.column("usr").to_numpy(), i.column("item").to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(usr[row], pa.int64()), pa.array(item[col], pa.int32()), pa.array(s[row, col])], names=["usr", "item", "score"])

    return listed(cells(written(users, "users"), items, kernel, "usr bigint, item int, score double"), k)


def blended(users: DataFrame, items: DataFrame, k: int, w_repeat: float, w_discovery: float, exclude: bool, opened: Callable[[pa.Scalar], pa.Table] = read) -> DataFrame:
    """Rows (usr, item, score, played, rank0): repeat scores and products, each scaled over all items, then blended.

    users: (usr, v, w, items, repeat): the vector, the weight on the repeat part, and the repeat scores by item. Where all items
    are one block or of up to SHARED bytes, a block of users gets its bounds and whole lists there. Otherwise products are made twice, for their bounds
    and for the lists, as that is cheaper than rows for all pairs. With `exclude` played items get -1, so they come last but
    aren't left out.
    """

    def bounds(u: pa.Table, i: pa.Table) -> pa.RecordBatch:
        s = scored(u, i)
        return pa.RecordBatch.from_arrays([u.column("usr").combine_chunks().cast(pa.int64()), pa.array(s.min(axis=1)), pa.array(s.max(axis=1))], names=["usr", "lo", "hi"])

    released(users.sparkSession)
    n, size = room(items)
    meet = shared if size <= SHARED else cells
    whole = meet is shared or blocks_of(n) == 1
    # an item that isn't played has a repeat score of 0
    least = F.when(F.size("items") < n, F.least(F.lit(0.0), F.array_min("repeat"))).otherwise(F.array_min("repeat"))
    most = F.when(F.size("items") < n, F.greatest(F.lit(0.0), F.array_max("repeat"))).otherwise(F.array_max("repeat"))
    full = users.withColumn("r_lo", least).withColumn("r_hi", most)
    if not whole:
        span = cells(users.select("usr", "v"), items, bounds, "usr bigint, lo double, hi double", opened).groupBy("usr").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        full = written(full.join(span, "usr"), "users")
        del span
        released(users.sparkSession)

    def kernel(u: pa.Table, i: pa.Table) -> pa.RecordBatch:
        def scale(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            flat = hi - lo < 1e-12
            return np.where(flat[:, None], 0.0, (x - lo[:, None]) / np.where(flat, 1.0, hi - lo)[:, None])

        products = scored(u, i)
        column = {c: u.column(c).to_numpy() for c in ("usr", "w", "r_lo", "r_hi")}
        lo, hi = (products.min(axis=1), products.max(axis=1)) if whole else (u.column("lo").to_numpy(), u.column("hi").to_numpy())
        item = i.column("item").to_numpy()
        repeat, played = np.zeros((len(u), len(item))), np.zeros((len(u), len(item)), bool)
        for r, (ids, scores) in enumerate(zip(u.column("items").to_pylist(), u.column("repeat").to_pylist(), strict=True)):
            at = np.searchsorted(item, ids)
            here = (at < len(item)) & (item[np.minimum(at, len(item) - 1)] == ids)
            repeat[r, at[here]] = np.array(scores)[here]
            played[r, at[here]] = True
        s = np.round(w_repeat * scale(repeat, column["r_lo"], column["r_hi"]) * column["w"][:, None] + w_discovery * scale(products, lo, hi), 9) + 0.0
        if exclude:
            s[played] = -1.0
        row, col = best(s, k)
        arrays = [pa.array(column["usr"][row], pa.int64()), pa.array(item[col], pa.int32()), pa.array(s[row, col]), pa.array(played[row, col].astype(np.int32)), pa.array(ranks(row, s[row, col]))]
        return pa.RecordBatch.from_arrays(arrays, names=["usr", "item", "score", "played", "rank0"])

    rows = meet(full, items, kernel, "usr bigint, item int, score double, played int, rank0 int", opened)
    return rows if whole else listed(rows.drop("rank0"), k)
