"""Operator 10: near-duplicate documents by DartMinHash signatures and banded joining.

A document is its set of five-word shingles (words are runs of other characters than ASCII white space; a text of one
to four words is one shingle), each of weight 1; the sketch itself takes any weights. Two documents of Jaccard
similarity 0.8 or more, computed exactly from their texts, are linked, and a class is a connected component.

Darts: an element of weight w owns the region [0, w) x [0, inf) of weight by rank, and darts fall on it as a Poisson
process that depends on the element alone. The process is drawn per doubling weight interval, by rank. Only darts of
rank below a bound that leaves about K ln K of them are drawn; each is hashed to one of K coordinates, and a coordinate
keeps its dart of lowest rank. Two sets agree in a coordinate with the probability of their weighted Jaccard similarity.

Candidates: exact copies are one node. BANDS bands of ROWS coordinates give bucket keys. In each bucket every node
is compared with one hub, chosen by a hash that differs by bucket; a node is in up to BANDS buckets, so it meets many
hubs, and the rows are linear in the group. What a bucket leaves in several components is then compared by signature,
in tasks of bounded size and without emitting pairs: first each node's closest nodes of other components are verified,
then all pairs of different components whose signatures allow the threshold. So large groups are neither cut nor
multiplied out.

Cases: texts without a word (null, empty, white space) are classes of their own; texts of any length are hashed whole;
equal texts always share a class; repeated rows and null doc_ids keep their rows; a class's id is its smallest doc_id;
an empty table gives no rows; other columns, whatever their names, are untouched.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earshot.llm.common import arrow, components, cut, discard, free_name, lean, ship

WORDS = 5
THRESHOLD = 0.8
K, BANDS, ROWS = 256, 32, 4
#: Pairs of a bucket whose signatures agree in less than the threshold less so many standard deviations aren't verified:
#: a pair of just the threshold's similarity falls there with a probability of 3e-5. With six deviations check_h's large
#: group of near copies had not ended after seven minutes.
DEVIATIONS = 4
#: Nodes of a bucket in one task of the remainder, and the closest nodes it proposes first.
PART, CLOSEST = 1024, 4

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingle_sets(texts: list[str], size: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each text."""
    parts = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
    counts = pc.list_value_length(parts).to_numpy().astype(np.int64)
    flat = parts.flatten()
    held = pc.not_equal(flat, "")
    if not pc.all(held).as_py():
        own = np.repeat(np.arange(len(texts)), counts)[held.to_numpy(zero_copy_only=False)]
        counts, flat = np.bincount(own, minlength=len(texts)), flat.filter(held)
    coded = flat.dictionary_encode()
    names = coded.dictionary.cast(pa.large_binary()).to_pylist()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, names), U, len(names))[coded.indices.to_numpy()]
    # shingles of the texts on end; those that cross into the next text are left out below
    s = np.full(max(0, len(h) - size + 1), U(size))
    for k in range(size):
        s = mix(s * U(0x9E3779B97F4A7C15) + h[k : k + len(s)])
    out, at = [], 0
    for n in counts.tolist():
        if n >= size:
            out.append(np.unique(s[at : at + n - size + 1]))
        else:
            one = np.full(min(n, 1), U(n))
            for k in range(n):
                one = mix(one * U(0x9E3779B97F4A7C15) + h[at + k : at + k + 1])
            out.append(one)
        at += n
    return out


def shingles(text: str, size: int = WORDS) -> np.ndarray:
    return shingle_sets([text], size)[0]


def uniform(draw: np.ndarray) -> np.ndarray:
    """A number in (0, 1) of each hash, from its upper 53 bits."""
    return ((draw >> U(11)).astype(np.float64) + 0.5) / 2.0**53


def darts(elements: np.ndarray, weights: np.ndarray | None, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of elements, hashes and ranks of the darts below each element's bound that hit its region."""
    places, hashes, ranks = [], [], []
    low, high, level = 0.0, 1.0, 0
    most = 1.0 if weights is None else float(weights.max(initial=0))
    while low < most or level == 0:
        at = np.arange(len(elements)) if weights is None else np.flatnonzero(weights > low)
        rank, m = np.zeros(len(at)), 0
        while len(at):
            draw = mix(elements[at] + U(((level << 40) + m + 1) * 0x9E3779B97F4A7C15 % 2**64))
            # the next arrival on a region of width high - low
            rank = rank - np.log(uniform(draw)) / (high - low)
            alive = rank < bound[at]
            at, rank, draw = at[alive], rank[alive], draw[alive]
            if weights is None:
                hit = slice(None)
            else:
                hit = low + (high - low) * uniform(mix(draw ^ U(0xD1B54A32D192ED03))) < weights[at]
            places.append(at[hit])
            hashes.append(draw[hit])
            ranks.append(rank[hit])
            m += 1
        low, high, level = high, 2 * high, level + 1
    return np.concatenate(places), np.concatenate(hashes), np.concatenate(ranks)


def dart_minhashes(sets: list[np.ndarray], weights: list[np.ndarray] | None = None, k: int = K) -> np.ndarray:
    """A row of k coordinates for each set: the hash of the lowest dart in each. No set may be empty, no weight 0."""
    out = np.empty((len(sets), k), U)
    todo, factor = np.arange(len(sets)), 1.0
    while len(todo):
        own = np.repeat(np.arange(len(todo)), [len(sets[i]) for i in todo])
        elements = np.concatenate([sets[i] for i in todo])
        w = None if weights is None else np.concatenate([weights[i] for i in todo]).astype(np.float64)
        total = np.array([float(len(sets[i])) if weights is None else float(weights[i].sum()) for i in todo])
        bound = factor * (k * np.log(k) + 2 * k) / total
        place, h, rank = darts(elements, w, bound[own])
        coordinate = ((mix(h ^ U(0xA0761D6478BD642F)) >> U(32)) * U(k) >> U(32)).astype(np.int64)
        cell = own[place] * k + coordinate
        lowest = np.full(len(todo) * k, np.inf)
        np.minimum.at(lowest, cell, rank)
        least = rank == lowest[cell]
        held = np.empty(len(todo) * k, U)
        held[cell[least]] = h[least]
        full = np.isfinite(lowest.reshape(-1, k)).all(axis=1)
        out[todo[full]] = held.reshape(-1, k)[full]
        todo, factor = todo[~full], 2 * factor
    return out


def dart_minhash(elements: np.ndarray, weights: np.ndarray | None = None, k: int = K) -> np.ndarray:
    """The coordinates of one set."""
    return dart_minhashes([elements], None if weights is None else [weights], k)[0]


def bands(signatures: np.ndarray, n: int = BANDS) -> np.ndarray:
    """One 64-bit key per band, for each row of coordinates."""
    rows = signatures[:, : n * ROWS].reshape(len(signatures), n, ROWS)
    key = np.tile(np.arange(n, dtype=U) * U(0x9E3779B97F4A7C15), (len(rows), 1))
    for k in range(rows.shape[2]):
        key = mix(key + rows[:, :, k])
    return key.view(np.int64)


def runs(texts: list[str], size: int = 400_000) -> Iterator[list[str]]:
    """The texts in runs of about so many characters."""
    now: list[str] = []
    n = 0
    for t in texts:
        now.append(t)
        n += len(t)
        if n >= size:
            yield now
            now, n = [], 0
    if now:
        yield now


SKETCH = "struct<bands:array<bigint>,sig:binary>"


def _sketched(texts: pa.Array) -> pa.Array:
    lean()
    keys, sigs = [], []
    for run in runs([t.as_py() or "" for t in texts]):
        sets = shingle_sets(run)
        held = [s for s in sets if len(s)]
        sig = dart_minhashes(held) if held else np.empty((0, K), U)
        rows = zip(bands(sig), (sig & U(0xFFFF)).astype("<u2"), strict=True)
        for s in sets:
            key, row = next(rows) if len(s) else (None, None)
            keys.append(key)
            sigs.append(None if row is None else row.tobytes())
    valid = pa.array([x is None for x in sigs], pa.bool_())
    return pa.StructArray.from_arrays([pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], names=["bands", "sig"], mask=valid)


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if both else 0.0


def _linked(threshold: float):
    """Keeps the pairs of rows (a, b, ta, tb) whose texts are as similar as the threshold."""

    def linked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        last: tuple = (None, None)
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                firsts, texts, other = part.column(0).to_pylist(), part.column(2).to_pylist(), shingle_sets(part.column(3).to_pylist())
                keep = []
                for a, text, y in zip(firsts, texts, other, strict=True):
                    if last[0] != a:
                        last = (a, shingles(text))
                    x = last[1]
                    # the smaller set bounds the similarity
                    keep.append(min(len(x), len(y)) >= threshold * max(len(x), len(y)) and _jaccard(x, y) >= threshold)
                yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return linked


def _remainder(closest: int | None, estimate: float):
    """Pairs of different components, by signature, within runs of rows (g, node, root, sig, side, band, bands) of equal g.

    Rows of a group are adjacent. With `closest`, a node proposes so many of the most similar nodes of other
    components; only nodes outside the group's largest component do. A pair is proposed by the first of its common
    buckets alone.
    """

    def pairs(rows: list) -> list[tuple[bytes, bytes]]:
        if len(rows) < 2:
            return []
        nodes, roots, sigs, side, band, keys = zip(*rows, strict=True)
        if len(set(roots)) < 2:
            return []
        m, roots = np.frombuffer(b"".join(sigs), "<u2").reshape(len(rows), -1), np.unique(np.array(roots, object), return_inverse=True)[1]
        side, keys = np.array(side), np.array(keys)
        largest = np.bincount(roots).argmax()
        out = set()
        for i in np.flatnonzero(roots != largest):
            share = (m == m[i]).mean(axis=1)
            share[roots == roots[i]] = 0
            if side[i] >= 0:
                share[side == side[i]] = 0
            share[(keys == keys[i]).argmax(axis=1) != band[i]] = 0
            good = np.flatnonzero(share >= estimate)
            if closest is not None and len(good) > closest:
                good = good[np.argsort(-share[good], kind="stable")[:closest]]
            out.update((min(nodes[i], nodes[j]), max(nodes[i], nodes[j])) for j in good)
        return sorted(out)

    def remainder(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        now, held, out = None, [], []
        for batch in batches:
            for g, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if g != now:
                    out += pairs(held)
                    now, held = g, []
                held.append(row)
            if len(out) > 10_000:
                yield _pairs(out)
                out = []
        out += pairs(held)
        if out:
            yield _pairs(out)

    return remainder


def _pairs(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary()) for i in range(2)], names=["a", "b"])


def digest(text: str = "text"):
    """Node of a text: its MD5."""
    return F.unhex(F.md5(F.col(text).cast("binary")))


def near_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (node, root, class_id, first): each distinct text with a word, its class, and the smallest doc_id that has it."""
    ship(docs.sparkSession)
    plain = docs.select(F.col("doc_id"), F.col("text"))
    sketched = plain.select(digest().alias("node"), "doc_id", arrow(_sketched, SKETCH)(F.col("text")).alias("s")).where(F.col("s").isNotNull())
    nodes = cut(
        sketched.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("s").alias("s")).select("node", "first", "s.bands", "s.sig"),
        "sketches",
    )
    dealt = nodes.select("node", F.posexplode("bands").alias("band", "bucket")).withColumn("prio", F.xxhash64("bucket", "node"))
    busy = dealt.groupBy("bucket").agg(F.min("prio").alias("hub_prio"), F.max("prio").alias("other")).where("hub_prio <> other").select("bucket", "hub_prio")
    members = cut(dealt.join(busy, "bucket"), "buckets")
    hubs = members.where("prio = hub_prio").select("bucket", F.col("node").alias("hub"))
    stars = members.select("bucket", "node").join(hubs, "bucket").where("node <> hub").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()
    involved = members.select("node").distinct().join(nodes.select("node", "first"), "node")
    texts = cut(
        plain.select(digest().alias("n"), F.col("doc_id"), "text")
        .join(involved, F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("n") == F.col("node")))
        .groupBy("node").agg(F.first("text").alias("text")),
        "texts",
    )

    def verified(pairs: DataFrame, label: str) -> DataFrame:
        left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
        right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
        rows = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
        return cut(rows.mapInArrow(_linked(threshold), "a binary, b binary"), label)

    edges = verified(stars, "stars")
    found = components(edges)
    estimate = threshold - DEVIATIONS * (threshold * (1 - threshold) / K) ** 0.5
    parts = [edges]
    for closest in (CLOSEST, None):
        rooted = rooted_members(members, found)
        pairs = open_buckets(rooted, nodes).mapInArrow(_remainder(closest, estimate), "a binary, b binary").distinct()
        more = verified(pairs, "remainder")
        discard(rooted)
        parts.append(more)
        if more.isEmpty():
            continue
        edges = edges.unionByName(more)
        before, found = found, components(edges)
        discard(before)
    discard(members, texts, *parts)
    rooted = nodes.select("node", "first").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("first").alias("class_id"))
    return rooted.join(least, "root").select("node", "root", "class_id", "first")


def rooted_members(members: DataFrame, found: DataFrame) -> DataFrame:
    """The members of the buckets but for the hubs, which have been compared with their whole bucket, and their components."""
    roots = found.withColumnRenamed("root", "r")
    rows = members.where("prio <> hub_prio").join(roots, members["node"] == roots["node"], "left")
    return cut(rows.select("bucket", "band", members["node"], "prio", F.coalesce("r", members["node"]).alias("root")), "rooted")


def open_buckets(rooted: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (g, node, root, sig, side, band, bands) of the buckets that still hold several components.

    A bucket of more than PART nodes is dealt into parts, and each pair of parts is a group; side tells the part, so a
    pair of parts compares only across.
    """
    marks = rooted.withColumn("h", F.xxhash64("root"))
    still = marks.groupBy("bucket").agg(F.min("h").alias("low"), F.max("h").alias("high"), F.count("*").alias("n")).where("low <> high")
    still = still.select("bucket", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    rows = rooted.join(still, "bucket").join(nodes.select("node", "sig", "bands"), "node").withColumn("part", F.pmod("prio", F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    rows = rows.withColumn("q", other).withColumn("lo", F.least("part", "q")).withColumn("hi", F.greatest("part", "q"))
    g = F.concat_ws(":", "bucket", "lo", "hi")
    side = F.when(F.col("lo") == F.col("hi"), F.lit(-1)).otherwise(F.col("part"))
    rows = rows.select(g.alias("g"), "node", "root", "sig", side.alias("side"), "band", "bands")
    return rows.repartition(F.col("g")).sortWithinPartitions("g")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, class_id) of all documents."""
    rows = docs.select("doc_id", digest().alias("n"))
    classes = near_classes(docs, threshold)
    return rows.join(classes, F.col("n") == F.col("node"), "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def distinct_docs(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of docs for each class, the one of the smallest doc_id, with docs' own columns.

    Rows without a word all stay. Of rows with equal doc_id and text one stays.
    """
    n, i = free_name(docs.columns, "node_of_text"), free_name(docs.columns, "row_in_node")
    keep = near_classes(docs, threshold).where(F.col("class_id").eqNullSafe(F.col("first")))
    keep = keep.groupBy("root").agg(F.min("node").alias("keep_node"), F.min("class_id").alias("keep_id")).drop("root")
    rows = docs.withColumn(n, digest())
    blank = docs.where(~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    own = [F.col(f"`{c}`") for c in docs.columns]
    chosen = rows.join(keep, (F.col(n) == F.col("keep_node")) & F.col("doc_id").eqNullSafe(F.col("keep_id")))
    one = chosen.withColumn(i, F.row_number().over(Window.partitionBy("keep_node").orderBy(F.xxhash64(*own)))).where(F.col(i) == 1)
    return one.select(*own).unionByName(blank)
