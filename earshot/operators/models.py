"""Training of the embedding and factor models as iterations over DataFrames.

Parameters are tables (id, v, m, s): a vector and its two running moments. A step joins the training rows with the vectors
they name, computes the gradient of all rows, sums it by id (combined before the shuffle) and applies Adam. Each
step's parameters are a table in the shared folder, so nothing grows on the driver, no parameters are broadcast, and a
lost executor costs no more than the running step. First vectors and negatives are drawn by hashes, so reruns agree.

Items are named by their dense place in the vocabulary, 0 to n - 1.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.operators import grid
from earshot.operators.scorers import LIST
from earshot.plans import catalog
from earshot.plans.scratch import discard, written as kept

DIM, NEGATIVES = 64, 5
#: Epochs of the embedding and the factor model, and mini-batches of an epoch.
SKIPGRAM_EPOCHS, PAIRWISE_EPOCHS, BATCHES = 2, 3, 8
BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-8


def drawn(name: str, dim: int) -> Column:
    """The first vector of an id: hashed numbers between -0.5 and 0.5, over the dimension."""
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda j: (F.pmod(F.xxhash64(F.lit(name), "id", j), F.lit(1 << 30)) / float(1 << 30) - 0.5) / dim)


def parameters(ids: DataFrame, name: str, dim: int = DIM) -> DataFrame:
    """The first parameters of a column of ids."""
    zero = F.array_repeat(F.lit(0.0), dim)
    return kept(ids.select("id").distinct().select("id", drawn(name, dim).alias("v"), zero.alias("m"), zero.alias("s")), name)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def softplus(x: Column) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def times(v: Column, w: Column) -> Column:
    return F.transform(v, lambda x: x * w)


def summed(rows: DataFrame) -> DataFrame:
    """Rows (id, g) with the gradients of each id added up."""
    return rows.groupBy("id").agg(vector_to_array(Summarizer.sum(array_to_vector("g"))).alias("g"))


def stepped(params: DataFrame, gradients: DataFrame, step: int, rate: float, label: str) -> DataFrame:
    """Parameters after one Adam step up the gradients; an id without one keeps its own."""
    b1, b2 = 1 - BETA1**step, 1 - BETA2**step
    p = params.join(summed(gradients), "id", "left")
    m = F.zip_with("m", "g", lambda m, g: BETA1 * m + (1 - BETA1) * g)
    s = F.zip_with("s", "g", lambda s, g: BETA2 * s + (1 - BETA2) * g * g)
    p = p.select("id", "v", "g", F.when(F.col("g").isNull(), F.col("m")).otherwise(m).alias("m"), F.when(F.col("g").isNull(), F.col("s")).otherwise(s).alias("s"))
    move = F.zip_with("m", "s", lambda m, s: rate * (m / b1) / (F.sqrt(s / b2) + EPSILON))
    v = F.when(F.col("g").isNull(), F.col("v")).otherwise(F.zip_with("v", move, lambda v, x: v + x))
    return kept(p.select("id", v.alias("v"), "m", "s"), label)


def with_vectors(rows: DataFrame, params: DataFrame, key: str, name: str) -> DataFrame:
    return rows.join(params.select(F.col("id").alias(key), F.col("v").alias(name)), key)


def batch_of(rows: DataFrame, step: int, batches: int, *key: str) -> DataFrame:
    """The rows of a step's mini-batch."""
    epoch, k = divmod(step - 1, batches)
    return rows if batches == 1 else rows.where(F.pmod(F.xxhash64(*key, F.lit(epoch)), F.lit(batches)) == k)


def skipgram(pairs: DataFrame, n_items: int, epochs: int = SKIPGRAM_EPOCHS, batches: int = BATCHES, rate: float = 0.05, dim: int = DIM) -> tuple[DataFrame, list[float]]:
    """Parameters of the centres, and the mean loss of each step's batch before it, from rows (centre, other, n) of counted pairs.

    A pair is a positive of weight n, and each of its NEGATIVES uniform draws (drawn anew in each step) a negative of
    that weight, as drawing n times would give on average. A draw that hits the pair's own item stays.
    """
    ids = pairs.sparkSession.range(n_items).select("id")
    centre, other = parameters(ids, "centre", dim), parameters(ids, "other", dim)
    losses = []
    for step in range(1, epochs * batches + 1):
        batch = batch_of(pairs, step, batches, "centre", "other")
        total = batch.agg(F.sum("n")).first()[0] or 0
        if not total:
            continue
        negative = F.transform(F.sequence(F.lit(1), F.lit(NEGATIVES)), lambda j: F.struct(F.pmod(F.xxhash64("centre", "other", j, F.lit(step)), F.lit(n_items)).alias("other"), F.lit(0.0).alias("label")))
        both = batch.withColumn("x", F.explode(F.concat(F.array(F.struct(F.col("other").cast("long").alias("other"), F.lit(1.0).alias("label"))), negative)))
        rows = both.groupBy("centre", F.col("x.other").alias("other"), F.col("x.label").alias("label")).agg(F.sum("n").cast("double").alias("n"))
        rows = with_vectors(with_vectors(rows, centre, "centre", "c"), other, "other", "o").withColumn("z", dot(F.col("c"), F.col("o")))
        # the sign of z under which the row costs little
        rows = kept(rows.withColumn("w", F.col("n") * (F.col("label") - sigmoid(F.col("z"))) / F.lit(float(total))).withColumn("cost", F.col("n") * softplus(F.when(F.col("label") > 0, -F.col("z")).otherwise(F.col("z")))), "pairs")
        losses.append(rows.agg(F.sum("cost")).first()[0] / total)
        up_c = rows.select(F.col("centre").alias("id"), times(F.col("o"), F.col("w")).alias("g"))
        up_o = rows.select(F.col("other").alias("id"), times(F.col("c"), F.col("w")).alias("g"))
        before = centre, other
        centre, other = stepped(centre, up_c, step, rate, "centre"), stepped(other, up_o, step, rate, "other")
        discard(*before, rows)
    return centre, losses


def pairwise(positives: DataFrame, n_items: int, epochs: int = PAIRWISE_EPOCHS, batches: int = BATCHES, rate: float = 0.05, dim: int = DIM) -> tuple[DataFrame, DataFrame, list[float]]:
    """User and item parameters and the mean loss before each step, from rows (usr, item, pos) of positives.

    Each positive is ranked against one uniform draw; of up to 10 draws the first that the user has no positive of
    counts. A positive all of whose draws are the user's own is left out of that step.
    """
    spark = positives.sparkSession
    users, items = parameters(positives.select(F.col("usr").alias("id")), "user", dim), parameters(spark.range(n_items).select("id"), "item", dim)
    own, losses = positives.select("usr", F.col("item").alias("drawn")).distinct(), []
    for step in range(1, epochs * batches + 1):
        batch = batch_of(positives, step, batches, "usr", "item", "pos")
        draws = F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(10)), lambda j: F.pmod(F.xxhash64("usr", "item", "pos", j, F.lit(step)), F.lit(n_items))))
        tried = batch.select("usr", "item", "pos", draws.alias("j", "drawn")).join(own, ["usr", "drawn"], "left_anti")
        rows = tried.groupBy("usr", "item", "pos").agg(F.min(F.struct("j", "drawn"))["drawn"].alias("other"))
        rows = with_vectors(with_vectors(with_vectors(rows, users, "usr", "u"), items, "item", "p"), items, "other", "q")
        rows = rows.withColumn("d", F.zip_with("p", "q", lambda p, q: p - q)).withColumn("z", dot(F.col("u"), F.col("d"))).withColumn("w", sigmoid(-F.col("z")))
        rows = kept(rows.select("usr", "item", "other", "u", "d", "z", "w"), "triples")
        n, cost = rows.agg(F.count("*"), F.sum(softplus(-F.col("z")))).first()
        if not n:
            continue
        losses.append(cost / n)
        part = F.col("w") / F.lit(float(n))
        up_u = rows.select(F.col("usr").alias("id"), times(F.col("d"), part).alias("g"))
        up_i = rows.select(F.col("item").alias("id"), times(F.col("u"), part).alias("g")).unionByName(rows.select(F.col("other").alias("id"), times(F.col("u"), -part).alias("g")))
        before = users, items
        users, items = stepped(users, up_u, step, rate, "users"), stepped(items, up_i, step, rate, "items")
        discard(*before, rows)
    return users, items, losses


def aligned(factors: DataFrame, vocab: DataFrame, dim: int = DIM) -> DataFrame:
    """Rows (item, v) of a whole vocabulary (item): the factors of those that have some (id, v), zeros for the others."""
    zero = F.array_repeat(F.lit(0.0), dim)
    return vocab.select("item").join(factors.select(F.col("id").alias("item"), "v"), "item", "left").select("item", F.coalesce("v", zero).alias("v"))


def factor_lists(users: DataFrame, items: DataFrame, k: int = LIST) -> DataFrame:
    """Rows (usr, item, score, rank0): the k items of the largest product with each user's factors."""
    return grid.top_scores(users.select("usr", "v"), items.select(F.col("item").cast("int").alias("item"), "v"), k)


def gated(x: np.ndarray, length: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """Last states of a gated recurrent unit over sequences (n, steps, dim) of these lengths, projected.

    w: weight_ih, weight_hh, bias_ih, bias_hh with the rows of reset, update and new gate on end, and proj and proj_bias.
    """

    def sig(z: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-z))

    h = np.zeros((len(x), w["weight_hh"].shape[1]))
    for t in range(x.shape[1]):
        a = np.split(x[:, t] @ w["weight_ih"].T + w["bias_ih"], 3, axis=1)
        b = np.split(h @ w["weight_hh"].T + w["bias_hh"], 3, axis=1)
        reset, update = sig(a[0] + b[0]), sig(a[1] + b[1])
        new = (1 - update) * np.tanh(a[2] + reset * b[2]) + update * h
        h = np.where((t < length)[:, None], new, h)
    return h @ w["proj"].T + w["proj_bias"]


def sequence_weights(dim: int, hidden: int, seed: int = 42) -> dict[str, np.ndarray]:
    """First weights, uniform by the square root of the hidden size."""
    rng, most = np.random.default_rng(seed), hidden**-0.5
    shapes = {"weight_ih": (3 * hidden, dim), "weight_hh": (3 * hidden, hidden), "bias_ih": (3 * hidden,), "bias_hh": (3 * hidden,), "proj": (dim, hidden), "proj_bias": (dim,)}
    return {k: rng.uniform(-most, most, shape) for k, shape in shapes.items()}


def sequence_gradients(w: dict[str, np.ndarray], x: np.ndarray, length: np.ndarray, candidates: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean softmax loss of the first candidate (n, k, dim) of each sequence, and the gradients of the weights."""
    n, hidden = len(x), w["weight_hh"].shape[1]
    h, steps = np.zeros((n, hidden)), []
    for t in range(x.shape[1]):
        a = np.split(x[:, t] @ w["weight_ih"].T + w["bias_ih"], 3, axis=1)
        b = np.split(h @ w["weight_hh"].T + w["bias_hh"], 3, axis=1)
        r, z = 1 / (1 + np.exp(-(a[0] + b[0]))), 1 / (1 + np.exp(-(a[1] + b[1])))
        c = np.tanh(a[2] + r * b[2])
        live = (t < length)[:, None]
        steps.append((h, r, z, c, b[2], live))
        h = np.where(live, (1 - z) * c + z * h, h)
    logits = np.einsum("nd,nkd->nk", h @ w["proj"].T + w["proj_bias"], candidates)
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    loss = float(-np.log(np.maximum(p[:, 0], 1e-300)).mean())
    p[:, 0] -= 1
    out = np.einsum("nk,nkd->nd", p / n, candidates)
    g = {k: np.zeros_like(v) for k, v in w.items()}
    g["proj"], g["proj_bias"] = out.T @ h, out.sum(axis=0)
    d = out @ w["proj"]
    for t in range(x.shape[1] - 1, -1, -1):
        before, r, z, c, b, live = steps[t]
        dh = np.where(live, d, 0)
        dc = dh * (1 - z) * (1 - c * c)
        dr, dz = dc * b * r * (1 - r), dh * (before - c) * z * (1 - z)
        da, db = np.hstack([dr, dz, dc]), np.hstack([dr, dz, dc * r])
        g["weight_ih"] += da.T @ x[:, t]
        g["weight_hh"] += db.T @ before
        g["bias_ih"] += da.sum(axis=0)
        g["bias_hh"] += db.sum(axis=0)
        d = np.where(live, dh * z, d) + db @ w["weight_hh"]
    return loss, g


def fit_sequence(windows: DataFrame, vectors: np.ndarray, negative_weights: np.ndarray, epochs: int = 2, batch: int = 128, negatives: int = 1024, hidden: int = 128, rate: float = 1e-3, seed: int = 42) -> tuple[dict[str, np.ndarray], list[float]]:
    """Weights of the recurrent model and the mean loss of each epoch, from rows (context, target) of item places.

    The trainer stands outside Spark: it holds the frozen item vectors (bounded by the catalogue) and takes windows as a
    stream, partition by partition in an order that differs by epoch, a batch at a time. Of each window the target is
    told from the other targets of the batch and from drawn items.
    """
    rng, w = np.random.default_rng(seed), sequence_weights(vectors.shape[1], hidden, seed)
    m, s, step, losses = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0, []
    p = negative_weights / negative_weights.sum()

    def learn(rows: list) -> float:
        nonlocal step
        length = np.array([len(r["context"]) for r in rows])
        x = np.zeros((len(rows), max(1, length.max()), vectors.shape[1]))
        for i, r in enumerate(rows):
            x[i, : length[i]] = vectors[r["context"]]
        target = np.array([r["target"] for r in rows])
        others = np.array([np.delete(target, i) for i in range(len(rows))]).reshape(len(rows), -1)
        drawn_ = rng.choice(len(p), (len(rows), negatives), p=p)
        loss, g = sequence_gradients(w, x, length, vectors[np.hstack([target[:, None], others, drawn_]).astype(np.int64)])
        step += 1
        for k in w:
            m[k] = BETA1 * m[k] + (1 - BETA1) * g[k]
            s[k] = BETA2 * s[k] + (1 - BETA2) * g[k] ** 2
            w[k] = w[k] - rate * (m[k] / (1 - BETA1**step)) / (np.sqrt(s[k] / (1 - BETA2**step)) + EPSILON)
        return loss

    for epoch in range(epochs):
        total, n, held = 0.0, 0, []
        for r in windows.select("context", "target").orderBy(F.xxhash64("context", "target", F.lit(epoch))).toLocalIterator():
            held.append(r)
            if len(held) == batch:
                total, n, held = total + learn(held), n + 1, []
        if len(held) > 1:
            total, n = total + learn(held), n + 1
        losses.append(total / max(n, 1))
    return w, losses


def sequence_lists(contexts: DataFrame, vectors: DataFrame, weights: dict[str, np.ndarray], k: int = LIST, longest: int = 50) -> DataFrame:
    """Rows (usr, item, score, rank0) by a trained sequence model, from each user's last items (usr, context: an array, oldest first).

    The vectors of a context are joined by position and gathered per user, at most `longest`; items without a vector are left out.
    """
    spark = contexts.sparkSession
    last = contexts.select("usr", F.posexplode(F.slice("context", F.greatest(F.lit(1), F.size("context") - longest + 1), longest)).alias("pos", "item"))
    seen = last.join(vectors.select("item", "v"), "item").groupBy("usr").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("s"))
    shared = spark.sparkContext.broadcast(weights)

    def states(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            usr, rows = batch.column(0), batch.column(1).to_pylist()
            if rows:
                length = np.array([len(r) for r in rows])
                x = np.zeros((len(rows), length.max(), len(rows[0][0]["v"])))
                for i, r in enumerate(rows):
                    x[i, : len(r)] = [p["v"] for p in r]
                h = gated(x, length, shared.value)
                h /= np.linalg.norm(h, axis=1, keepdims=True) + 1e-8
                yield pa.RecordBatch.from_arrays([usr, pa.array(list(h), pa.list_(pa.float64()))], names=["usr", "v"])

    return factor_lists(seen.mapInArrow(states, "usr bigint, v array<double>"), vectors, k)


def vocabulary(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Rows (item, place) of the training vocabulary, and their number."""
    v = catalog.run(spark, sf_dir, "win_vocab_v2").select("item", F.col("item_id").cast("long").alias("place"))
    return v, v.count()


def fit_skipgram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (item, v): item vectors trained on all skip-gram pairs, of length one."""
    places, n = vocabulary(spark, sf_dir)
    pairs = catalog.run(spark, sf_dir, "win_skipgram_pairs")
    a, b = places.toDF("centre", "a"), places.toDF("other", "b")
    params, _ = skipgram(pairs.join(a, "centre").join(b, "other").select(F.col("a").alias("centre"), F.col("b").alias("other"), "n"), n)
    unit = F.transform("v", lambda x: x / (F.sqrt(dot(F.col("v"), F.col("v"))) + 1e-8))
    return params.join(places, F.col("id") == F.col("place")).select("item", unit.alias("v"))


def fit_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (kind, id, v): factors of all users and items trained on each user's first positives."""
    places, n = vocabulary(spark, sf_dir)
    positives = catalog.run(spark, sf_dir, "win_first_positives").join(places, "item").select("usr", F.col("place").alias("item"), "pos")
    users, items, _ = pairwise(positives, n)
    named = items.join(places, F.col("id") == F.col("place")).select(F.lit("item").alias("kind"), F.col("item").cast("long").alias("id"), "v")
    return users.select(F.lit("user").alias("kind"), F.col("id").cast("long").alias("id"), "v").unionByName(named)


def scr_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (usr, item, score, rank0): first twenty by the factor model, over the vocabulary of all events; what has no factors gets zeros."""
    fitted = kept(fit_pairwise(spark, sf_dir), "factors")
    items = aligned(fitted.where("kind = 'item'"), catalog.table(spark, sf_dir, "vocab_all"))
    users = fitted.where("kind = 'user'").select(F.col("id").alias("usr"), "v").join(catalog.table(spark, sf_dir, "cohort"), "usr")
    return factor_lists(users, items, 20)


QUERIES = {"fit_skipgram": fit_skipgram, "fit_pairwise": fit_pairwise, "scr_pairwise": scr_pairwise}
