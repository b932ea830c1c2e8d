"""The trainers against the same steps in NumPy, and that they learn."""

import os

import numpy as np
import pytest

from earshot.operators import models

DATA = "/root/testdata/sf0.001"


def vectors(params):
    return {r["id"]: np.array(r["v"]) for r in params.collect()}


def test_a_step_is_adams(spark):
    params = models.parameters(spark.range(3).select("id"), "x", 4)
    before = vectors(params)
    rows = spark.createDataFrame([(0, [1.0, 0.0, -2.0, 0.5]), (0, [1.0, 1.0, 0.0, 0.0]), (2, [0.1, 0.2, 0.3, 0.4])], "id long, g array<double>")
    after = vectors(models.stepped(params, rows, 1, 0.1, "x"))
    for i, g in ((0, np.array([2.0, 1.0, -2.0, 0.5])), (2, np.array([0.1, 0.2, 0.3, 0.4]))):
        assert np.allclose(after[i], before[i] + 0.1 * g / (np.abs(g) + 1e-8))
    assert np.array_equal(after[1], before[1])


def test_skipgram_learns_and_reruns_agree(spark):
    pairs = spark.createDataFrame([(a, b, 5) for g in (range(0, 3), range(3, 6)) for a in g for b in g if a != b], "centre long, other long, n long")
    params, losses = models.skipgram(pairs, 6, epochs=6, batches=1, rate=0.2, dim=8)
    assert losses[-1] < losses[0] and abs(losses[0] - 6 * np.log(2)) < 0.05
    again = vectors(models.skipgram(pairs, 6, epochs=6, batches=1, rate=0.2, dim=8)[0])
    assert all(np.allclose(v, again[i]) for i, v in vectors(params).items())


def test_skipgram_without_pairs(spark):
    params, losses = models.skipgram(spark.createDataFrame([], "centre long, other long, n long"), 2, dim=4)
    assert losses == [] and params.count() == 2


def test_pairwise_ranks_positives_first(spark):
    own = {0: [0, 1], 1: [0, 1], 2: [2, 3], 3: [2, 3]}
    rows = spark.createDataFrame([(u, i, k) for u, items in own.items() for k, i in enumerate(items)], "usr long, item long, pos int")
    users, items, losses = models.pairwise(rows, 4, epochs=6, batches=1, rate=0.3, dim=8)
    u, i = vectors(users), vectors(items)
    assert losses[-1] < losses[0]
    assert all(min(u[x] @ i[y] for y in own[x]) > max(u[x] @ i[y] for y in range(4) if y not in own[x]) for x in own)


def test_an_epoch_takes_each_row_once(spark):
    rows = spark.range(100).selectExpr("id AS centre", "id + 1 AS other")
    for epoch in range(2):
        got = [r.centre for step in range(1, 5) for r in models.batch_of(rows, 4 * epoch + step, 4, "centre", "other").collect()]
        assert sorted(got) == list(range(100))


def test_factors_are_aligned_and_ranked(spark):
    items = models.aligned(spark.createDataFrame([(1, [1.0, 0.0]), (3, [0.0, 2.0])], "id long, v array<double>"), spark.createDataFrame([(i,) for i in range(1, 5)], "item long"), 2)
    assert {r.item: r.v for r in items.collect()} == {1: [1.0, 0.0], 2: [0.0, 0.0], 3: [0.0, 2.0], 4: [0.0, 0.0]}
    users = spark.createDataFrame([(7, [1.0, 1.0]), (8, [1.0, -1.0])], "usr long, v array<double>")
    got = {(r.usr, r.rank0): (r.item, r.score) for r in models.factor_lists(users, items, 3).collect()}
    assert [got[7, k] for k in range(3)] == [(3, 2.0), (1, 1.0), (2, 0.0)] and [got[8, k] for k in range(3)] == [(1, 1.0), (2, 0.0), (4, 0.0)]


def test_sequence_model_against_plain_loops(spark):
    rng = np.random.default_rng(0)
    w = {"weight_ih": rng.normal(size=(9, 4)), "weight_hh": rng.normal(size=(9, 3)), "bias_ih": rng.normal(size=9), "bias_hh": rng.normal(size=9), "proj": rng.normal(size=(4, 3)), "proj_bias": rng.normal(size=4)}
    v = rng.normal(size=(6, 4))
    context = {1: [0, 1, 2], 2: [5], 3: [3, 9, 4]}

    def one(items):
        h = np.zeros(3)
        for i in items:
            a, b = w["weight_ih"] @ v[i] + w["bias_ih"], w["weight_hh"] @ h + w["bias_hh"]
            r, z = 1 / (1 + np.exp(-(a[:3] + b[:3]))), 1 / (1 + np.exp(-(a[3:6] + b[3:6])))
            h = (1 - z) * np.tanh(a[6:] + r * b[6:]) + z * h
        h = w["proj"] @ h + w["proj_bias"]
        return v @ (h / (np.linalg.norm(h) + 1e-8))

    vectors_ = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "item int, v array<double>")
    got = models.sequence_lists(spark.createDataFrame(list(context.items()), "usr long, context array<int>"), vectors_, w, 6).collect()
    for u, items in context.items():
        want = one([i for i in items if i < 6])
        mine = {r.item: r.score for r in got if r.usr == u}
        assert all(abs(mine[i] - want[i]) < 1e-8 for i in range(6)) and [r.item for r in sorted((r for r in got if r.usr == u), key=lambda r: r.rank0)] == list(np.argsort(-want))


def test_sequence_gradients_against_differences():
    rng = np.random.default_rng(0)
    w = models.sequence_weights(3, 4)
    x, length, candidates = rng.normal(size=(5, 4, 3)), np.array([4, 1, 3, 2, 4]), rng.normal(size=(5, 6, 3))
    _, g = models.sequence_gradients(w, x, length, candidates)
    for k in w:
        for at in list(np.ndindex(w[k].shape))[:: max(1, w[k].size // 7)]:
            two = []
            for d in (1e-6, -1e-6):
                moved = {n: v.copy() for n, v in w.items()}
                moved[k][at] += d
                two.append(models.sequence_gradients(moved, x, length, candidates)[0])
            assert abs((two[0] - two[1]) / 2e-6 - g[k][at]) < 1e-6


def test_sequence_model_learns_what_follows(spark):
    vectors_ = np.eye(6)
    rows = [([i, (i + 1) % 6], (i + 2) % 6) for i in range(6)] * 20
    windows = spark.createDataFrame(rows, "context array<int>, target int")
    w, losses = models.fit_sequence(windows, vectors_, np.ones(6), epochs=20, batch=24, negatives=8, hidden=12, rate=0.05)
    # a target is among its own negatives, so the loss has a floor
    assert losses[-1] < losses[0] - 0.5
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors_)], "item int, v array<double>")
    got = models.sequence_lists(spark.createDataFrame([(i, [i, (i + 1) % 6]) for i in range(6)], "usr long, context array<int>"), items, w, 1).collect()
    assert sum(r.item == (r.usr + 2) % 6 for r in got) >= 5


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not there")
def test_queries_give_every_item(spark):
    places, n = models.vocabulary(spark, DATA)
    assert models.fit_skipgram(spark, DATA).count() == n
    assert models.fit_pairwise(spark, DATA).where("kind = 'item'").count() == n
