"""Every query of the catalogue against SQL of its own in DuckDB, golden values of the serving path, and plans."""

import datetime as dt
import decimal
import os

import duckdb
import numpy as np
import pytest

import earshot.operators  # noqa: F401
from earshot.operators import grid, vectors
from earshot.plans import catalog, flagship, oracles, scratch

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not there")


def plain(x):
    x = float(x) if isinstance(x, decimal.Decimal) else x
    return None if isinstance(x, float) and x != x else x


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    for t in catalog.TABLES:
        made.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return made


def compare(df, con, sql):
    got = sorted(repr(tuple(plain(r[c]) for c in sorted(df.columns))) for r in df.collect())
    out = con.execute(sql)
    names = [c[0] for c in out.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    want = sorted(repr(tuple(plain(r[i]) for i in order)) for r in out.fetchall())
    assert sorted(names) == sorted(df.columns)
    assert got == want


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    compare(catalog.run(spark, DATA, name), con, catalog.oracle(name))


def test_every_query_has_sql_of_its_own():
    assert set(catalog.QUERIES) <= set(oracles.ORACLES)


def test_frames_are_written_once_and_again_for_other_files(spark, tmp_path):
    for k, n in enumerate((40, 60)):
        rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), i % 2, "view", 0.0, '{"k": %d}' % (i % 3)) for i in range(n)]
        spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.mode("overwrite").parquet(f"file://{tmp_path}/events.parquet")
        before = len(catalog._views)
        assert catalog.run(spark, f"file://{tmp_path}", "win_assign_splits").count() == n
        made = len(catalog._views) - before
        catalog.run(spark, f"file://{tmp_path}", "agg_split_stats").collect()
        held = len(catalog._views)
        catalog.run(spark, f"file://{tmp_path}", "agg_split_stats").collect()
        assert made == 2 and len(catalog._views) == held
        os.utime(tmp_path / "events.parquet", (k, k))


def test_a_users_own_views_stay(spark):
    spark.range(3).createOrReplaceTempView("events")
    catalog.run(spark, DATA, "agg_user_span").collect()
    assert spark.table("events").count() == 3
    spark.catalog.dropTempView("events")


def test_plans(spark):
    """Evaluation reads written frames; nothing broadcasts a side that grows in a nested loop, and no anti join is null-aware."""
    for name in ("met_ranking", "met_per_user", "met_calibration", "met_coverage", "set_missing_users", "set_known_cold", "vec_exact_topk", "pq_adc_dot", "win_vocab_v1", "agg_same_brand_rate"):
        plan = catalog.run(spark, DATA, name)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Scan parquet") < 10 and "CartesianProduct" not in plan, name
        if name not in ("win_vocab_v1", "met_coverage", "agg_same_brand_rate"):
            # but for sums over all rows, and numbers of ranges, no task takes everything
            assert "Exchange SinglePartition" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan and "null-aware" not in plan.lower(), name


def test_numbered_like_one_sort(spark):
    from earshot.operators.prep import numbered

    spark.range(2000).selectExpr("id AS item", "1 + pmod(hash(id), 300) AS n").createOrReplaceTempView("numbers_in")
    got = spark.sql(numbered("SELECT item, n FROM numbers_in", "n DESC, item", "n")).collect()
    want = sorted(((r.n, r.item) for r in got), key=lambda x: (-x[0], x[1]))
    assert [(r.n, r.item) for r in sorted(got, key=lambda r: r.rnk)] == want and sorted(r.rnk for r in got) == list(range(1, 2001))
    spark.catalog.dropTempView("numbers_in")


def test_best_of_each_row_takes_the_first_at_ties():
    rng = np.random.default_rng(0)
    for _ in range(50):
        s = rng.integers(0, 4, size=(3, 9)).astype(float)
        for k in (1, 4, 9, 12):
            row, col = grid.best(s, k)
            for r in range(3):
                assert sorted(col[row == r]) == sorted(np.lexsort((np.arange(9), -s[r]))[:k])


def test_products_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(grid, "USERS", 3)
    monkeypatch.setattr(grid, "ITEMS", 5)
    rng = np.random.default_rng(0)
    u, v = rng.normal(size=(10, 4)), rng.normal(size=(23, 4))
    users = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(u)], "usr long, v array<double>")
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "item int, v array<double>")
    s = np.round(u @ v.T, 9)
    got = {(r.usr, r.rank0): (r.item, r.score) for r in grid.top_scores(users, items, 6).collect()}
    assert got == {(i, k): (j, s[i, j]) for i in range(10) for k, j in enumerate(np.argsort(-s[i])[:6])}
    # ten items played of which some may only come last
    played = users.selectExpr("usr", "v", "0.5e0 AS w", "array(0, 2, 4, 6, 8, 10, 12, 14, 16, 18, 20, 22) AS items", "transform(array(0, 2, 4, 6, 8, 10, 12, 14, 16, 18, 20, 22), x -> x + 1e0) AS repeat")
    rows = grid.blended(played, items, 15, 0.7, 0.3, True).collect()
    for i in range(10):
        mine = sorted((r for r in rows if r.usr == i), key=lambda r: r.rank0)
        x = (u @ v.T)[i]
        x = np.round(0.3 * (x - x.min()) / (x.max() - x.min()), 9)
        free = sorted(range(1, 23, 2), key=lambda j: (-x[j], j))
        assert [r.item for r in mine] == free + [0, 2, 4, 6] and [r.score for r in mine][11:] == [-1.0] * 4 and [r.played for r in mine] == [0] * 11 + [1] * 4


def test_codebooks_against_plain_iterations(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 8))
    got = vectors.fitted(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "item int, v array<double>"), 2, 16, 4)
    order = sorted(range(120), key=lambda i: (i * 7919 % 1000003, i))
    for s in range(2):
        part = x[:, 4 * s : 4 * s + 4]
        c = part[order[:16]]
        for step in range(4):
            code = np.round(((part[:, None] - c[None]) ** 2).sum(axis=2), 12).argmin(axis=1)
            c = np.array([np.round(part[code == k].mean(axis=0), 12) if (code == k).any() else part[order[(step * 16 + k) % 120]] for k in range(16)])
        assert np.allclose(got[s], c, atol=1e-9)


#: Values worked out by hand from the definitions of the serving path.
def test_golden_values(spark, tmp_path):
    now, day = 1706745600, 86400
    kinds = {"view": 1.0, "purchase": 2.0, "signup": 1.5, "click": 0.3, "error": 0.0}
    # user 1 plays item 1 twice (now and half a life ago is one row: the last time counts), item 2 by every signal once
    events = [(1, now, "view", 1), (1, now - 90 * day, "view", 1)] + [(1, now - 180 * day, e, 2) for e in kinds] + [(2, now + 50 * day, "purchase", 3)]
    rows = [(i, dt.datetime.fromtimestamp(t, dt.UTC).replace(tzinfo=None), u, e, 0.0, '{"k": %d}' % k) for i, (u, t, e, k) in enumerate(events)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"file://{tmp_path}/events.parquet")
    folder = f"file://{tmp_path}"
    state = {(r.usr, r.item): (r.n, r.wscore) for r in catalog.run(spark, folder, "srv_profile_state").collect()}
    assert state == {(1, 1): (2, 2.0), (1, 2): (5, 4.8), (2, 3): (1, 2.0)}
    scores = {(r.usr, r.item): r.score for r in catalog.run(spark, folder, "srv_decay_scores").collect()}
    # a quarter after two half-lives; an event in the future isn't scored above its weight
    assert scores == {(1, 1): 2.0, (1, 2): 1.2, (2, 3): 2.0}
    # 2024-02-01 00:00 is a Thursday: day 3, hour 0. All of user 1's listens are at midnight, two on a Thursday
    weekday = {t: (t // day + 3) % 7 for _, t, *_ in events}
    share = sum(weekday[t] == 3 for u, t, *_ in events if u == 1) / 7
    weight = {r.usr: r.w for r in catalog.run(spark, folder, "srv_context_weight").collect()}
    assert abs(weight[1] - (0.9 + 0.2 * (0.7 * 1.0 + 0.3 * share))) < 1e-8


def test_flagship(spark, con):
    compare(flagship.decayed_top(spark, DATA), con, flagship.ORACLE)


def test_flagship_plan_limits_before_the_shuffle(spark):
    plan = flagship.decayed_top(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert "ReadSchema: struct<ts" in plan


def test_two_gini_definitions_agree(spark):
    a = catalog.run(spark, DATA, "dst_gini_rank").first()[0]
    b = catalog.run(spark, DATA, "dst_gini_lorenz").first()[0]
    assert abs(a - b) < 1e-8


def test_centres_against_plain_loops(spark, monkeypatch):
    """Over several blocks and slices, with items that repeat, are missing, end early or have nulls, and scores without a value."""
    for name, size in (("USERS", 3), ("ITEMS", 4), ("GROUPS", 1)):
        monkeypatch.setattr(grid, name, size)
    rng = np.random.default_rng(2)
    vectors = [(i, rng.normal(size=5 if i % 6 else 3).tolist()) for i in range(15)] + [(4, rng.normal(size=5).tolist()), (15, None), (16, [1.0, None, 2.0]), (17, [float("nan")] * 5)]
    scores = [(u, i, float(rng.uniform(0.1, 2)) if ((u or 0) + i) % 5 else None) for u in [*range(20), None] for i in range(16) if rng.uniform() < 0.4]
    scores += [(20, 16, 1.0), (20, 2, 3.0), (21, 15, 1.0), (22, 99, 1.0), (23, 17, 1.0), (23, 3, 1.0), (24, None, 1.0), (25, 16, 2.0)]
    got = {r.usr: r.v for r in grid.centres(spark.createDataFrame(scores, "usr long, item int, score double"), spark.createDataFrame(vectors, "item int, v array<double>"), 0.3).collect()}
    want = {}
    for u in {u for u, *_ in scores}:
        mine = [(s, v) for w, i, s in scores if w == u for j, v in vectors if j == i and v is not None]
        for p in range(max((len(v) for _, v in mine), default=0)):
            there = [(s, v[p]) for s, v in mine if len(v) > p]
            top = [s * x for s, x in there if s is not None and x is not None]
            weight, plain = sum(s for s, _ in there if s is not None), [x for _, x in there if x is not None]
            want.setdefault(u, []).append(0.7 * sum(top) / weight + 0.3 * sum(plain) / len(plain) if top else None)
    assert set(got) == set(want) and {21, 22, 24}.isdisjoint(got)
    for u, v in want.items():
        assert [x is None for x in v] == [x is None for x in got[u]], u
        assert np.allclose([x or 0.0 for x in v], [x or 0.0 for x in got[u]], rtol=0, atol=1e-12, equal_nan=True), u


def shuffled(spark):
    """Bytes that the application has written to shuffles."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    executors = context.statusStore().executorList(False)
    return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))


@pytest.fixture(scope="module")
def listeners(spark, tmp_path_factory):
    """2,000 users with 40 listens each to 500 items, and 3,000 vectors (1.5 MB in doubles)."""
    folder = f"file://{tmp_path_factory.mktemp('listeners')}"
    kind = "array('view', 'purchase', 'signup', 'click', 'error')[pmod(hash(id), 5)]"
    events = spark.range(80_000).selectExpr("id AS event_id", "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 30) AS ts", "pmod(id, 2000) AS user_id", f"{kind} AS event_type", "0e0 AS value", "concat('{\"k\": ', pmod(xxhash64(id), 500), '}') AS props")
    events.coalesce(2).write.parquet(f"{folder}/events.parquet")
    spark.range(3000).selectExpr("id AS vec_id", "transform(sequence(0, 63), j -> CAST(pmod(xxhash64(id, j), 1000) / 500.0 - 1 AS FLOAT)) AS embedding", "0 AS label").coalesce(2).write.parquet(f"{folder}/embeddings.parquet")
    return folder


def shuffle_of(spark, folder, name, monkeypatch):
    """MB that the query shuffles with small blocks of users, all frames being written anew."""
    monkeypatch.setattr(grid, "USERS", 16)
    monkeypatch.setattr(grid, "TASKS", 4, raising=False)
    monkeypatch.setattr(catalog, "_views", {})
    before = shuffled(spark)
    assert catalog.run(spark, folder, name).count() in (2000, 40_000)
    return (shuffled(spark) - before) / 1e6


@pytest.mark.parametrize("name", ["srv_recommend_with_played", "srv_breakdown", "srv_recommend_in_context", "srv_recommend", "srv_recommend_pq"])
def test_vectors_are_not_shuffled_for_each_score_or_block_of_users(spark, listeners, monkeypatch, name):
    assert shuffle_of(spark, listeners, name, monkeypatch) < 60


def shared(spark):
    """Bytes in the folder of written frames."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch.shared_root(spark)}/earshot")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getContentSummary(at).getLength() if fs.exists(at) else 0


@pytest.mark.parametrize(("name", "most"), [("srv_recommend_in_context", 24), ("srv_recommend", 24), ("srv_recommend_pq", 24)])
def test_users_are_shuffled_once_and_items_stay_narrow(spark, listeners, monkeypatch, name, most):
    """MB of shuffles and frames together: no frame is made of vectors that the input has, and lists come whole from their block."""
    before = shared(spark)
    mb = shuffle_of(spark, listeners, name, monkeypatch)
    assert mb + (shared(spark) - before) / 1e6 < most


def test_one_block_gives_what_several_give(spark, monkeypatch):
    """Also at ties, with a user whose products are all equal, and with vectors that are divided in their block."""
    monkeypatch.setattr(grid, "USERS", 3)
    rng = np.random.default_rng(4)
    v = np.round(rng.normal(size=(23, 4)), 1)
    v[7], v[11], v[20] = v[3], v[3], v[3]
    by = rng.uniform(0.5, 2.0, size=(23, 2))
    users = [(i, x.tolist(), 0.5 + i / 20, [0, 3, 7, 19][: i % 4 + 1], [1.0, 0.5, 0.5, 2.0][: i % 4 + 1]) for i, x in enumerate([*rng.normal(size=(10, 4)), np.zeros(4)])]
    users = spark.createDataFrame(users, "usr long, v array<double>, w double, items array<int>, repeat array<double>")
    items = spark.createDataFrame([(i, x.tolist(), *map(float, by[i])) for i, x in enumerate(v)], "item int, v array<float>, a double, b double")
    plain = spark.createDataFrame([(i, (np.float32(x) / by[i, 0] / by[i, 1]).tolist()) for i, x in enumerate(v)], "item int, v array<double>")
    for k in (1, 6, 40):
        for exclude in (False, True):
            monkeypatch.setattr(grid, "ITEMS", 100)
            one = {tuple(r) for r in grid.blended(users, items, k, 0.7, 0.3, exclude, grid.divided("a", "b")).collect()}
            monkeypatch.setattr(grid, "ITEMS", 5)
            assert one == {tuple(r) for r in grid.blended(users, plain, k, 0.7, 0.3, exclude).collect()}
            assert len(one) == 11 * min(k, 23)


def test_items_of_bounded_size_are_broadcast(spark, monkeypatch):
    """Neither users nor items are shuffled then, also with more items than a block has; lists are those that shuffled blocks give."""
    monkeypatch.setattr(grid, "USERS", 8)
    monkeypatch.setattr(grid, "TASKS", 4)
    rng = np.random.default_rng(7)
    users = [(i, x.tolist(), 1.0, [i % 50, 50 + i % 30], [1.0, 0.5]) for i, x in enumerate(rng.normal(size=(300, 8)))]
    users = spark.createDataFrame(users, "usr long, v array<double>, w double, items array<int>, repeat array<double>").repartition(4)
    users = scratch.written(users, "users")
    items = scratch.written(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(90, 8)))], "item int, v array<double>"), "items")
    for block in (100, 40):
        monkeypatch.setattr(grid, "ITEMS", block)
        before = shuffled(spark)
        monkeypatch.setattr(grid, "SHARED", 1 << 26, raising=False)
        got = {tuple(r) for r in grid.blended(users, items, 7, 0.7, 0.3, True).collect()}
        # counts only
        assert shuffled(spark) - before < 1000
        monkeypatch.setattr(grid, "SHARED", 0, raising=False)
        assert got == {tuple(r) for r in grid.blended(users, items, 7, 0.7, 0.3, True).collect()}
        assert len(got) == 300 * 7
