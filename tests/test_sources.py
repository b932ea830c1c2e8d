"""Readers, writers, streaming and the contribution payload on small fixtures."""

import io
import json
import tarfile

import numpy as np
import pytest
import zstandard

from earshot.plans import sweep
from earshot.sources import files, models, reports
from earshot.streaming import profile

A, B = "00000000-0000-0000-0000-00000000000a", "00000000-0000-0000-0000-00000000000b"


def test_archive(spark, tmp_path):
    with tarfile.open(tmp_path / "x.tar", "w") as tar:
        for name, text in (("bb/u2.txt.zst", "100\t\t\t" + A + "\n\n200\n"), ("aa/u1.txt.zst", "300\tx\ty\t" + B)):
            data = zstandard.ZstdCompressor().compress(text.encode())
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    lines = files.read_archive(spark, f"file://{tmp_path}/x.tar")
    assert [(r.user_uuid, r.line) for r in lines.orderBy("user_uuid", "line_no").collect()] == [("u1", "300\tx\ty\t" + B), ("u2", "100\t\t\t" + A), ("u2", "200")]
    assert {r.user_uuid: r.usr for r in files.number_users(lines).collect()} == {"u1": 0, "u2": 1}


def test_export_reads_both_places(spark, tmp_path):
    rows = [
        {"listened_at": 1, "track_metadata": {"additional_info": {"recording_mbid": A}, "mbid": B}},
        {"listened_at": 2, "track_metadata": {"additional_info": {"recording_mbid": ""}, "mbid": B}},
        {"listened_at": 3, "track_metadata": {}},
    ]
    (tmp_path / "a.json").write_text(json.dumps({"listens": rows}))
    (tmp_path / "b.json").write_text(json.dumps(rows))
    for name in ("a.json", "b.json"):
        got = [(r.listened_at, r.mbid) for r in files.read_export(spark, f"file://{tmp_path}/{name}").orderBy("listened_at").collect()]
        assert got == [(1, A), (2, B), (3, None)]


def test_profile_without_weighted_scores_uses_counts(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"item_counts": {"1": 2, "2": 1}, "last_seen_ts": {"1": 2000.0, "2": 1500.0}, "created_at": 0, "exploration": 5.0}))
    rows = files.read_profile(spark, f"file://{tmp_path}/p.json").orderBy("item").collect()
    assert [(r.item, r.n, r.last_seen, r.wscore, r.exploration) for r in rows] == [(1, 2, 2000.0, 2.0, 0.9), (2, 1, 1500.0, 1.0, 0.9)]


def test_archive_members_of_any_size(spark, tmp_path, monkeypatch):
    text = "\n".join(f"{i}\t\t\t{A}" for i in range(5000))
    with tarfile.open(tmp_path / "x.tar", "w") as tar:
        for k in range(3):
            data = zstandard.ZstdCompressor().compress(f"{text}\n{k}".encode())
            info = tarfile.TarInfo(f"aa/u{k}.txt.zst")
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    rows = files.read_archive(spark, f"file://{tmp_path}/x.tar").groupBy("user_uuid").agg({"line_no": "max", "line": "count"}).collect()
    assert sorted(tuple(r) for r in rows) == [(f"u{k}", 5001, 5000) for k in range(3)]
    part = files._Part(io.BytesIO(b"abcdef"), 4)
    assert part.read(3) == b"abc" and part.read(3) == b"d" and part.read(3) == b""


def test_index_and_search(spark, tmp_path):
    ids = [f"{i * 7919 % 65536:08x}-0000-0000-0000-{i:012x}" for i in range(500)]
    vocab = spark.createDataFrame([(bytearray(files.uuid_bytes(u)), i) for i, u in enumerate(ids)], "mbid_bytes binary, item int")
    folder = f"file://{tmp_path}/index"
    files.write_index(vocab, folder)
    raw = b"".join(open(p.removeprefix("file://"), "rb").read() for p in files.index_files(folder))
    want = sorted((files.uuid_bytes(u), i) for i, u in enumerate(ids))
    assert raw == files.pack_records(*zip(*want))
    assert sorted((bytes(r.mbid_bytes), r.item) for r in files.read_index(spark, folder).collect()) == want
    r = files.Resolver(folder)
    assert len(r) == 500 and [r.resolve(u) for u in ids] == list(range(500)) and r.resolve(ids[3].upper()) == 3
    assert [r.resolve(x) for x in ("nonsense", "", None, "00000000-0000-0000-0000-00000000ffff", "ffffffff-ffff-ffff-ffff-ffffffffffff")] == [None] * 5
    found = files.resolved(spark.createDataFrame([(ids[0],), (ids[0],), ("nonsense",), (A,), (None,)], "mbid string"), files.read_index(spark, folder))
    assert sorted((r.mbid or "", r.item) for r in found.collect() if r.item is not None) == [(ids[0], 0)] * 2 and found.count() == 5
    assert tuple(files.misses(found).first()) == (1, 3)
    assert files.uuid_bytes("nonsense") is None
    with open(tmp_path / "index" / "part-99999.bin", "wb") as f:
        f.write(b"x")
    with pytest.raises(ValueError):
        files.Resolver(folder)


def test_matrix_round_trip(spark, tmp_path, monkeypatch):
    m = np.random.default_rng(0).normal(size=(50, 6)).astype(np.float32)
    np.save(tmp_path / "m.npy", m)
    monkeypatch.setattr(models, "CHUNK", 7 * 6 * 4)
    rows = models.read_matrix(spark, str(tmp_path / "m.npy"), 50)
    assert rows.rdd.getNumPartitions() >= 1 and np.array_equal(np.array([r.embedding for r in rows.orderBy("item").collect()], np.float32), m)
    models.write_matrix(rows, str(tmp_path / "again.npy"))
    assert np.array_equal(np.load(tmp_path / "again.npy"), m)
    np.save(tmp_path / "flat.npy", np.arange(4))
    for path, n in ((tmp_path / "flat.npy", None), (tmp_path / "m.npy", 49)):
        with pytest.raises(ValueError):
            models.read_matrix(spark, str(path), n)
    assert models.discover_model([tmp_path / "none", tmp_path]) == ("vectors", tmp_path / "again.npy")


def test_quantized_round_trip(spark, tmp_path):
    codes = spark.createDataFrame([(i, s, (i + s) % 3) for i in range(5) for s in range(2)], "item int, subspace int, code int")
    books = spark.createDataFrame([(s, c, [float(c), float(s)]) for s in range(2) for c in range(3)], "subspace int, code int, centroid array<double>")
    models.write_quantized(codes, books, str(tmp_path / "q.npz"))
    rows, again = models.read_quantized(spark, str(tmp_path / "q.npz"))
    assert {r.item: r.codes for r in rows.collect()} == {i: [i % 3, (i + 1) % 3] for i in range(5)}
    assert all(abs(r.norm - (r.codes[0] ** 2 + r.codes[1] ** 2 + 1) ** 0.5) < 1e-9 for r in rows.collect()) and again.count() == 6
    assert models.discover_model([tmp_path]) == ("codes", tmp_path / "q.npz")


def test_manifests_and_inputs(tmp_path, monkeypatch):
    assert models.read_md5s("abc  *a.tar\ndef b.tar\n\nnothing here at all\n") == {"a.tar": "abc", "b.tar": "def"}
    (tmp_path / "a").write_bytes(b"hello")
    url = (tmp_path / "a").as_uri()
    assert models.download(url, str(tmp_path / "b"), "5d41402abc4b2a76b9719d911017c592") == 5 and (tmp_path / "b").read_bytes() == b"hello"
    assert models.sizes_of([url, (tmp_path / "none").as_uri()]) == {url: 5}
    with pytest.raises(ValueError):
        models.download(url, str(tmp_path / "c"), "0" * 32)
    assert not (tmp_path / "c").exists() and models.find_input([tmp_path], "a") == tmp_path / "a"
    with pytest.raises(FileNotFoundError):
        models.find_input([tmp_path], "missing")
    monkeypatch.setenv("EARSHOT_MODELS", f"{tmp_path}:/elsewhere")
    assert [str(p) for p in models.search_dirs()] == [str(tmp_path), "/elsewhere", "models"]
    assert models.largest_under({"a": 5, "b": 9, "c": 20}, 10) == "b" and models.largest_under({"a": 5}, 1) is None
    (tmp_path / "top.json").write_text(json.dumps([{"item_id": 3, "count": 9}]))
    assert models.read_top_items(str(tmp_path / "top.json")) == [(3, 9)]
    seen = []

    def fetch(i):
        seen.append(i)
        if i == "bad":
            raise OSError
        return {"id": i}

    assert models.metadata(["x", "x", "bad"], fetch) == {"x": {"id": "x"}} and seen.count("x") == 1 and seen.count("bad") == 3
    made = models.synthetic_profile(50, 90, 1_700_000_000)
    assert made == models.synthetic_profile(50, 90, 1_700_000_000) and all(1 <= n <= 10 and 1_700_000_000 - 90 * 86400 <= t <= 1_700_000_000 for _, n, t in made)


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("a", "overall", 0.5), ("a", "repeat", None), ("b", "overall", 0.25)], "scorer string, part string, recall double")
    reports.write_json(rows, str(tmp_path / "m.json"), "scorer", "part")
    assert json.loads((tmp_path / "m.json").read_text()) == {"a": {"overall": {"recall": 0.5}, "repeat": {"recall": None}}, "b": {"overall": {"recall": 0.25}}}
    reports.write_report(str(tmp_path / "r.md"), "Report", {"Lists": rows})
    assert (tmp_path / "r.md").read_text().splitlines()[4:7] == ["| scorer | part | recall |", "|-|-|-|", "| a | overall | 0.5000 |"]
    reports.write_tables(f"file://{tmp_path}/out", {"m": rows})
    assert spark.read.parquet(f"file://{tmp_path}/out/m.parquet").count() == 3
    reports.write_figure(spark.createDataFrame([(1, 2.0), (2, 1.0)], "x int, y double"), "x", "y", str(tmp_path / "f.svg"), "t")
    assert "polyline" in (tmp_path / "f.svg").read_text()


def test_sweep_and_latencies(spark):
    assert sweep.latencies([3.0, 1.0, 2.0, 4.0]) == {"p50": 2.5, "p95": 4.0} and sweep.latencies([]) == {}
    got = sweep.sweep(lambda k, up: spark.range(k).selectExpr(f"id + {up}"), {"k": (1, 2), "up": (0, 5)})
    assert [(x["settings"], x["rows"]) for x in got][3] == ({"k": 2, "up": 5}, [(5,), (6,)]) and sweep.overlap([1, 2], [2, 3]) == 1 / 3


def test_events_are_written_by_user(spark, tmp_path):
    rows = spark.createDataFrame([(2, 5, 1), (1, 9, 1), (1, 3, 2)], "usr long, ts long, item int")
    files.write_listens(rows, f"file://{tmp_path}/e")
    assert sorted(map(tuple, spark.read.parquet(f"file://{tmp_path}/e").collect())) == [(1, 3, 2), (1, 9, 1), (2, 5, 1)]


def test_contribution(spark):
    state = spark.createDataFrame([(i, i, 1710513000) for i in range(1, 301)], "item int, n bigint, last_seen bigint")
    with pytest.raises(ValueError):
        files.contribution(state, False, 300)
    made = json.loads(files.contribution(state, True, 300, min_count=1))
    assert made["schema"] == "contribution.v1" and {x["count"] for x in made["items"]} == set(range(101, 301))
    assert made["items"][0]["last_seen_month"] == "2024-03"
    assert "last_seen_month" not in json.loads(files.contribution(state, True, 300, coarse_time=False))["items"][0]


def test_contributions_return_to_the_counts(spark, tmp_path):
    state = spark.createDataFrame([(1, 7, 1710513000), (2, 9, 1710513000)], "item int, n bigint, last_seen bigint")
    (tmp_path / "a.json").write_text(files.contribution(state, True, 3))
    (tmp_path / "b.json").write_text(json.dumps({"schema": "other", "items": [{"item_id": 1, "count": 99}]}))
    got = files.read_contributions(spark, f"file://{tmp_path}/*.json")
    assert sorted((r.item, r.n, r.month) for r in got.collect()) == [(1, 7, "2024-03"), (2, 9, "2024-03")]
    counts = files.with_contributions(spark.createDataFrame([(2, 1), (3, 4)], "item int, n bigint"), got)
    assert sorted(map(tuple, counts.collect())) == [(1, 7), (2, 10), (3, 4)]


def test_stream_equals_batch(spark, tmp_path):
    import datetime as dt

    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), i % 3, e, 0.0, '{"k": %d}' % (i % 4)) for i, (h, e) in enumerate([(5, "view"), (1, "purchase"), (9, "error"), (2, "click"), (7, "view"), (3, "signup")])]
    for i in range(2):
        spark.createDataFrame(rows[3 * i : 3 * i + 3], profile.EVENT_TYPE).coalesce(1).write.parquet(f"file://{tmp_path}/events/{i}")
    got = profile.run_stream(spark, f"file://{tmp_path}/events/*", f"file://{tmp_path}/check")
    want = profile.profile_state(spark.createDataFrame(rows, profile.EVENT_TYPE))
    assert sorted(map(tuple, got.select("usr", "item", "n", "last_seen", "wscore").collect())) == sorted(map(tuple, want.select("usr", "item", "n", "last_seen", "wscore").collect()))


def test_stream_restarts_where_it_stopped(spark, tmp_path):
    import datetime as dt

    rows = [(i, dt.datetime(2024, 1, 1 + i, 3 * i), i % 2, "view", 0.0, '{"k": %d}' % (i % 3)) for i in range(6)]
    for state in (profile.profile_state, profile.rhythm_state):
        root = f"file://{tmp_path}/{state.__name__}"
        for part in (rows[:4], [], rows[4:]):
            if part:
                spark.createDataFrame(part, profile.EVENT_TYPE).coalesce(1).write.mode("append").parquet(f"{root}/events")
            got = profile.run_stream(spark, f"{root}/events/*", f"{root}/check", state)
            seen = rows[:4] if part != rows[4:] else rows
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, state(spark.createDataFrame(seen, profile.EVENT_TYPE)).collect()))


def test_unknown_signal_is_an_error(spark):
    import datetime as dt

    bad = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), 1, "invalid", 0.0, '{"k": 1}')], profile.EVENT_TYPE)
    with pytest.raises(Exception, match="unknown signal"):
        profile.profile_state(bad).collect()
