"""Operators of the engine against hand values, brute force and DuckDB."""

import math
import os
import random
import sqlite3
import struct
import time

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from framewright.functions import decoders, geometry, images, text
from framewright.operators import align, quality, sequence, stats, validate
from framewright.plans import config, queries
from framewright.sinks import dataset
from framewright.sources import bags, cdr
from framewright.streaming import hold

SF = "/root/testdata/sf0.001"


def brute(samples, grid, policy, tol):
    s = sorted(samples)
    out = []
    for t in grid:
        before, after = [x for x in s if x[0] <= t], [x for x in s if x[0] > t]
        if policy == "hold":
            pick = before[-1] if before else (after[0] if after and after[0][0] - t <= tol else None)
        else:
            b, a = before[-1] if before else None, after[0] if after else None
            pick = b if b and (not a or t - b[0] <= a[0] - t) else a
            pick = pick if pick and abs(pick[0] - t) <= tol else None
        out.append(pick[2] if pick else None)
    return out


@pytest.mark.parametrize("policy", ["hold", "nearest", "drop"])
def test_resample_with_ties(spark, policy):
    r = random.Random(3)
    data = [(e, k, r.randint(0, 60), s, float(s)) for s, (e, k) in enumerate((e, k) for e in range(3) for k in "ab" for _ in range(25))]
    grid = [(e, f, 5 * f) for e in range(3) for f in range(14)]
    got = align.resample(spark.createDataFrame(data, "episode_index long, feature_key string, ts_ns long, seq long, value double"), spark.createDataFrame(grid, "episode_index long, frame_index long, grid_ns long"), ["a", "b", "none"], policy, 4).collect()
    rows = {(x.episode_index, x.feature_key, x.frame_index): x.value for x in got}
    assert len(rows) == 3 * 14 * 3 and all(v is None for (_, k, _), v in rows.items() if k == "none")
    for e in range(3):
        for k in "ab":
            want = brute([(t, s, v) for e2, k2, t, s, v in data if (e2, k2) == (e, k)], [g[2] for g in grid if g[0] == e], policy, 4)
            assert [rows[e, k, f] for f in range(14)] == want


@pytest.mark.parametrize("policy", ["hold", "nearest"])
def test_resample_of_a_long_key_is_linear(spark, policy):
    n = 200_000
    one = lambda *c: spark.range(n).select(F.lit(0).cast("long").alias("episode_index"), *c)
    samples = one(F.lit("a").alias("feature_key"), (F.col("id") * 10).alias("ts_ns"), F.col("id").alias("seq"), F.col("id").cast("double").alias("value"))
    got = align.resample(samples, one(F.col("id").alias("frame_index"), (F.col("id") * 10 + 7).alias("grid_ns")), ["a"], policy, 5)
    began = time.time()
    x = got.agg(F.count("value").alias("n"), F.sum("value").alias("v"), F.sum(F.abs(F.col("src_ns") - F.col("grid_ns"))).alias("off")).first()
    assert time.time() - began < 60  # a frame read anew for every row took minutes for a tenth of this
    assert (x.n, x.v, x.off) == ((n, n * (n - 1) / 2, 7 * n) if policy == "hold" else (n - 1, n * (n - 1) / 2, 3 * (n - 1)))


def rows_sent(df):
    """Rows that the exchanges of a query wrote, and how many sorts it has; the query runs for that."""
    df.collect()
    sent, sorts, todo = 0, 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            if name == "ShuffleExchangeExec":
                sent += node.metrics().get("shuffleRecordsWritten").get().value()
            sorts += name == "SortExec"
            kids = node.children()
            todo += [kids.apply(k) for k in range(kids.size())]
    return sent, sorts


@pytest.mark.parametrize("policy", ["hold", "nearest", "drop"])
def test_resampling_sorts_samples_and_no_frames(spark, policy):
    df = queries.resampled(spark, SF, policy)
    n, windows = queries.samples(spark, SF).count(), align.required_window(queries.samples(spark, SF), queries.REQUIRED).count()
    sent, sorts = rows_sent(df)
    assert df.count() > 9 * n  # all of these were sent, and for all but hold sorted twice
    assert sorts == 1 and sent <= n + windows * (len(queries.KEYS) + 4 * len(queries.REQUIRED))


@pytest.mark.parametrize("policy", ["hold", "nearest", "drop"])
def test_resample_of_windows_is_that_of_their_grid(spark, policy):
    r, fps, tol = random.Random(5), 1e9 / 7, 9
    data = [(e, k, r.randint(-20, 300), s, None if s % 9 == 0 else float(s)) for s, (e, k) in enumerate((e, k) for e in range(5) for k in "abx" for _ in range(3 if k == "b" else 40))]
    lost = [(0, "a", None, 1000, 1.0), (None, "a", 50, 1001, 2.0)]  # without a time, without an episode: of no frame
    spans = [(0, 0, 280), (1, 60, 60), (2, -40, 400), (3, 100, 163), (7, 5, 50), (None, 40, 90)]
    samples = spark.createDataFrame(data + lost, "episode_index long, feature_key string, ts_ns long, seq long, value double")
    windows = spark.createDataFrame(spans, "episode_index long, start_ns long, end_ns long")
    keys, want = ["a", "b", "none"], {}
    for e, start, end in spans:
        grid = [start + 7 * f for f in range(max(1, math.ceil((end - start) / 1e9 * fps)))]
        for k in keys:
            picked = brute([(t, s, (t, v)) for e2, k2, t, s, v in data if (e2, k2) == (e, k)], grid, policy, tol)
            want |= {(e, k, f): (t, *(p or (None, None))) for f, (t, p) in enumerate(zip(grid, picked, strict=True))}
    for got in (align.resample_windows(samples, windows, fps, keys, policy, tol), align.resample(samples, align.frame_grid(windows, fps), keys, policy, tol)):
        rows = got.collect()
        assert len(rows) == len(want) and {(x.episode_index, x.feature_key, x.frame_index): (x.grid_ns, x.src_ns, x.value) for x in rows} == want


@pytest.mark.parametrize("policy", ["hold", "nearest", "drop"])
def test_resample_of_windows_far_from_a_sample(spark, policy):
    fps, tol, far = 1e9 / 7, 9, 2**63 - 1
    spans = [(0, -40, 400), (1, 10, 10)]
    data = [(e, k, t, s, float(s)) for s, (e, k, t) in enumerate((e, k, t) for e in (0, 1) for k in "ab" for t in (-far, -50, 3, 11, 90, 95, 402, far))]
    samples = spark.createDataFrame(data, "episode_index long, feature_key string, ts_ns long, seq long, value double")
    windows = spark.createDataFrame(spans, "episode_index long, start_ns long, end_ns long")
    want = {}
    for e, start, end in spans:
        grid = [start + 7 * f for f in range(max(1, math.ceil((end - start) / 1e9 * fps)))]
        for k in "ab":
            picked = brute([(t, s, (t, v)) for e2, k2, t, s, v in data if (e2, k2) == (e, k)], grid, policy, tol)
            want |= {(e, k, f): (t, *(p or (None, None))) for f, (t, p) in enumerate(zip(grid, picked, strict=True))}
    rows = align.resample_windows(samples, windows, fps, ["a", "b"], policy, tol).collect()
    assert len(rows) == len(want) and {(x.episode_index, x.feature_key, x.frame_index): (x.grid_ns, x.src_ns, x.value) for x in rows} == want


def test_nulls_count_as_rows_and_elements(spark):
    rows = [(0, [1.0, float("nan")]), (0, None), (0, [None, 2.0]), (1, None), (1, [])]
    got = quality.null_counts(spark.createDataFrame(rows, "e long, v array<double>"), ["e"], "v").orderBy("e").collect()
    assert [(x.n_values, x.n_null, x.n_nan) for x in got] == [(4, 1, 2), (0, 1, 0)]
    rates = spark.createDataFrame([(0.0, 0.0, 0.0)], "null_rate double, oor_rate double, freeze_rate double")
    videos = spark.createDataFrame([(0,), (-1,)], "mismatch long")
    assert [quality.score(rates, v).first().verdict for v in (None, videos.limit(1), videos)] == ["PASS", "PASS", "FAIL"]


def test_required_window_and_grid(spark):
    ms = 1_000_000
    data = [(0, "a", t * ms, t, 1.0) for t in range(0, 1001, 100)] + [(0, "b", t * ms, t, 1.0) for t in range(300, 701, 100)] + [(1, "a", 0, 0, 1.0)]
    s = spark.createDataFrame(data, "episode_index long, feature_key string, ts_ns long, seq long, value double")
    w = align.required_window(s, ["a", "b"]).collect()
    assert [(x.episode_index, x.start_ns // ms, x.end_ns // ms) for x in w] == [(0, 300, 700)]
    assert align.frame_grid(align.required_window(s, ["a", "b"]), 10).count() == 4


def test_trim_keeps_inner_gaps(spark):
    wide = spark.createDataFrame([(0, f, v) for f, v in enumerate([None, 1.0, None, 2.0, None])], "episode_index long, frame_index long, a double")
    got = align.trim_to_valid(wide, ["a"]).orderBy("frame_index").collect()
    assert [(x.frame_index, x.a) for x in got] == [(0, 1.0), (1, None), (2, 2.0)]


def test_stats(spark):
    d = stats.explode_dims(spark.createDataFrame([([float(k), float("nan") if k == 3 else 5.0],) for k in range(100)], "v array<double>"), [], "v")
    got = {r.dim: r for r in stats.feature_stats(d, ["dim"]).collect()}
    assert (got[0]["min"], got[0]["max"], got[0]["mean"], got[0]["count"]) == (0, 99, 49.5, 100) and got[1]["count"] == 99
    q = {r.dim: r for r in stats.histogram_quantiles(d.where("dim = 0"), ["dim"]).collect()}
    assert abs(q[0].q50 - 49.5) < 1.1 and abs(q[0].q99 - 98.5) < 1.1
    gap = spark.createDataFrame([(0, "t", int(t * 1e9), k) for k, t in enumerate([0, 0.1, 0.2, 0.73333])], "episode_index long, topic string, recv_ns long, seq long")
    (g,) = stats.gaps(gap, ["episode_index", "topic"], 200_000_000).collect()
    assert g.at_ns == 200_000_000 and round(g.gap_ms, 2) == 533.33


def test_sequence(spark):
    assert sequence.splits(7, (0.7, 0.15, 0.15)) == {"train": (0, 5), "val": (5, 6), "test": (6, 7)}
    assert sequence.splits(3, (0.5, 0.5, 0.0)) == {"train": (0, 2), "val": (2, 3)}
    assert sequence.check_splits({"a": "0:5", "b": "5:7"}, 7) is None and "gap" in sequence.check_splits({"a": "0:5", "b": "6:7"}, 7) and "overlap" in sequence.check_splits({"a": "0:5", "b": "4:7"}, 7)
    assert sequence.pack_files([60, 60, 10, 100, 1], 100) == [0, 0, 1, 1, 2]
    e = spark.createDataFrame([(k, k % 7 + 1) for k in range(0, 300, 3)], "episode_index long, length long")
    got = sequence.running(e, "length", "upto", span=16).orderBy("episode_index").collect()
    assert [x.upto for x in got] == np.cumsum([k % 7 + 1 for k in range(0, 300, 3)]).tolist()
    spans = sequence.span_table(spark, [(0, 1, "x"), (1, 2, "y")])
    at = sequence.lookup_span(spark.createDataFrame([(t,) for t in (-1e-7, 0.0, 1.0, 2.0, 3.0)], "t double"), spans, "t").collect()
    assert [x.subtask for x in at] == ["x", "x", "y", "y", None]


def test_quality(spark):
    d = stats.explode_dims(spark.createDataFrame([([0.0, 5.0],), ([-1.0, 2.0],), ([3.0, 11.0],), ([float("nan"), 1.0],)], "v array<double>"), [], "v").withColumn("f", F.lit("x"))
    b = spark.createDataFrame([(0, 0.0, 2.0), (1, 0.0, 10.0)], "dim int, lo double, hi double")
    assert quality.out_of_range(d, b, ["dim"], ["f"]).first().n_oor == 3
    z = spark.createDataFrame([(0, k, v) for k, v in enumerate([[1.0, 2.0], [1.0, 2.0], [1.0, 2.0]])] + [(1, 0, [1.0, 1.0])], "e long, k long, v array<double>")
    assert [(x.e, x.pairs, x.frozen) for x in quality.freeze_pairs(z, ["e"], "k", "v").collect()] == [(0, 2, 2)]


def test_geometry(spark):
    one = spark.range(1)
    q = [F.lit(v) for v in (0.0, 0.0, math.sin(math.pi / 4), math.cos(math.pi / 4))]
    t, _ = geometry.compose([F.lit(1.0), F.lit(0.0), F.lit(0.0)], q, [F.lit(1.0), F.lit(0.0), F.lit(0.0)], q)
    back, _ = geometry.inverse([F.lit(1.0), F.lit(1.0), F.lit(0.0)], [F.lit(0.0)] * 3 + [F.lit(1.0)])
    x = one.select(*[c.alias(f"t{k}") for k, c in enumerate(t)], *[c.alias(f"b{k}") for k, c in enumerate(back)], *[c.alias(f"e{k}") for k, c in enumerate(geometry.euler(q))]).first()
    assert np.allclose([x.t0, x.t1, x.t2], [1, 1, 0]) and np.allclose([x.b0, x.b1], [-1, -1]) and np.allclose([x.e0, x.e1, x.e2], [0, 0, math.pi / 2])
    assert geometry.path([("A", "B"), ("B", "C")], "C", "A") == [(1, True), (0, True)]
    with pytest.raises(ValueError):
        geometry.path([("A", "B")], "A", "Z")


def test_text_and_decoders(spark):
    x = spark.createDataFrame([("/camera/color/image_raw0", "30000/1001"), ("/camera/image_raw", "0/0")], "t string, r string").select(text.slug(F.col("t")).alias("s"), text.rate(F.col("r")).alias("r")).collect()
    assert [a.s for a in x] == ["image_raw0", "camera_image_raw"] and abs(x[0].r - 29.97) < 0.01 and x[1].r is None
    joints = spark.createDataFrame([((["a", "b"], [1.0, math.pi], [0.5, 0.6]),)], "m struct<name:array<string>,position:array<double>,velocity:array<double>>")
    d = lambda *a, **k: [round(v, 3) for v in joints.select(decoders.decode("sensor_msgs/msg/JointState", F.col("m"), *a, **k).alias("v")).first().v]
    assert d() == [1.0, 3.142] and d(["pos[-1]"], "rad2deg") == [180.0] and d(["velocity.b", "position[0]"]) == [0.6, 1.0] and d(pad_to=3) == [1.0, 3.142, 0.0]
    stamp = spark.createDataFrame([(1, 5), (0, 0), (None, 1)], "s int, n long").select(decoders.header_stamp(F.col("s"), F.col("n")).alias("v")).collect()
    assert [v.v for v in stamp] == [1_000_000_005, None, None]
    assert images.rgb(bytes([1, 2, 3]), "bgr8", 1, 1).tolist() == [[[3, 2, 1]]]
    assert images.rvl(struct.pack("<I", 0x11410000), 3).tolist() == [0, 2, 0]


def test_config():
    c = config.load("fps: 10\nrobot_type: r\ntask: t\nfeatures:\n- {topic: /a, key: observation.state.x}\n- {topic: /b, key: action.y, required: false}\n")
    assert config.load(config.dump(c)) == c and c.required_keys == ["observation.state.x"] and c.merged == {"observation.state": ["observation.state.x"], "action": ["action.y"]}
    for bad, says in (("fps: 0\nrobot_type: r\ntask: t", "fps"), ("fps: 1\nrobot_typ: r\ntask: t", "robot_type"), ("fps: 1\nfps: 2", "twice")):
        with pytest.raises(config.ConfigError, match=says):
            config.load(bad)


def joint_payload(values):
    raw = struct.pack("<4sii", b"\0\1\0\0", 7, 9) + struct.pack("<I", 2) + b"f\0"
    raw += b"\0" * (-(len(raw) - 4) % 4) + struct.pack("<I", len(values))
    raw += b"\0" * (-(len(raw) - 4) % 8) + struct.pack(f"<{len(values)}d", *values)
    return raw


def test_bags(spark, tmp_path):
    for k in range(2):
        os.makedirs(tmp_path / f"bag{k}")
        with sqlite3.connect(tmp_path / f"bag{k}" / "x.db3") as db:
            db.execute("CREATE TABLE topics (id INTEGER, name TEXT, type TEXT)")
            db.execute("CREATE TABLE messages (id INTEGER, topic_id INTEGER, timestamp INTEGER, data BLOB)")
            db.execute("INSERT INTO topics VALUES (1, '/j', 'p/msg/J'), (2, '/other', 'q')")
            db.executemany("INSERT INTO messages VALUES (?, ?, ?, ?)", [(i, 1 + i % 2, 100 - i, joint_payload([float(i), 0.5])) for i in range(6)])
    df = bags.read_bags(spark, str(tmp_path))
    assert df.count() == 12 and [r.recv_ns for r in df.where("episode_index = 0").orderBy("seq").collect()] == list(range(95, 101))
    some = bags.read_bags(spark, str(tmp_path), topics=["/j"])
    assert some.count() == 6 and df.where("topic = '/j'").union(df.where("topic = '/other'")).count() == 12
    msg = cdr.decode_payloads(some, "p/msg/J", "std_msgs/Header header\nuint8 K=3\nfloat64[] position # values")
    got = msg.orderBy("episode_index", "recv_ns").first()
    assert (got.msg.header.stamp.sec, got.msg.header.frame_id, got.msg.position) == (7, "f", [4.0, 0.5])
    with pytest.raises(FileNotFoundError):
        bags.discover(str(tmp_path / "bag0" / "none"))


def test_mcap(tmp_path):
    text_ = lambda s: struct.pack("<I", len(s)) + s.encode()
    record = lambda op, body: struct.pack("<BQ", op, len(body)) + body
    body = record(3, struct.pack("<H", 1) + text_("p/msg/J") + text_("ros2msg") + struct.pack("<I", 0)) + record(4, struct.pack("<HH", 5, 1) + text_("/j") + text_("cdr") + struct.pack("<I", 0))
    body += record(5, struct.pack("<HIQQ", 5, 0, 30, 30) + b"late") + record(5, struct.pack("<HIQQ", 5, 1, 20, 20) + b"early")
    with open(tmp_path / "a.mcap", "wb") as f:
        f.write(b"\x89MCAP0\r\n" + record(6, struct.pack("<QQQI", 20, 30, len(body), 0) + text_("") + struct.pack("<Q", len(body)) + body))
    assert list(bags.read_mcap(str(tmp_path / "a.mcap"), None, True)) == [("/j", "p/msg/J", 20, b"early"), ("/j", "p/msg/J", 30, b"late")]
    # with a chunk index: chunks overlap in time, lz4 too, and those without a wanted topic aren't touched
    kinds = record(3, struct.pack("<H", 1) + text_("p/msg/J") + text_("ros2msg") + struct.pack("<I", 0)) + b"".join(record(4, struct.pack("<HH", c, 1) + text_(n) + text_("cdr") + struct.pack("<I", 0)) for c, n in ((5, "/j"), (6, "/k")))
    out, index = b"\x89MCAP0\r\n" + record(1, text_("") + text_("")), b""
    for how, messages in (("", [(5, 10), (6, 40)]), ("lz4", [(5, 20), (5, 50)]), ("bad", [(6, 45)]), ("zstd", [(6, 60), (5, 55)])):
        inner = b"".join(record(5, struct.pack("<HIQQ", c, 0, t, t) + b"%d" % t) for c, t in messages)
        packed = {"": bytes, "bad": bytes, "lz4": lambda x: pa.Codec("lz4").compress(x, asbytes=True), "zstd": lambda x: zstandard.compress(x)}[how](inner)
        times = [t for _, t in messages]
        index += record(8, struct.pack("<QQQQ", min(times), max(times), len(out), 0) + struct.pack("<I", 10 * len({c for c, _ in messages})) + b"".join(struct.pack("<HQ", c, 0) for c in {c for c, _ in messages}) + struct.pack("<Q", 0) + text_(how) + struct.pack("<QQ", 0, 0))
        out += record(6, struct.pack("<QQQI", min(times), max(times), len(inner), 0) + text_(how) + struct.pack("<Q", len(packed)) + packed)
    with open(tmp_path / "b.mcap", "wb") as f:
        f.write(out + record(15, b"\0" * 4) + kinds + index + record(2, struct.pack("<QQI", len(out) + 13, 0, 0)) + b"\x89MCAP0\r\n")
    assert [m[2:] for m in bags.read_mcap(str(tmp_path / "b.mcap"), {"/j"}, True)] == [(t, b"%d" % t) for t in (10, 20, 50, 55)]
    assert [m[3] for m in bags.read_mcap(str(tmp_path / "b.mcap"), {"/j"}, False)] == [None] * 4
    with pytest.raises(ValueError, match="bad"):
        list(bags.read_mcap(str(tmp_path / "b.mcap"), None, True))


def test_dataset(spark, tmp_path):
    rows = [(e * 2, f, "pick" if e % 2 else "place", [float(f), None if f is None else 1.0], None if f == 0 else [0.5]) for e in range(4) for f in range(5 + e)]
    frames = spark.createDataFrame(rows, "episode_index long, frame_index long, task string, `observation.state` array<double>, action array<double>").withColumnRenamed("observation.state", "state")
    path = str(tmp_path / "out")
    info = dataset.write(frames, path, {"state": 2, "action": 1}, 10.0, "arm", split=(0.5, 0.5, 0.0), frames_per_file=8)
    assert info["total_frames"] == len(rows) and info["splits"] == {"train": "0:2", "val": "2:4"}
    back = dataset.read(spark, path).orderBy("index").collect()
    assert [r["index"] for r in back] == list(range(len(rows))) and math.isnan(back[0].action[0])
    assert validate.verdict(validate.dataset_issues(spark, path), strict=True).first().verdict == "PASS"
    with pytest.raises(FileExistsError):
        dataset.guard(path)
    os.remove(os.path.join(path, "meta", "stats.json"))
    assert validate.verdict(validate.dataset_issues(spark, path)).first().verdict == "FAIL"


def video_case(spark, **change):
    frames = [(e, 10 * e + f, f / 10) for e in range(2) for f in range(10)]
    eps = [{"episode_index": e, "length": 10, "c": 0, "f": 0, "a": float(e), "b": float(e + 1)} for e in range(2)]
    eps[1].update(change.get("episode", {}))
    data = spark.createDataFrame(change.get("frames", frames), "episode_index long, index long, timestamp double")
    episodes = spark.createDataFrame([tuple(e.values()) for e in eps], "episode_index long, length long, `videos/v/chunk_index` long, `videos/v/file_index` long, `videos/v/from_timestamp` double, `videos/v/to_timestamp` double")
    n = change.get("frames_in_video", 20)
    probe = spark.createDataFrame([("v", 0, 0, change.get("readable", True), change.get("fps", 10.0), 20, n, [k / 10 for k in range(n)])], "video_key string, chunk_index long, file_index long, readable boolean, avg_fps double, header_frames long, decoded_frames long, pts array<double>")
    if change.get("no_probe"):
        probe = probe.limit(0)
    found = validate.video_issues(data, episodes, probe, 10.0, ["v"], change.get("strict", False)).collect()
    return {(x.status, x.episode_index): x.detail for x in found}


def test_video_faults(spark):
    assert video_case(spark) == {} and video_case(spark, strict=True) == {}
    got = video_case(spark, frames_in_video=18)
    assert got["FRAME_INDEX_OUT_OF_RANGE", 1] == "requested 19 max 17 overflow 2 index 19"
    assert ("FRAME_INDEX_NEGATIVE", 1) in video_case(spark, episode={"a": -0.5})
    assert ("VIDEO_MISSING", 0) in video_case(spark, no_probe=True) and ("VIDEO_UNREADABLE", 1) in video_case(spark, readable=False)
    assert ("EPISODE_LENGTH_MISMATCH", 1) in video_case(spark, episode={"length": 9}) and ("MISSING_METADATA_VALUE", 1) in video_case(spark, episode={"a": None})
    assert video_case(spark, episode={"c": None, "f": None, "a": None, "b": None}) == {}
    assert ("TO_TIMESTAMP_TOO_SMALL", 1) in video_case(spark, episode={"b": 1.2}) and ("DATASET_VIDEO_FPS_MISMATCH", None) in video_case(spark, fps=10.1)
    frames = [(0, f, f / 10) for f in range(10)] + [(1, 10 + f, (9 - f) / 10) for f in range(9)] + [(1, 25, 0.0)]
    got = video_case(spark, frames=frames, strict=True)
    assert ("INVALID_INDEX_SEQUENCE", 1) in got and ("NON_MONOTONIC_TIMESTAMP", 1) in got


def test_streaming(spark, tmp_path):
    rows = [(0, "a", t, t, float(t)) for t in (5, 9, 7)]
    schema = "episode_index long, feature_key string, ts_ns long, seq long, value double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = hold.latest(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("held").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.ts_ns, r.value, r.n) for r in spark.table("held").collect()] == [(9, 9.0, 3)]


@pytest.mark.parametrize("part", range(4))
def test_registered_queries_match_sql(spark, part):
    import duckdb

    from framewright import registry

    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    names = sorted(registry.queries())[part::4]
    for n in names:
        got, want = registry.queries()[n](spark, SF).toPandas(), db.sql(registry.oracle_sql()[n]).df()
        cols = sorted(got.columns)
        assert cols == sorted(want.columns), n
        key = lambda d: d[cols].astype(str).sort_values(cols).reset_index(drop=True)
        assert key(got).equals(key(want)), n
