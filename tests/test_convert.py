"""From bags to a checked dataset, and the commands around it."""

import json
import os
import sqlite3
import struct

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright import cli
from framewright.functions import decoders
from framewright.operators import validate
from framewright.plans import config, convert
from framewright.sinks import dataset
from framewright.sources import cdr

CONFIG = """
fps: 10
robot_type: arm
task: configured
features:
- {topic: /joints, key: observation.state.arm, selector: "position,velocity[0]", stamp_source: header}
- {topic: /gauge, key: observation.state.gauge, required: false}
- {topic: /cmd, key: action.goal, decoder: "tests.test_convert:doubled"}
resampling: {policy: nearest, tolerance_ms: 60, min_length: 3}
"""


def doubled(msg, selectors):
    return F.transform(decoders.floats(msg["data"]), lambda v: v * 2)


def joints(ns, a, b):
    raw = b"\0\1\0\0" + struct.pack("<iI", ns // 10**9, ns % 10**9) + struct.pack("<I", 1) + b"\0"
    raw += b"\0" * (-(len(raw) - 4) % 4) + struct.pack("<I", 2)
    for n in (b"a\0", b"b\0"):
        raw += b"\0" * (-(len(raw) - 4) % 4) + struct.pack("<I", 2) + n
    for values in ((a, b), (a / 2,), ()):
        raw += b"\0" * (-(len(raw) - 4) % 4) + struct.pack("<I", len(values))
        raw += (b"\0" * (-(len(raw) - 4) % 8) + struct.pack(f"<{len(values)}d", *values)) if values else b""
    return raw


def bag(folder, seconds, gauge=True):
    os.makedirs(folder)
    with sqlite3.connect(folder / "x.db3") as db:
        db.execute("CREATE TABLE topics (id INTEGER, name TEXT, type TEXT)")
        db.execute("CREATE TABLE messages (id INTEGER, topic_id INTEGER, timestamp INTEGER, data BLOB)")
        db.execute("INSERT INTO topics VALUES (1, '/joints', 'sensor_msgs/msg/JointState'), (2, '/gauge', 'std_msgs/msg/Float32'), (3, '/cmd', 'std_msgs/msg/Float64')")
        start, step, out = 5 * 10**9, 10**8, []
        for k in range(int(seconds * 10) + 1):
            out.append((1, start + k * step + 10**7, joints(start + k * step, float(k), -float(k))))  # received 10 ms late
            if gauge and k % 2 == 0:
                out.append((2, start + k * step, b"\0\1\0\0" + struct.pack("<f", k / 4)))
            out.append((3, start + k * step, b"\0\1\0\0" + struct.pack("<d", k)))
        db.executemany("INSERT INTO messages VALUES (?, ?, ?, ?)", [(i, *m) for i, m in enumerate(out)])


def test_convert(spark, tmp_path, capsys):
    bag(tmp_path / "bags" / "a", 1.0)
    bag(tmp_path / "bags" / "b", 0.2)  # two frames: too short
    bag(tmp_path / "bags" / "c", 2.0)
    (tmp_path / "bags" / "c" / "task.json").write_text(json.dumps({"task": "pick", "subtasks": [{"start": 0, "end": 1, "subtask": "reach"}, {"start": 1, "end": 3, "subtask": "lift"}]}))
    plan, out = config.load(CONFIG), str(tmp_path / "out")
    info = convert.convert(spark, str(tmp_path / "bags"), out, plan)
    assert (info["total_episodes"], info["total_frames"], info["total_tasks"]) == (2, 30, 2)
    rows = dataset.read(spark, out).orderBy("index").collect()
    # by their header stamps joints lie on the grid; the gauge comes at every other frame and is held for none
    assert [list(r["observation.state"]) for r in rows[:3]] == [[0.0, 0.0, 0.0, 0.0], [1.0, -1.0, 0.5, 0.0], [2.0, -2.0, 1.0, 0.5]]
    assert [list(r["action"]) for r in rows[:3]] == [[0.0], [2.0], [4.0]]
    assert {(r.episode_index, r.task_index) for r in rows} == {(0, 0), (1, 1)}
    found = validate.dataset_issues(spark, out)
    assert validate.verdict(found, strict=True).first().verdict == "PASS", found.collect()
    e = spark.read.parquet(f"{out}/meta/episodes").orderBy("episode_index").collect()
    assert [(x.dataset_from_index, x.dataset_to_index, x["data/chunk_index"], x["data/file_index"]) for x in e] == [(0, 10, 0, 0), (10, 30, 0, 0)]
    assert e[0]["stats/action/max"] == [18.0] and e[1].tasks == [1]
    assert pq.read_table(f"{out}/meta/subtasks.parquet").to_pydict() == {"subtask": ["reach", "lift"], "subtask_index": [0, 1]}
    assert pq.read_table(f"{out}/meta/subtask_spans.parquet")["episode_index"].to_pylist() == [1, 1]
    summary = json.load(open(f"{out}/meta/job_summary.json"))
    assert (summary["succeeded"], summary["dropped"]) == (2, 1) and len(json.load(open(f"{out}/meta/conversion_log.json"))["inputs"]) == 3
    assert convert.convert(spark, str(tmp_path / "bags"), out, plan, resume=True) == info
    # the commands, on the same dataset
    assert cli.main(["quality-report", out, "--json", str(tmp_path / "q.json")]) == 0
    assert json.load(open(tmp_path / "q.json"))["verdict"] == "PASS"
    assert cli.main(["audit-timestamps", out]) == 0
    assert cli.main(["audit-timestamps", out, "--video-key", "top"]) == 2 and cli.main(["quality-report", str(tmp_path / "none")]) == 2
    (tmp_path / "plan.yaml").write_text(CONFIG)
    assert cli.main(["convert", str(tmp_path / "plan.yaml"), str(tmp_path / "bags"), str(tmp_path / "x"), "--dry-run"]) == 0 and not (tmp_path / "x").exists()
    os.remove(f"{out}/meta/info.json")  # an interrupted run
    assert dataset.guard(out, resume=True) and not os.listdir(out)


def test_generic_decoder(spark):
    types = cdr.Types("p/Odd", "string name\nfloat32[] gains\nuint8 mode\ngeometry_msgs/Point at\ngeometry_msgs/Quaternion turn")
    rows = spark.createDataFrame([(("n", [1.0, 2.0], 3, (4.0, 5.0, 6.0), (0.0, 0.0, 0.0, 1.0)),)], T.StructType([T.StructField("m", types.schema)]))
    got = lambda *s: rows.select(decoders.decode("p/Odd", F.col("m"), list(s) or None, schema=types.schema).alias("v")).first().v
    assert got() == [1, 2, 3, 4, 5, 6, 0, 0, 0, 1]
    assert got("at.y", "gains[-1]", "gains.0", "turn") == [5, 2, 1, 0, 0, 0, 1]
    for bad in ("name", "at.q"):
        with pytest.raises(ValueError):
            got(bad)


def test_guard_and_bad_plans(spark, tmp_path):
    bag(tmp_path / "bags" / "a", 1.0)
    for change, says in (("/joints", "missing"), ("tests.test_convert:doubled", "found")):
        plan = config.load(CONFIG.replace(change, "/none" if change == "/joints" else "tests.none:x"))
        with pytest.raises(config.ConfigError, match=says):
            convert.convert(spark, str(tmp_path / "bags"), str(tmp_path / "out"), plan)
