"""Transforms, topics, pixels, sidecars and commands."""

import json

import numpy as np
import pytest

from framewright import cli
from framewright.operators import metadata, pixels, transforms
from framewright.plans import config
from framewright.sources import sidecars


def test_transforms(spark):
    schema = "episode_index long, stamp_ns long, seq long, tx double, ty double, tz double, qx double, qy double, qz double, qw double"
    edge = spark.createDataFrame([(0, 1000, 0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0), (0, 3000, 1, 0.0, 2.0, 0.0, 0.0, 0.0, 0.0, 1.0), (0, 3000, 2, 0.0, 9.0, 0.0, 0.0, 0.0, 0.0, 1.0)], schema)
    grid = spark.createDataFrame([(0, k, t) for k, t in enumerate((0, 1000, 1400, 2000, 2600, 3000, 9000))], "episode_index long, frame_index long, grid_ns long")
    edges, static = [("A", "B"), ("B", "C")], {0: (1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)}
    got = transforms.sample(grid, edges, {1: edge}, static, "A", "C").orderBy("frame_index").collect()
    assert [r.value[1] for r in got] == [1, 1, 1, 1, 2, 2, 9] and got[1].value[:3] == [1, 1, 0]
    back = transforms.sample(grid, edges, {1: edge}, static, "C", "A", euler=True).where("frame_index = 1").first()
    assert np.allclose(back.value, [-1, -1, 0, 0, 0, 0])


def test_topics(spark):
    m = spark.createDataFrame([("/cam/image", "sensor_msgs/msg/Image", "640x480"), ("/cam/image", "sensor_msgs/msg/Image", None), ("/joints", "sensor_msgs/msg/JointState", "6"), ("/cmd_vel", "geometry_msgs/msg/Twist", "6"), ("/rosout", "rcl_interfaces/msg/Log", "1")], "topic string, msg_type string, shape string")
    found = metadata.topics(m)
    plan, candidates = metadata.scaffold(found, 10.0, "r", "t")
    assert [f.key for f in plan.features] == ["observation.images.cam_image", "observation.state.joints"] and [f.topic for f in candidates] == ["/cmd_vel"]
    assert config.load(config.dump(plan)) == plan
    assert metadata.config_verdict(found, plan)["verdict"] == "PASS" and metadata.config_verdict(found, plan, strict=True)["unused"] == ["/cmd_vel", "/rosout"]
    shapes = {r.topic: r["shape"] for r in metadata.consensus_shape(m, "topic", "shape", "shape").collect()}
    assert shapes["/cam/image"] is None and shapes["/joints"] == "6"
    assert [metadata.target_rate([29.6, 30.2], []), metadata.target_rate([], [0.2]), metadata.target_rate([], [])] == [30, 1, 30]


def test_pixels(spark):
    white, dark = bytes([255] * 12), bytes([0] * 12)
    df = spark.createDataFrame([("a", bytearray(white), "rgb8", 2, 2), ("b", bytearray(white), "rgb8", 2, 2), ("b", bytearray(dark), "rgb8", 2, 2)], "feature_key string, data binary, encoding string, height int, width int")
    got = {(r.feature_key, r.channel): r for r in pixels.pixel_stats(pixels.level_counts(df)).collect()}
    assert got["a", 0].mean == 1.0 and got["a", 0].std == 0.0 and got["b", 2].mean == 0.5 and got["b", 2].q10 == 0.0


def test_sidecars(spark, tmp_path):
    t = sidecars.parse_task(json.dumps({"task": "pick", "subtasks": [{"start": 0, "end": 1, "subtask": "a"}, {"start": 1, "end": 2.5, "subtask": "b"}]}))
    assert t.spans == ((0.0, 1.0, "a"), (1.0, 2.5, "b"))
    for bad in ('{"tasks": 1}', '{"task": 3}', '{"subtasks": [{"start": 0, "end": 1, "subtask": "a"}, {"start": 2, "end": 3, "subtask": "b"}]}', "[", '{"subtasks": [{"start": 1, "end": 2, "subtask": "a"}]}'):
        with pytest.raises(sidecars.SidecarError):
            sidecars.parse_task(bad)
    assert sidecars.resolve_task(" ", None, "c") == "c" and sidecars.resolve_task(None, "b", "c") == "b"
    (tmp_path / "x.db3").write_bytes(b"one")
    (tmp_path / "metadata.yaml").write_bytes(b"any")
    first = sidecars.digests(spark, [str(tmp_path)]).first().sha256
    (tmp_path / "metadata.yaml").write_bytes(b"other")
    assert sidecars.bag_digest(str(tmp_path)) == first
    (tmp_path / "x.db3").write_bytes(b"two")
    assert sidecars.bag_digest(str(tmp_path)) != first


def test_commands(spark, tmp_path, capsys):
    assert cli.main(["validate-dataset", str(tmp_path)]) == 1 and "MISSING_FILE" in capsys.readouterr().out
    assert cli.main(["inspect", str(tmp_path)]) == 2
