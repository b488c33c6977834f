"""Commands over bags, configurations and datasets. Exit codes: 0 good, 1 a finding, 2 it couldn't be checked."""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from framewright.operators import metadata, quality, sequence, stats, validate
from framewright.plans import config, convert
from framewright.sinks import dataset
from framewright.sources import bags, sidecars


def session() -> SparkSession:
    return SparkSession.builder.appName("framewright").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def validate_config(args: argparse.Namespace) -> int:
    with open(args.config) as f:
        plan = config.load(f.read())
    first = bags.discover(args.bags)[0]
    out = metadata.config_verdict(metadata.topics(bags.read_bags(session(), first, payload=False)), plan, args.strict)
    print(json.dumps(out, indent=1))
    return int(out["verdict"] == "FAIL")


def inspect(args: argparse.Namespace) -> int:
    bags.discover(args.bags)
    m = bags.read_bags(session(), args.bags, payload=False)
    by = ["episode_index", "topic"]
    (stats.fps_report(m, by) if args.fps_stats else metadata.topics(m)).show(1000, False)
    return 0


def scaffold(args: argparse.Namespace) -> int:
    bags.discover(args.bags)
    plan, candidates = metadata.scaffold(metadata.topics(bags.read_bags(session(), args.bags, payload=False)), args.fps, args.robot_type, args.task)
    print(config.dump(plan), end="")
    for f in candidates:
        print(f"# candidate: {f.topic} ({f.msg_type}) as {f.key}")
    return 0


def validate_dataset(args: argparse.Namespace) -> int:
    found = validate.dataset_issues(session(), args.dataset)
    v = validate.verdict(found, args.strict).first()
    rows = [r.asDict() for r in validate.capped(found, args.max_errors).collect()]
    print(json.dumps({"verdict": v.verdict, "errors": v.errors, "warnings": v.warnings, "issues": rows}, indent=1))
    return int(v.verdict == "FAIL")


def report(args: argparse.Namespace, body: dict) -> None:
    """To the standard output, and whole into a file if one is named."""
    print(json.dumps(body, indent=1, default=str))
    if getattr(args, "json", None):
        with open(args.json, "w") as f:
            json.dump(body, f, indent=1, default=str)


def convert_bags(args: argparse.Namespace) -> int:
    with open(args.config) as f:
        plan = config.load(f.read())
    plan = dataclasses.replace(plan, fps=args.fps if args.fps is not None else plan.fps)
    if args.dry_run:
        found = bags.discover(args.bags)[: args.max_episodes]
        report(args, {"bags": found, "features": [f.key for f in plan.features], "fps": plan.fps, "policy": plan.resampling.policy, "output": args.output})
        return 0
    report(args, convert.convert(session(), args.bags, args.output, plan, args.task, args.max_episodes, resume=args.resume))
    return 0


def quality_report(args: argparse.Namespace) -> int:
    """Null, NaN and out-of-range rates of each feature against the dataset's own statistics; without videos nothing is frozen."""
    spark = session()
    with open(f"{args.dataset}/meta/info.json") as f:
        info = json.load(f)
    with open(f"{args.dataset}/meta/stats.json") as f:
        known = json.load(f)
    data = dataset.read(spark, args.dataset)
    rows = []
    for key in (k for k, v in info["features"].items() if k in known and v["dtype"] != "video"):
        nulls = quality.null_counts(data.withColumn("feature", F.lit(key)), ["feature"], f"`{key}`").first()
        bounds = spark.createDataFrame([(d, float(a), float(b)) for d, (a, b) in enumerate(zip(known[key]["min"], known[key]["max"], strict=True))], "dim int, lo double, hi double")
        dims = stats.explode_dims(data.withColumn("feature", F.lit(key)), ["feature"], f"`{key}`")
        out = quality.out_of_range(dims, bounds, ["dim"], ["feature"], args.range_tol).first()
        n = max(1, nulls.n_values)
        rows.append((key, (nulls.n_null + nulls.n_nan) / n, (out.n_oor if out else 0) / n, 0.0))
    score = quality.score(spark.createDataFrame(rows, "feature string, null_rate double, oor_rate double, freeze_rate double"), least=args.score_threshold).first()
    report(args, {"score": score.score, "verdict": score.verdict, "features": [dict(zip(("feature", "null_rate", "oor_rate", "freeze_rate"), r, strict=True)) for r in rows]})
    return int(score.verdict == "FAIL")


def audit_timestamps(args: argparse.Namespace) -> int:
    """Whether each video's episodes follow each other without a gap."""
    episodes = session().read.parquet(f"{args.dataset}/meta/episodes")
    keys = [args.video_key] if args.video_key else validate.video_keys(episodes.columns)
    found = {}
    for key in keys:
        if lacking := [c for c in validate.VIDEO_COLUMNS if f"videos/{key}/{c}" not in episodes.columns]:
            raise ValueError(f"{key}: no column {lacking[0]}")
        rows = validate.video_mapping(episodes, key).where("from_timestamp IS NOT NULL").withColumn("file", F.col("chunk_index") * 1_000_000 + F.col("file_index"))
        bad = sequence.audit_offsets(rows, args.max_drift_us, "file").orderBy("episode_index")
        found[key] = {"errors": bad.count(), "first": [r.asDict() for r in bad.limit(args.max_errors).collect()]}
    report(args, found)
    return int(any(v["errors"] for v in found.values()))


def validate_video_metadata(args: argparse.Namespace) -> int:
    """Frames, episodes and what a probe found of the videos (a Parquet table: this machine has no decoder)."""
    spark = session()
    with open(f"{args.dataset}/meta/info.json") as f:
        fps = json.load(f)["fps"]
    episodes = spark.read.parquet(f"{args.dataset}/meta/episodes")
    found = validate.video_issues(dataset.read(spark, args.dataset), episodes, spark.read.parquet(args.probe), fps, validate.video_keys(episodes.columns), args.strict, args.tolerance_s).cache()
    v = validate.verdict(found).first()
    report(args, {"verdict": v.verdict, "errors": v.errors, "warnings": v.warnings, "issues": [r.asDict() for r in validate.capped(found, args.max_errors).collect()]})
    return int(v.verdict == "FAIL")


def digest(args: argparse.Namespace) -> int:
    for r in sidecars.digests(session(), bags.discover(args.bags)).orderBy("bag_path").collect():  # one row a bag
        print(r.sha256, r.bag_path)
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="framewright", description=__doc__)
    sub = parser.add_subparsers(required=True)

    def add(name: str, run, *options: tuple[str, dict]) -> None:  # noqa: ANN001
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        for option, how in options:
            p.add_argument(option, **how)

    strict, folder = ("--strict", {"action": "store_true"}), ("bags", {})
    add("validate-config", validate_config, ("config", {}), folder, strict)
    add("inspect", inspect, folder, ("--fps-stats", {"action": "store_true"}))
    add("scaffold", scaffold, folder, ("--fps", {"type": float, "default": 30.0}), ("--robot-type", {"default": "robot"}), ("--task", {"default": "task"}))
    add("validate-dataset", validate_dataset, ("dataset", {}), strict, ("--max-errors", {"type": int, "default": 50}))
    add("digest", digest, folder)
    data, out = ("dataset", {}), ("--json", {"help": "also write the report to this file"})
    most = ("--max-errors", {"type": int, "default": 50})
    add("convert", convert_bags, ("config", {}), folder, ("output", {}), ("--task", {}), ("--fps", {"type": float}), ("--max-episodes", {"type": int}), ("--resume", {"action": "store_true"}), ("--dry-run", {"action": "store_true"}), out)
    add("quality-report", quality_report, data, ("--range-tol", {"type": float, "default": 0.0}), ("--score-threshold", {"type": float, "default": 0.95}), out)
    add("audit-timestamps", audit_timestamps, data, ("--max-drift-us", {"type": float, "default": 1.0}), ("--video-key", {}), most, out)
    add("validate-video-metadata", validate_video_metadata, data, ("probe", {}), strict, ("--tolerance-s", {"type": float}), most, out)
    args = parser.parse_args(argv)
    try:
        return args.run(args)
    except (OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
