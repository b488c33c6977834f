"""Files beside a bag: task.json and the digest of the bag's own files."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class SidecarError(ValueError):
    """A task.json that can't be used."""


@dataclass(frozen=True)
class Task:
    task: str | None
    spans: tuple[tuple[float, float, str], ...]


def parse_task(text: str) -> Task:
    try:
        data = json.loads(text)
    except ValueError as e:
        raise SidecarError(str(e)) from e
    if not isinstance(data, dict) or set(data) - {"task", "subtasks"}:
        raise SidecarError("only task and subtasks are known")
    if not isinstance(data.get("task"), (str, type(None))):
        raise SidecarError("task is text")
    spans = []
    for s in data.get("subtasks") or []:
        if not isinstance(s, dict) or set(s) != {"start", "end", "subtask"} or not isinstance(s["subtask"], str):
            raise SidecarError("a subtask has start, end and subtask")
        if any(isinstance(s[k], bool) or not isinstance(s[k], (int, float)) for k in ("start", "end")) or s["end"] <= s["start"]:
            raise SidecarError("a subtask ends after it starts")
        spans.append((float(s["start"]), float(s["end"]), s["subtask"]))
    for (_, b, _), (a, _, _) in zip(spans, spans[1:], strict=False):
        if abs(a - b) > 1e-6:
            raise SidecarError(f"subtasks leave a gap or overlap at {b}")
    if spans and abs(spans[0][0]) > 1e-6:
        raise SidecarError("subtasks start at 0")
    return Task(data.get("task"), tuple(spans))


def resolve_task(sidecar: str | None, option: str | None, configured: str) -> str:
    """The sidecar's task, else the command's, else the configuration's; blank ones don't count."""
    return next((t for t in (sidecar, option) if t and t.strip()), configured)


def resolved_task(sidecar: Column, option: Column, configured: Column) -> Column:
    """resolve_task() for columns."""
    stated = lambda c: F.when(F.regexp_like(c, F.lit(r"\S")), c)
    return F.coalesce(stated(sidecar), stated(option), configured)


def bag_digest(path: str) -> str:
    """SHA-256 over the names and bytes of a bag's files in order of name, without metadata.yaml."""
    out = hashlib.sha256()
    files = [path] if os.path.isfile(path) else sorted(os.path.join(path, f) for f in os.listdir(path) if f != "metadata.yaml")
    for f in filter(os.path.isfile, files):
        out.update(os.path.basename(f).encode())
        with open(f, "rb") as data:
            while block := data.read(1 << 20):
                out.update(block)
    return out.hexdigest()


def digests(spark: SparkSession, bags: list[str]) -> DataFrame:
    """(bag_path, sha256), a task a bag, read in blocks."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"bag_path": p["bag_path"], "sha256": [bag_digest(b) for b in p["bag_path"]]})

    return spark.createDataFrame([(b,) for b in bags], "bag_path string").repartition(max(1, len(bags))).mapInPandas(run, "bag_path string, sha256 string")
