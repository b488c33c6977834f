"""The conversion configuration: YAML to checked dataclasses and back. It is the logical plan of a conversion."""

from __future__ import annotations

import difflib
from dataclasses import asdict, dataclass, field, fields
from typing import Any

import yaml


class ConfigError(ValueError):
    """The configuration can't be used."""


class _Loader(yaml.SafeLoader):
    pass


def _mapping(loader: _Loader, node: yaml.MappingNode, deep: bool = False) -> dict:
    keys = [loader.construct_object(k, deep=deep) for k, _ in node.value]
    if twice := [k for k in keys if keys.count(k) > 1]:
        raise ConfigError(f"key {twice[0]!r} comes twice")
    return yaml.SafeLoader.construct_mapping(loader, node, deep)


_Loader.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, _mapping)


def build(kind: type, data: Any, where: str) -> Any:
    """A dataclass from a mapping; unknown keys are refused, with the nearest known one."""
    if not isinstance(data, dict):
        raise ConfigError(f"{where}: a mapping is needed")
    known = [f.name for f in fields(kind)]
    for k in data:
        if k not in known:
            near = difflib.get_close_matches(str(k), known, 1)
            raise ConfigError(f"{where}: unknown key {k!r}" + (f"; did you mean {near[0]!r}?" if near else ""))
    try:
        return kind(**data)
    except TypeError as e:
        raise ConfigError(f"{where}: {e}") from e


DTYPES = ("float32", "float64", "int32", "int64", "uint8", "bool", "image", "string")


@dataclass
class Feature:
    """A topic's part that becomes a feature."""

    topic: str
    key: str
    msg_type: str | None = None
    selector: str | None = None
    dtype: str = "float32"
    unit: str | float | None = None
    required: bool = True
    stamp_source: str = "receive"
    max_stamp_delay_ms: float | None = None
    shape: list[int] | None = None
    decoder: str | None = None

    def __post_init__(self) -> None:
        if self.dtype not in DTYPES:
            raise ConfigError(f"{self.key}: dtype {self.dtype!r} isn't one of {', '.join(DTYPES)}")
        if self.stamp_source not in ("receive", "header"):
            raise ConfigError(f"{self.key}: stamp_source is receive or header")

    @property
    def selectors(self) -> list[str] | None:
        return self.selector.split(",") if self.selector else None


@dataclass
class Resampling:
    policy: str = "hold"
    tolerance_ms: float = 100.0
    align_to_required: bool = True
    trim_to_valid: bool = True
    max_stamp_delay_ms: float | None = None
    min_length: int = 0

    def __post_init__(self) -> None:
        if self.policy not in ("hold", "nearest", "drop"):
            raise ConfigError(f"unknown policy {self.policy!r}")


@dataclass
class Split:
    train: float = 1.0
    val: float = 0.0
    test: float = 0.0

    def __post_init__(self) -> None:
        if min(self.train, self.val, self.test) < 0 or abs(self.train + self.val + self.test - 1) > 1e-6:
            raise ConfigError("split ratios are shares that add up to 1")


@dataclass
class Conversion:
    fps: float
    robot_type: str
    task: str
    features: list[Feature] = field(default_factory=list)
    resampling: Resampling = field(default_factory=Resampling)
    split: Split = field(default_factory=Split)

    def __post_init__(self) -> None:
        if not self.fps > 0:
            raise ConfigError("fps must be positive")
        if not str(self.robot_type).strip() or not str(self.task).strip():
            raise ConfigError("robot_type and task can't be empty")
        keys = [f.key for f in self.features]
        if twice := [k for k in keys if keys.count(k) > 1]:
            raise ConfigError(f"feature {twice[0]!r} comes twice")

    @property
    def topics(self) -> list[str]:
        return list(dict.fromkeys(f.topic for f in self.features))

    @property
    def required_keys(self) -> list[str]:
        return [f.key for f in self.features if f.required and f.topic != "/tf"]

    @property
    def merged(self) -> dict[str, list[str]]:
        """observation.state and action with their sub-keys, in the order of the configuration."""
        out: dict[str, list[str]] = {}
        for f in self.features:
            for head in ("observation.state", "action"):
                if f.key.startswith(head + "."):
                    out.setdefault(head, []).append(f.key)
        return out


def load(text: str) -> Conversion:
    try:
        data = yaml.load(text, _Loader)  # noqa: S506 - a SafeLoader that also refuses repeated keys
    except yaml.YAMLError as e:
        raise ConfigError(str(e)) from e
    if not isinstance(data, dict):
        raise ConfigError("the configuration is a mapping")
    data = dict(data)
    data["features"] = [build(Feature, f, f"features[{k}]") for k, f in enumerate(data.get("features") or [])]
    data["resampling"] = build(Resampling, data.get("resampling") or {}, "resampling")
    data["split"] = build(Split, data.get("split") or {}, "split")
    return build(Conversion, data, "configuration")


def dump(config: Conversion) -> str:
    return yaml.safe_dump(asdict(config), sort_keys=False)
