"""Settings with defaults, and YAML to overlay them."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any


# What a marked image has.
WATERMARKS = ("NONE", "VISIBLE", "INVISIBLE", "BOTH")


@dataclass(frozen=True)
class Samples:
    hash_distance: int = 6
    cosine: float = 0.96
    outlier_percentile: float = 95.0
    neighbours: int = 5
    pattern_samples: int = 3
    review_ratio: float = 0.15
    quarantine_ratio: float = 0.30


@dataclass(frozen=True)
class Models:
    probes: int = 20
    tolerance: float = 0.05
    outlier_sigma: float = 4.0


@dataclass(frozen=True)
class Provenance:
    spot_check_rate: float = 0.25
    spot_check_tolerance: float = 1e-4
    watermark: str = "INVISIBLE"

    def __post_init__(self):
        policy = str(self.watermark).upper()
        if policy not in WATERMARKS:
            raise ValueError(f"watermark is {self.watermark}, not one of {', '.join(WATERMARKS)}")
        object.__setattr__(self, "watermark", policy)


@dataclass(frozen=True)
class Shift:
    bins: int = 20
    drift_threshold: float = 0.25


@dataclass(frozen=True)
class Config:
    samples: Samples = field(default_factory=Samples)
    models: Models = field(default_factory=Models)
    provenance: Provenance = field(default_factory=Provenance)
    shift: Shift = field(default_factory=Shift)
    output_dir: str = "runs"


def _merged(base: Any, values: dict[str, Any]) -> Any:
    unknown = set(values) - {f.name for f in fields(base)}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return dataclasses.replace(base, **{k: _merged(getattr(base, k), v) if is_dataclass(getattr(base, k)) else v for k, v in values.items()})


def load(path: str | None = None) -> Config:
    if not path:
        return Config()
    import yaml

    with open(path, encoding="utf-8") as f:
        return _merged(Config(), yaml.safe_load(f) or {})


def save(config: Config, path: str) -> None:
    import yaml

    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump(dataclasses.asdict(config), f, sort_keys=False)
