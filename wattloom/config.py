"""Thresholds and windows. Two daypart tables exist: one for features, one for detectors."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace

#: Hours [start, end) of dayparts; night wraps in the feature table.
FEATURE_DAYPARTS = {"night": (22, 6), "morning": (6, 10), "midday": (10, 16), "evening": (16, 22)}
DETECTOR_DAYPARTS = {"night": (0, 6), "morning": (6, 10), "midday": (10, 16), "evening": (17, 22)}
SUMMER, WINTER = (6, 7, 8), (12, 1, 2)
#: Half-open temperature bins in degrees Celsius.
TEMPERATURE_BINS = {"below_minus5": (None, -5.0), "minus5_to_0": (-5.0, 0.0), "0_to_5": (0.0, 5.0), "5_to_10": (5.0, 10.0), "10_to_15": (10.0, 15.0), "above_15": (15.0, None)}
#: Weather columns whose values name the end of their hour.
INTERVAL_END = ("shortwave_radiation", "direct_radiation", "diffuse_radiation", "sunshine_duration", "precipitation", "snowfall")
ASSETS = ("pv", "ev", "heatpump", "battery")


@dataclass(frozen=True)
class Thresholds:
    near_zero_kw: float = 0.2
    near_zero_run: int = 2
    event_kw: tuple[float, ...] = (3.0, 5.0, 7.0, 11.0)
    event_run: int = 2
    session_kw: float = 3.0
    session_run: int = 2
    min_radiation: float = 100.0
    min_pairs: int = 30
    min_bin_rows: int = 20
    valid_day_rows: int = 90
    day_rows: int = 96
    kwh_to_kw: float = 4.0
    interval_minutes: int = 15


@dataclass(frozen=True)
class DetectorConfig:
    interval_minutes: int = 15
    ev_window: int = 32
    ev_residual_kw: float = 2.5
    ev_gap: int = 2
    ev_run: int = 3
    ev_max_cv: float = 0.25
    ev_levels: tuple[float, ...] = (3.7, 7.0, 11.0)
    export_kw: float = 0.1
    pv_corr: float = 0.5
    dip_share: float = 0.5
    dip_run: int = 8
    dip_hours: tuple[int, int] = (9, 17)
    hp_excess_kw: float = 0.8
    hp_window: int = 12
    hp_switches: int = 3
    hp_run: int = 8
    hp_hours: tuple[int, int] = (4, 10)
    battery_kw: float = 0.1
    battery_run: int = 4
    battery_radiation: float = 50.0
    battery_evening: tuple[int, int] = (17, 23)
    high_quantile: float = 0.95
    high_run: int = 4
    day_rows: int = 96
    showcase_confidence: float = 0.6
    dayparts: dict = field(default_factory=lambda: DETECTOR_DAYPARTS)


@dataclass(frozen=True)
class Settings:
    """Where things are; without a registry folder, the registry is in the data folder."""

    data_dir: str = "data/load"
    registry_dir: str | None = None
    weather_dir: str = "data/weather"
    store_dir: str = "data/store"

    @property
    def registry_root(self) -> str:
        return self.registry_dir or self.data_dir


def settings_from(env: Mapping[str, str] = os.environ, prefix: str = "WATTLOOM_") -> Settings:
    """Settings with those replaced that the environment has as PREFIX_NAME; names in any case, empty ones don't count."""
    known = {k.upper(): v for k, v in env.items()}
    return Settings(**{f.name: known[name] for f in fields(Settings) if known.get(name := f"{prefix}{f.name}".upper())})


@dataclass(frozen=True)
class Config:
    features: Thresholds = Thresholds()
    events: DetectorConfig = DetectorConfig()


def config_from(text: str | None = None) -> Config:
    """Defaults with those replaced that a JSON text of the same nesting names; unknown names are errors."""
    out = Config()
    for section, values in json.loads(text or "{}").items():
        if section not in {f.name for f in fields(Config)}:
            raise ValueError(f"unknown section {section!r}")
        part = getattr(out, section)
        unknown = set(values) - {f.name for f in fields(part)}
        if unknown:
            raise ValueError(f"unknown in {section}: {', '.join(sorted(unknown))}")
        out = replace(out, **{section: replace(part, **{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})})
    return out
