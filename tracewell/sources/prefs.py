"""Preferences: a dataclass kept as TOML."""

from __future__ import annotations

import dataclasses
import json
import logging
import os
import tomllib
from dataclasses import dataclass, field

from tracewell.functions import color
from tracewell.model import PreprocConfig

log = logging.getLogger("tracewell")


@dataclass
class Preferences:
    """Settings of a viewing session."""

    preproc: PreprocConfig = field(default_factory=lambda: PreprocConfig(sample_rate=30_000.0))
    view_s: float = 0.5
    color_mode: str = "Percentile"
    color_percent: float = 99.0
    color_uv: float = 250.0
    colormap: str = "IceFire"
    spike_threshold: float = -20.0
    spike_scale: float = 1.0
    spike_sigma: float = 1.5
    buffer_s: float = 30.0
    extension_margin_s: float = 5.0
    memory_pressure_percent: float = 15.0
    memory_reserve_mb: float = 1500.0
    last_dir: str | None = None


# The names of settings and choices in a preferences file.
KEYS = {
    "view_s": "view_dur_s", "color_mode": "color_mode", "color_percent": "color_pct", "color_uv": "color_uv", "colormap": "colormap_choice", "spike_threshold": "spike_threshold",
    "spike_scale": "spike_overlay_scale", "spike_sigma": "spike_smoothing_sigma", "buffer_s": "initial_buffer_s", "extension_margin_s": "extension_margin_s",
    "memory_pressure_percent": "mem_pressure_pct", "memory_reserve_mb": "mem_reserve_mb", "last_dir": "last_dir",
}
REQUIRED = ("view_s", "color_mode", "color_percent", "color_uv", "colormap", "spike_threshold")
PREPROC_KEYS = {"dc_removal": "dc_removal", "phase_shift": "phase_shift", "highpass": "highpass", "spatial": "spatial_filter", "avg_depths": "avg_depths", "sample_rate": "sample_rate", "probe_type": "im_dat_prb_type"}
SPATIAL_NAMES = {"off": "Off", "global_cmr": "GlobalCmr", "local_cmr": "LocalCmr", "destripe": "Destripe"}
COLOR_MODES = ("Percentile", "Voltage")


def _line(key: str, value) -> str:
    return f"{key} = {'true' if value is True else 'false' if value is False else json.dumps(value)}"


def save_preferences(prefs: Preferences, path: str) -> None:
    flat = dataclasses.asdict(prefs)
    nested = flat.pop("preproc")
    nested["spatial"] = SPATIAL_NAMES[nested["spatial"]]
    lines = [_line(key, flat[name]) for name, key in KEYS.items() if flat[name] is not None]
    text = "\n".join([*lines, "", "[preproc_cfg]", *(_line(key, nested[name]) for name, key in PREPROC_KEYS.items()), ""])
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def _read(text: str, sample_rate: float, probe_type: int) -> Preferences:
    """Preferences of a file's text; one that lacks a required setting, or has an unknown choice, raises."""
    found = tomllib.loads(text)
    nested = found["preproc_cfg"]
    stages = {name: nested[key] for name, key in PREPROC_KEYS.items()}
    stages["spatial"] = {v: k for k, v in SPATIAL_NAMES.items()}[stages["spatial"]]
    given = {name: found[key] for name, key in KEYS.items() if key in found}
    if lost := [KEYS[n] for n in REQUIRED if n not in given]:
        raise ValueError(f"no {', '.join(lost)}")
    if given["color_mode"] not in COLOR_MODES or given["colormap"] not in color.POSITIVE:
        raise ValueError(f"unknown choice {given['color_mode']!r} or {given['colormap']!r}")
    return Preferences(preproc=PreprocConfig(**(stages | {"sample_rate": sample_rate, "probe_type": probe_type})), **given)


def load_preferences(path: str, sample_rate: float, probe_type: int, legacy: str | None = None) -> Preferences | None:
    """Preferences of a file, or of an older place if that one isn't there; None if they cannot be read. Rate and probe are the recording's.

    Optional settings that a file lacks have their defaults; settings of other names are ignored.
    """
    for p in filter(None, (path, legacy)):
        try:
            with open(p, encoding="utf-8") as f:
                text = f.read()
        except OSError as e:
            log.debug("preferences at %s not read: %s", p, e)
            continue
        try:
            return _read(text, sample_rate, probe_type)
        except (tomllib.TOMLDecodeError, KeyError, TypeError, ValueError) as e:
            log.debug("preferences at %s not read: %s", p, e)
            return None
    return None


def debug_log(path: str) -> None:
    """Timestamped lines of this package appended to a file."""
    handler = logging.FileHandler(path)
    handler.setFormatter(logging.Formatter("%(asctime)s %(message)s"))
    log.addHandler(handler)
    log.setLevel(logging.DEBUG)
