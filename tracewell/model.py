"""Plain records that describe a recording and a preprocessing configuration."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

SPATIAL = ("off", "global_cmr", "local_cmr", "destripe")
PROBE_TYPES_2 = (21, 24, 2013, 2014)  # fixed values: probe types with 16 samples per multiplexer cycle

# Fixed operating values.
HIGHPASS_HZ, FILTER_ORDER, KFILT_WN = 300.0, 3, 0.01
CMR_NEAR_UM, CMR_FAR_UM = 100.0, 400.0
AGC_SECONDS, AGC_EPSILON, KFILT_PAD = 0.1, 0.003, 60
REFRACTORY_MS, SMOOTH_RADIUS = 1.5, 3
PSTH_PAD_S, OVERLAP_SAMPLES = 0.15, 2000


@dataclass(frozen=True)
class PreprocConfig:
    """Which stages run, and what their parameters derive from."""

    sample_rate: float
    dc_removal: bool = True
    phase_shift: bool = False
    highpass: bool = True
    spatial: str = "global_cmr"
    avg_depths: bool = True
    probe_type: int = 0

    def __post_init__(self):
        if self.spatial not in SPATIAL:
            raise ValueError(f"spatial filter {self.spatial!r}: not one of {SPATIAL}")

    def with_(self, **changes) -> PreprocConfig:
        return replace(self, **changes)

    @property
    def highpass_wn(self) -> float:
        return HIGHPASS_HZ / self.sample_rate * 2.0

    @property
    def agc_half(self) -> int:
        """Half of the gain window in samples: a tenth of a second, rounded, halved down."""
        return round_half_away(self.sample_rate * AGC_SECONDS) // 2

    @property
    def refractory(self) -> int:
        return int(REFRACTORY_MS * self.sample_rate / 1000.0)


@dataclass(frozen=True)
class Channel:
    ch: int
    x_um: float
    y_um: float
    shank: int


@dataclass(frozen=True)
class Meta:
    """What a recording's side-car files say about it."""

    n_saved_chans: int
    n_chans: int
    sample_rate: float
    n_samples: int
    uv_per_bit: float
    probe_type: int = 0
    channels: tuple[Channel, ...] = field(default=(), repr=False)


def round_half_away(x: float) -> int:
    return int(math.floor(abs(x) + 0.5)) * (1 if x >= 0 else -1)


def sample_of(seconds: float, rate: float) -> int:
    """The sample of an event time: rounded, halves away from zero."""
    return round_half_away(seconds * rate)


def view_sample(seconds: float, rate: float) -> int:
    """The first sample of a view: cut off, not rounded."""
    return int(seconds * rate)
