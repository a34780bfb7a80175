"""Settings shared by the operators: the analysed grid and default constants."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class GridSpec:
    """A lon/lat box cut into ``nx`` columns and ``ny`` rows."""

    lon0: float
    lat0: float
    lon1: float
    lat1: float
    nx: int
    ny: int

    def __post_init__(self) -> None:
        if self.nx < 1 or self.ny < 1:
            raise ValueError("a grid needs at least one column and one row")
        if not (self.lon1 > self.lon0 and self.lat1 > self.lat0):
            raise ValueError("the upper right corner must lie above the lower left one")

    @property
    def lon_step(self) -> float:
        return (self.lon1 - self.lon0) / self.nx

    @property
    def lat_step(self) -> float:
        return (self.lat1 - self.lat0) / self.ny

    @property
    def cells(self) -> int:
        return self.nx * self.ny


# The three analysed boxes (lon0, lat0, lon1, lat1).
REGION_1 = (116.258726, 39.820333, 116.505918, 40.028333)
REGION_2 = (116.275935, 39.840503, 116.495319, 40.000593)
REGION_3 = (116.26954, 39.828598, 116.49167, 39.997132)

# Default grid, window, thresholds and speed limits (metres, seconds, m/s).
DEFAULT_GRID = GridSpec(*REGION_3, nx=48, ny=48)
WINDOW_MINUTES = 20
ROAD_CLASSES = (0, 1, 2, 3, 4, 6)
MIN_SPEED = 0.5
MAX_SPEED = 50.0
MIN_KNOWN_SPEED = 0.25
INCOMPLETE_DAY_FRACTION = 0.3
NO_SIGNAL_FRACTION = 0.05
LOW_WEIGHT = 5
LOW_WEIGHT_SPEED = 20.0
CHANGE_THRESHOLD = 200.0
TOP_CHANGES = 3000
COUNT_SPLITS = (2500, 5000, 10000)

# Road class codes of the network files.
ROAD_CLASS_CODES = {
    "0x00": 0,
    "0x01": 1,
    "0x02": 2,
    "0x03": 3,
    "0x04": 4,
    "0x06": 6,
    "0x08": 8,
    "0x09": 9,
    "0x0b": 11,
}

# Congestion labels.
LABEL_NONE, LABEL_JAM, LABEL_SLIGHT_JAM, LABEL_GENERAL, LABEL_CLEAR = 0, 1, 2, 3, 4


def check_window(minutes: int) -> int:
    """Windows are 1 to 60 whole minutes."""
    if not 1 <= minutes <= 60:
        raise ValueError("the window must be 1 to 60 minutes")
    return minutes


def windows_per_day(minutes: int) -> int:
    return 24 * 60 // minutes
