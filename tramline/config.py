"""Settings shared by the operators. Every operator takes them as arguments."""

from __future__ import annotations

from dataclasses import dataclass

ZONE = "America/Denver"
EARTH_RADIUS_M = 6_371_000.0

# The feed folders, lowest precedence first.
FEED_FOLDERS = [
    "light_rail",
    "op_commuter_rail",
    "op_motorbus",
    "pur_commuter_rail",
    "pur_motorbus",
]
RAIL_FOLDERS = ["light_rail", "op_commuter_rail", "pur_commuter_rail"]

# Routes that replace whatever the files say.
ROUTE_OVERRIDES = [
    ("101C", "C", "C Line", "0", "f79239", "RTD"),
    ("101T", "T", "T Line", "0", "b71318", "RTD"),
]

# route_type codes.
RAIL_TYPES = ["0", "1", "2"]
ROUTE_TYPE_NAMES = {"0": "light_rail", "1": "heavy_rail", "2": "commuter_rail", "3": "bus"}
CYCLE_MINUTES = {"0": 45.0, "1": 30.0, "2": 120.0, "3": 90.0}
DEFAULT_CYCLE_MINUTES = 90.0
SNAPSHOT_CYCLE_MINUTES = 120.0

WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]

# Occupancy names and the rollup counter of each, least crowded first.
OCCUPANCY_COUNTERS = {
    "empty": "EMPTY",
    "many_seats": "MANY_SEATS_AVAILABLE",
    "few_seats": "FEW_SEATS_AVAILABLE",
    "standing": "STANDING_ROOM_ONLY",
    "crushed": "CRUSHED_STANDING_ROOM_ONLY",
    "full": "FULL",
    "not_accepting": "NOT_ACCEPTING_PASSENGERS",
}
OCCUPANCY_ORDER = [*OCCUPANCY_COUNTERS.values(), "UNKNOWN"]

STATUS_LABELS = {0: "INCOMING_AT", 1: "STOPPED_AT", 2: "IN_TRANSIT_TO"}

ON_TIME_SECONDS = 300
DEFAULT_COLOR = "888888"


@dataclass(frozen=True)
class DetectionConfig:
    """Distances in metres, times in seconds."""

    radius: float = 152.0
    radius_rail: float = 402.0
    corridor_factor: float = 3.0
    segment_max_gap: int = 300
    origin_radius: float = 100.0
    origin_silence: int = 900
    terminus_radius: float = 750.0
    terminus_radius_rail: float = 1500.0
    terminus_silence: int = 900
    max_delay: int = 10_800
    alias_min_delay: int = 600
    alias_max_gap: int = 60
    alias_active_window: int = 1800
    zone: str = ZONE


@dataclass(frozen=True)
class StuckConfig:
    threshold_seconds: int = 720
    tolerance_deg: float = 0.0002
    terminal_radius_m: float = 300.0
    zero_deg: float = 0.001

    @property
    def window_seconds(self) -> int:
        return self.threshold_seconds * 3
