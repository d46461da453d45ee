"""All tunable values of the ledger in one frozen object, and the model registry rows."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date


@dataclass(frozen=True)
class LedgerConfig:
    tz: str = "Europe/Berlin"
    slot_minutes: int = 15
    horizons: tuple[int, ...] = (1, 2)
    min_coverage: float = 0.9
    # issue window, local wall clock, half open
    earliest_issue: str = "08:45"
    deadline: str = "12:00"
    # recommended window
    window_hours: int = 3
    near_tolerance: float = 5.0
    # hourly shaping
    min_hours_per_day: int = 22
    shape_days: int = 28
    shape_start: date | None = None
    # covariates
    publication_delay_hours: int = 6
    # reporting
    windows: tuple[tuple[str, int | None], ...] = (("7d", 7), ("30d", 30), ("90d", 90), ("all", None))
    min_dm_days: int = 10
    feature_window_days: int = 30
    feature_min_days: int = 14
    level_jump: float = 25.0
    bias_limit: float = 10.0

    @property
    def slot_seconds(self) -> int:
        return self.slot_minutes * 60

    @property
    def slots_per_hour(self) -> int:
        return 60 // self.slot_minutes

    @property
    def slots_per_day(self) -> int:
        return 24 * self.slots_per_hour

    @property
    def window_slots(self) -> int:
        return self.window_hours * self.slots_per_hour

    @property
    def resolution(self) -> str:
        return f"PT{self.slot_minutes}M"


@dataclass(frozen=True)
class ModelSpec:
    """One registered model version; ``live_since`` opens the period in which it is due."""

    name: str
    version: str = "1"
    rule: str | None = None
    error_days: int = 90
    min_error_days: int = 30
    live_since: date | None = None
    retired_after: date | None = None
    description: str = field(default="", compare=False)

    @property
    def key(self) -> str:
        return f"{self.name}.v{self.version}"


NAIVE_SPECS: tuple[ModelSpec, ...] = (
    ModelSpec("naive_last_day", rule="last_day", description="Profile of the issue day."),
    ModelSpec("naive_weekly", rule="weekly", description="Profile of the same day one week earlier."),
    ModelSpec(
        "naive_similar_day",
        rule="similar_day",
        description="Mon/Sat/Sun: one week earlier; otherwise the last known day.",
    ),
)

REFERENCE_MODEL = "naive_similar_day.v1"
