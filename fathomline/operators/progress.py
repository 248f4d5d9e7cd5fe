"""Progress of an index build: states, batches, remaining time."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

STATES = ("idle", "parsing", "building_bm25", "vectorizing", "completed", "error")
BATCH = 50


def batches(n: Column, size: int = BATCH) -> Column:
    return F.ceil(n / size).cast("long")


def eta(elapsed: Column, current: Column, total: Column) -> Column:
    """Seconds that are left; null before the first batch."""
    return F.when(current > 0, elapsed / current * (total - current))


@dataclass(frozen=True)
class Status:
    """State of one build; changes give a new value, and a run's start is set when it leaves idle."""

    state: str = "idle"
    current: int = 0
    total: int = 0
    started: datetime | None = None
    message: str | None = None

    def to(self, state: str, now: datetime, **changes) -> Status:
        if state not in STATES:
            raise ValueError(f"not a state: {state}")
        started = now if state not in ("idle", "completed", "error") and self.started is None else self.started
        return replace(self, state=state, started=None if state == "idle" else started, **changes)

    def remaining(self, now: datetime) -> float | None:
        if not self.started or not self.current:
            return None
        return (now - self.started).total_seconds() / self.current * (self.total - self.current)
