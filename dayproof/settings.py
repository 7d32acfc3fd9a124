"""Operational limits, as one frozen value that jobs take as an argument."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta
from decimal import Decimal


@dataclass(frozen=True)
class Settings:
    source_topic: str = "business-events"
    alert_topic: str = "reconciliation-alerts"
    zone: str = "UTC"
    settlement_delay: timedelta = timedelta(hours=1)
    amount_tolerance: Decimal = Decimal("0.0001")
    max_replay_days: int = 31
    max_replay_attempts: int = 5
    replay_stale_after: timedelta = timedelta(minutes=10)
    redispatch_after: timedelta = timedelta(minutes=5)
    alert_retry_after: timedelta = timedelta(minutes=5)
    recovery_batch: int = 100
    source_retention: timedelta = timedelta(days=45)
    webhook_enabled: bool = True
    # Offsets per source partition that one replay chunk covers at least (see replay.chunk_offsets).
    replay_chunk_offsets: int = 100_000

    def __post_init__(self) -> None:
        if self.amount_tolerance < 0:
            raise ValueError("amount_tolerance must not be negative")
        if not 1 <= self.max_replay_days <= 365:
            raise ValueError("max_replay_days must be between 1 and 365")
        if not 1 <= self.max_replay_attempts <= 20:
            raise ValueError("max_replay_attempts must be between 1 and 20")
        if self.source_retention < timedelta(days=self.max_replay_days):
            raise ValueError("source retention must cover the longest replay window")

    @property
    def channels(self) -> list[str]:
        return ["KAFKA", "WEBHOOK"] if self.webhook_enabled else ["KAFKA"]


DEFAULTS = Settings()
