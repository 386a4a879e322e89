"""Column roles of a continuous labelled frame and the eager checks on them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Columns:
    """Which column plays which part. ``tie`` orders rows that share a timestamp."""

    ts: str
    group: str
    label: str
    features: tuple[str, ...] = field(default_factory=tuple)
    tie: str | None = None

    @property
    def values(self) -> tuple[str, ...]:
        return (self.label, *self.features)

    def check(self, df: DataFrame) -> None:
        if not self.features:
            raise ValueError("at least one feature column is needed")
        needed = [self.ts, self.group, self.label, *self.features]
        missing = [c for c in needed if c not in df.columns]
        if missing:
            raise ValueError(f"columns not found: {missing}; available: {df.columns}")


def require(df: DataFrame, *names: str) -> None:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}; available: {df.columns}")
