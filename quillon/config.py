"""Validated settings of a top-k query."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum


class Agg(Enum):
    SUM = "SUM"
    COUNT = "COUNT"
    MAX = "MAX"
    MIN = "MIN"

    @classmethod
    def parse(cls, text: str | Agg) -> Agg:
        """The aggregate of that name, in any case; an unknown name is an error."""
        if isinstance(text, cls):
            return text
        try:
            return cls[str(text).upper()]
        except KeyError:
            raise ValueError(f"unknown aggregate {text!r}; one of {', '.join(a.value for a in cls)}") from None


class Mode(Enum):
    """How candidate groups are found. All modes return the same rows."""

    EXACT = "brute-force"
    SAMPLE = "baseline"
    STRATIFIED = "ext-a"
    EXTREMES = "ext-b"
    COMBINED = "ext-ab"

    @classmethod
    def parse(cls, text: str | Mode) -> Mode:
        if isinstance(text, cls):
            return text
        for mode in cls:
            if text in (mode.value, mode.name, mode.name.lower()):
                return mode
        raise ValueError(f"unknown mode {text!r}; one of {', '.join(m.value for m in cls)}")


@dataclass(frozen=True)
class TopKConfig:
    """Options of the pruned plans; defaults suit large skewed inputs.

    Inputs of fewer than ``min_rows_per_core`` rows for each core take the exact
    plan, whose single shuffle is then cheaper than several scans, and so do modes
    that would count all groups first, as that is the exact plan's shuffle already
    (0: neither).
    """

    fa_capacity: int = 50_000
    n_partitions: int = 10_000
    sample_frac: float = 0.01
    delta: float = 0.05
    alpha_ci: float = 0.05
    beta_ci: float = 0.95
    alpha_locality: float = 0.20
    underrep_threshold: float = 0.5
    boost_rows: int = 10
    measure_m: int = 500
    min_topk_share: float = 0.01
    min_rows_per_core: int = 50_000_000
    force: bool = False
    max_levels: int = 2
    seed: int = 42

    def __post_init__(self):
        for name in ("fa_capacity", "n_partitions", "max_levels"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")
        for name in ("boost_rows", "measure_m", "min_rows_per_core"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")
        if not 0 < self.sample_frac <= 1:
            raise ValueError("sample_frac must lie in (0, 1]")
        if self.fa_capacity > 1_000_000 or self.n_partitions > 1_000_000:
            raise ValueError("fa_capacity and n_partitions bound what the driver holds: one million each at most")
        if not 0 <= self.beta_ci < 1:
            raise ValueError("beta_ci must lie in [0, 1)")
        if not 0 <= self.min_topk_share <= 1:
            raise ValueError("min_topk_share must lie in [0, 1]")
