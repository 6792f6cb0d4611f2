"""Thresholds and limits of the analysis, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    iqr_factor: float = 1.5
    z_limit: float = 3.0
    context_z: float = 3.2
    context_columns: int = 4
    context_numeric: int = 12
    context_values: int = 30
    group_rows: int = 8
    series_columns: int = 8
    series_rows: int = 12
    events_per_type: int = 120
    events: int = 600
    lags: tuple[int, ...] = (7, 12, 24, 30)
    lag_correlation: float = 0.25
    run_floor: float = 0.58
    run_rows: int = 3
    trees: int = 160
    tree_rows: int = 256
    neighbours: int = 20
    lof_limit: float = 1.5
    #: 0: all rows judge each other, however many they are. Else up to so many do; larger tables are judged against lof_rows of theirs.
    lof_switch: int = 0
    lof_rows: int = 100_000
    #: How profiles count distinct values: "exact", or "by need": sketches, and exact counts only where a threshold is near.
    distinct: str = "exact"
    #: Rows of a sampled analysis, and the fewest that it takes.
    sample_rows: int = 120_000
    sample_least: int = 20_000
    seed: int = 42
    top_n: int = 100
    #: Larger inputs are refused; 0 or less: none are.
    max_mb: float = 0
    #: Rows of a block of an ordered series: what one task holds.
    block_rows: int = 50_000


DEFAULT = Config()
