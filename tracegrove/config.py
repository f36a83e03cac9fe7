"""Parameters of the engine, with the defaults that results depend on."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    rrf_k: int = 60
    route_limit: int = 20
    rewrite_limit: int = 5
    lane_top_k: int = 20
    top_k: int = 10
    context_lines: int = 20
    slow_ms: float = 3000.0
    graph_alpha: float = 0.6
    graph_hops: int = 2
    graph_seeds: int = 20
    graph_files: int = 100
    dense_bonus: float = 0.05
    chunk_window: int = 30
    chunk_overlap: int = 10
    summary_window: str = "5 minutes"
    trend_slots: int = 12
    retention_days: int = 30
    stale_hours: int = 2
    bm25_k1: float = 1.2
    bm25_b: float = 0.75


def from_env(env: Mapping[str, str], prefix: str = "TRACEGROVE_") -> Config:
    """The defaults with numbers, flags and words of the environment in place of some; what doesn't parse is refused."""
    kinds = {"int": int, "float": float, "str": str, "bool": lambda x: x.strip().lower() in ("1", "true", "yes", "on")}
    given = {f.name: env[f"{prefix}{f.name.upper()}"] for f in fields(Config) if f"{prefix}{f.name.upper()}" in env}
    return replace(DEFAULT, **{f.name: kinds[str(f.type)](given[f.name]) for f in fields(Config) if f.name in given})


DEFAULT = Config()

#: (span, bucket) in seconds of the windows of the statistics.
WINDOWS = {"1h": (3600, 60), "6h": (21600, 300), "24h": (86400, 900)}
