"""Lanes as jobs of their own, with a time limit each; a slow or failing lane is an empty one."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession


@dataclass
class Answer:
    """What became of a lane: ok, error or timeout, its rows and how long it took."""

    lane: str
    status: str
    latency_ms: float
    rows: list[Row] = field(default_factory=list)
    detail: str | None = None


def dispatch(spark: SparkSession, lanes: dict[str, Callable[[], DataFrame]], timeout_s: float | dict[str, float] = 10.0) -> list[Answer]:
    """Runs each lane's (small, limited) result in a thread; jobs of a lane that is late are cancelled by their tag."""

    def run(tag: str, plan: Callable[[], DataFrame]) -> list[Row]:
        spark.addTag(tag)
        try:
            return plan().collect()
        finally:
            spark.removeTag(tag)

    out = []
    with ThreadPoolExecutor(max(1, len(lanes))) as pool:
        begun = time.monotonic()
        tags = {name: f"lane-{uuid.uuid4().hex}" for name in lanes}
        running = {name: pool.submit(run, tags[name], plan) for name, plan in lanes.items()}
        for name, job in running.items():
            limit = timeout_s.get(name, 10.0) if isinstance(timeout_s, dict) else timeout_s
            try:
                rows = job.result(max(0.0, begun + limit - time.monotonic()))
                out.append(Answer(name, "ok", (time.monotonic() - begun) * 1000, rows))
            except Late:
                spark.interruptTag(tags[name])
                out.append(Answer(name, "timeout", (time.monotonic() - begun) * 1000, detail=f"more than {limit:g} s"))
            except Exception as e:  # noqa: BLE001
                out.append(Answer(name, "error", (time.monotonic() - begun) * 1000, detail=str(e)[:200]))
    return out
