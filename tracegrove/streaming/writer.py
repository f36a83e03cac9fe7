"""Audit events as JSON lines: formatting, truncation and a rotating file."""

from __future__ import annotations

import json
import os
import queue
import re
import sys
import threading
from contextlib import contextmanager
from datetime import UTC, datetime
from time import perf_counter

from tracegrove.config import DEFAULT


# How answers state their number of results, and the tools whose answer is one file.
COUNT = re.compile(r"找到 (\d+)")
FILE_TOOLS = ("get_file_content",)


def truncate(value: object, limit: int = 1024) -> tuple[str, bool]:
    """JSON of a value, cut to ``limit`` characters if it has more bytes than that, and whether it was."""
    text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, default=str)
    return (text, False) if len(text.encode()) <= limit else (text[:limit] + "...", True)


def event(kind: str, trace_id: str, duration_ms: float, status: str = "ok", slow_ms: float = DEFAULT.slow_ms, **more: object) -> dict:
    """An event: times in UTC without a zone, durations to one place, slow beyond the threshold."""
    out = {"timestamp": datetime.now(UTC).replace(tzinfo=None).isoformat(timespec="milliseconds"), "trace_id": trace_id, "event": kind, "duration_ms": round(duration_ms, 1), "status": status, "slow": duration_ms > slow_ms}
    if "arguments" in more:
        more["arguments"], cut = truncate(more["arguments"])
        if cut:
            more["arguments_truncated"] = True
    return out | {k: v for k, v in more.items() if v is not None}


class RotatingLog:
    """Appends lines; a file that would grow beyond ``size`` bytes is renamed to .1, .1 to .2 and so on. Without a path, to stderr."""

    def __init__(self, path: str | None, size: int = 50 << 20, keep: int = 5):
        self.path, self.size, self.keep = path, size, keep

    def write(self, record: dict) -> None:
        line = json.dumps(record, ensure_ascii=False, default=str) + "\n"
        if self.path is None:
            sys.stderr.write(line)
            return
        if os.path.exists(self.path) and os.path.getsize(self.path) + len(line.encode()) > self.size:
            for k in range(self.keep - 1, 0, -1):
                if os.path.exists(f"{self.path}.{k}"):
                    os.replace(f"{self.path}.{k}", f"{self.path}.{k + 1}")
            os.replace(self.path, f"{self.path}.1")
        with open(self.path, "a", encoding="utf-8") as f:
            f.write(line)

    @contextmanager
    def measured(self, kind: str, trace_id: str, **more: object):  # noqa: ANN201
        """Writes one event for the block, with its duration, and ``error`` if it raises."""
        begun = perf_counter()
        try:
            yield
        except Exception as e:
            self.write(event(kind, trace_id, (perf_counter() - begun) * 1000, "error", error_message=str(e)[:200], **more))
            raise
        self.write(event(kind, trace_id, (perf_counter() - begun) * 1000, **more))


class QueuedLog:
    """Hands records to a log from a thread of its own; when ``size`` of them wait, new ones are dropped and counted."""

    def __init__(self, log: RotatingLog, size: int = 10_000):
        self.log, self.dropped, self._waiting = log, 0, queue.Queue(size)
        self._thread = threading.Thread(target=self._run, daemon=True)
        self._thread.start()

    def _run(self) -> None:
        while (record := self._waiting.get()) is not None:
            self.log.write(record)

    def write(self, record: dict) -> None:
        try:
            self._waiting.put_nowait(record)
        except queue.Full:
            self.dropped += 1

    def close(self, grace_s: float = 2.0) -> bool:
        """Writes what waits, for ``grace_s`` at most; whether all was written."""
        try:
            self._waiting.put(None, timeout=grace_s)
        except queue.Full:
            return False
        self._thread.join(grace_s)
        return not self._thread.is_alive()


def result_count(tool: str, text: str) -> int | None:
    """How many results a tool's answer tells of; one for tools that give a file."""
    if tool in FILE_TOOLS:
        return 1
    found = COUNT.search(text)
    return int(found[1]) if found else None
