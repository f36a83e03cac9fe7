"""Cache of rewrites: entries age out, and the oldest insertion goes when it is full."""

from __future__ import annotations

import hashlib
import time
from collections import OrderedDict
from collections.abc import Callable


class RewriteCache:
    """Keyed by the lower-cased, stripped query; reads don't refresh an entry."""

    def __init__(self, ttl_s: float = 86_400, size: int = 1000, clock: Callable[[], float] = time.time):
        self.ttl_s, self.size, self.clock = ttl_s, size, clock
        self._held: OrderedDict[str, tuple[float, list[str]]] = OrderedDict()

    @staticmethod
    def key(query: str) -> str:
        return hashlib.md5(query.strip().lower().encode()).hexdigest()  # noqa: S324

    def get(self, query: str) -> list[str] | None:
        entry = self._held.get(self.key(query))
        if entry is None:
            return None
        if self.clock() - entry[0] > self.ttl_s:
            del self._held[self.key(query)]
            return None
        return entry[1]

    def put(self, query: str, routes: list[str]) -> None:
        k = self.key(query)
        self._held.pop(k, None)
        while len(self._held) >= self.size:
            self._held.popitem(last=False)
        self._held[k] = (self.clock(), routes)

    def __len__(self) -> int:
        return len(self._held)
