"""The engine's functions as a service would call them: plain arguments in, JSON-ready values out."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrove.config import WINDOWS
from tracegrove.operators import events as E
from tracegrove.operators import jobs as J
from tracegrove.operators import stats as T
from tracegrove.plans.search import Searcher, render


class ApiError(Exception):
    """A refusal with the status that a server would give."""

    def __init__(self, status: int, message: str, **detail: Any):
        super().__init__(message)
        self.status, self.detail = status, detail


def rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


@dataclass
class SearchService:
    """Search endpoints, and tools of the same names."""

    searcher: Searcher

    def health(self) -> dict:
        return {"status": "ok", "backends": {"lexical": True, **{name: name not in self.searcher.failed for name in self.searcher.lanes}}}

    def search(self, query: str = "", top_k: int = 10, score_threshold: float = 0.0, **narrow: str) -> list[dict]:
        if not query.strip():
            raise ApiError(400, "query is required")
        return rows(self.searcher.search(query, top_k, score_threshold, **narrow))

    def search_symbol(self, symbol: str = "", top_k: int = 5) -> list[dict]:
        if not symbol:
            raise ApiError(400, "symbol is required")
        return rows(self.searcher.symbol(symbol, top_k))

    def search_file(self, path: str = "", extra_query: str = "", top_k: int = 5) -> list[dict]:
        if not path:
            raise ApiError(400, "path is required")
        return rows(self.searcher.file(path, extra_query, top_k))

    def search_regex(self, pattern: str = "", top_k: int = 10) -> list[dict]:
        if not pattern:
            raise ApiError(400, "pattern is required")
        return rows(self.searcher.regex(pattern, top_k))

    def list_repos(self, query: str = "", top_k: int = 50) -> list[dict]:
        return rows(self.searcher.repos(query, top_k))

    def get_file_content(self, repo: str, filepath: str, start_line: int = 1, end_line: int | None = None) -> dict:
        found = rows(self.searcher.content(repo, filepath, start_line, end_line))
        if not found:
            raise ApiError(404, f"{repo}/{filepath} not found")
        return found[0]

    TOOLS = ("search", "search_symbol", "search_file", "search_regex", "list_repos", "get_file_content")

    def call_tool(self, name: str, arguments: dict) -> str:
        """A tool's result as text; errors are text, too."""
        if name not in self.TOOLS:
            return f"error: unknown tool {name}"
        try:
            if name == "search":
                return render(self.searcher.search(**arguments).withColumn("rank", F.monotonically_increasing_id())).first()["text"]
            got = getattr(self, name)(**arguments)
            return got["content"] if isinstance(got, dict) else "\n".join(str(r.get("title") or r.get("repo")) for r in got)
        except Exception as e:  # noqa: BLE001
            return f"error: {e}"


@dataclass
class AuditService:
    """Endpoints over the event table."""

    table: DataFrame

    def health(self) -> dict:
        return rows(E.health(self.table))[0]

    def stats(self, now_ms: int, window: str = "1h") -> dict:
        if window not in WINDOWS:
            raise ApiError(400, f"window is one of {', '.join(WINDOWS)}")
        span, bucket = WINDOWS[window]
        own = T.in_window(self.table, now_ms, window)
        pct = rows(T.percentiles(own))
        return {**rows(T.totals(own, span))[0], **({k: pct[0][k] for k in ("p50", "p95", "p99")} if pct else dict.fromkeys(("p50", "p95", "p99"), 0.0)), "buckets": rows(T.buckets(own, bucket).orderBy("bucket"))}

    def events(self, limit: int = 50, offset: int = 0, **conditions: Any) -> dict:
        own = E.event_filter(self.table, **conditions)
        return {"total": own.count(), "events": rows(E.page(own, limit, offset))}

    def trace(self, trace_id: str) -> dict:
        own = self.table.where(F.col("trace_id") == trace_id)
        found = rows(E.trace_summary(own))
        if not found:
            raise ApiError(404, f"no trace {trace_id}")
        return {**found[0], "events": rows(own.select(*E.COLUMNS).orderBy("ts_ms", "id"))}

    def search(self, q: str, limit: int = 50) -> list[dict]:
        return rows(E.payload_search(self.table, q, limit))


@dataclass
class IndexService:
    """Endpoints over the job catalog; tables are snapshots that a change replaces."""

    repos: DataFrame
    jobs: DataFrame
    token: str = ""
    now_ms: int = 0
    launched: list[tuple[str, str]] = field(default_factory=list)

    def list_repos(self, backend: str | None = None, status: str | None = None) -> list[dict]:
        return rows(J.latest_job_per_repo(self.repos, self.jobs, backend, status).orderBy(F.col("id").desc()))

    def detail(self, repo_id: int) -> list[dict]:
        got = rows(J.repo_detail(self.repos, self.jobs, repo_id))
        if not got:
            raise ApiError(404, f"no repository {repo_id}")
        return got

    def start(self, repo_path: str, backend: str) -> int:
        self.repos = J.upsert_repos(self.repos, self.repos.sparkSession.createDataFrame([(repo_path,)], "repo_path string"))
        repo_id = self.repos.where(F.col("repo_path") == repo_path).first()["id"]
        try:
            self.jobs = J.create_job(self.jobs, repo_id, backend, self.now_ms)
        except RuntimeError as e:
            raise ApiError(409, str(e), existing_job_id=int(str(e).split()[1])) from e
        self.launched.append((repo_path, backend))
        return self.jobs.agg(F.max("id")).first()[0]

    def finish(self, job_id: int, exit_code: int, token: str = "") -> None:
        if not self.token or token != self.token:
            raise ApiError(403, "wrong token")
        self.jobs = J.finish_job(self.jobs, job_id, exit_code, self.now_ms)

    def delete(self, repo_id: int, backend: str | None = None) -> None:
        self.jobs = J.delete_jobs(self.jobs, repo_id, backend)
        own = self.repos.where(F.col("id") == repo_id)
        rest = self.repos.where(F.col("id") != repo_id)
        self.repos = rest.unionByName(J.archive_when_empty(own, self.jobs, self.now_ms), allowMissingColumns=True)
