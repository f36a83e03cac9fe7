"""Running index jobs: brackets around builds, batches of repositories, retries, triggers and what they leave behind."""

from __future__ import annotations

import fnmatch
import hmac
import json
import os
import shutil
import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tracegrove.operators import graph
from tracegrove.plans.lanes import graph_lane
from tracegrove.plans.service import ApiError, IndexService, rows
from tracegrove.sources.tables import SOURCE_SUFFIXES


def with_retry(call: Callable[[], Any], waits: tuple[float, ...] = (1.0, 2.0), sleep: Callable[[float], None] = time.sleep) -> Any:
    """The call's result; after a failure it is tried again behind each of the waits. Refusals (status 4xx) aren't."""
    for k in range(len(waits) + 1):
        try:
            return call()
        except ApiError as e:
            if 400 <= e.status < 500 or k == len(waits):
                raise
        except Exception:
            if k == len(waits):
                raise
        sleep(waits[k])
    return None


def finish(service: IndexService, job_id: int, exit_code: int, fallback: str, token: str = "", **retry: Any) -> bool:
    """Reports a job's end; if that fails for good, a JSON file in ``fallback`` says what was to be reported."""
    try:
        with_retry(lambda: service.finish(job_id, exit_code, token), **retry)
        return True
    except Exception as e:  # noqa: BLE001  the job itself has ended; its report must not be lost
        os.makedirs(fallback, exist_ok=True)
        with open(os.path.join(fallback, f"job_{job_id}.json"), "w", encoding="utf-8") as f:
            json.dump({"job_id": job_id, "exit_code": exit_code, "error": str(e)}, f)
        return False


@contextmanager
def bracket(service: IndexService, repo_path: str, backend: str, fallback: str, token: str = "", **retry: Any) -> Iterator[int]:
    """Starts a job, gives its id, and reports its end, however the block ends."""
    job_id = with_retry(lambda: service.start(repo_path, backend), **retry)
    code = 1
    try:
        yield job_id
        code = 0
    finally:
        finish(service, job_id, code, fallback, token, **retry)


@dataclass
class BatchReport:
    succeeded: list[str] = field(default_factory=list)
    failed: dict[str, str] = field(default_factory=dict)
    skipped: list[str] = field(default_factory=list)


def run_batch(repos: list[str], build: Callable[[str], Any], skip: Callable[[str], bool] = lambda _: False) -> BatchReport:
    """Builds one repository after the other and goes on after a failure."""
    out = BatchReport()
    for repo in repos:
        if skip(repo):
            out.skipped.append(repo)
            continue
        try:
            build(repo)
            out.succeeded.append(repo)
        except Exception as e:  # noqa: BLE001
            out.failed[repo] = str(e)
    return out


# Folders below a source root that are repositories.
REPO_GLOBS = ("frameworks/*", "packages/*/*")


def discover_repos(root: str, globs: tuple[str, ...] = REPO_GLOBS, depth: int = 5, suffixes: tuple[str, ...] = SOURCE_SUFFIXES) -> list[str]:
    """Folders below ``root`` that match a glob and hold a source file at most ``depth`` levels down, sorted."""
    out = []
    for glob in globs:
        level = glob.count("/") + 1
        for at, folders, _ in os.walk(root):
            rel = os.path.relpath(at, root).replace(os.sep, "/")
            if (0 if rel == "." else rel.count("/") + 1) >= level:
                folders.clear()
                if fnmatch.fnmatch(rel, glob) and has_source(at, depth, suffixes):
                    out.append(rel)
    return sorted(set(out))


def has_source(folder: str, depth: int, suffixes: tuple[str, ...] = SOURCE_SUFFIXES) -> bool:
    for at, folders, files in os.walk(folder):
        if any(f.endswith(suffixes) for f in files):
            return True
        rel = os.path.relpath(at, folder)
        if (0 if rel == "." else rel.count(os.sep) + 1) >= depth - 1:
            folders.clear()
    return False


def delete_shards(index: str, repo: str) -> list[str]:
    """Removes the shards of a repository from a partitioned index; names with a slash are looked for with an underscore."""
    gone = [n for n in sorted(os.listdir(index)) if fnmatch.fnmatch(n, f"repo={repo.replace('/', '_')}*")]
    for name in gone:
        shutil.rmtree(os.path.join(index, name))
    return gone


def write_baseline(path: str, latencies: dict[str, float]) -> None:
    """Latencies of stages as JSON, for later runs to compare with."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(latencies, f, indent=2, sort_keys=True)


def authorised(header: str | None, token: str) -> bool:
    """Whether a header carries the bearer token; without a token set, anyone may."""
    if not token:
        return True
    kind, _, given = (header or "").partition(" ")
    return kind.lower() == "bearer" and hmac.compare_digest(given.strip(), token)


class Adapter(ABC):
    """A search backend behind the service."""

    name = "adapter"

    @abstractmethod
    def search(self, query: str, top_k: int = 10) -> DataFrame: ...

    @abstractmethod
    def content(self, repo: str, path: str) -> dict: ...

    def health(self) -> bool:
        return True


class NoBackend(Adapter):
    """Stands for a backend that isn't built: never healthy, every call refused."""

    name = "none"

    def search(self, query: str, top_k: int = 10) -> DataFrame:
        raise NotImplementedError(f"no backend for {query!r}")

    def content(self, repo: str, path: str) -> dict:
        raise NotImplementedError(f"no backend for {repo}/{path}")

    def health(self) -> bool:
        return False


class GraphAdapter(Adapter):
    """The graph lane as a backend: title, content, score and metadata of its files."""

    name = "graph"

    def __init__(self, files: DataFrame, graph: str, repos: list[str] | str | None = None):
        self.files, self.lane = files, graph_lane(files.sparkSession, graph, repos)

    def search(self, query: str, top_k: int = 10) -> DataFrame:
        found = self.lane(query, top_k)
        return found.selectExpr("rank", "title", "content", "score", "named_struct('repo', repo, 'path', path, 'source', source) AS metadata").orderBy("rank")

    def content(self, repo: str, path: str) -> dict:
        got = rows(self.files.where((self.files["repo"] == repo) & (self.files["path"] == path)).select("repo", "path", "content").limit(1))
        if not got:
            raise ApiError(404, f"{repo}/{path} not found")
        return got[0]


@dataclass
class Backend:
    """What a kind of index can do: build a repository, drop it, and count what it holds."""

    name: str
    build: Callable[[str], Any]
    drop: Callable[[str], Any]
    count: Callable[[str], int]

    def trigger(self, service: IndexService, repo: str, fallback: str, token: str = "", **retry: Any) -> int:
        with bracket(service, repo, self.name, fallback, token, **retry) as job_id:
            self.build(repo)
        return job_id


def graph_backend(spark: SparkSession, nodes_table: str, build: Callable[[str], DataFrame]) -> Backend:
    """Nodes (nid, repo, ...) as a table with a folder a repository."""
    at = lambda repo: f"{nodes_table}/repo={repo.replace('/', '_')}"

    def count(repo: str) -> int:
        if not os.path.exists(at(repo)):
            return 0
        found = graph.node_counts(spark.read.parquet(nodes_table), repo.replace("/", "_")).first()
        return found["n"] if found else 0

    return Backend("graph", lambda repo: build(repo).write.mode("overwrite").parquet(at(repo)), lambda repo: delete_shards(nodes_table, repo), count)
