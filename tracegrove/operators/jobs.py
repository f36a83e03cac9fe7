"""Catalog of index jobs: repositories, jobs, and the statements that change them, as snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracegrove.config import DEFAULT

BACKENDS = ("lexical", "dense", "graph")
STATUSES = ("pending", "running", "success", "fail", "warn")


def latest_job_per_repo(repos: DataFrame, jobs: DataFrame, backend: str | None = None, status: str | None = None) -> DataFrame:
    """Each repository with its latest job among those that the filters leave; without one, nulls."""
    if backend:
        jobs = jobs.where(F.col("backend") == backend)
    if status:
        jobs = jobs.where(F.col("status") == status)
    order = Window.partitionBy("repo_id").orderBy(F.col("started_at").desc(), F.col("id").desc())
    last = jobs.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("repo_id", F.col("id").alias("job_id"), "backend", "status", "started_at")
    return repos.join(last, repos["id"] == last["repo_id"], "left").select(repos["id"], "repo_path", "job_id", "backend", "status", "started_at")


def repo_detail(repos: DataFrame, jobs: DataFrame, repo_id: int, limit: int = 50) -> DataFrame:
    one = repos.where(F.col("id") == repo_id).withColumnRenamed("id", "repo_id")
    return one.join(jobs, "repo_id", "left").select("repo_id", "repo_path", F.col("id").alias("job_id"), "backend", "status", "started_at").orderBy(F.col("started_at").desc(), F.col("job_id").desc()).limit(limit)


def running(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status") == "running")


def locked(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (repo_id, backend) that a running job of the same repository and backend holds up, with that job's id."""
    held = running(jobs).groupBy("repo_id", "backend").agg(F.min("id").alias("existing_job_id"))
    return requests.join(held, ["repo_id", "backend"])


def reap_stale(jobs: DataFrame, now_ms: int, hours: int = DEFAULT.stale_hours) -> DataFrame:
    """Jobs that have been running for too long get status warn."""
    old = (F.col("status") == "running") & (F.col("started_at") < now_ms - hours * 3_600_000)
    return jobs.withColumn("status", F.when(old, "warn").otherwise(F.col("status")))


def upsert_repos(repos: DataFrame, paths: DataFrame) -> DataFrame:
    """The repositories and those of ``paths`` (repo_path) that are new, numbered on from the largest id."""
    new = paths.select("repo_path").distinct().join(repos, "repo_path", "left_anti")
    top = repos.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    numbered = new.crossJoin(F.broadcast(top)).withColumn("id", F.col("top") + F.row_number().over(Window.orderBy("repo_path")))  # one row a new repository
    return repos.select("id", "repo_path").unionByName(numbered.select("id", "repo_path"))


def checked(jobs: DataFrame) -> DataFrame:
    """The jobs; a row of an unknown backend or status fails the plan that reads it."""
    good = F.col("backend").isin(*BACKENDS) & F.col("status").isin(*STATUSES)
    return jobs.where(F.coalesce(good, F.lit(False)) | F.raise_error(F.concat(F.lit("no such backend or status: "), F.to_json(F.struct("backend", "status")))).cast("boolean"))


def by_last_finish(repos: DataFrame, jobs: DataFrame, descending: bool = True) -> DataFrame:
    """id, repo_path, last_finished of each repository in order of its last finished job; none counts as 0."""
    last = jobs.groupBy(F.col("repo_id").alias("id")).agg(F.max("finished_at").alias("last_finished"))
    out = repos.join(last, "id", "left").select("id", "repo_path", F.coalesce("last_finished", F.lit(0)).alias("last_finished"))
    return out.orderBy(F.col("last_finished").desc() if descending else F.col("last_finished"), "id")


def start_job(jobs: DataFrame, job_id: int, now_ms: int) -> DataFrame:
    """The jobs with a pending one running; refused while another runs for its repository and backend."""
    own = jobs.where(F.col("id") == job_id).select("repo_id", "backend")
    held = running(jobs).where(F.col("id") != job_id).join(own, ["repo_id", "backend"]).agg(F.min("id")).first()[0]
    if held is not None:
        raise RuntimeError(f"job {held} is running")
    pending = (F.col("id") == job_id) & (F.col("status") == "pending")
    return jobs.withColumns({"started_at": F.when(pending, F.lit(now_ms).cast("long")).otherwise(F.col("started_at")), "status": F.when(pending, "running").otherwise(F.col("status"))})


def create_job(jobs: DataFrame, repo_id: int, backend: str, now_ms: int, status: str = "running") -> DataFrame:
    """The jobs with a new one, running or pending; a running one is refused while another runs for the repository and backend."""
    if backend not in BACKENDS:
        raise ValueError(f"unknown backend {backend}")
    if status not in ("pending", "running"):
        raise ValueError(f"a new job is pending or running, not {status}")
    held = running(jobs).where((F.col("repo_id") == repo_id) & (F.col("backend") == backend)).agg(F.min("id")).first()[0]
    if held is not None and status == "running":
        raise RuntimeError(f"job {held} is running")
    top = jobs.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return jobs.unionByName(jobs.sparkSession.createDataFrame([(top + 1, repo_id, backend, now_ms, status)], jobs.select("id", "repo_id", "backend", "started_at", "status").schema), allowMissingColumns=True)


def finish_job(jobs: DataFrame, job_id: int, exit_code: int, now_ms: int) -> DataFrame:
    own = F.col("id") == job_id
    status = "success" if exit_code == 0 else "fail"
    out = jobs.withColumn("status", F.when(own, status).otherwise(F.col("status")))
    for name, value in (("exit_code", exit_code), ("finished_at", now_ms)):
        old = F.col(name) if name in jobs.columns else F.lit(None).cast("long")
        out = out.withColumn(name, F.when(own, F.lit(value).cast("long")).otherwise(old))
    return out


def delete_jobs(jobs: DataFrame, repo_id: int, backend: str | None = None) -> DataFrame:
    """The jobs that stay when a repository's (of one backend, if given) are deleted."""
    gone = F.col("repo_id") == repo_id
    if backend:
        gone = gone & (F.col("backend") == backend)
    return jobs.where(~gone)


def archive_when_empty(repos: DataFrame, jobs: DataFrame, now_ms: int) -> DataFrame:
    """Repositories without a job get archived_at, unless they have one."""
    empty = repos.join(jobs.select(F.col("repo_id").alias("id")).distinct(), "id", "left_anti").select("id", F.lit(True).alias("_e"))
    old = F.col("archived_at") if "archived_at" in repos.columns else F.lit(None).cast("long")
    return repos.withColumn("archived_at", old).join(empty, "id", "left").withColumn("archived_at", F.coalesce("archived_at", F.when(F.col("_e"), F.lit(now_ms)))).drop("_e")


def put_meta(meta: DataFrame, key: str, value: str) -> DataFrame:
    return meta.where(F.col("key") != key).unionByName(meta.sparkSession.createDataFrame([(key, value)], "key string, value string"))
