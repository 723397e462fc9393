"""Runs in the background: one at a time for each name, with progress, cancellation, records and errors."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Errors in a listing at most.
MOST_ERRORS = 500


@dataclass
class Job:
    """status: running, done, failed, cancelled. Its Spark jobs carry the tag `id`, so that cancelling stops them too."""

    name: str
    id: str = field(default_factory=lambda: f"tarnbridge-{uuid4().hex}")
    status: str = "running"
    percent: float = 0.0
    step: str = ""
    began: float = field(default_factory=time.time)
    ended: float | None = None
    result: object = None
    errors: list[tuple[str, str, str]] = field(default_factory=list)  # kind, name, detail
    stop: threading.Event = field(default_factory=threading.Event)
    thread: threading.Thread | None = None

    def progress(self, step: str, percent: float) -> None:
        self.step, self.percent = step, percent

    @property
    def seconds(self) -> float:
        return (self.ended or time.time()) - self.began


class Jobs:
    """Jobs of one session."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jobs, self.lock = spark, {}, threading.Lock()

    def start(self, name: str, work: Callable[[Job], object]) -> Job:
        """Runs work(job) in a thread; it should look at job.stop. A second job of a name that still runs is refused."""
        with self.lock:
            self.reap()
            if any(j.name == name and j.status == "running" for j in self.jobs.values()):
                raise RuntimeError(f"a job {name} is running")
            job = Job(name)
            self.jobs[job.id] = job

        def run() -> None:
            self.spark.sparkContext.addJobTag(job.id)
            try:
                job.result = work(job)
                job.errors += [(r.kind, r.name, r.detail) for r in getattr(job.result, "results", []) if r.status == "failed"]
                status = "cancelled" if job.stop.is_set() else "failed" if job.errors else "done"
            except Exception as e:
                job.errors.append(("job", name, str(e).split("\n")[0]))
                status = "cancelled" if job.stop.is_set() else "failed"
            job.ended, job.status = time.time(), status

        job.thread = threading.Thread(target=run, daemon=True)
        job.thread.start()
        return job

    def cancel(self, job: Job) -> None:
        """Asks the work to stop and cancels the Spark jobs that it has under way."""
        job.stop.set()
        self.spark.sparkContext.cancelJobsWithTag(job.id)

    def reap(self) -> None:
        """A job whose thread ended without saying so has failed."""
        for job in self.jobs.values():
            if job.status == "running" and job.thread is not None and not job.thread.is_alive() and job.thread.ident is not None:
                job.status, job.ended = "failed", time.time()
                job.errors.append(("job", job.name, "the worker ended"))

    def frame(self) -> DataFrame:
        """(id, name, status, percent, step, seconds, n_errors), the latest first."""
        rows = [(j.id, j.name, j.status, j.percent, j.step, j.seconds, len(j.errors)) for j in sorted(self.jobs.values(), key=lambda j: -j.began)]
        return self.spark.createDataFrame(rows, "id string, name string, status string, percent double, step string, seconds double, n_errors int")

    def errors(self, kind: str | None = None, job: str | None = None, text: str | None = None) -> DataFrame:
        """(job, kind, name, detail), filtered; at most MOST_ERRORS rows, a limit of the listing."""
        rows = [(j.id, *e) for j in self.jobs.values() for e in j.errors]
        df, low = self.spark.createDataFrame(rows, "job string, kind string, name string, detail string"), lambda c: F.lower(F.col(c))
        conditions: list[Column] = [F.lit(True)]
        if kind:
            conditions.append(F.col("kind") == kind)
        if job:
            conditions.append(F.col("job") == job)
        if text:
            conditions.append(F.contains(low("name"), F.lit(text.lower())) | F.contains(low("detail"), F.lit(text.lower())))
        for c in conditions:
            df = df.filter(c)
        return df.orderBy("job", "kind", "name").limit(MOST_ERRORS)
