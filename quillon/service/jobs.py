"""Background jobs on the driver: pending, running, then succeeded or failed. Each runs under a Spark job group of its own."""

from __future__ import annotations

import threading
import uuid
from collections import OrderedDict
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Job:
    job_id: str
    name: str
    status: str = "pending"
    done: int = 0
    total: int = 0
    result: object = None
    error: str | None = None

    @property
    def percent(self) -> int:
        return 100 * self.done // self.total if self.total > 0 else 0


class Jobs:
    """Remembers the latest `kept` jobs; the oldest finished ones are forgotten first, unfinished ones never."""

    def __init__(self, spark: SparkSession | None = None, workers: int = 2, kept: int = 200):
        self.spark, self.kept = spark, kept
        self._pool, self._lock, self._jobs = ThreadPoolExecutor(workers), threading.Lock(), OrderedDict()

    def _put(self, job_id: str, **changes) -> None:
        with self._lock:
            if job_id in self._jobs:
                self._jobs[job_id] = replace(self._jobs[job_id], **changes)

    def submit(self, name: str, work: Callable[[Callable[[int, int], None]], object]) -> Job:
        """work is called with a function that takes progress (done, total)."""
        job = Job(uuid.uuid4().hex, name)
        with self._lock:
            self._jobs[job.job_id] = job
            over = len(self._jobs) - self.kept
            for old in [k for k, j in self._jobs.items() if j.status in ("succeeded", "failed")][: max(0, over)]:
                del self._jobs[old]
        self._pool.submit(self._run, job.job_id, work)
        return job

    def _run(self, job_id: str, work: Callable) -> None:
        self._put(job_id, status="running")
        try:
            if self.spark:
                self.spark.sparkContext.setJobGroup(job_id, job_id, interruptOnCancel=True)
            result = work(lambda done, total: self._put(job_id, done=done, total=total))
            self._put(job_id, status="succeeded", result=result)
        except Exception as error:
            self._put(job_id, status="failed", error=str(error) or type(error).__name__)

    def get(self, job_id: str) -> Job | None:
        with self._lock:
            return self._jobs.get(job_id)

    def tasks(self, job_id: str) -> tuple[int, int]:
        """(done, all) of the Spark tasks that the job's group runs just now."""
        tracker = self.spark.sparkContext.statusTracker() if self.spark else None
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(job_id) if (info := tracker.getJobInfo(j)) for s in info.stageIds] if tracker else []
        return sum(s.numCompletedTasks for s in stages if s), sum(s.numTasks for s in stages if s)

    def cancel(self, job_id: str) -> None:
        if self.spark:
            self.spark.sparkContext.cancelJobGroup(job_id)

    def close(self) -> None:
        self._pool.shutdown(wait=True)
