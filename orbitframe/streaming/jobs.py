"""Background jobs on the driver: queued, running, succeeded or failed; interruptible by tag."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession


class Jobs:
    """A few jobs at a time.  A result that `cached` knows makes a job that is born succeeded."""

    def __init__(self, spark: SparkSession, workers: int = 2):
        self.spark, self.pool, self.lock, self.jobs = spark, ThreadPoolExecutor(workers), threading.Lock(), {}

    def submit(self, run: Callable[[], object], cached: object | None = None) -> str:
        job = uuid.uuid4().hex
        self.jobs[job] = {"id": job, "status": "queued" if cached is None else "succeeded", "result": cached, "error": None}
        if cached is None:
            self.pool.submit(self._run, job, run)
        return job

    def _run(self, job: str, run: Callable[[], object]) -> None:
        self.spark.addTag(job)
        self._set(job, status="running")
        try:
            self._set(job, status="succeeded", result=run())
        except Exception as e:  # a job's error is its result
            self._set(job, status="failed", error=f"{type(e).__name__}: {e}")
        finally:
            self.spark.removeTag(job)

    def _set(self, job: str, **values) -> None:
        with self.lock:
            self.jobs[job] |= values

    def get(self, job: str) -> dict | None:
        with self.lock:
            found = self.jobs.get(job)
            return dict(found) if found else None

    def cancel(self, job: str) -> None:
        self.spark.interruptTag(job)
