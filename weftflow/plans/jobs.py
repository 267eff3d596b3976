"""Pipelines that run beside the caller: a thread for each, whose Spark jobs carry a tag by which they are watched and cancelled."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import SparkContext
from pyspark.sql import DataFrame

Action = Callable[[DataFrame], object]
#: States that end a job.
ENDED = ("completed", "failed", "cancelled")


@dataclass
class Progress:
    """What Spark's status tracker tells of a job's stages, those done included: tasks, rows read, and rows a second since the job began."""

    tasks: int = 0
    tasks_done: int = 0
    tasks_running: int = 0
    tasks_failed: int = 0
    rows_read: int = 0
    rows_per_second: float = 0.0


@dataclass
class Job:
    """Its results are those of its steps, the last one in `result`; it can be held before each step. A state is left only by `move`."""

    id: str = field(default_factory=lambda: f"job-{uuid.uuid4().hex}")
    status: str = "queued"  # then running, paused between steps, and completed, failed or cancelled
    result: object = None
    done: int = 0
    error: str = ""
    seconds: float = 0.0
    began: float = 0.0
    thread: threading.Thread | None = None
    open: threading.Event = field(default_factory=threading.Event)
    lock: threading.Lock = field(default_factory=threading.Lock)

    def move(self, to: str, *before: str) -> bool:
        """Pass to a state from one of those before, or tell that the job isn't in one of them."""
        with self.lock:
            if self.status not in before:
                return False
            self.status = to
            return True

    def wait(self, timeout: float | None = None) -> Job:
        if self.thread:
            self.thread.join(timeout)
        return self


def submit(df: DataFrame, *actions: Action, paused: bool = False) -> Job:
    """Run `action(df)`, such as a write, for each action, in a thread of its own; with `paused` it waits for `resume`."""
    context, job = df.sparkSession.sparkContext, Job()
    if not paused:
        job.open.set()

    def run() -> None:
        job.began = time.time()
        context.addJobTag(job.id)
        try:
            for action in actions:
                if not job.open.is_set():
                    job.move("paused", "queued", "running")
                job.open.wait()
                if not job.move("running", "queued", "running", "paused"):
                    return
                found = action(df)
                with job.lock:  # a step that ends after its job was cancelled counts for nothing
                    if job.status != "running":
                        return
                    job.result, job.done = found, job.done + 1
            job.move("completed", "running", "queued")
        except Exception as e:  # noqa: BLE001  what the job met is told by its status
            job.error = str(e)
            job.move("failed", "queued", "running", "paused")
        finally:
            job.seconds = time.time() - job.began
            context.removeJobTag(job.id)

    job.thread = threading.Thread(target=run, daemon=True)
    job.thread.start()
    return job


def pause(job: Job) -> None:
    """Hold the job before its next step; Spark can't hold one that runs."""
    job.open.clear()


def resume(job: Job) -> None:
    job.open.set()


def cancel(df: DataFrame, job: Job) -> bool:
    """Cancel a job that hasn't ended, and what Spark runs for it; tells whether it did."""
    if not job.move("cancelled", "queued", "running", "paused"):
        return False
    job.open.set()
    df.sparkSession.sparkContext.cancelJobsWithTag(job.id)
    return True


def progress(df: DataFrame, job: Job) -> Progress:
    """How far a job's Spark jobs have come, also while they run."""
    context: SparkContext = df.sparkSession.sparkContext
    inner = context._jsc.sc()
    tracker, found, stages = context.statusTracker(), Progress(), set()
    for i in inner.statusTracker().getJobIdsForTag(job.id):
        info = tracker.getJobInfo(i)
        stages.update(info.stageIds if info else [])
    for s in stages:
        info = tracker.getStageInfo(s)
        if info:  # a stage that was skipped has none
            found.tasks += info.numTasks
            found.tasks_done += info.numCompletedTasks
            found.tasks_running += info.numActiveTasks
            found.tasks_failed += info.numFailedTasks
            found.rows_read += inner.statusStore().lastStageAttempt(s).inputRecords()
    seconds = job.seconds or (time.time() - job.began if job.began else 0.0)
    found.rows_per_second = found.rows_read / seconds if seconds else 0.0
    return found
