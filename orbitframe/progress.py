"""Progress of a command's jobs, and their cancellation.

A step's jobs share a job group. A thread of the driver asks Spark how many of the group's tasks
have ended and draws a bar; nothing is measured on executors. An interrupt cancels the group, so its
tasks end, and is raised again once that is done: what the step had staged is removed by its owner.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import TextIO

from pyspark.sql import SparkSession

WIDTH, PAUSE = 30, 0.2


def tasks_of(spark: SparkSession, group: str) -> tuple[int, int]:
    """(ended, known so far) tasks of a group's jobs."""
    tracker = spark.sparkContext.statusTracker()
    ended = known = 0
    for job in tracker.getJobIdsForGroup(group):
        info = tracker.getJobInfo(job)
        for stage in (tracker.getStageInfo(s) for s in (info.stageIds if info else ())):
            if stage:
                ended, known = ended + stage.numCompletedTasks, known + stage.numTasks
    return ended, known


def bar(name: str, ended: int, known: int) -> str:
    full = min(WIDTH, WIDTH * ended // known) if known else 0
    return f"\r  {name} {'█' * full}{'░' * (WIDTH - full)} {ended} / {known} tasks"


@contextmanager
def step(spark: SparkSession, name: str, out: TextIO | None = None) -> Iterator[str]:
    """Run jobs as one group; its bar is drawn on ``out`` if that is a terminal."""
    sc, group = spark.sparkContext, f"orbitframe-{uuid.uuid4().hex}"
    sc.setJobGroup(group, name, interruptOnCancel=True)
    over = threading.Event()

    def draw() -> None:
        while not over.wait(PAUSE):
            out.write(bar(name, *tasks_of(spark, group)))
            out.flush()

    drawn = threading.Thread(target=draw, daemon=True) if out is not None and out.isatty() else None
    if drawn:
        drawn.start()
    try:
        yield group
    except KeyboardInterrupt:
        cancel(spark, group)
        raise
    finally:
        over.set()
        if drawn:
            drawn.join()
            out.write(bar(name, *tasks_of(spark, group)) + "\n")
        sc.setLocalProperty("spark.jobGroup.id", None)


def cancel(spark: SparkSession, group: str, patience: float = 30.0) -> None:
    """Cancel a group's jobs and wait, for a while, until none is running."""
    sc = spark.sparkContext
    sc.cancelJobGroup(group)
    end, tracker = time.time() + patience, sc.statusTracker()
    while time.time() < end and any((i := tracker.getJobInfo(j)) and i.status == "RUNNING" for j in tracker.getJobIdsForGroup(group)):
        time.sleep(PAUSE)
