"""Progress of the jobs that run inside a block, told line by line."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


@contextmanager
def progress(spark: SparkSession, tell: Callable[[str], None] = print, seconds: float = 2.0) -> Iterator[None]:
    """Tells every so many seconds, and once at the end, how many tasks of each active stage are done."""
    tracker, over, last = spark.sparkContext.statusTracker(), threading.Event(), {}

    def look() -> None:
        for stage in tracker.getActiveStageIds():
            info = tracker.getStageInfo(stage)
            if info and last.get(stage) != info.numCompletedTasks:
                last[stage] = info.numCompletedTasks
                tell(f"stage {stage}: {info.numCompletedTasks}/{info.numTasks}")

    def watch() -> None:
        while not over.wait(seconds):
            look()

    thread = threading.Thread(target=watch, daemon=True)
    thread.start()
    try:
        yield
    finally:
        over.set()
        thread.join()
        tell(f"done: {len(last)} stages seen")
