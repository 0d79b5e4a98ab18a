"""Long work under control: cancelled by its mark, or cut short by a time budget."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from typing import TypeVar

from pyspark.sql import SparkSession

R = TypeVar("R")
# Fixed value: how the warning of a cut search begins.
BUDGET = "Time budget"


@contextmanager
def marked(spark: SparkSession, mark: str):
    """Jobs started inside, in this thread, bear the mark; ``cancel`` ends them."""
    spark.sparkContext.addJobTag(mark)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(mark)


def cancel(spark: SparkSession, mark: str) -> None:
    spark.sparkContext.cancelJobsWithTag(mark)


def within(spark: SparkSession, seconds: float, action: Callable[[], R], otherwise: R) -> tuple[R, str | None]:
    """The action's result and no warning; if its jobs take longer they are cancelled, and ``otherwise`` comes with a warning."""
    mark, late = f"budget-{uuid.uuid4().hex}", threading.Event()

    def end() -> None:
        late.set()
        cancel(spark, mark)

    timer = threading.Timer(seconds, end)
    timer.start()
    try:
        with marked(spark, mark):
            return action(), None
    except Exception:
        if not late.is_set():
            raise
        return otherwise, f"{BUDGET} of {int(seconds * 1000)} ms exhausted; results may be incomplete"
    finally:
        timer.cancel()
