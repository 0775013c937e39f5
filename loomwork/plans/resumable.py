"""Model calls over many rows, in batches that are committed one by one: what is paid for is kept, and a rerun asks only for what is open."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import incremental
from ..sources.scratch import written
from ..sources.store import Store

#: Rows of a batch, and failures of the whole job after which no further batch begins.
BATCH, FAILURES = 1_000, 25


@dataclass(frozen=True)
class Progress:
    done: int
    failed: int
    stopped: bool


def worked(store: Store, name: str, todo: DataFrame, key: str, make: Callable[[DataFrame], DataFrame], batch: int = BATCH, failures: int = FAILURES) -> Progress:
    """``make`` on the rows of ``todo`` whose key the table ``name`` has not, dealt into batches by the hash of the key. ``make`` gives rows with
    ``failed``, null where it went well; those are committed with their batch, so a lost executor, or driver, repeats one batch at most. Rows
    that failed stay open. Failures are counted over all batches of a run."""
    had = store.read(name)
    open_ = written(todo if had is None else incremental.pending(todo, had, key), f"{name}-open")
    batches, done, failed = -(-open_.count() // batch), 0, 0
    for b in range(batches):
        made = written(make(open_.where(F.pmod(F.xxhash64(key), F.lit(batches)) == b)), f"{name}-made")
        good = made.where("failed is null").drop("failed")
        bad = made.where("failed is not null").select(key).distinct().count()
        if not good.isEmpty():
            with store.transaction() as t:
                t.add(name, good)
        done, failed = done + good.select(key).distinct().count(), failed + bad
        if failed >= failures:
            return Progress(done, failed, b + 1 < batches)
    return Progress(done, failed, False)
