"""Memory of Python workers, which Spark keeps for later tasks of any operator."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import SparkSession

#: Most rows, and about as many bytes, of whole texts that JVM and worker exchange at once.
BATCH_ROWS = 2000
BATCH_BYTES = 4 << 20
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


#: What an operator keeps in a worker for its later tasks, by its module; the first task of another operator drops it.
held: dict[str, object] = {}


def _begin(owner: str) -> None:
    if any(name != owner for name in held):
        for name in [name for name in held if name != owner]:
            del held[name]
        _trim()


def _trim() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to return by hand
        pass


def returning_memory(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A ``mapInArrow`` function that gives a task's memory back when the task ends, and at its start what other operators hold.

    Built on the driver, where it also lowers the session's Arrow batches to BATCH_ROWS rows and BATCH_BYTES bytes if they are
    larger. Spark reads these settings when a plan is made, which for a result that is returned is later than this call, so they
    can't be put back here; a session whose other Arrow work needs larger batches sets them again afterwards.
    """
    session = SparkSession.getActiveSession()
    if session is not None:
        if not 0 < int(session.conf.get(_ROWS, "10000")) <= BATCH_ROWS:
            session.conf.set(_ROWS, str(BATCH_ROWS))
        session.conf.set(_BYTES, str(BATCH_BYTES))

    owner = run.__module__

    @wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        _begin(owner)
        try:
            yield from run(batches)
        finally:
            _trim()

    return wrapped
