"""What a worker remembers between texts: bounded in bytes, and given back when a task ends."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import SparkSession

#: Keys of one generation, of which there are two; with LONGEST that is some 30 MB a worker at most.
MOST = 50_000
#: Longer keys (in bytes or characters) are forgotten with their generation.
LONGEST = 64


#: Bytes of an Arrow batch, and the session's setting of them with its default.
BATCH, _SETTING, _DEFAULT = "8m", "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def small_batches(spark: SparkSession) -> None:
    """Has Spark hand texts to workers a few MB at a time, unless the session says how many: several copies of a batch are held at once."""
    if spark.conf.get(_SETTING, _DEFAULT) == _DEFAULT:
        spark.conf.set(_SETTING, BATCH)


class Recent(dict):
    """The values of recent keys in two generations: when the newer one is full it becomes the older one, whose keys come back when asked for."""

    def __init__(self, most: int = MOST):
        super().__init__()
        self.most, self.old = most, {}

    def missing(self, keys: Iterable) -> list:
        """The keys without a value; the others are in the dict after it. Values of earlier calls may be gone."""
        if len(self) > self.most:
            self.old = {k: v for k, v in self.items() if len(k) <= LONGEST}
            self.clear()
        new = [k for k in keys if k not in self]
        if not self.old:
            return new
        out = []
        for k in new:
            if (v := self.old.get(k)) is None:
                out.append(k)
            else:
                self[k] = v
        return out

    def forget(self) -> None:
        self.clear()
        self.old = {}


def give_back() -> None:
    """Returns freed memory to the system, as workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
