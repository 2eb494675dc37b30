"""A mapping of named datasets built on first access.

Building a DataFrame runs Spark's analyzer on its plan; a pipeline with thirty
outputs should only pay for the ones a caller asks for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame


class Datasets(dict):
    """Named lazy DataFrames.  A dataset defined with ``shared=True`` is read
    by several others; when the mapping was created with ``persist=True`` it is
    persisted (memory, spilling to disk) on first build, so its consumers --
    which prune different columns and therefore cannot reuse each other's
    shuffles -- compute it once.  Lost cached blocks are recomputed from
    lineage, so executor loss costs time, not correctness."""

    def __init__(self, persist: bool = False) -> None:
        super().__init__()
        self._makers: dict[str, Callable[[], DataFrame]] = {}
        self._persist = persist
        self._shared: set[str] = set()

    def define(self, name: str, maker: Callable[[], DataFrame], shared: bool = False) -> None:
        self._makers[name] = maker
        if shared:
            self._shared.add(name)

    def names(self) -> list[str]:
        return list(self._makers)

    def __missing__(self, name: str) -> DataFrame:
        if name not in self._makers:
            raise KeyError(name)
        df = self._makers[name]()
        if self._persist and name in self._shared:
            df = df.persist(StorageLevel.MEMORY_AND_DISK)
        self[name] = df
        return df
