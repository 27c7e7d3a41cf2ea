"""Standing results, kept up by deltas: what a delta changes is summed up by itself and appended, so history is not read again.

Reading merges what the parts of a table have of a key, at most one row each; compaction does so once for all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlens.sinks.store import Store


class Latest:
    """The latest row of each key, by ``order``; of rows equal in that, any."""

    def __init__(self, store: Store, table: str, keys: list[str], order: list[str]):
        self.store, self.table, self.keys, self.order = store, table, keys, order

    def _latest(self, rows: DataFrame) -> DataFrame:
        values = [c for c in rows.columns if c not in self.keys]
        last = F.max_by(F.struct(*values), F.struct(*self.order)).alias("_last")  # summed up before the shuffle
        return rows.groupBy(*self.keys).agg(last).select(*self.keys, "_last.*")

    def add(self, rows: DataFrame) -> int:
        return self.store.commit({self.table: self._latest(rows)})

    def read(self, version: int | None = None) -> DataFrame:
        return self._latest(self.store.read(self.table, version))

    def compact(self) -> int:
        on = self.store.version()
        return self.store.replace(self.table, self.read(on), on)


class Seen:
    """Keys once across runs."""

    def __init__(self, store: Store, table: str, keys: list[str]):
        self.store, self.table, self.keys = store, table, keys

    def add(self, rows: DataFrame) -> DataFrame:
        """Remembers the keys of ``rows``; returns those that were not there, as they are stored. Refused if another run added some
        meanwhile."""
        on, new = self.store.version(), rows.select(*self.keys).distinct()
        if self.table in self.store.manifest(on):
            new = new.join(self.store.read(self.table, on), self.keys, "left_anti")
        version = self.store.commit({self.table: new}, on)
        own = self.store.manifest(version)[self.table]["parts"][-1]
        return self.store.part(self.table, own)
