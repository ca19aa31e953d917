"""A write path with registered column transforms: before a write, and derived columns that follow their inputs.

Hooks are functions of columns, registered from outside with the columns that they read. Those before a change run over
the batch in the order in which they were registered. Derived columns run after them, in their order, and only for
rows in which one of their inputs differs from what is stored; else the stored value is kept. The rows are then merged, so that a batch
without differences writes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keyed import KeyedTable

Transform = Callable[..., Column]


@dataclass
class Collection:
    """A keyed table and its hooks. Registering a column again replaces its hook in its place."""

    table: KeyedTable
    before: dict[str, tuple[tuple[str, ...], Transform]] = field(default_factory=dict)
    derived: dict[str, tuple[tuple[str, ...], Transform]] = field(default_factory=dict)

    def before_change(self, column: str, *inputs: str) -> Callable[[Transform], Transform]:
        """Registers what sets `column` of a batch, from the columns named as inputs (the column itself where none are)."""
        return self._register(self.before, column, inputs or (column,))

    def after_change(self, column: str, *inputs: str) -> Callable[[Transform], Transform]:
        """Registers what derives `column` from the inputs, which may be derived themselves if they were registered earlier."""
        if not inputs or column in inputs:
            raise ValueError(f"{column} is derived from other columns, which are to be named")
        return self._register(self.derived, column, inputs)

    @staticmethod
    def _register(hooks: dict, column: str, inputs: tuple[str, ...]) -> Callable[[Transform], Transform]:
        def add(transform: Transform) -> Transform:
            hooks[column] = (inputs, transform)
            return transform

        return add

    def prepared(self, batch: DataFrame) -> DataFrame:
        """The batch as it is to be merged."""
        for column, (inputs, transform) in self.before.items():
            batch = batch.withColumn(column, transform(*map(F.col, inputs)))
        names = [*batch.columns, *(c for c in self.derived if c not in batch.columns)]
        stored = self.table.beside(batch)
        if stored is None or set(self.derived) - set(stored.columns):
            stored = batch.limit(0).select(*self.table.key)  # what is there knows nothing of these columns yet
        kept = [c for c in stored.columns if c not in self.table.key and c != "version"]
        old = stored.select(*self.table.key, *(F.col(c).alias(f"_was_{c}") for c in kept), F.lit(True).alias("_known"))
        met = batch.join(old, self.table.key, "left")
        for column, (inputs, transform) in self.derived.items():
            same = F.coalesce("_known", F.lit(False))
            for c in inputs:
                same = same & (F.col(c).eqNullSafe(F.col(f"_was_{c}")) if c in kept else F.lit(False))
            fresh = transform(*map(F.col, inputs))
            met = met.withColumn(column, F.when(same, F.col(f"_was_{column}")).otherwise(fresh) if column in kept else fresh)
        return met.select(*names)

    def save(self, batch: DataFrame) -> int:
        """Merges a batch; how many rows of the table changed."""
        return self.table.merge(self.prepared(batch))
