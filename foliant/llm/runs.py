"""Levels of sorted runs in the shared folder: an index that grows batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import Scratch

#: How a column of two rows of one key is combined: in a group, and from two columns of which the second may be null.
COMBINE = {
    "sum": (F.sum, lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))),
    "min": (F.min, lambda a, b: F.least(a, b)),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
}


class Levels:
    """Runs of (keys, columns) sorted by the keys in their order; ``columns`` says how each column combines.

    ``add`` takes one row a key. The batch is merge-anti-joined with every run: keys that none of them has
    become the batch's own run at level 0, so a key lies in one run only; what the batch says of known
    keys is written beside the runs. When a level holds ``fanout`` runs they are compacted into one run of the
    next level, so a key is rewritten a logarithmic number of times; runs are disjoint, so nothing is combined then.
    """

    def __init__(self, scratch: Scratch, name: str, keys: list[str], columns: dict[str, str], *, fanout: int = 4):
        self.scratch, self.name, self.keys, self.columns, self.fanout = scratch, name, keys, columns, fanout
        self.levels: list[list[tuple[str, DataFrame]]] = []
        self.again: list[tuple[str, DataFrame]] = []
        self.written = 0

    def _written(self, rows: DataFrame) -> tuple[str, DataFrame]:
        name = f"{self.name}{self.written}"
        self.written += 1
        return name, self.scratch.write(rows, name)

    def _place(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(self._written(run.sortWithinPartitions(*self.keys)))
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._place(union([r for _, r in old]).repartition(*self.keys), level + 1)
            for gone, _ in old:
                self.scratch.drop(gone)

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for _, r in level]

    def new(self, batch: DataFrame) -> DataFrame:
        """The batch's rows whose key no run has: a merge anti-join with each run."""
        for run in self.runs():
            batch = batch.join(run.select(*self.keys).hint("merge"), self.keys, "left_anti")
        return batch

    def known(self, batch: DataFrame) -> DataFrame:
        """The batch's rows whose key a run has: a merge scan of the runs."""
        return batch.join(union([r.select(*self.keys) for r in self.runs()]).hint("merge"), self.keys, "left_semi")

    def add(self, batch: DataFrame) -> None:
        if not self.runs():
            self._place(batch, 0)
            return
        name, batch = self._written(batch)
        self.again.append(self._written(self.known(batch)))
        self._place(self.new(batch), 0)
        self.scratch.drop(name)

    def all(self) -> DataFrame:
        """One row a key: its run's row combined with what later batches said of it."""
        runs = union(self.runs())
        if not self.again:
            return runs
        later = self._said_again().select(*self.keys, *[F.col(c).alias(f"later_{c}") for c in self.columns])
        return runs.join(later, self.keys, "left").select(*self.keys, *[COMBINE[how][1](c, f"later_{c}").alias(c) for c, how in self.columns.items()])

    def _said_again(self) -> DataFrame:
        return union([r for _, r in self.again]).groupBy(*self.keys).agg(*[COMBINE[how][0](c).alias(c) for c, how in self.columns.items()])

    def written_again(self) -> tuple[str, DataFrame]:
        """What later batches said of known keys, written as one run."""
        return self._written(self._said_again().sortWithinPartitions(*self.keys))

    def drop(self) -> None:
        for name, _ in [x for level in self.levels for x in level] + self.again:
            self.scratch.drop(name)


def union(runs: list[DataFrame]) -> DataFrame:
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return out
