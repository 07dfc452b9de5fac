"""Property indexes as sorted tables.

An index of a label over columns is a Parquet table of the label's nodes that
have all the columns, ranged and sorted by them, so that row groups outside a
lookup are skipped by their statistics. Later additions and removals are small
tables beside it, which lookups take into account until rebuild().
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import PropertyGraph, union
from ..plans.lineage import shared_dir
from . import search


@dataclass
class Index:
    label: str
    columns: tuple[str, ...]
    path: str
    added: list[str] = field(default_factory=list)
    removed: list[str] = field(default_factory=list)

    @property
    def name(self) -> str:
        return f"{self.label}({', '.join(self.columns)})"


class Indexes:
    """The indexes of a graph; the schema says which exist, `folder` holds their tables (the shared folder by default)."""

    def __init__(self, graph: PropertyGraph, folder: str | None = None) -> None:
        self.graph, self.spark = graph, graph.spark
        self.folder = folder or f"{shared_dir(graph.spark)}/indexes-{uuid.uuid4().hex}"
        self.made: dict[tuple[str, tuple[str, ...]], Index] = {}

    # Schema

    def create(self, label: str, *columns: str) -> Index:
        """An index over one column or several in order, filled from the nodes there are."""
        if not columns or (label, columns) in self.made:
            raise ValueError(f"an index needs columns and must be new: {label}{columns}")
        index = self.made[label, columns] = Index(label, columns, "")
        index.path = self._write(index, self.graph.label(label))
        return index

    def drop(self, label: str, *columns: str) -> None:
        self._get(label, columns)
        del self.made[label, columns]

    def clear(self) -> None:
        self.made.clear()

    def should_index(self, label: str, column: str) -> bool:
        """Whether an index of the label starts with the column."""
        return any(x.label == label and x.columns[0] == column for x in self.made.values())

    def usable(self, label: str, columns: Sequence[str]) -> list[Index]:
        """Indexes of which the columns are a leading part, or that are a leading part of the columns; those that use most columns first, then the narrower."""
        fits = lambda x: all(a == b for a, b in zip(x.columns, columns, strict=False))
        return sorted((x for x in self.made.values() if x.label == label and columns and fits(x)), key=lambda x: (-min(len(x.columns), len(columns)), len(x.columns)))

    def catalog(self) -> DataFrame:
        """(label, columns, kind) of each index."""
        rows = [(x.label, list(x.columns), "composite" if len(x.columns) > 1 else "single") for x in self.made.values()]
        return self.spark.createDataFrame(rows, "label string, columns array<string>, kind string")

    # Upkeep

    def add(self, nodes: DataFrame, label: str) -> int:
        """Take new nodes (id, properties) of the label into its indexes; how many indexes took them."""
        mine = [x for x in self.made.values() if x.label == label]
        for x in mine:
            x.added.append(self._write(x, nodes))
        return len(mine)

    def remove(self, ids: DataFrame, label: str) -> int:
        """Take nodes (first column: id) out of the label's indexes."""
        mine = [x for x in self.made.values() if x.label == label]
        if mine:
            path = f"{self.folder}/gone-{uuid.uuid4().hex}"
            ids.select(F.col(ids.columns[0]).cast("bigint").alias("gone")).distinct().write.parquet(path)
            for x in mine:
                x.removed.append(path)
        return len(mine)

    def rebuild(self, label: str, *columns: str) -> Index:
        """One sorted table again of what an index holds."""
        index = self._get(label, columns)
        index.path, index.added, index.removed = self._write(index, self.table(label, *columns)), [], []
        return index

    def _write(self, index: Index, nodes: DataFrame) -> str:
        keys = [F.col(f"`{c}`") for c in index.columns]
        path = f"{self.folder}/{uuid.uuid4().hex}"
        have = [c for c in index.columns if c in nodes.columns]
        rows = nodes.dropna(subset=have) if len(have) == len(index.columns) else nodes.limit(0)
        rows = rows.withColumns({c: F.lit(None).cast("string") for c in index.columns if c not in have})
        rows.select("id", *keys).repartitionByRange(*keys).sortWithinPartitions(*keys, "id").write.parquet(path)
        return path

    def _get(self, label: str, columns: Sequence[str]) -> Index:
        if (label, tuple(columns)) not in self.made:
            raise ValueError(f"no index {label}{tuple(columns)}")
        return self.made[label, tuple(columns)]

    # Lookups; each gives (id, columns of the index)

    def table(self, label: str, *columns: str) -> DataFrame:
        return self._rows(self._get(label, columns))

    def _rows(self, index: Index, where=lambda df: df) -> DataFrame:
        df = union([where(self.spark.read.parquet(p)) for p in (index.path, *index.added)])
        for p in index.removed:
            df = df.join(self.spark.read.parquet(p), F.col("id") == F.col("gone"), "left_anti")
        return df

    def find(self, label: str, values: dict[str, object]) -> DataFrame:
        """Nodes (id) with the values, given in the order of an index's leading columns; by a scan of the label where no index fits."""
        columns = list(values)
        for index in self.usable(label, columns)[:1]:
            lead = [c for c in index.columns if c in values]
            found = self._rows(index, lambda df: search.composite(df, lead, [values[c] for c in lead])).select("id")
            if len(lead) == len(columns):
                return found
            return search.composite(self.graph.label(label), columns, list(values.values())).join(found, "id", "left_semi").select("id")
        return search.composite(self.graph.label(label), columns, list(values.values())).select("id")

    def find_range(self, label: str, columns: Sequence[str], low: Sequence, high: Sequence) -> DataFrame:
        """Rows between two tuples in lexicographic order, both included."""
        return self._rows(self._get(label, columns), lambda df: search.composite_range(df, columns, low, high))

    def stats(self, label: str, *columns: str) -> DataFrame:
        """One row: total, unique, selectivity, per_key."""
        return search.index_stats(self.table(label, *columns), columns)

    def all_stats(self) -> DataFrame:
        """(index, total, unique, selectivity, per_key) of each index."""
        rows = [self.stats(x.label, *x.columns).select(F.lit(x.name).alias("index"), "*") for x in self.made.values()]
        return union(rows) if rows else self.spark.createDataFrame([], "index string, total bigint, unique bigint, selectivity double, per_key double")
