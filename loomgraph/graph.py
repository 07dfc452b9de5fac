"""The property graph: typed node and relationship tables behind labels and types."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class NodeTable:
    """Nodes that have exactly these labels: id bigint, then one column per property."""

    labels: tuple[str, ...]
    df: DataFrame

    @property
    def props(self) -> list[str]:
        return [c for c in self.df.columns if c != "id"]


@dataclass(frozen=True)
class RelTable:
    """Relationships of one type: id, start, end bigint, then properties; start and end name a label that all ends have, if known."""

    typ: str
    df: DataFrame
    start: str | None = None
    end: str | None = None

    @property
    def props(self) -> list[str]:
        return [c for c in self.df.columns if c not in ("id", "start", "end")]


def union(tables: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


@dataclass(frozen=True)
class PropertyGraph:
    """An immutable version of a graph; every change gives a new one."""

    spark: SparkSession
    node_tables: tuple[NodeTable, ...] = ()
    rel_tables: tuple[RelTable, ...] = ()

    @classmethod
    def of(cls, spark: SparkSession, nodes: Iterable[tuple], rels: Iterable[tuple] = ()) -> PropertyGraph:
        """From rows (id, labels, {property: value}) and (id, start, end, type, {property: value}); for fixtures."""
        by_labels: dict[tuple, list] = {}
        for i, labels, props in nodes:
            by_labels.setdefault((labels,) if isinstance(labels, str) else tuple(labels), []).append({"id": i, **props})
        by_type: dict[str, list] = {}
        for i, s, e, typ, props in rels:
            by_type.setdefault(typ, []).append({"id": i, "start": s, "end": e, **props})
        return cls(spark, tuple(NodeTable(k, _frame(spark, v, ("id",))) for k, v in by_labels.items()), tuple(RelTable(k, _frame(spark, v, ("id", "start", "end"))) for k, v in by_type.items()))

    def with_tables(self, nodes: Iterable[NodeTable] | None = None, rels: Iterable[RelTable] | None = None) -> PropertyGraph:
        return replace(self, node_tables=self.node_tables if nodes is None else tuple(nodes), rel_tables=self.rel_tables if rels is None else tuple(rels))

    # Scans

    def label(self, *labels: str) -> DataFrame:
        """Nodes that have all the labels: id, labels and the properties of their tables."""
        found = [t for t in self.node_tables if set(labels) <= set(t.labels)]
        return union([_labelled(t) for t in found]) if found else self._empty("id bigint, labels array<string>")

    def nodes(self, props: bool = True) -> DataFrame:
        """All nodes; without properties only id and labels."""
        tables = [_labelled(t) if props else _labelled(t).select("id", "labels") for t in self.node_tables]
        return union(tables) if tables else self._empty("id bigint, labels array<string>")

    def rels(self, types: Sequence[str] = (), props: bool = False) -> DataFrame:
        """id, start, end, typ of relationships (of the types, if any are named); with properties on request."""
        found = [t for t in self.rel_tables if not types or t.typ in types]
        frames = [t.df.select("id", "start", "end", F.lit(t.typ).alias("typ"), *(t.props if props else ())) for t in found]
        return union(frames) if frames else self._empty("id bigint, start bigint, end bigint, typ string")

    def edges(self, types: Sequence[str] = (), directed: bool = True) -> DataFrame:
        """(src, dst), parallel ones included; both ways if not directed."""
        e = self.rels(types).select(F.col("start").alias("src"), F.col("end").alias("dst"))
        return e if directed else e.unionAll(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))

    def node(self, node_id: int) -> DataFrame:
        return self.nodes().where(F.col("id") == node_id)

    def rel(self, rel_id: int) -> DataFrame:
        return self.rels(props=True).where(F.col("id") == rel_id)

    def adjacent(self, node_id: int) -> DataFrame:
        """(direction, rel, id): a row for each relationship of a node, at any degree."""
        r = self.rels()
        out = r.where(F.col("start") == node_id).select(F.lit("out").alias("direction"), F.col("id").alias("rel"), F.col("end").alias("id"))
        return out.unionAll(r.where(F.col("end") == node_id).select(F.lit("in"), "id", "start"))

    def cached(self) -> PropertyGraph:
        """This version with its tables kept in Spark's cache from their first use on; release() gives them back."""
        return self.with_tables([replace(t, df=t.df.cache()) for t in self.node_tables], [replace(t, df=t.df.cache()) for t in self.rel_tables])

    def release(self) -> None:
        for t in (*self.node_tables, *self.rel_tables):
            t.df.unpersist()

    def neighbors(self, node_id: int) -> DataFrame:
        """One row: outgoing and incoming neighbour ids, sorted; adjacent() gives a hub's as rows."""
        out = self.rels().where(F.col("start") == node_id).agg(F.array_sort(F.collect_list("end")).alias("outgoing"))
        into = self.rels().where(F.col("end") == node_id).agg(F.array_sort(F.collect_list("start")).alias("incoming"))
        return out.withColumn("k", F.lit(1)).join(into.withColumn("k", F.lit(1)), "k").drop("k")

    # Catalog

    def labels(self) -> list[str]:
        return sorted({x for t in self.node_tables for x in t.labels})

    def types(self) -> list[str]:
        return sorted({t.typ for t in self.rel_tables})

    def stats(self) -> DataFrame:
        """(kind, name, n): nodes per label and relationships per type."""
        nodes = self.nodes(False).select(F.lit("label").alias("kind"), F.explode("labels").alias("name"))
        return nodes.unionAll(self.rels().select(F.lit("type"), "typ")).groupBy("kind", "name").agg(F.count("name").alias("n"))

    def dangling(self) -> DataFrame:
        """Relationships with an end that is no node."""
        ids = self.nodes(False).select("id")
        r = self.rels()
        return r.join(ids, r["start"] == ids["id"], "left_anti").unionAll(r.join(ids, r["end"] == ids["id"], "left_anti")).distinct()

    def _empty(self, schema: str) -> DataFrame:
        return self.spark.createDataFrame([], schema)


def _labelled(t: NodeTable) -> DataFrame:
    return t.df.select("id", F.array(*[F.lit(x) for x in t.labels]).cast("array<string>").alias("labels"), *[F.col(f"`{c}`") for c in t.props])


_TYPES = {bool: "boolean", int: "bigint", float: "double", str: "string"}


def type_of(values: Iterable) -> str:
    """Spark type of Python values of one property; mixed types become text."""
    kinds = {type(v) for v in values if v is not None}
    if len(kinds) == 1:
        kind = kinds.pop()
        return f"array<{type_of(x for v in values for x in v)}>" if kind in (list, tuple) else _TYPES.get(kind, "string")
    return "double" if kinds and kinds <= {int, float} else "string"


def _frame(spark: SparkSession, rows: list[dict], first: tuple[str, ...]) -> DataFrame:
    names = list(dict.fromkeys(k for r in rows for k in r if k not in first))
    kinds = {n: type_of([r.get(n) for r in rows]) for n in names}
    cast = {"string": lambda v: v if v is None or isinstance(v, str) else str(v), "double": lambda v: None if v is None else float(v)}
    data = [tuple(r[c] for c in first) + tuple(cast.get(kinds[n], lambda v: v)(r.get(n)) for n in names) for r in rows]
    return spark.createDataFrame(data, ", ".join([f"{c} bigint" for c in first] + [f"`{n}` {kinds[n]}" for n in names]))
