"""Changes: each takes a version of a graph and gives the next one. Tables stay lazy; counts are actions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import NodeTable, PropertyGraph, RelTable, type_of, union
from ..plans.lineage import cut


def next_id(df: DataFrame, column: str = "id") -> int:
    """One more than the largest id."""
    top = df.agg(F.max(column)).first()[0]
    return 0 if top is None else top + 1


def append_nodes(graph: PropertyGraph, labels: tuple[str, ...], rows: DataFrame) -> PropertyGraph:
    """Rows (id, properties) as nodes of the labels."""
    tables, labels = list(graph.node_tables), tuple(labels)
    for k, t in enumerate(tables):
        if t.labels == labels:
            tables[k] = NodeTable(labels, union([t.df, rows]))
            return graph.with_tables(nodes=tables)
    return graph.with_tables(nodes=[*tables, NodeTable(labels, rows)])


def append_rels(graph: PropertyGraph, typ: str, rows: DataFrame) -> PropertyGraph:
    """Rows (id, start, end, properties) as relationships of the type."""
    tables = list(graph.rel_tables)
    for k, t in enumerate(tables):
        if t.typ == typ and t.start is None and t.end is None:
            tables[k] = RelTable(typ, union([t.df, rows]))
            return graph.with_tables(rels=tables)
    return graph.with_tables(rels=[*tables, RelTable(typ, rows)])


def _rows(graph: PropertyGraph, first: int, items: list[dict], fixed: tuple[str, ...] = ()) -> DataFrame:
    names = list(dict.fromkeys(k for r in items for k in r if k not in fixed))
    schema = ", ".join(["id bigint", *[f"{f} bigint" for f in fixed], *[f"`{n}` {type_of([r.get(n) for r in items])}" for n in names]])
    return graph.spark.createDataFrame([(first + k, *[r[f] for f in fixed], *[r.get(n) for n in names]) for k, r in enumerate(items)], schema)


def create_nodes(graph: PropertyGraph, labels: Iterable[str], items: list[dict]) -> tuple[PropertyGraph, list[int]]:
    """Nodes with consecutive ids, from property dicts."""
    first = next_id(graph.nodes(False))
    return append_nodes(graph, tuple(labels), _rows(graph, first, items)), list(range(first, first + len(items)))


def create_rels(graph: PropertyGraph, typ: str, items: list[tuple[int, int, dict]], enforce: bool = False) -> tuple[PropertyGraph, list[int]]:
    """Relationships (start, end, properties) with consecutive ids; enforce raises for an end that is no node."""
    first = next_id(graph.rels())
    new = append_rels(graph, typ, _rows(graph, first, [{"start": s, "end": e, **p} for s, e, p in items], ("start", "end")))
    if enforce and not new.dangling().isEmpty():
        raise ValueError("a relationship ends at no node")
    return new, list(range(first, first + len(items)))


def create_nodes_from(graph: PropertyGraph, labels: Iterable[str], rows: DataFrame) -> PropertyGraph:
    """Nodes from any number of rows of properties; ids are unique and above all others, but not consecutive."""
    first = next_id(graph.nodes(False))
    return append_nodes(graph, tuple(labels), cut(rows.withColumn("id", F.monotonically_increasing_id() + F.lit(first))).select("id", *rows.columns))


def delete_nodes(graph: PropertyGraph, ids: DataFrame) -> tuple[PropertyGraph, int, int]:
    """Without the nodes (column id) and the relationships that touch them; how many of each went."""
    gone = cut(ids.select(F.col(ids.columns[0]).alias("__gone")).distinct())
    drop = lambda df, c: df.join(gone, df[c] == gone["__gone"], "left_anti")
    n = graph.nodes(False).join(gone, F.col("id") == F.col("__gone"), "left_semi").count()
    r = graph.rels()
    rels = r.count() - drop(drop(r, "start"), "end").count()
    return graph.with_tables([NodeTable(t.labels, drop(t.df, "id")) for t in graph.node_tables], [RelTable(t.typ, drop(drop(t.df, "start"), "end"), t.start, t.end) for t in graph.rel_tables]), n, rels


def delete_rels(graph: PropertyGraph, ids: DataFrame, types: tuple[str, ...] = ()) -> PropertyGraph:
    gone = ids.select(F.col(ids.columns[0]).alias("__gone")).distinct()
    return graph.with_tables(rels=[RelTable(t.typ, t.df.join(gone, t.df["id"] == gone["__gone"], "left_anti") if not types or t.typ in types else t.df, t.start, t.end) for t in graph.rel_tables])


def _updated(df: DataFrame, changes: DataFrame) -> DataFrame:
    """changes: id, then a struct column for each property, null where it isn't changed."""
    names = [c for c in changes.columns if c != "id"]
    new = changes.select(F.col("id").alias("__id"), *[F.col(f"`{n}`").alias(f"__{n}") for n in names])
    kinds = dict(df.dtypes)
    out = df.join(new, df["id"] == new["__id"], "left")
    for n in names:
        value, hit = F.col(f"`__{n}`.v"), F.col(f"`__{n}`").isNotNull()
        kind = dict(new.dtypes)[f"__{n}"].removeprefix("struct<v:").removesuffix(">")
        if n in kinds and kinds[n] != kind:
            value = value.cast(kinds[n] if kind == "void" else "string" if "string" in (kind, kinds[n]) else kinds[n] if kinds[n] == "double" else kind)
        out = out.withColumn(n, F.when(hit, value).otherwise(F.col(f"`{n}`")) if n in kinds else F.when(hit, value))
    return out.select("id", *[c for c in out.columns if c != "id" and not c.startswith("__")])


def update_nodes(graph: PropertyGraph, changes: DataFrame, labels: Iterable[str] = ()) -> PropertyGraph:
    """Set properties: changes has id and a column struct<v> for each property (null: not changed)."""
    changes = cut(changes.dropDuplicates(["id"]))
    return graph.with_tables(nodes=[NodeTable(t.labels, _updated(t.df, changes)) if set(labels) <= set(t.labels) else t for t in graph.node_tables])


def update_rels(graph: PropertyGraph, changes: DataFrame, types: tuple[str, ...] = ()) -> PropertyGraph:
    changes = cut(changes.dropDuplicates(["id"]))
    return graph.with_tables(rels=[RelTable(t.typ, _updated(t.df, changes), t.start, t.end) if not types or t.typ in types else t for t in graph.rel_tables])


def set_props(graph: PropertyGraph, ids: DataFrame, values: dict[str, Column | object]) -> PropertyGraph:
    """Overwrite or add properties of the nodes in ids."""
    return update_nodes(graph, ids.select(F.col(ids.columns[0]).alias("id"), *[F.struct((v if isinstance(v, Column) else F.lit(v)).alias("v")).alias(n) for n, v in values.items()]))
