"""Graph views as JSON, DOT and CSV, and layouts. Rows are made on executors; a file is one view for a viewer."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import display_name, dot_escape
from ..graph import PropertyGraph
from ..operators.paths import hops
from ..plans.lineage import cut


def view(graph: PropertyGraph, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the graph, or of the part that the ids induce: (id, label, name, props) and (id, source, target, type)."""
    nodes, rels = graph.nodes(), graph.rels().distinct()
    if ids is not None:
        own = ids.select(F.col(ids.columns[0]).alias("__id")).distinct()
        nodes = nodes.join(own, F.col("id") == F.col("__id"), "left_semi")
        rels = rels.join(own, F.col("start") == F.col("__id"), "left_semi").join(own, F.col("end") == F.col("__id"), "left_semi")
    name = display_name(F.col("name").cast("string"), F.col("id")) if "name" in nodes.columns else F.col("id").cast("string")
    props = [F.col(f"`{c}`") for c in nodes.columns if c not in ("id", "labels")]
    nodes = nodes.select("id", "labels", name.alias("name"), F.to_json(F.struct(*props)).alias("props") if props else F.lit("{}").alias("props"))
    return nodes, rels.select("id", F.col("start").alias("source"), F.col("end").alias("target"), F.col("typ").alias("type"))


#: Rows that one document for a viewer may hold; it is a text on the driver.
MOST = 1_000_000
STYLE = ("x", "y", "color", "size")


def _bounded(df: DataFrame, most: int) -> list:
    got = df.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} elements; write the rows instead")
    return got


def json_elements(nodes: DataFrame, edges: DataFrame, style: DataFrame | None = None) -> DataFrame:
    """(kind, id, element): one JSON text per node and edge; style has an id and any of x, y, color, size, which become _x, _y, _color, _size."""
    looks = [c for c in STYLE if style is not None and c in style.columns]
    if looks:
        nodes = nodes.join(style.select(F.col("id").alias("__sid"), *[F.col(c).alias(f"_{c}") for c in looks]), F.col("id") == F.col("__sid"), "left").drop("__sid")
    n = nodes.select(F.lit("node").alias("kind"), "id", F.to_json(F.struct(F.struct(F.col("id").cast("string").alias("id"), F.element_at("labels", 1).alias("label"), "name", "props", *[f"_{c}" for c in looks]).alias("data"))).alias("element"))
    e = edges.select(F.lit("edge").alias("kind"), "id", F.to_json(F.struct(F.struct(F.concat(F.lit("e"), "id").alias("id"), F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"), F.col("type").alias("label")).alias("data"))).alias("element"))
    return n.unionAll(e)


def to_json(nodes: DataFrame, edges: DataFrame, style: DataFrame | None = None, most: int = MOST) -> str:
    """One document {nodes, edges} for a viewer; more than `most` elements are an error, write json_elements() then."""
    got = _bounded(json_elements(nodes, edges, style).orderBy("kind", "id"), most)
    return json.dumps({f"{kind}s": [json.loads(r.element) for r in got if r.kind == kind] for kind in ("node", "edge")}, ensure_ascii=False)


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, id, line): one DOT statement per node and edge."""
    n = nodes.select(F.lit(0).alias("kind"), "id", F.concat(F.lit("  n"), "id", F.lit(' [label="'), dot_escape(F.col("name")), F.lit('"];')).alias("line"))
    e = edges.select(F.lit(1), "id", F.concat(F.lit("  n"), "source", F.lit(" -> n"), "target", F.lit(' [label="'), dot_escape(F.col("type")), F.lit('"];')))
    return n.unionAll(e)


def to_dot(nodes: DataFrame, edges: DataFrame, name: str = "G", most: int = MOST) -> str:
    """One document for a viewer; more than `most` lines are an error, write dot_lines() then."""
    return "\n".join([f"digraph {name} {{", *[r.line for r in _bounded(dot_lines(nodes, edges).orderBy("kind", "id", "line"), most)], "}"])


def write_json(df: DataFrame, folder: str) -> None:
    """A JSON object a line, missing values left out."""
    df.write.mode("overwrite").json(folder)


def read_csv(spark, folder: str, schema: str) -> DataFrame:
    """What write_csv() has written."""
    return spark.read.schema(schema).option("escape", '"').option("multiLine", True).csv(folder, header=True)


def write_csv(df: DataFrame, folder: str) -> None:
    """RFC 4180: a header, quotes doubled."""
    df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]).write.mode("overwrite").option("escape", '"').csv(folder, header=True)


def circle(nodes: DataFrame, spacing: float = 100.0) -> DataFrame:
    """(id, x, y) around a circle of radius spacing * n / 2 pi, in order of the ids.

    Ranks come from ranges of ids: each task numbers its own range, behind the
    counts of those before.
    """
    parts = cut(nodes.select("id").repartitionByRange("id").withColumn("p", F.spark_partition_id()))
    sizes = parts.groupBy("p").agg(F.count("id").alias("n"))
    first = sizes.select("p", (F.sum("n").over(Window.orderBy("p")) - F.col("n")).alias("first"))  # one row a partition
    n = parts.count()
    angle = (F.row_number().over(Window.partitionBy("p").orderBy("id")) - 1 + F.col("first")) * F.lit(2 * math.pi / max(1, n))
    radius = spacing * n / (2 * math.pi)
    return parts.join(F.broadcast(first), "p").select("id", (F.cos(angle) * radius).alias("x"), (F.sin(angle) * radius).alias("y"))


def layers(graph: PropertyGraph) -> DataFrame:
    """(id, layer): least hops from nodes without incoming relationships; what these don't reach is on layer 0."""
    ids = graph.nodes(False).select("id")
    roots = ids.join(graph.edges().select(F.col("dst").alias("id")).distinct(), "id", "left_anti")
    from_top = graph.edges().unionAll(roots.select(F.lit(-1).cast("bigint").alias("src"), F.col("id").alias("dst")))  # a node before all roots
    depth = hops(from_top, graph.spark.createDataFrame([(-1,)], "id bigint")).select("id", (F.col("depth") - 1).alias("layer"))
    return ids.join(depth, "id", "left").select("id", F.coalesce("layer", F.lit(0)).alias("layer"))


def hierarchical(graph: PropertyGraph, spacing: float = 100.0) -> DataFrame:
    """(id, x, y): a row for each layer, nodes in order of ids."""
    k = F.row_number().over(Window.partitionBy("layer").orderBy("id")) - 1
    return layers(graph).select("id", (k * spacing).alias("x"), (F.col("layer") * spacing).alias("y"))


def force_directed(graph: PropertyGraph, iterations: int = 50, width: float = 1000.0, height: float = 1000.0, seed: int = 0, most: int = 5000) -> DataFrame:
    """(id, x, y) by repulsion (1 / distance^2), springs and damping 0.9, kept inside the frame.

    Every node repels every other, so it is for graphs a viewer can show: one
    task takes the whole of it, and more than `most` nodes are an error.
    """
    ids = graph.nodes(False).select("id")
    n = ids.count()
    if n > most:
        raise ValueError(f"a force-directed layout of more than {most} nodes")
    rows = ids.select("id", F.lit(None).cast("bigint").alias("to")).unionAll(graph.edges().where("src <> dst").select(F.col("src").alias("id"), F.col("dst").alias("to")))

    def placed(pdf):
        import numpy as np
        import pandas as pd

        ids = np.sort(pdf.id[pdf.to.isna()].to_numpy(np.int64))
        e = pdf[pdf.to.notna()].astype("int64").sort_values(["id", "to"])
        e = e[e.id.isin(ids) & e.to.isin(ids)]
        a, b = np.searchsorted(ids, e.id), np.searchsorted(ids, e.to)
        frame = np.array([width, height])
        at, speed = np.random.default_rng(seed).uniform(0, frame, (len(ids), 2)), np.zeros((len(ids), 2))
        for _ in range(iterations):
            force = np.zeros_like(at)
            for k in range(0, len(at), 256):
                apart = at[k : k + 256, None] - at[None]
                d = np.maximum(1.0, np.hypot(apart[..., 0], apart[..., 1]))
                force[k : k + 256] = (10_000.0 * apart / d[..., None] ** 3).sum(1)
            pull = (at[b] - at[a]) * 0.01
            np.add.at(force, a, pull)
            np.add.at(force, b, -pull)
            speed = (speed + force) * 0.9
            at = np.clip(at + speed, 0, frame)
        return pd.DataFrame({"id": ids, "x": at[:, 0], "y": at[:, 1]})

    return rows.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(placed, "id bigint, x double, y double")
