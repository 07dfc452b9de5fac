"""Uniqueness and existence constraints, checked over whole labels."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import PropertyGraph, union


@dataclass(frozen=True)
class Constraint:
    kind: str  # unique or exists
    label: str
    prop: str


@dataclass
class Constraints:
    items: list[Constraint] = field(default_factory=list)

    def add(self, kind: str, label: str, prop: str) -> None:
        c = Constraint(kind, label, prop)
        if kind not in ("unique", "exists") or c in self.items:
            raise ValueError(f"unknown kind or known constraint: {c}")
        self.items.append(c)

    def drop(self, kind: str, label: str, prop: str) -> None:
        self.items.remove(Constraint(kind, label, prop))

    def of_label(self, label: str) -> list[Constraint]:
        return [c for c in self.items if c.label == label]

    def violations(self, graph: PropertyGraph) -> DataFrame:
        """(kind, label, prop, id) of nodes that break a constraint; a missing value can't break uniqueness."""
        found = []
        for c in self.items:
            df = graph.label(c.label)
            if c.prop not in df.columns:
                bad = df.select("id").where(F.lit(c.kind == "exists"))
            elif c.kind == "exists":
                bad = df.where(F.col(f"`{c.prop}`").isNull()).select("id")
            else:
                value = df.select("id", F.col(f"`{c.prop}`").alias("v")).where("v IS NOT NULL")
                twice = value.groupBy("v").agg(F.count("id").alias("n")).where("n > 1").select("v")
                bad = value.join(twice, "v", "left_semi").select("id")
            found.append(bad.select(F.lit(c.kind).alias("kind"), F.lit(c.label).alias("label"), F.lit(c.prop).alias("prop"), "id"))
        return union(found) if found else graph.spark.createDataFrame([], "kind string, label string, prop string, id bigint")

    def enforce(self, graph: PropertyGraph) -> PropertyGraph:
        """The graph, or an error if a constraint is broken."""
        bad = self.violations(graph).first()
        if bad:
            raise ValueError(f"constraint broken: {bad}")
        return graph
