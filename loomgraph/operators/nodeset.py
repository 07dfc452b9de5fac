"""Fluent queries over a set of nodes; every step is lazy."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import percentile_disc
from ..graph import PropertyGraph
from ..plans.cypher import cypher
from .paths import hops


@dataclass(frozen=True)
class NodeSet:
    """Rows (id, labels, properties); a multiset until distinct()."""

    graph: PropertyGraph
    df: DataFrame

    @classmethod
    def all(cls, graph: PropertyGraph) -> NodeSet:
        return cls(graph, graph.nodes())

    @classmethod
    def label(cls, graph: PropertyGraph, label: str) -> NodeSet:
        return cls(graph, graph.label(label))

    def where(self, condition: Column | str) -> NodeSet:
        return replace(self, df=self.df.where(condition))

    def _compare(self, key: str, kinds: tuple[str, ...], test) -> NodeSet:
        kind = dict(self.df.dtypes).get(key)
        return self.where(test(F.col(f"`{key}`")) if kind in kinds else F.lit(False))

    def prop_eq(self, key: str, value: str) -> NodeSet:
        """Text equality; nodes without the property or with one of another type go."""
        return self._compare(key, ("string",), lambda c: c == F.lit(value))

    def int_eq(self, key: str, value: int) -> NodeSet:
        return self._compare(key, ("bigint", "int"), lambda c: c == F.lit(value))

    def int_gt(self, key: str, value: int) -> NodeSet:
        return self._compare(key, ("bigint", "int"), lambda c: c > F.lit(value))

    def _hop(self, types: tuple[str, ...], near: str, far: str) -> NodeSet:
        r = self.graph.rels(types).select(F.col(near).alias("__near"), F.col(far).alias("__far"))
        ids = self.df.select(F.col("id").alias("__id")).join(r, F.col("__id") == F.col("__near")).select("__far")
        return self._nodes(ids, "__far")

    def _nodes(self, ids: DataFrame, at: str) -> NodeSet:
        return replace(self, df=self.graph.nodes().join(ids, F.col("id") == F.col(at)).drop(at))

    def out(self, *types: str) -> NodeSet:
        """One hop along outgoing relationships; as many rows as relationships."""
        return self._hop(types, "start", "end")

    def in_(self, *types: str) -> NodeSet:
        return self._hop(types, "end", "start")

    def both(self, *types: str) -> NodeSet:
        return replace(self, df=self.out(*types).df.unionByName(self.in_(*types).df, allowMissingColumns=True)).distinct()

    def hops(self, *types: str, low: int = 1, high: int | None = None, direction: str = "out") -> NodeSet:
        """Nodes whose least number of hops from a start lies in low..high, once for each start."""
        e = self.graph.edges(types, directed=direction != "both")
        e = e.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if direction == "in" else e
        return self._nodes(hops(e, self.df.select("id"), low, high).select(F.col("id").alias("__to")), "__to")

    def distinct(self) -> NodeSet:
        return replace(self, df=self.df.dropDuplicates(["id"]))

    def order_by(self, key: str, ascending: bool = True) -> NodeSet:
        """Missing values last either way; ties by id."""
        c = F.col(f"`{key}`")
        return replace(self, df=self.df.orderBy(c.asc_nulls_last() if ascending else c.desc_nulls_last(), "id"))

    def skip(self, n: int) -> NodeSet:
        return replace(self, df=self.df.offset(n))

    def limit(self, n: int) -> NodeSet:
        return replace(self, df=self.df.limit(n))

    def paginate(self, offset: int, n: int) -> NodeSet:
        return self.skip(offset).limit(n)

    def ids(self) -> DataFrame:
        return self.df.select("id")

    # Aggregates as one-row frames, so that they stay lazy

    def count(self) -> int:
        return self.df.count()

    def agg(self, *columns: Column) -> DataFrame:
        return self.df.agg(*columns)

    def sum_int(self, key: str) -> int:
        return self.df.agg(F.coalesce(F.sum(f"`{key}`"), F.lit(0))).first()[0]

    def avg_int(self, key: str) -> float | None:
        return self.df.agg(F.avg(f"`{key}`")).first()[0]

    def percentile_cont(self, key: str, q: float) -> float | None:
        return self.df.agg(F.percentile(f"`{key}`", F.lit(q))).first()[0] if 0 <= q <= 1 else None

    def percentile_disc(self, key: str, q: float) -> float | None:
        return percentile_disc(self.df, {}, F.col(f"`{key}`"), q).first()[0] if 0 <= q <= 1 else None

    def stdev(self, key: str) -> float | None:
        """Of the sample; null below two values."""
        return self.df.agg(F.try_divide(F.stddev_samp(f"`{key}`"), F.when(F.count(f"`{key}`") >= 2, F.lit(1.0)))).first()[0]

    def variance(self, key: str) -> float | None:
        return self.df.agg(F.when(F.count(f"`{key}`") >= 2, F.var_samp(f"`{key}`"))).first()[0]


def simple_query(graph: PropertyGraph, label: str, prop: str | None = None, value=None, out: str | None = None, into: str | None = None) -> NodeSet:
    """Nodes of a label with a property's value, then a hop out and a hop in, each if given."""
    s = NodeSet.label(graph, label)
    if prop is not None:
        s = s.int_eq(prop, value) if isinstance(value, int) and not isinstance(value, bool) else s.prop_eq(prop, value)
    s = s.out(out) if out else s
    return s.in_(into) if into else s


@dataclass(frozen=True)
class QueryBuilder:
    """A reading query put together from the texts of its clauses; run() compiles them as one Cypher text."""

    graph: PropertyGraph
    patterns: tuple[str, ...] = ()
    conditions: tuple[str, ...] = ()
    items: tuple[str, ...] = ()
    orders: tuple[str, ...] = ()
    first: int | None = None
    most: int | None = None
    once: bool = False

    def match(self, pattern: str) -> QueryBuilder:
        return replace(self, patterns=(*self.patterns, pattern))

    def where(self, condition: str) -> QueryBuilder:
        return replace(self, conditions=(*self.conditions, condition))

    def returns(self, *items: str, distinct: bool = False) -> QueryBuilder:
        return replace(self, items=(*self.items, *items), once=distinct)

    def order_by(self, *orders: str) -> QueryBuilder:
        return replace(self, orders=(*self.orders, *orders))

    def skip(self, n: int) -> QueryBuilder:
        return replace(self, first=n)

    def limit(self, n: int) -> QueryBuilder:
        return replace(self, most=n)

    def text(self) -> str:
        if not self.patterns or not self.items:
            raise ValueError("a query needs a pattern and something to return")
        parts = ["MATCH " + ", ".join(self.patterns)]
        parts += ["WHERE " + " AND ".join(f"({c})" for c in self.conditions)] * bool(self.conditions)
        parts.append("RETURN " + "DISTINCT " * self.once + ", ".join(self.items))
        parts += ["ORDER BY " + ", ".join(self.orders)] * bool(self.orders)
        parts += [f"SKIP {self.first}"] * (self.first is not None) + [f"LIMIT {self.most}"] * (self.most is not None)
        return " ".join(parts)

    def run(self, null_semantics: str = "sql") -> DataFrame:
        return cypher(self.graph, self.text(), null_semantics)
