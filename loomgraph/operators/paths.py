"""Path search: level by level over an edge table (src, dst), a checkpoint a level, never the graph on the driver."""

from __future__ import annotations

import functools
import tempfile
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .compact import adjacency


def hops(edges: DataFrame, starts: DataFrame, low: int = 1, high: int | None = None) -> DataFrame:
    """(start, id, depth): nodes whose least number of hops >= 1 from a start lies in low..high, once for each start."""
    edges = edges.select("src", "dst").distinct()
    if high is None or high > 2:
        edges = cut(edges)
    frontier = starts.select(F.col(starts.columns[0]).alias("start")).distinct().join(edges, F.col("start") == F.col("src")).select("start", F.col("dst").alias("id"))
    seen, depth = frontier.withColumn("depth", F.lit(1)), 1
    if high is None or high > 2:
        seen = cut(seen)
        frontier = seen.select("start", "id")
    while high is None or depth < high:
        depth += 1
        ahead = frontier.join(edges, F.col("id") == F.col("src")).select("start", F.col("dst").alias("id")).distinct()
        new = ahead.join(seen.select("start", "id"), ["start", "id"], "left_anti")
        if high is None or high > 2:
            new = cut(new)
            if new.isEmpty():
                break
        seen, frontier = seen.unionAll(new.withColumn("depth", F.lit(depth))), new
        if depth % 8 == 0:
            seen = cut(seen)
    return seen.where(F.col("depth") >= low)


def bfs(edges: DataFrame, start: int, max_depth: int | None = None) -> DataFrame:
    """(id, depth) of what a start reaches, itself at depth 0."""
    one = edges.sparkSession.createDataFrame([(start,)], "id bigint")
    if max_depth == 0:
        return one.withColumn("depth", F.lit(0))
    found = hops(edges, one, 1, max_depth).where(F.col("id") != F.lit(start)).select("id", "depth")
    return one.withColumn("depth", F.lit(0)).unionAll(found)


def dfs(edges: DataFrame, start: int, max_depth: int | None = None) -> list[int]:
    """Ids in pre-order, smaller neighbours first, nodes never visited again.

    Depth-first order is one sequence, so the driver makes it; the edges lie
    in a file on its disk (compact.adjacency), however many there are, and
    only a few numbers for each node are in its memory.
    """
    if max_depth is not None:
        near = bfs(edges, start, max_depth)
        edges = edges.join(near.select(F.col("id").alias("src")), "src", "left_semi")
    with tempfile.TemporaryDirectory(prefix="loomgraph-") as folder:
        ids, ends, heads = adjacency(edges, folder)
        first = int(np.searchsorted(ids, start))
        if first == len(ids) or ids[first] != start:
            return [start]
        at, seen = ends[:-1].copy(), np.zeros(len(ids), bool)
        seen[first], order, stack = True, [first], [first]
        while stack:
            node, found = stack[-1], False
            deeper = max_depth is None or len(stack) <= max_depth
            while deeper and not found and at[node] < ends[node + 1]:
                some = heads[at[node] : min(at[node] + 256, ends[node + 1])]
                new = np.flatnonzero(~seen[some])
                found = len(new) > 0
                at[node] += new[0] + 1 if found else len(some)
            if found:
                x = int(some[new[0]])
                seen[x] = True
                order.append(x)
                stack.append(x)
            else:
                stack.pop()
        return ids[np.array(order)].tolist()


def shortest_tree(edges: DataFrame, start: int, goal: int | None = None, max_depth: int | None = None) -> DataFrame:
    """(id, depth, parent, paths): of all shortest paths from start, the smallest parent and the number, parallel edges counted."""
    edges = cut(edges.groupBy("src", "dst").agg(F.count("dst").alias("n")))
    frontier = seen = edges.sparkSession.createDataFrame([(start, 0, None, 1)], "id bigint, depth int, parent bigint, paths bigint")
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.join(edges, F.col("id") == F.col("src")).groupBy("dst").agg(F.min("src").alias("parent"), F.sum(F.col("paths") * F.col("n")).alias("paths"))
        new = cut(step.join(seen.select(F.col("id").alias("dst")), "dst", "left_anti").select(F.col("dst").alias("id"), F.lit(depth).alias("depth"), "parent", "paths"))
        if new.isEmpty():
            break
        seen, frontier = seen.unionAll(new), new
        if depth % 8 == 0:
            seen = cut(seen)
        if goal is not None and not new.where(F.col("id") == goal).isEmpty():
            break
    return seen


def _trace(tree: DataFrame, goal: int, hops: int = 8) -> tuple[list[int], object] | None:
    """Nodes from the start to the goal by the tree's parents, and the goal's row; `hops` joins of one broadcast row a job."""
    last = tree.where(F.col("id") == goal).first()
    if last is None:
        return None
    path, parent, own = [goal], last.parent, tree.select(F.col("id").alias("i"), F.col("parent").alias("p"))
    while parent is not None:
        chain = tree.sparkSession.createDataFrame([(parent,)], "n0 bigint")
        for k in range(hops):
            chain = own.withColumnRenamed("p", f"n{k + 1}").join(F.broadcast(chain), F.col("i") == F.col(f"n{k}"), "right").drop("i")
        found = chain.select(*[f"n{k}" for k in range(hops + 1)]).first()
        path += [x for x in found[:hops] if x is not None]
        parent = found[hops]
    return path[::-1], last


def shortest_path(edges: DataFrame, start: int, goal: int) -> list[int] | None:
    """Nodes of the unweighted shortest path whose parents are smallest; None if there is none."""
    got = _trace(shortest_tree(edges, start, goal), goal)
    return got and got[0]


def has_path(edges: DataFrame, start: int, goal: int) -> bool:
    return start == goal or not bfs(edges, start).where(F.col("id") == goal).isEmpty()


def count_shortest(edges: DataFrame, start: int, goal: int) -> int:
    """Number of shortest paths; 1 from a node to itself, 0 if there is none."""
    got = shortest_tree(edges, start, goal).where(F.col("id") == goal).first()
    return got.paths if got else 0


def all_shortest(edges: DataFrame, start: int, goal: int) -> DataFrame:
    """(nodes array<bigint>): every shortest path, once for each choice of parallel edges."""
    tree = shortest_tree(edges, start, goal)
    goal_row = tree.where(F.col("id") == goal).first()
    paths = edges.sparkSession.createDataFrame([(goal, [goal])] if goal_row else [], "at bigint, nodes array<bigint>")
    for depth in range(goal_row.depth - 1 if goal_row else -1, -1, -1):
        level = tree.where(F.col("depth") == depth).select(F.col("id").alias("src"))
        back = edges.join(level, "src")
        paths = paths.join(back, F.col("at") == F.col("dst")).select(F.col("src").alias("at"), F.concat(F.array("src"), "nodes").alias("nodes"))
    return paths.select("nodes")


def simple_paths(edges: DataFrame, start: int, goal: int | None = None, low: int = 1, high: int | None = 3) -> DataFrame:
    """(nodes array<bigint>) without repeated nodes and low..high hops, to the goal or to anywhere. Each sequence of nodes once; none from a node to itself.

    Without `high` paths go on until none can grow; their number can grow with
    the factorial of the reachable nodes. Long searches write each level.
    """
    edges = cut(edges.select("src", "dst").distinct())
    spark, far = edges.sparkSession, high is None or high > 4
    paths, found, depth = spark.createDataFrame([(start, [start])], "at bigint, nodes array<bigint>"), [], 0
    while high is None or depth < high:
        depth += 1
        paths = paths.join(edges, F.col("at") == F.col("src")).where(~F.array_contains("nodes", F.col("dst"))).select(F.col("dst").alias("at"), F.concat("nodes", F.array("dst")).alias("nodes"))
        if far:
            paths = cut(paths)
            if paths.isEmpty():
                break
        if depth >= low:
            found.append(paths if goal is None else paths.where(F.col("at") == goal))
        if goal is not None:
            paths = paths.where(F.col("at") != goal)
    return union_all([f.select("nodes") for f in found], spark, "nodes array<bigint>")


def union_all(frames: list[DataFrame], spark, schema: str) -> DataFrame:
    return functools.reduce(DataFrame.unionAll, frames, spark.createDataFrame([], schema))


@dataclass(frozen=True)
class PathQuery:
    """Builder of path queries over a graph: types, direction, depths; paths come as node ids or hydrated."""

    graph: object
    start: int
    goal: int | None = None
    types: tuple[str, ...] = ()
    direction: str = "out"  # out, in, both
    low: int = 1
    high: int | None = 3

    def to(self, goal: int) -> PathQuery:
        return replace(self, goal=goal)

    def via(self, *types: str) -> PathQuery:
        return replace(self, types=types)

    def along(self, direction: str) -> PathQuery:
        if direction not in ("out", "in", "both"):
            raise ValueError("a direction is out, in or both")
        return replace(self, direction=direction)

    def depths(self, low: int = 1, high: int | None = 3) -> PathQuery:
        return replace(self, low=low, high=high)

    def edges(self) -> DataFrame:
        e = self.graph.edges(self.types, directed=self.direction != "both")
        return e.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if self.direction == "in" else e

    def paths(self) -> DataFrame:
        """(nodes): all simple paths within the depths."""
        return simple_paths(self.edges(), self.start, self.goal, self.low, self.high)

    def shortest(self) -> DataFrame:
        """(nodes): every shortest path to the goal."""
        return all_shortest(self.edges(), self.start, self._goal()).distinct()

    def hydrated(self, paths: DataFrame | None = None) -> DataFrame:
        """(nodes, rels) of the paths (all simple ones by default), walked in the builder's direction."""
        return hydrate(self.graph, self.paths() if paths is None else paths, self.types, self.direction)

    def _goal(self) -> int:
        if self.goal is None:
            raise ValueError("name the goal by to()")
        return self.goal


def path_between(graph, start: int, goal: int, types: tuple[str, ...] = ()) -> DataFrame:
    """(nodes, rels) of one shortest path between the ends: that whose parents are smallest; no row if there is none."""
    path = shortest_path(graph.edges(types), start, goal)
    return hydrate(graph, graph.spark.createDataFrame([(path,)] if path else [], "nodes array<bigint>"), types)


def hydrate(graph, paths: DataFrame, types: tuple[str, ...] = (), direction: str = "out") -> DataFrame:
    """nodes and rels: for each pair of neighbours on a path the relationship with the smallest id, of the types and along the direction."""
    numbered = paths.withColumn("p", F.monotonically_increasing_id())
    numbered = cut(numbered)
    steps = numbered.select("p", F.posexplode(F.arrays_zip(F.expr("slice(nodes, 1, size(nodes) - 1)").alias("a"), F.expr("slice(nodes, 2, size(nodes) - 1)").alias("b"))).alias("k", "s")).select("p", "k", F.col("s.a").alias("start"), F.col("s.b").alias("end"))
    rels = graph.rels(types).select("id", "start", "end")
    back = rels.select("id", F.col("end").alias("start"), F.col("start").alias("end"))
    best = {"out": rels, "in": back, "both": rels.unionAll(back)}[direction].groupBy("start", "end").agg(F.min("id").alias("rel"))
    rels = steps.join(best, ["start", "end"]).groupBy("p").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "rel"))), lambda x: x["rel"]).alias("rels"))
    return numbered.join(rels, "p", "left").select("nodes", F.coalesce("rels", F.array().cast("array<bigint>")).alias("rels"))


def cheapest(edges: DataFrame, start: int, weight: str | None = None) -> DataFrame:
    """(id, cost, parent) of the cheapest way from start to every node, by relaxation in rounds; edges cost 1 without a weight column.

    Weights may not be negative. Ties go to the smallest parent.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    edges = cut(edges.withColumn("w", w).where("w IS NOT NULL").groupBy("src", "dst").agg(F.min("w").alias("w")))
    if not edges.where("w < 0").isEmpty():
        raise ValueError("negative weight")
    best = edges.sparkSession.createDataFrame([(start, 0.0, None)], "id bigint, cost double, parent bigint")
    frontier = best
    while True:
        offers = frontier.join(edges, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), (F.col("cost") + F.col("w")).alias("cost"), F.col("src").alias("parent"))
        offers = offers.groupBy("id").agg(F.min(F.struct("cost", "parent")).alias("o"))
        old = best.select(F.col("id").alias("oid"), F.col("cost").alias("ocost"), F.col("parent").alias("oparent"))
        merged = old.join(offers, F.col("oid") == F.col("id"), "full_outer")
        better = F.col("o.cost").isNotNull() & (F.col("ocost").isNull() | (F.col("o.cost") < F.col("ocost")))
        best = cut(merged.select(F.coalesce("oid", "id").alias("id"), F.when(better, F.col("o.cost")).otherwise(F.col("ocost")).alias("cost"), F.when(better, F.col("o.parent")).otherwise(F.col("oparent")).alias("parent"), better.alias("new")))
        frontier = best.where("new").select("id", "cost", "parent")
        best = best.select("id", "cost", "parent")
        if frontier.isEmpty():
            return best


def cheapest_path(edges: DataFrame, start: int, goal: int, weight: str | None = None) -> tuple[list[int], float] | None:
    """Nodes and cost of the cheapest path; None if there is none."""
    got = _trace(cheapest(edges, start, weight), goal)
    return got and (got[0], got[1].cost)


def a_star(edges: DataFrame, start: int, goal: int, positions: DataFrame | None = None, distance: str | Callable[[Column, Column, Column, Column], Column] = "euclidean", directed: bool = False):
    """(nodes, cost) of the cheapest path; edges go both ways unless directed.

    With positions (id, x, y) an edge costs the distance of its ends, else 1.
    Rounds relax the whole frontier at once, so the heuristic, which only
    orders a queue, isn't needed for the same optimum.
    """
    e = edges if directed else edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    if positions is None:
        return cheapest_path(e, start, goal)
    measure = {"euclidean": lambda a, b, c, d: F.sqrt(F.pow(a - c, 2) + F.pow(b - d, 2)), "manhattan": lambda a, b, c, d: F.abs(a - c) + F.abs(b - d)}.get(distance, distance)
    p, q = (positions.select(F.col("id").alias(k), F.col("x").alias(f"{k}x"), F.col("y").alias(f"{k}y")) for k in ("src", "dst"))
    weighted = e.join(p, "src").join(q, "dst").select("src", "dst", measure(F.col("srcx"), F.col("srcy"), F.col("dstx"), F.col("dsty")).alias("w"))
    return cheapest_path(weighted, start, goal, "w")
