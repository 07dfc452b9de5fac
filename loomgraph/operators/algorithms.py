"""Whole-graph algorithms over vertices (id) and edges (src, dst), a few shuffles a round."""

from __future__ import annotations

import tempfile

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from . import stars
from .compact import adjacency


def ids(vertices: DataFrame) -> DataFrame:
    return vertices.select("id").distinct()


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct edges a < b without loops."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree, degree) with multiplicity, 0 for lone nodes."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select("dst", F.lit(0), F.lit(1)))
    ends = ends.unionAll(ids(vertices).select("id", F.lit(0), F.lit(0))).groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    return ends.withColumn("degree", F.col("out_degree") + F.col("in_degree"))


def degree_centrality(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, centrality): degree over n - 1; raw for a single node."""
    n = ids(vertices).count()
    return degrees(vertices, edges).select("id", (F.col("degree") / F.lit(float(max(1, n - 1)))).alias("centrality"))


def pagerank(vertices: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 20) -> DataFrame:
    """(id, rank): (1-d)/n + d * sum(rank / out-degree) over all edges, dangling mass dropped, scaled to sum 1 at the end."""
    v = cut(ids(vertices))
    n = v.count()
    if not n:
        return v.withColumn("rank", F.lit(0.0))
    links = edges.groupBy("src", "dst").agg(F.count("dst").alias("k"))
    out = edges.groupBy("src").agg(F.count("dst").alias("out"))
    links = cut(links.join(out, "src").select("src", "dst", (F.col("k") / F.col("out")).alias("share")))
    rank = v.withColumn("rank", F.lit(1.0 / n))
    for k in range(iterations):
        given = rank.join(links, rank["id"] == links["src"]).select(F.col("dst").alias("id"), (F.col("rank") * F.col("share")).alias("r"))
        rank = given.unionAll(v.withColumn("r", F.lit(0.0))).groupBy("id").agg(((1 - damping) / n + damping * F.sum("r")).alias("rank"))
        if k % 5 == 4:
            rank = cut(rank)
    rank = cut(rank)
    total = rank.agg(F.sum("rank")).first()[0]
    return rank.select("id", (F.col("rank") / F.lit(total)).alias("rank"))


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) with the smallest id of each weakly connected component, by alternating stars."""
    roots = stars.components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return ids(vertices).join(roots, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("component"))


def label_propagation(vertices: DataFrame, edges: DataFrame, iterations: int = 10) -> DataFrame:
    """(id, community): every node takes the label most edges to its neighbours carry, the smallest on ties, all at once; a round that changes nothing is the last."""
    links = edges.where("src <> dst")
    links = cut(links.unionAll(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).groupBy("src", "dst").agg(F.count("dst").alias("w")))
    label = cut(ids(vertices).withColumn("community", F.col("id")))
    for _ in range(iterations):
        votes = links.join(label.withColumnRenamed("id", "dst"), "dst").groupBy("src", "community").agg(F.sum("w").alias("w"))
        best = votes.groupBy("src").agg(F.max(F.struct("w", (-F.col("community")).alias("m"))).alias("b")).select(F.col("src").alias("id"), (-F.col("b.m")).alias("new"))
        label = cut(label.join(best, "id", "left").select("id", F.coalesce("new", "community").alias("community"), (F.coalesce("new", "community") != F.col("community")).alias("moved")))
        still = label.where("moved").isEmpty()
        label = label.drop("moved")
        if still:
            break
    return label


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c) with a smaller degree first: each triangle once.

    Edges point from the end of smaller degree to the other, so a hub has few
    outgoing ones and no node pairs up all its neighbours.
    """
    e = undirected(edges)
    deg = e.select(F.col("a").alias("id")).unionAll(e.select("b")).groupBy("id").agg(F.count("id").alias("d"))
    ranked = e.join(deg.select(F.col("id").alias("a"), F.col("d").alias("da")), "a").join(deg.select(F.col("id").alias("b"), F.col("d").alias("db")), "b")
    up = F.struct("da", "a") < F.struct("db", "b")
    e = cut(ranked.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("b"), F.when(up, F.col("db")).otherwise(F.col("da")).alias("d")))
    x, y = e.select("a", "b", "d"), e.select("a", F.col("b").alias("c"), F.col("d").alias("dc"))
    wedge = x.join(y, "a").where(F.struct("d", "b") < F.struct("dc", "c")).select("a", "b", "c")
    return wedge.join(e.select(F.col("a").alias("b"), F.col("b").alias("c")), ["b", "c"], "left_semi").select("a", "b", "c")


def triangle_count(edges: DataFrame) -> int:
    return triangles(edges).count()


def node_triangles(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, triangles), 0 included."""
    t = triangles(edges).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("id").alias("n"))
    return ids(vertices).join(t, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("triangles"))


def clustering(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, coefficient): triangles over pairs of distinct neighbours; 0 with fewer than two."""
    e = undirected(edges)
    deg = e.select(F.col("a").alias("id")).unionAll(e.select("b")).groupBy("id").agg(F.count("id").alias("k"))
    t = node_triangles(vertices, edges).join(deg, "id", "left")
    return t.select("id", F.when(F.col("k") >= 2, F.col("triangles") * 2.0 / (F.col("k") * (F.col("k") - 1))).otherwise(0.0).alias("coefficient"))


def mean_clustering(vertices: DataFrame, edges: DataFrame) -> float:
    return clustering(vertices, edges).agg(F.coalesce(F.avg("coefficient"), F.lit(0.0))).first()[0]


def k_core(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, core): degree is in plus out with multiplicity, a loop counts twice.

    Every node starts with its degree and lowers its estimate to the largest h
    for which so many of its edges lead to estimates of h or more. Rounds end
    when nothing changes: far fewer than levels, or links of a chain. A node's
    neighbours are counted by estimate before they are looked at, so a hub has
    a row for each estimate, not for each edge.
    """
    both = cut(edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).groupBy("src", "dst").agg(F.count("dst").alias("n")))
    core = cut(ids(vertices).join(both.groupBy(F.col("src").alias("v")).agg(F.sum("n").alias("d")), F.col("id") == F.col("v"), "left").select("id", F.coalesce("d", F.lit(0)).alias("core")))
    down = Window.partitionBy("src").orderBy(F.desc("core"))
    while True:
        counted = both.join(core, F.col("dst") == F.col("id")).groupBy("src", "core").agg(F.sum("n").alias("n"))
        upto = counted.withColumn("upto", F.sum("n").over(down)).groupBy("src").agg(F.max(F.least("core", "upto")).alias("h"))
        new = cut(core.join(upto, F.col("id") == F.col("src"), "left").select("id", F.least("core", F.coalesce("h", F.lit(0))).alias("core"), (F.coalesce("h", F.lit(0)) < F.col("core")).alias("less")))
        core, still = new.select("id", "core"), new.where("less").isEmpty()
        if still:
            return core


def k_core_nodes(vertices: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """(id) of the nodes whose core number is k or more."""
    return k_core(vertices, edges).where(F.col("core") >= k).select("id")


def max_core(vertices: DataFrame, edges: DataFrame) -> int:
    """The largest core number; 0 without nodes."""
    return k_core(vertices, edges).agg(F.coalesce(F.max("core"), F.lit(0))).first()[0]


def strong_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) with the smallest id of each strongly connected component.

    Rounds: nodes without in- or out-edges are components of their own; the
    others spread the smallest id forward to a fixpoint, and the nodes that
    reach their colour's own node against the edges, within the colour, are its
    component.
    """
    e = cut(edges.where("src <> dst").select("src", "dst").distinct())
    left = cut(ids(vertices))
    done = left.limit(0).select("id", F.col("id").alias("component"))
    while not left.isEmpty():
        while True:  # trim
            live = e.select(F.col("src").alias("id")).distinct().intersect(e.select(F.col("dst").alias("id")).distinct())
            single = cut(left.join(live, "id", "left_anti"))
            if single.isEmpty():
                break
            done = done.unionAll(single.select("id", F.col("id").alias("component")))
            left = cut(left.join(single, "id", "left_anti"))
            e = cut(e.join(left.withColumnRenamed("id", "src"), "src", "left_semi").join(left.withColumnRenamed("id", "dst"), "dst", "left_semi"))
        if left.isEmpty():
            break
        colour = left.withColumn("c", F.col("id"))
        while True:
            sent = colour.join(e, colour["id"] == e["src"]).select(F.col("dst").alias("id"), "c")
            new = cut(colour.withColumn("own", F.col("c")).unionByName(sent.withColumn("own", F.lit(None).cast("bigint"))).groupBy("id").agg(F.min("c").alias("c"), F.max("own").alias("own")))
            moved = not new.where("c <> own").isEmpty()
            colour = new.select("id", "c")
            if not moved:
                break
        same = e.join(colour.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst").where("cs = cd").select("src", "dst")
        same = cut(same)
        frontier = found = cut(colour.where("id = c").select("id"))
        while True:
            back = same.join(frontier.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id")).distinct()
            frontier = cut(back.join(found, "id", "left_anti"))
            if frontier.isEmpty():
                break
            found = cut(found.unionAll(frontier))
        done = cut(done.unionAll(colour.join(found, "id").select("id", F.col("c").alias("component"))))
        left = cut(left.join(found, "id", "left_anti"))
        e = cut(e.join(left.withColumnRenamed("id", "src"), "src", "left_semi").join(left.withColumnRenamed("id", "dst"), "dst", "left_semi"))
    return done


def component_sizes(parts: DataFrame) -> DataFrame:
    """(size, n): how many components have each size."""
    return parts.groupBy("component").agg(F.count("id").alias("size")).groupBy("size").agg(F.count("size").alias("n"))


def is_strongly_connected(vertices: DataFrame, edges: DataFrame) -> bool:
    return strong_components(vertices, edges).select("component").distinct().count() <= 1


#: Edges up to which betweenness gives every task the graph (8 bytes an edge); larger graphs are searched by joins.
TASK_EDGES = 1 << 23


def _betweenness_of_tasks(begin: DataFrame, e: DataFrame, exact: bool) -> DataFrame:
    """(id, delta): sums over the sources (id) of a task, each searched by itself in arrays of the whole graph; nothing is held for a pair."""
    sc = e.sparkSession.sparkContext
    with tempfile.TemporaryDirectory(prefix="loomgraph-") as folder:
        ids, ends, heads = adjacency(e, folder)
        small = heads.astype(np.int32)  # TASK_EDGES has few enough nodes
    tails = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(ends))
    by_head = np.argsort(small, kind="stable")  # so the predecessors of a node come in order
    graph = sc.broadcast((ids, ends, small, np.searchsorted(small[by_head], np.arange(len(ids) + 1)), tails[by_head]))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        ids, ends, heads, in_ends, preds = graph.value
        n, score = len(ids), np.zeros(len(ids))

        def spread(at, ends, others):
            """(k, other): for the k-th of the nodes each of its neighbours, in order."""
            count = ends[at + 1] - ends[at]
            k = np.repeat(np.arange(len(at)), count)
            return k, others[np.arange(len(k)) + np.repeat(ends[at] - np.cumsum(count) + count, count)]

        def search(source):
            depth, sigma, place = np.full(n, -1, np.int32), np.zeros(n), np.empty(n, np.int64)
            depth[source], sigma[source], levels, level, left = 0, 1, [], np.array([source]), n - 1
            while len(level) and left:
                if not exact and (ends[level + 1] - ends[level]).sum() > 4 * left:  # most are in the level: look from those not yet found
                    rest, src, dst, k = np.flatnonzero(depth < 0), [], [], 0
                    while len(rest):
                        rest = rest[in_ends[rest] + k < in_ends[rest + 1]]
                        if k < 16:
                            p = preds[in_ends[rest] + k]
                            hit = depth[p] == len(levels)
                            src.append(p[hit])
                            dst.append(rest[hit])
                            rest, k = rest[~hit], k + 1
                        else:
                            j, p = spread(rest, in_ends, preds)
                            hit = depth[p] == len(levels)
                            j, first = np.unique(j[hit], return_index=True)
                            src.append(p[hit][first])
                            dst.append(rest[j])
                            rest = rest[:0]
                    src, dst = np.concatenate([level[:0], *src]), np.concatenate([level[:0], *dst])
                    new = np.sort(dst)
                else:
                    j, dst = spread(level, ends, heads)
                    fresh = depth[dst] < 0
                    src, dst = level[j[fresh]], dst[fresh]
                    at = np.arange(len(dst))
                    place[dst[::-1]] = at[::-1]  # the first edge to a node, that of the smallest parent, is written last
                    first = place[dst] == at
                    new = np.sort(dst[first])
                    if exact:
                        np.add.at(sigma, dst, sigma[src])
                    else:
                        src, dst = src[first], dst[first]
                depth[new] = len(levels) + 1
                left -= len(new)
                levels.append((src, dst))
                level = new
            delta = np.zeros(n)
            for src, dst in reversed(levels):
                np.add.at(delta, src, (sigma[src] / sigma[dst] if exact else 1) * (1 + delta[dst]))
            delta[source] = 0
            return delta

        for b in batches:
            own = b.column(0).to_numpy(zero_copy_only=False)
            at = np.searchsorted(ids, own)
            for source in at[(at < n) & (ids[np.minimum(at, n - 1)] == own)].tolist() if n else []:
                score += search(source)
        some = np.flatnonzero(score)
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(score[some])], ["id", "delta"])

    tasks = int(e.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(begin.select(F.col("id").cast("bigint")).repartition(tasks).mapInArrow(run, "id bigint, delta double").groupBy("id").agg(F.sum("delta").alias("delta")))


def betweenness(vertices: DataFrame, edges: DataFrame, exact: bool = False, sources: DataFrame | None = None) -> DataFrame:
    """(id, centrality) over all ordered pairs, divided by (n-1)(n-2).

    For each pair one shortest path counts, the one whose parents are smallest;
    exact shares the pair among all its shortest paths. Up to TASK_EDGES edges
    sources are dealt to tasks, which hold the graph. Beyond, all sources
    advance together by joins: the state is (source, id) pairs, so this is for
    graphs whose square fits the cluster. With `sources` (id) only pairs that
    start there count, scaled up to all: an estimate.
    """
    v = cut(ids(vertices))
    begin = v if sources is None else cut(v.join(sources.select("id").distinct(), "id", "left_semi"))
    n = v.count()
    e = cut(edges.where("src <> dst").select("src", "dst").distinct())
    scores = _betweenness_of_tasks(begin, e, exact) if e.count() <= TASK_EDGES else _betweenness_by_joins(begin, e, exact)
    out = v.withColumn("c", F.lit(0.0)).unionAll(scores)
    by = float((n - 1) * (n - 2)) if n > 2 else 1.0
    by *= 1.0 if sources is None else max(1, begin.count()) / n
    return out.groupBy("id").agg((F.sum("c") / F.lit(by)).alias("centrality"))


def _betweenness_by_joins(begin: DataFrame, e: DataFrame, exact: bool) -> DataFrame:
    """(id, delta) over all sources at once, a row for each pair of a source and a node that it reaches."""
    level = cut(begin.select(F.col("id").alias("s"), "id", F.lit(0).alias("depth"), F.lit(None).cast("bigint").alias("parent"), F.lit(1.0).alias("sigma")))
    seen, depth = level, 0
    while True:
        depth += 1
        step = level.join(e, level["id"] == e["src"]).groupBy("s", "dst").agg(F.min("src").alias("parent"), F.sum("sigma").alias("sigma")).withColumnRenamed("dst", "id")
        level = cut(step.join(seen.select("s", "id"), ["s", "id"], "left_anti").select("s", "id", F.lit(depth).alias("depth"), "parent", "sigma"))
        if level.isEmpty():
            break
        seen = cut(seen.unionAll(level))
    last, scores = depth - 1, None
    flow = seen.limit(0).select("s", "id", F.lit(0.0).alias("delta"))
    for d in range(last, 0, -1):  # what nodes at depth d hand to those before them
        here = seen.where(F.col("depth") == d).join(flow, ["s", "id"], "left").select("s", "id", "parent", "sigma", F.coalesce("delta", F.lit(0.0)).alias("delta"))
        mid = here.where("delta > 0").select("id", "delta")
        scores = mid if scores is None else scores.unionAll(mid)
        if exact:
            above = seen.where(F.col("depth") == d - 1).select("s", F.col("id").alias("src"), F.col("sigma").alias("up"))
            given = here.join(e.withColumnRenamed("dst", "id"), "id").join(above, ["s", "src"]).select("s", F.col("src").alias("id"), (F.col("up") / F.col("sigma") * (1 + F.col("delta"))).alias("delta"))
        else:
            given = here.select("s", F.col("parent").alias("id"), (1 + F.col("delta")).alias("delta"))
        flow = cut(given.groupBy("s", "id").agg(F.sum("delta").alias("delta")))
        scores = cut(scores)
    if scores is None:
        return flow.select("id", "delta")
    return scores.groupBy("id").agg(F.sum("delta").alias("delta"))
