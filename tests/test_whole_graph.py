"""Registered graph queries against plain Python on every NEXT edge of the small tables."""

from collections import Counter, defaultdict

import pytest

from loomgraph import catalog
from loomgraph.graph import PropertyGraph

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def next_edges(spark):
    """(event_id, src, dst) of all events but the last, in order of time."""
    events = sorted((r.ts, r.event_id, r.user_id) for r in spark.read.parquet(f"{SF}/events.parquet").collect())
    return [(e, a, b) for (_, e, a), (_, _, b) in zip(events, events[1:], strict=False)]


def got(spark, name):
    return sorted(tuple(r) for r in catalog.QUERIES[name](spark, SF).collect())


def levels(pairs, start=0):
    """Depth of what a start reaches by edges (src, dst)."""
    depth, level = {start: 0}, {start}
    while level:
        level = {b for a, b in pairs if a in level} - set(depth)
        depth |= {b: max(depth.values()) + 1 for b in level}
    return depth


def test_paths_use_every_edge(spark, next_edges):
    pairs = {(a, b) for _, a, b in next_edges}
    both = pairs | {(b, a) for a, b in pairs}
    assert len(pairs) > len({(a, b) for e, a, b in next_edges if e % 40 == 0})
    depth = levels(pairs)
    again = min((depth[a] + 1 for a, b in pairs if b == 0 and a in depth), default=0)
    assert got(spark, "var_length_hops") == sorted((u,) for u, d in {**depth, 0: again}.items() if 2 <= d <= 4)
    assert got(spark, "bfs_depths") == sorted(depth.items())
    assert got(spark, "undirected_bfs") == sorted((u, d) for u, d in levels(both).items() if d <= 3)
    many, paths = Counter((a, b) for _, a, b in next_edges), {0: 1}
    for u in sorted(depth, key=depth.get):
        if u:
            paths[u] = sum(paths[a] * n for (a, b), n in many.items() if b == u and depth.get(a) == depth[u] - 1)
    assert got(spark, "shortest_path_counts") == sorted((u, depth[u], n) for u, n in paths.items() if u)
    assert got(spark, "cheapest_costs") == sorted((u, float(d)) for u, d in depth.items())
    after, found, level = defaultdict(set), [], [[0]]
    for a, b in pairs:
        after[a].add(b)
    for n in range(1, 5):
        level = [[*p, b] for p in level for b in after[p[-1]] if b not in p]
        found += level if n >= 2 else []
    by_end = defaultdict(list)
    for p in found:
        by_end[p[-1], len(p) - 1].append(p[1])
    assert got(spark, "simple_paths") == sorted((*k, len(v), sum(v)) for k, v in by_end.items())


def test_algorithms_use_every_edge(spark, next_edges):
    pairs = {(a, b) for _, a, b in next_edges}
    both = pairs | {(b, a) for a, b in pairs}
    users = {r.user_id for r in spark.read.parquet(f"{SF}/events.parquet").collect()}
    reach, weak = {u: set(levels(pairs, u)) for u in users}, {u: min(levels(both, u)) for u in users}
    strong = {u: min(w for w in reach[u] if u in reach[w]) for u in users}
    assert got(spark, "components") == sorted(weak.items())
    assert got(spark, "strong_components") == sorted(strong.items())
    assert got(spark, "strong_component_sizes") == sorted(Counter(Counter(strong.values()).values()).items())
    near = {u: {b for a, b in both if a == u != b} for u in users}
    tri = {(a, b, c) for a in users for b in near[a] for c in near[a] & near[b] if a < b < c}
    assert got(spark, "triangles") == sorted(tri)
    k = {u: len(near[u]) for u in users}
    assert got(spark, "clustering") == sorted((u, round(sum(u in t for t in tri) * 2 / (k[u] * (k[u] - 1)), 9) if k[u] > 1 else 0.0) for u in users)
    score, n = Counter(), len(users)
    for s in users:
        depth = levels(pairs, s)
        parent = {u: min(a for a, b in pairs if b == u and depth.get(a) == d - 1) for u, d in depth.items() if d}
        for x in parent:
            while (x := parent[x]) != s:
                score[x] += 1
    assert got(spark, "betweenness") == sorted((u, round(score[u] / ((n - 1) * (n - 2)), 9)) for u in users)


def test_patterns_and_unions_take_every_id(spark, next_edges):
    after = defaultdict(set)
    for _, a, b in next_edges:
        after[a].add(b)
    assert got(spark, "var_length_all_starts") == sorted((a, len(bs | {c for b in bs for c in after[b]})) for a, bs in after.items())
    pairs = Counter((a, b) for (e, a, b) in next_edges for (f, c, d) in next_edges if (c, d) == (b, a) and e != f)
    assert got(spark, "cyclic_pattern") == sorted((a, b, n) for (a, b), n in pairs.items())
    nations = [r[0] for t, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey")) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(c).collect()]
    assert got(spark, "union_all") == sorted((n,) for n in nations)


def chain(spark, n):
    """n users, each followed by the next."""
    at = catalog.USER
    return PropertyGraph.of(spark, [(at + k, "User", {"user_id": k}) for k in range(n)], [(k, at + k, at + k + 1, "NEXT", {}) for k in range(n - 1)])


def test_paths_have_no_last_depth(spark, monkeypatch):
    g = chain(spark, 16)
    monkeypatch.setattr(catalog, "_users", lambda spark, sf: g)
    assert got(spark, "bfs_depths") == [(k, k) for k in range(16)]
    assert got(spark, "shortest_path_counts") == [(k, k, 1) for k in range(1, 16)]
    assert got(spark, "cheapest_costs") == [(k, float(k)) for k in range(16)]


def test_labels_move_on_after_four_rounds(spark, monkeypatch):
    g, n = chain(spark, 16), 16
    monkeypatch.setattr(catalog, "_users", lambda spark, sf: g)
    label, rounds = list(range(n)), []
    for _ in range(10):
        votes = [Counter(label[k] for k in (u - 1, u + 1) if 0 <= k < n) for u in range(n)]
        label = [min(v, key=lambda c: (-v[c], c)) for v in votes]
        rounds.append(label)
    assert rounds[3] != rounds[9]
    assert got(spark, "label_propagation") == list(enumerate(rounds[9]))
