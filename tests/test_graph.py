import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomgraph.graph import PropertyGraph
from loomgraph.functions import scalar
from loomgraph.operators import algorithms, mutate, paths, search, stars
from loomgraph.operators.constraints import Constraints
from loomgraph.operators.indexes import Indexes
from loomgraph.operators.nodeset import NodeSet, QueryBuilder
from loomgraph.plans import lineage
from loomgraph.plans.cypher import cypher
from loomgraph.plans.parser import CypherError, parse
from loomgraph.session import Session, Store
from loomgraph.sinks import export
from loomgraph.sources.star_schema import parquet_graph, write_parquet
from loomgraph.streaming import pages

PEOPLE = [("Ada", 41, "Oslo"), ("Bo", 19, "Rome"), ("Cem", 52, "Oslo"), ("Dina", 33, "Lima"), ("Eli", 27, None), ("Fay", 60, "Rome"), ("Gus", 33, "Oslo")]
KNOWS = [(0, 1, {"since": 2019}), (1, 2, {}), (2, 3, {}), (0, 3, {}), (3, 4, {}), (0, 1, {"since": 2021})]


@pytest.fixture(scope="module")
def users(spark):
    nodes = [(k, "User", {"name": n, "age": a, **({"city": c} if c else {})}) for k, (n, a, c) in enumerate(PEOPLE)]
    return PropertyGraph.of(spark, nodes, [(k, a, b, "KNOWS", p) for k, (a, b, p) in enumerate(KNOWS)] + [(6, 5, 5, "LIKES", {}), (7, 6, 0, "LIKES", {})])


def rows(graph, text, **k):
    return sorted([tuple(r) for r in cypher(graph, text, **k).collect()], key=repr)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("MATCH (u:User) WHERE u.name =~ '^[AB]' RETURN u.name", [("Ada",), ("Bo",)]),
        ("MATCH (u:User) WHERE u.name =~ '[' RETURN u.name", []),
        ("MATCH (u:User) WHERE u.city IS NULL RETURN u.name", [("Eli",)]),
        ("MATCH (u:User) WHERE EXISTS(u.city) AND (u.age > 50 OR u.city = 'Lima') RETURN u.name", [("Cem",), ("Dina",), ("Fay",)]),
        ("MATCH (u:User) WHERE u.city <> 'Oslo' RETURN u.name", [("Bo",), ("Dina",), ("Fay",)]),
        ("MATCH (u:User) WHERE u.age != 33 AND u.age IN [19, 33, 60] RETURN u.name", [("Bo",), ("Fay",)]),
        ("MATCH (a:User)-[:KNOWS]->(b) WHERE a.name = 'Ada' RETURN b.name", [("Bo",), ("Bo",), ("Dina",)]),
        ("MATCH (a:User {name: 'Ada'})-[r:KNOWS {since: 2021}]->(b:User) RETURN b.name, r.since", [("Bo", 2021)]),
        ("MATCH (a)-->(a) RETURN a.name", [("Fay",)]),
        ("MATCH (a:User {name: 'Dina'})<-[:KNOWS]-(b)<-[:KNOWS]-(c) RETURN c.name, b.name", [("Bo", "Cem")]),
        ("MATCH (a:User {name: 'Ada'})-[:KNOWS*2..2]->(b) RETURN b.name", [("Cem",), ("Eli",)]),
        ("MATCH (a:User {name: 'Ada'})-[:KNOWS*]->(b) RETURN b.name", [("Bo",), ("Cem",), ("Dina",), ("Eli",)]),
        ("MATCH (a:User {name: 'Dina'})-[:KNOWS*1..2]-(b) RETURN b.name", [("Ada",), ("Bo",), ("Cem",), ("Dina",), ("Eli",)]),
        ("MATCH (a:User) OPTIONAL MATCH (a)-[:KNOWS]->(b:User) WHERE b.age > 30 RETURN a.name AS a, b.name AS b ORDER BY a LIMIT 4", [("Ada", "Dina"), ("Bo", "Cem"), ("Cem", "Dina"), ("Dina", None)]),
        ("MATCH (a:User) WITH a, a.age AS age OPTIONAL MATCH (a)-[:KNOWS]->(b) WHERE b.age < age RETURN a.name AS a, b.name AS b ORDER BY a LIMIT 4", [("Ada", "Bo"), ("Ada", "Bo"), ("Ada", "Dina"), ("Bo", None)]),
        ("MATCH (a:User {city: 'Oslo'}), (c:User {city: 'Lima'}) OPTIONAL MATCH (a)-[r:KNOWS]->(b) WHERE b.name = c.name RETURN a.name AS a, b.name AS b", [("Ada", "Dina"), ("Cem", "Dina"), ("Gus", None)]),
        ("MATCH (u:User) RETURN u.city AS c, COUNT(*) AS n GROUP BY u.city", [("Lima", 1), ("Oslo", 3), ("Rome", 2), (None, 1)]),
        ("MATCH (u:User) RETURN u.city AS c, u.name AS first, COUNT(*) AS n GROUP BY u.city", [("Lima", "Dina", 1), ("Oslo", "Ada", 3), ("Rome", "Bo", 2), (None, "Eli", 1)]),
        ("MATCH (u:User) WITH u.city AS c, MAX(u.age) AS top WHERE top > 52 RETURN c, top", [("Rome", 60)]),
        ("MATCH (u:Nobody) RETURN COUNT(*)", []),
        ("MATCH (u:User) RETURN COUNT(u), COUNT(u.city), SUM(u.age)", [(7, 6, 265)]),
        ("MATCH (u:User) RETURN u.city AS c ORDER BY c DESC SKIP 5", [("Lima",), (None,)]),
        ("MATCH (u:User) WHERE u.age < 30 RETURN u.city AS x UNION MATCH (u:User) WHERE u.city = 'Rome' RETURN u.city AS x", [("Rome",), (None,)]),
        ("MATCH (u:User) RETURN u.city AS x INTERSECT ALL MATCH (u:User) WHERE u.age > 40 RETURN u.city AS x", [("Oslo",), ("Oslo",), ("Rome",)]),
        ("MATCH (u:User) RETURN u.city AS x EXCEPT MATCH (u:User) WHERE u.age > 40 RETURN u.city AS x", [("Lima",), (None,)]),
        ("CALL { MATCH (u:User) RETURN u.age AS age } RETURN MIN(age) AS low", [(19,)]),
        ("MATCH (n) WHERE id(n) = 3 RETURN labels(n), n.name", [(["User"], "Dina")]),
    ],
)
def test_cypher(users, text, want):
    assert rows(users, text) == sorted(want, key=repr)


def test_reference_nulls(users):
    assert rows(users, "MATCH (u:User) WHERE u.city <> 'Oslo' RETURN u.name", null_semantics="reference") == [("Bo",), ("Dina",), ("Eli",), ("Fay",)]


def test_column_names_and_whole_nodes(users):
    df = cypher(users, "MATCH (u:User) RETURN u.city, COUNT(*), AVG(u.age)")
    assert df.columns == ["u.city", "count", "avg(u.age)"]
    assert cypher(users, "MATCH (u:User {name: 'Bo'}) RETURN u").first().u.age == 19


@pytest.mark.parametrize("text", ["MATCH (a", "RETURN", "MATCH (a) RETURN b.x", "MATCH (a) RETURN nosuch(a.x)", "MATCH (a:User) RETURN PERCENTILECONT(a.age, 2)", "MATCH (a)<-[:X]->(b) RETURN a", "MATCH (a:User) RETURN a §"])
def test_errors(users, text):
    with pytest.raises(CypherError):
        cypher(users, text)


def test_parse_lengths():
    spans = [parse(f"MATCH (a)-[:T{s}]->(b) RETURN a").clauses[0].body[0].rels[0].span for s in ("", "*", "*3", "*2..4", "*..4", "*2..")]
    assert spans == [None, (1, None), (1, 3), (2, 4), (1, 4), (2, None)]


def test_numbers(spark):
    g = PropertyGraph.of(spark, [(k, "N", {"v": v, "g": c}) for k, (v, c) in enumerate([(x, "A") for x in range(1, 6)] + [(x, "B") for x in range(10, 16)])])
    assert rows(g, "MATCH (n:N) RETURN n.g AS g, PERCENTILECONT(n.v, 0.5) AS m") == [("A", 3.0), ("B", 12.5)]
    assert rows(g, "MATCH (n:N) WHERE n.g = 'A' RETURN PERCENTILEDISC(n.v, 0.6)") == [(3.0,)]
    assert abs(cypher(g, "MATCH (n:N) WHERE n.g = 'A' RETURN STDEV(n.v) AS s").first().s - 2**0.5) < 1e-9
    assert rows(g, "MATCH (n:N) WHERE n.v = 1 RETURN STDEV(n.v)") == [(None,)]
    s = NodeSet.label(g, "N").where("g = 'A'")
    assert (s.count(), s.sum_int("v"), s.avg_int("v"), s.variance("v"), s.percentile_cont("v", 2)) == (5, 15, 3.0, 2.5, None)
    assert abs(s.stdev("v") - 2.5**0.5) < 1e-9


def test_fluent(users):
    s = NodeSet.label(users, "User")
    names = lambda x: [r.name for r in x.df.select("name").collect()]
    assert names(s.order_by("city", False).order_by("age").limit(2)) == ["Bo", "Eli"]
    assert sorted(names(s.prop_eq("name", "Ada").out("KNOWS"))) == ["Bo", "Bo", "Dina"]
    assert sorted(names(s.prop_eq("name", "Ada").both("KNOWS", "LIKES"))) == ["Bo", "Dina", "Gus"]
    assert sorted(names(s.int_gt("age", 50))) == ["Cem", "Fay"] and names(s.prop_eq("age", "41")) == []
    assert sorted(names(s.int_eq("age", 27).hops("KNOWS", low=2, direction="in"))) == ["Ada", "Bo", "Cem"]
    assert names(s.order_by("age").paginate(10, 5)) == []


def random_graph(spark, n, m, seed):
    rng = random.Random(seed)
    e = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    return e, spark.createDataFrame([(k,) for k in range(n)], "id bigint"), spark.createDataFrame(e, "src bigint, dst bigint")


def test_paths(spark):
    e, _, df = random_graph(spark, 12, 26, 1)
    ahead = defaultdict(set)
    for a, b in e:
        ahead[a].add(b)
    depth, level = {0: 0}, [0]
    while level:
        level = sorted({y for x in level for y in ahead[x] if y not in depth})
        depth |= {y: depth[next(p for p in depth if y in ahead[p] and depth[p] == max(depth.values()))] + 1 for y in level} if level else {}
    got = {r.id: r.depth for r in paths.bfs(df, 0).collect()}
    assert got == depth
    order = paths.dfs(df, 0)
    assert set(order) == set(depth) and order[0] == 0 and len(order) == len(set(order))
    for goal in range(12):
        p = paths.shortest_path(df, 0, goal)
        assert (p is None) == (goal not in depth) and (p is None or len(p) == depth[goal] + 1)
        assert paths.has_path(df, 0, goal) == (goal in depth)
    far = max(depth, key=depth.get)
    every = [r.nodes for r in paths.all_shortest(df, 0, far).collect()]
    assert len(every) == paths.count_shortest(df, 0, far) and all(len(p) == depth[far] + 1 and all(y in ahead[x] for x, y in zip(p, p[1:], strict=False)) for p in every)

    def simple(path, most):
        if len(path) > 1:
            yield tuple(path)
        if len(path) <= most:
            for y in ahead[path[-1]] - set(path):
                yield from simple([*path, y], most)

    want = sorted(p for p in set(simple([0], 3)) if len(p) >= 2)
    assert sorted(tuple(r.nodes) for r in paths.simple_paths(df, 0, None, 1, 3).collect()) == want
    assert sorted(tuple(r.nodes) for r in paths.simple_paths(df, 0, far, 1, 3).collect()) == [p for p in want if p[-1] == far]


def test_weighted_paths(spark):
    e = spark.createDataFrame([(0, 1, 5.0), (0, 2, 1.0), (2, 1, 1.0), (1, 3, 1.0)], "src bigint, dst bigint, km double")
    assert paths.cheapest_path(e, 0, 3, "km") == ([0, 2, 1, 3], 3.0) and paths.cheapest_path(e, 3, 0) is None
    at = spark.createDataFrame([(0, 0, 0), (1, 10, 0), (2, 10, 10)], "id bigint, x bigint, y bigint")
    road = spark.createDataFrame([(0, 1), (1, 2)], "src bigint, dst bigint")
    assert paths.a_star(road, 2, 0, at) == ([2, 1, 0], 20.0)
    assert paths.a_star(road, 0, 2, at, "manhattan", directed=True) == ([0, 1, 2], 20.0) and paths.a_star(road, 2, 0, at, directed=True) is None


def test_diamond(spark):
    g = PropertyGraph.of(spark, [(k, "Node", {}) for k in range(4)], [(k, a, b, "EDGE", {}) for k, (a, b) in enumerate([(0, 1), (0, 2), (1, 3), (2, 3)])])
    found = paths.all_shortest(g.edges(), 0, 3)
    assert sorted(r.nodes for r in found.collect()) == [[0, 1, 3], [0, 2, 3]]
    assert sorted(r.rels for r in paths.hydrate(g, found).collect()) == [[0, 2], [1, 3]]


@pytest.mark.parametrize("seed", [1, 2])
def test_algorithms_against_plain_python(spark, seed):
    n = 14
    e, v, df = random_graph(spark, n, 22, seed)
    reach = {a: {a} for a in range(n)}
    for _ in range(n):
        for a in range(n):
            reach[a] |= {y for x in reach[a] for s, y in e if s == x}
    got = {r.id: r.component for r in algorithms.strong_components(v, df).collect()}
    assert got == {a: min(b for b in reach[a] if a in reach[b]) for a in range(n)}
    deg = [0] * n
    alive, core, k = set(range(n)), {}, 0
    while alive:
        for a in range(n):
            deg[a] = sum((x == a) + (y == a) for x, y in e if x in alive and y in alive)
        k = max(k, min(deg[a] for a in alive))
        for a in [a for a in alive if deg[a] <= k]:
            core[a] = k
            alive.discard(a)
    assert {r.id: r.core for r in algorithms.k_core(v, df).collect()} == core
    near = {a: {y for x, y in e if x == a and y != a} | {x for x, y in e if y == a and x != a} for a in range(n)}
    tri = {(a, b, c) for a in range(n) for b in near[a] for c in near[a] & near[b] if a < b < c}
    assert {tuple(sorted((r.a, r.b, r.c))) for r in algorithms.triangles(df).collect()} == tri and algorithms.triangle_count(df) == len(tri)
    assert {r.id: r.triangles for r in algorithms.node_triangles(v, df).collect()} == {a: sum(a in t for t in tri) for a in range(n)}
    ranks = {r.id: r["rank"] for r in algorithms.pagerank(v, df, iterations=7).collect()}
    r = [1 / n] * n
    for _ in range(7):
        r = [0.15 / n + 0.85 * sum(r[x] / sum(s == x for s, _ in e) for x, y in e if y == a) for a in range(n)]
    assert all(abs(ranks[a] - r[a] / sum(r)) < 1e-9 for a in range(n))
    score = [0.0] * n
    for s in range(n):
        depth, parent, level = {s: 0}, {}, [s]
        while level:
            new = sorted({y for x in level for a, y in e if a == x and y not in depth})
            for y in new:
                parent[y] = min(x for x in level if (x, y) in e)
            depth |= {y: depth[parent[y]] + 1 for y in new}
            level = new
        for t in parent:
            x = parent[t]
            while x != s:
                score[x] += 1
                x = parent[x]
    got = {r.id: r.centrality for r in algorithms.betweenness(v, df).collect()}
    assert all(abs(got[a] - score[a] / ((n - 1) * (n - 2))) < 1e-9 for a in range(n))


def test_exact_betweenness_and_edge_cases(spark):
    e = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (2, 3)], "src bigint, dst bigint")
    v = spark.createDataFrame([(k,) for k in range(5)], "id bigint")
    assert {r.id: round(r.centrality * 12, 6) for r in algorithms.betweenness(v, e, exact=True).collect()} == {0: 0, 1: 0.5, 2: 0.5, 3: 0, 4: 0}
    none = e.limit(0)
    assert {r.component for r in algorithms.components(v, none).collect()} == set(range(5))
    assert algorithms.mean_clustering(v, none) == 0 and algorithms.triangle_count(none) == 0
    assert algorithms.k_core(v, none).agg(F.max("core")).first()[0] == 0
    assert algorithms.pagerank(v.limit(0), none).count() == 0 and algorithms.strong_components(v.limit(0), none).count() == 0
    two = spark.createDataFrame([(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)], "src bigint, dst bigint")
    lab = {r.id: r.community for r in algorithms.label_propagation(spark.range(6), two).collect()}
    assert len(lab) == 6
    assert algorithms.is_strongly_connected(spark.range(3), spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "src bigint, dst bigint"))


def test_search(users):
    texts = users.spark.createDataFrame([(0, "Software Engineer, C++"), (1, "data scientist"), (2, "machine-learning engineer"), (3, None)], "id bigint, bio string")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(search.full_text(texts, "bio", "engineer DATA")) == [0, 1, 2]
    assert ids(search.full_text(texts, "bio", "engineer c", every=True)) == [0] and ids(search.full_text(texts, "bio", " ", every=True)) == []
    assert tuple(search.term_stats(search.inverted(texts, "bio")).first()) == (6, 3)
    u = users.label("User")
    assert ids(search.greater_than(u, "age", 52)) == [5] and ids(search.greater_or_equal(u, "age", 52)) == [2, 5] and ids(search.less_than(u, "age", 27)) == [1]
    assert ids(search.composite(u, ["city", "age"], ["Rome", 19])) == [1] and ids(search.composite(u, ["city", "age"], ["Oslo"])) == [0, 2, 6]
    assert ids(search.composite_range(u, ["city", "age"], ["Lima", 40], ["Oslo", 41])) == [0, 6]
    assert tuple(search.index_stats(u, ["city"]).first()) == (6, 3, 0.5, 2.0)
    assert ids(search.keyword(users.nodes(), "aDa")) == [0] and len(ids(search.keyword(users.nodes(), "USER"))) == 7


def test_changes(users):
    s = Session(users)
    assert s.run("CREATE (x:City {name: 'Turin'})<-[:IN {since: 5}]-(y:User {name: 'Hal'})").counts == {"nodes_created": 2, "relationships_created": 1}
    assert rows(s.graph, "MATCH (u:User)-[r:IN]->(c:City) RETURN u.name, r.since, c.name") == [("Hal", 5, "Turin")]
    assert s.run("MATCH (u:User) WHERE u.city = 'Rome' SET u.city = 'Pisa', u.tall = true").counts == {"properties_set_on": 2}
    assert rows(s.graph, "MATCH (u:User) WHERE u.city = 'Pisa' RETURN u.name, u.tall") == [("Bo", True), ("Fay", True)]
    assert s.run("MATCH (u:User {name: 'Ada'}) DELETE u").counts == {"nodes_deleted": 1, "relationships_deleted": 4}
    assert users.nodes().count() == 7  # the version before is untouched
    assert s.run("FOREACH (i IN [1, 2, 99] | SET i.age = 1)").counts == {"properties_set_on": 2}
    assert rows(s.graph, "MATCH (u:User) WHERE u.age = 1 RETURN u.name") == [("Bo",), ("Cem",)]
    assert s.run("MATCH (u:User)-[r:KNOWS]->(v) DELETE r").counts["relationships_deleted"] == 3


def test_merge(users):
    s = Session(users)
    s.run("MERGE (u:User {name: 'Bo'}) ON MATCH SET u.seen = 1 ON CREATE SET u.seen = 2")
    s.run("MERGE (u:User {name: 'Zed'}) ON MATCH SET u.seen = 1 ON CREATE SET u.seen = 2")
    assert rows(s.graph, "MATCH (u:User) WHERE u.seen IS NOT NULL RETURN u.name, u.seen") == [("Bo", 1), ("Zed", 2)]
    before = s.graph.nodes().count()
    s.run("MERGE (a:User {name: 'Ada'})-[:KNOWS]->(b:User {name: 'Bo'})")
    assert s.graph.nodes().count() == before
    s.run("MERGE (a:User {name: 'Bo'})-[:KNOWS]->(b:User {name: 'Eli'})")
    assert s.graph.nodes().count() == before + 1  # a missing relationship gets its end anew
    assert rows(s.graph, "MATCH (a:User {name: 'Bo'})-[:KNOWS]->(b) RETURN b.name") == [("Cem",), ("Eli",)]


def test_transactions(users):
    s = Session(users)
    s.run("BEGIN TRANSACTION")
    s.run("CREATE (a:Tmp)")
    s.savepoint("one")
    s.run("CREATE (a:Tmp)")
    s.rollback_to("one")
    assert rows(s.graph, "MATCH (t:Tmp) RETURN COUNT(*)") == [(1,)]
    s.run("COMMIT")
    s.run("BEGIN")
    s.run("MATCH (t:Tmp) DELETE t")
    s.run("ROLLBACK")
    assert rows(s.graph, "MATCH (t:Tmp) RETURN COUNT(*)") == [(1,)]
    with pytest.raises(CypherError):
        s.run("COMMIT")
    late = Session(users, timeout=-1)
    late.begin()
    with pytest.raises(CypherError):
        late.commit()


def test_constraints(users):
    c = Constraints()
    c.add("unique", "User", "city")
    c.add("exists", "User", "city")
    bad = c.violations(users)
    assert sorted((r.kind, r.id) for r in bad.collect()) == [("exists", 4), ("unique", 0), ("unique", 1), ("unique", 2), ("unique", 5), ("unique", 6)]
    with pytest.raises(ValueError):
        c.add("unique", "User", "city")
    c.drop("unique", "User", "city")
    c.drop("exists", "User", "city")
    c.add("unique", "User", "name")
    s = Session(users, constraints=c)
    with pytest.raises(ValueError):
        s.run("CREATE (u:User {name: 'Bo'})")
    assert s.graph.nodes().count() == 7


def test_api_changes(users):
    g, ids = mutate.create_nodes(users, ["User", "Admin"], [{"name": "Root"}, {"name": "Two", "age": 3}])
    assert ids == [7, 8] and sorted(r.id for r in g.label("Admin", "User").collect()) == [7, 8] and g.labels() == ["Admin", "User"]
    g, ids = mutate.create_rels(g, "OWNS", [(7, 8, {"w": 1.5})], enforce=True)
    assert ids == [8] and tuple(g.neighbors(8).first()) == ([], [7])
    with pytest.raises(ValueError):
        mutate.create_rels(g, "OWNS", [(6, 70, {})], enforce=True)
    assert mutate.delete_rels(g, users.spark.createDataFrame([(8,)], "id bigint"), ("OWNS",)).rels().count() == 8
    assert {(r.kind, r.name): r.n for r in g.stats().collect()}[("label", "User")] == 9


def test_delivery(users, tmp_path):
    df = users.spark.range(25).withColumn("v", F.col("id") * 2)
    p = pages.page(df, 2, 10)
    assert ([r.id for r in p.rows], p.pages, p.has_more) == ([20, 21, 22, 23, 24], 3, False) and pages.page(df, 9, 10).rows == []
    c, seen = pages.Cursor(df, 10), []
    while c.has_more:
        seen += [r.id for r in c.next_page()]
    assert seen == list(range(25)) and c.position == 25 and c.next_page() == []
    c.reset()
    assert len(c.next_page()) == 10
    b = pages.Batches(df, 7)
    assert [len(x) for x in b] == [7, 7, 7, 4] and b.progress == 100 and b.throughput > 0
    got = []
    w = pages.BatchProcessor(2, got.append)
    assert [w.add(1), w.add(2), w.add(3)] == [False, True, False]
    w.flush()
    assert got == [[1, 2], [3]]
    write_parquet(users, str(tmp_path / "g"))
    assert rows(parquet_graph(users.spark, str(tmp_path / "g")), "MATCH (a:User)-[:KNOWS]->(b) RETURN COUNT(*)") == [(6,)]


def test_streams(spark, tmp_path):
    events = pages.event_stream(spark, "/root/testdata/sf0.001")
    pages.ingest(events, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert spark.read.parquet(str(tmp_path / "out")).count() == table.count()
    q = pages.windowed_events(events, late="1 hour").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").count() == pages.windowed_events(table).count()


def test_export(users):
    n, e = export.view(users, users.spark.createDataFrame([(0,), (1,)], "id bigint"))
    dot = export.to_dot(n, e)
    assert dot.startswith("digraph") and dot.count("->") == 2 and '[label="Ada"]' in dot
    import json

    doc = json.loads(export.to_json(n, e))
    assert len(doc["nodes"]) == 2 and len(doc["edges"]) == 2
    assert {r.id: r.layer for r in export.layers(users).collect()} == {6: 0, 0: 1, 1: 2, 3: 2, 2: 3, 4: 3, 5: 0}
    assert export.circle(users.nodes()).count() == 7 and export.hierarchical(users).count() == 7
    at = [tuple(r) for r in export.force_directed(users).collect()]
    assert at == [tuple(r) for r in export.force_directed(users).collect()] and len(at) == 7 and all(0 <= x <= 1000 for _, *p in at for x in p)
    with pytest.raises(ValueError):
        export.force_directed(users, most=6)
    with pytest.raises(ValueError):
        export.to_json(n, e, most=3)


def test_merge_after_a_match(users):
    s = Session(users)
    assert s.run("MATCH (a:User {name: 'Ada'}) MERGE (a)-[:LIVES]->(y:Town {name: 'Ys'})").counts == {"nodes_created": 1, "relationships_created": 1}
    assert rows(s.graph, "MATCH (a)-[:LIVES]->(t:Town) RETURN a.name, t.name") == [("Ada", "Ys")]
    s.run("MATCH (a:User) WHERE a.age > 40 MERGE (a)-[:LIVES]->(t:Town {name: 'Ys'}) ON CREATE SET t.n = 1 ON MATCH SET t.n = 2")
    assert rows(s.graph, "MATCH (a)-[:LIVES]->(t:Town) RETURN a.name, t.n") == [("Ada", 2), ("Cem", 1), ("Fay", 1)]
    for w in (5, 6):
        s.run(f"MATCH (a:User {{name: 'Gus'}}), (b:User {{name: 'Eli'}}) MERGE (a)-[r:KNOWS]->(b) ON CREATE SET r.w = {w} ON MATCH SET r.again = {w}")
    assert rows(s.graph, "MATCH (a:User {name: 'Gus'})-[r:KNOWS]->(b) RETURN b.name, r.w, r.again") == [("Eli", 5, 6)]
    one = Session(users)
    assert one.run("MERGE (x:User)-[:LIVES]->(y:Town {name: 'Ur'})").counts == {"nodes_created": 1, "relationships_created": 1}
    assert rows(one.graph, "MATCH (a)-[:LIVES]->(t) RETURN a.name, t.name") == [("Ada", "Ur")]
    chain = Session(users)
    before = chain.graph.nodes().count()
    chain.run("MERGE (x:User {name: 'Fay'})-[:KNOWS]->(y:User {name: 'Gus'})-[:LIVES]->(z:Town {name: 'Ur'})")
    assert chain.graph.nodes().count() == before + 1 and rows(chain.graph, "MATCH (a)-[:KNOWS]->(b)-[:LIVES]->(c) RETURN a.name, b.name, c.name") == [("Fay", "Gus", "Ur")]


def test_cursor_keeps_ties_and_nulls(spark):
    for keys in ([1, 2, 2, 2, 3], [None, None, None, 1, 2], [5] * 7, [], [None]):
        df = spark.createDataFrame([(k, f"r{n}") for n, k in enumerate(keys)], "k int, name string").repartition(3)
        for size in (1, 2, 3, 10):
            c, seen = pages.Cursor(df, size, "k"), []
            while c.has_more:
                seen += [tuple(r) for r in c.next_page()]
            assert sorted(seen, key=repr) == sorted([(k, f"r{n}") for n, k in enumerate(keys)], key=repr)
            assert [k for k, _ in seen] == sorted(keys, key=lambda k: (k is None, k or 0)) and c.position == len(keys)


def test_item_streams_and_backpressure(users):
    stream = pages.ItemStream(users.label("User"), pages.rel_stream(users, ("KNOWS",), "since", 2021), 3)
    items = list(stream)
    assert [k for k, _ in items] == ["node"] * 3 + ["batch_end"] + ["node"] * 3 + ["batch_end", "node", "rel", "batch_end"] and items[-1][1] == 8 and stream.progress == 100
    got = []
    assert stream.for_each(lambda k, r: got.append((k, r.id)), "rel") == 1 and got == [("rel", 5)] and len(stream.collect("node")) == 7
    assert list(pages.ItemStream()) == [("batch_end", 0)]
    p, seen = pages.Backpressure(4, 2, 2), []
    assert p.run(range(11), seen.extend) == 11 and sorted(seen) == list(range(11))
    assert p.try_acquire() and p.try_acquire() and not p.try_acquire()
    p.release()
    with pytest.raises(ZeroDivisionError):
        pages.Backpressure().run([1], lambda x: 1 / 0)


def test_indexes(users, tmp_path):
    ix = Indexes(users, str(tmp_path))
    ix.create("User", "city", "age")
    ix.create("User", "age")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(ix.find("User", {"city": "Oslo"})) == [0, 2, 6] and ids(ix.find("User", {"city": "Oslo", "age": 33})) == [6]
    assert ids(ix.find("User", {"age": 33, "city": "Lima"})) == [3] and ids(ix.find("User", {"name": "Bo"})) == [1]
    assert [x.columns for x in ix.usable("User", ["city", "age"])] == [("city", "age")] and not ix.usable("User", ["name"]) and not ix.usable("Town", ["age"])
    assert ix.should_index("User", "age") and not ix.should_index("User", "name")
    ix.remove(users.spark.createDataFrame([(0,)], "id bigint"), "User")
    ix.add(users.spark.createDataFrame([(70, "Oslo", 9)], "id bigint, city string, age bigint"), "User")
    ix.add(users.spark.createDataFrame([(71, "no other property")], "id bigint, name string"), "User")
    for _ in range(2):
        assert ids(ix.find("User", {"city": "Oslo"})) == [2, 6, 70] and ids(ix.find_range("User", ["city", "age"], ["Oslo", 9], ["Oslo", 40])) == [6, 70]
        ix.rebuild("User", "city", "age")
    assert tuple(ix.stats("User", "city", "age").first())[:2] == (6, 6) and ix.all_stats().count() == 2
    with pytest.raises(ValueError):
        ix.create("User", "age")
    ix.drop("User", "age")
    with pytest.raises(ValueError):
        ix.drop("User", "age")
    ix.clear()
    assert ix.catalog().count() == 0 and ids(ix.find("User", {"city": "Oslo"})) == [0, 2, 6]


@pytest.mark.parametrize(("level", "wins"), [("read_committed", True), ("repeatable_read", False), ("serializable", False)])
def test_isolation(users, level, wins):
    store = Store(users)
    a, b = Session(store, timeout=3600), Session(store, timeout=3600)
    b.begin(level)
    b.run("MATCH (u:User {name: 'Bo'}) SET u.age = 1")
    a.run("MATCH (u:User {name: 'Ada'}) SET u.age = 2")
    assert rows(b.graph, "MATCH (u:User {name: 'Ada'}) RETURN u.age") == [(41,)]  # own changes stand on the version that was read
    if wins:
        b.commit()
    else:
        with pytest.raises(CypherError):
            b.commit()
    got = a.run("MATCH (u:User) WHERE u.age < 3 RETURN u.name AS name").df.collect()
    assert sorted(r.name for r in got) == (["Ada", "Bo"] if wins else ["Ada"])
    b.begin(level)
    a.run("MATCH (u:User {name: 'Cem'}) SET u.age = 0")
    seen = b.run("MATCH (u:User) WHERE u.age = 0 RETURN u.name AS name").df.count()
    assert seen == (1 if wins else 0)
    if level == "serializable":
        with pytest.raises(CypherError):
            b.commit()
    else:
        b.commit()


def test_nested_transactions_and_cleanup(users):
    s = Session(users, timeout=3600)
    s.begin()
    s.run("CREATE (a:Tmp)")
    s.begin()
    s.run("CREATE (a:Tmp)")
    s.commit()
    assert s.transactions[0].ops == ["CREATE (a:Tmp)"] * 2 and s.store.version == 0
    s.rollback()
    assert rows(s.graph, "MATCH (t:Tmp) RETURN COUNT(*)") == []
    assert s.cleanup(keep_last=1) == 1 and len(s.transactions) == 1 and s.begin() == s.transactions[0].id + 1
    s.timeout = -1
    assert s.expire() == 1 and s.transactions[-1].state == "expired"


def test_path_builder(users):
    q = paths.PathQuery(users, 0).to(4).via("KNOWS").depths(1, None)
    assert sorted(r.nodes for r in q.paths().collect()) == [[0, 1, 2, 3, 4], [0, 3, 4]]
    assert sorted(r.rels for r in q.hydrated().collect()) == [[0, 1, 2, 4], [3, 4]]
    assert [tuple(r) for r in paths.path_between(users, 0, 4, ("KNOWS",)).collect()] == [([0, 3, 4], [3, 4])] and paths.path_between(users, 4, 0).count() == 0
    back = paths.PathQuery(users, 4, 0, ("KNOWS",), "in", 1, 2)
    assert [tuple(r) for r in back.hydrated().collect()] == [([4, 3, 0], [4, 3])]
    assert len(paths.PathQuery(users, 6, 4, (), "both").depths(3, 3).paths().collect()) == 1
    with pytest.raises(ValueError):
        q.along("up")
    assert paths.shortest_path(chain := users.spark.range(30).selectExpr("id AS src", "id + 1 AS dst"), 0, 30) == list(range(31)) and paths.cheapest_path(chain, 0, 19) == (list(range(20)), 19.0)


def test_k_core_rounds_and_sampled_betweenness(spark):
    ring = spark.range(40).selectExpr("id AS src", "(id + 1) % 40 AS dst")
    tail = ring.unionAll(spark.range(40, 70).selectExpr("id - 1 AS src", "id AS dst"))
    v = spark.range(71)
    core = {r.id: r.core for r in algorithms.k_core(v, tail).collect()}
    assert core == {k: 2 if k < 40 else 1 for k in range(70)} | {70: 0} and algorithms.max_core(v, tail) == 2
    assert algorithms.k_core_nodes(v, tail, 2).count() == 40
    _, v, e = random_graph(spark, 12, 30, 3)
    whole = {r.id: r.centrality for r in algorithms.betweenness(v, e, exact=True).collect()}
    again = {r.id: r.centrality for r in algorithms.betweenness(v, e, exact=True, sources=v).collect()}
    assert all(abs(whole[k] - again[k]) < 1e-9 for k in whole)


def test_components_of_hubs(spark):
    rng = random.Random(5)
    e = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(1000, 1000 + k) for k in range(1, 700)] + [(5000 + k, 5001 + k) for k in range(40)]
    df = spark.createDataFrame(e, "a bigint, b bigint")
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in e:
        if a != b:
            a, b = sorted((find(a), find(b)))
            top[b] = a
    want = {x: find(x) for x in top}
    assert {r.node: r.root for r in stars.components(df).collect()} == want
    assert stars.components(df.where("a < 0")).count() == 0


def test_query_builder_and_functions(users):
    q = QueryBuilder(users).match("(a:User)-[:KNOWS]->(b:User)").where("a.age > 40 OR b.age > 40").returns("b.name AS b", distinct=True).order_by("b").limit(2)
    assert [r.b for r in q.run().collect()] == ["Bo", "Cem"]
    with pytest.raises(ValueError):
        QueryBuilder(users).text()
    scalar.register("shout", lambda c: F.concat(F.upper(c), F.lit("!")))
    assert rows(users, "MATCH (u:User {name: 'Bo'}) RETURN SHOUT(u.name)") == [("BO!",)]
    kept = users.cached()
    assert kept.nodes().count() == 7
    kept.release()


def test_streamed_nodes(spark, tmp_path):
    pages.ingest_nodes(pages.event_stream(spark, "/root/testdata/sf0.001"), str(tmp_path / "n"), str(tmp_path / "log")).awaitTermination()
    g = pages.with_streamed(PropertyGraph(spark), ("Event",), str(tmp_path / "n"))
    n = spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    assert g.label("Event").select("id").distinct().count() == n


def test_a_cluster_needs_a_shared_folder():
    class Cluster:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Cluster(), {}

    with pytest.raises(ValueError):
        lineage.shared_dir(Session())


def test_depth_first_order_of_more_than_a_million_edges(spark):
    """The edges needn't fit the driver: 1,100,000 of them, which were an error; smaller neighbours first, depths, no edges, a chain."""
    n = 1_100_000
    e = spark.range(n).select(F.lit(0).cast("bigint").alias("src"), (F.col("id") % (n // 2) + 1).alias("dst"), F.col("id").alias("k")).select("src", F.when(F.col("k") < n // 2, F.col("dst")).otherwise(F.col("dst") + n).alias("dst"))
    order = paths.dfs(e.union(spark.createDataFrame([(5, 3), (5, 0), (1, 2_000_000_000), (None, 3)], "src bigint, dst bigint")), 0)
    assert order[:4] == [0, 1, 2_000_000_000, 2] and len(order) == n + 2 and order[3:n // 2 + 2] == list(range(2, n // 2 + 1))
    chain = spark.range(50).select("id", (F.col("id") + 1).alias("dst")).toDF("src", "dst")
    assert paths.dfs(chain, 0) == list(range(51)) and paths.dfs(chain, 7, 3) == [7, 8, 9, 10] and paths.dfs(chain, 7, 0) == [7]
    assert paths.dfs(chain.limit(0), 4) == [4] and paths.dfs(chain, 50) == [50] and paths.dfs(chain, -1) == [-1]


def test_betweenness_of_tasks_and_by_joins(spark, monkeypatch):
    """Sources dealt to tasks and all sources by joins agree: dense, sparse, a hub, lone nodes, no edges. Tasks hold no pairs and need no rounds of joins."""
    rng = random.Random(5)
    dense = {(rng.randrange(40), rng.randrange(40)) for _ in range(500)}
    sparse = {(k, k + 1) for k in range(50, 52)} | {(60, k) for k in range(61, 90)} | {(k, 60) for k in range(70, 85)} | {(3, 60)}
    v = spark.range(95)
    e = spark.createDataFrame([*dense, *sparse], "src bigint, dst bigint")
    score = lambda **k: {r.id: round(r.centrality, 9) for r in algorithms.betweenness(v, e, **k).collect()}
    joins, by_joins = [], algorithms._betweenness_by_joins
    monkeypatch.setattr(algorithms, "_betweenness_by_joins", lambda *a: joins.append(1) or by_joins(*a))
    got = [score(), score(exact=True)]
    assert not joins
    monkeypatch.setattr(algorithms, "TASK_EDGES", 10)
    assert got == [score(), score(exact=True)] and len(joins) == 2
    monkeypatch.undo()
    assert {r.centrality for r in algorithms.betweenness(v, e.limit(0)).collect()} == {0.0}
