"""The registered queries of the graph engine and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import PropertyGraph
from .operators import algorithms, mutate, paths, search
from .operators.constraints import Constraints
from .operators.nodeset import NodeSet
from .plans.cypher import cypher
from .session import Session
from .sinks import export
from .sources.star_schema import LABELS, SHIFT, from_star_schema
from .streaming import pages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
USER = list(LABELS).index("User") * SHIFT

FLAGSHIP = "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE c.mktsegment = 'BUILDING' RETURN c.nationkey AS nation, COUNT(*) AS n, ROUND(AVG(o.totalprice), 2) AS avg_price GROUP BY c.nationkey ORDER BY n DESC, nation LIMIT 10"


def _cypher(name: str, labels: str, text: str, sql: str | None) -> None:
    parts = tuple(labels.split())
    QUERIES[name] = lambda spark, sf: cypher(from_star_schema(spark, sf, parts), text)
    if sql:
        ORACLES[name] = sql


def _add(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


# Scans and filters

_cypher("flagship_building_orders", "Customer Order", FLAGSHIP, "SELECT c_nationkey AS nation, count(*) AS n, round(avg(o_totalprice), 2) AS avg_price FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1 ORDER BY n DESC, nation LIMIT 10")
_cypher("label_scan", "Nation", "MATCH (n:Nation) RETURN n.nationkey AS k, n.name AS name", "SELECT n_nationkey AS k, n_name AS name FROM nation")
_cypher("unlabelled_scan", "Region Nation", "MATCH (n) RETURN n.name AS name", "SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation")
_cypher("prop_equals", "Customer", "MATCH (c:Customer {mktsegment: 'MACHINERY'}) RETURN c.custkey AS k", "SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'MACHINERY'")
_cypher("prop_greater", "Part", "MATCH (p:Part) WHERE p.size > 40 RETURN p.partkey AS k, p.size AS s", "SELECT p_partkey AS k, p_size AS s FROM part WHERE p_size > 40")
_cypher("and_or_parentheses", "Part", "MATCH (p:Part) WHERE (p.size < 5 OR p.size >= 48) AND p.retailprice <= 1500.5 RETURN p.partkey AS k", "SELECT p_partkey AS k FROM part WHERE (p_size < 5 OR p_size >= 48) AND p_retailprice <= 1500.5")
_cypher("not_equals", "Order", "MATCH (o:Order) WHERE o.orderstatus <> 'O' AND NOT o.totalprice < 200000 RETURN o.orderkey AS k", "SELECT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'O' AND NOT o_totalprice < 200000")
_cypher("regex_match", "Customer", "MATCH (c:Customer) WHERE c.name =~ '0[12]7' RETURN c.custkey AS k", "SELECT c_custkey AS k FROM customer WHERE regexp_matches(c_name, '0[12]7')")
_cypher("in_list", "Nation", "MATCH (n:Nation) WHERE n.nationkey IN [1, 5, 24, 99] RETURN n.name AS name", "SELECT n_name AS name FROM nation WHERE n_nationkey IN (1, 5, 24, 99)")
_cypher("text_predicates", "Part", "MATCH (p:Part) WHERE p.type STARTS WITH 'S' OR p.name CONTAINS '12' OR p.brand ENDS WITH '3' RETURN p.partkey AS k", "SELECT p_partkey AS k FROM part WHERE starts_with(p_type, 'S') OR contains(p_name, '12') OR ends_with(p_brand, '3')")
_cypher("exists_property", "Customer", "MATCH (c:Customer) WHERE EXISTS(c.acctbal) AND c.acctbal IS NOT NULL AND c.nothing IS NULL RETURN COUNT(*) AS n", "SELECT count(*) AS n FROM customer WHERE c_acctbal IS NOT NULL")
_cypher("property_to_property", "Customer Supplier Nation", "MATCH (c:Customer)-[:IN_NATION]->(n:Nation)<-[:IN_NATION]-(s:Supplier) WHERE c.acctbal < s.acctbal RETURN n.name AS nation, COUNT(*) AS pairs", "SELECT n_name AS nation, count(*) AS pairs FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey WHERE c_acctbal < s_acctbal GROUP BY 1")
_cypher("arithmetic", "Part", "MATCH (p:Part) WHERE p.size % 7 = 3 RETURN p.partkey AS k, ROUND(p.retailprice * 2 - p.size / 4, 4) AS v", "SELECT p_partkey AS k, round(p_retailprice * 2 - p_size / 4, 4) AS v FROM part WHERE p_size % 7 = 3")

# Hops

_cypher("out_hop", "Customer Nation", "MATCH (c:Customer)-[:IN_NATION]->(n:Nation) RETURN c.custkey AS k, n.name AS nation", "SELECT c_custkey AS k, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey")
_cypher("in_hop", "Nation Region", "MATCH (r:Region)<-[:IN_REGION]-(n:Nation) WHERE r.name = 'ASIA' OR r.regionkey = 0 RETURN n.nationkey AS k", "SELECT n_nationkey AS k FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' OR r_regionkey = 0")
_cypher("two_hops", "Customer Nation Region", "MATCH (c:Customer)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) RETURN r.name AS region, COUNT(c) AS n", "SELECT r_name AS region, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
_cypher("three_hops", "Order Customer Nation Region", "MATCH (o:Order)<-[:PLACED]-(c:Customer)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) RETURN r.name AS region, ROUND(SUM(o.totalprice), 1) AS total", "SELECT r_name AS region, round(sum(o_totalprice), 1) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
_cypher("undirected_hop", "Nation Region", "MATCH (r:Region)-[:IN_REGION]-(n:Nation) RETURN r.regionkey AS r, n.nationkey AS n", "SELECT n_regionkey AS r, n_nationkey AS n FROM nation")
_cypher("untyped_hop", "Customer Nation Region", "MATCH (n:Nation)-[e]->(x) RETURN TYPE(e) AS t, COUNT(*) AS n", "SELECT 'IN_REGION' AS t, count(*) AS n FROM nation")
_cypher("hop_with_properties", "Order Part", "MATCH (o:Order)-[l:CONTAINS]->(p:Part) WHERE l.quantity > 45 AND p.size = 1 RETURN o.orderkey AS o, p.partkey AS p, l.linenumber AS line", "SELECT l_orderkey AS o, l_partkey AS p, l_linenumber AS line FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity > 45 AND p_size = 1")
_cypher("optional_match", "Order Part", "MATCH (o:Order) OPTIONAL MATCH (o)-[l:CONTAINS]->(p:Part) RETURN o.orderkey AS o, COUNT(p) AS parts", "SELECT o_orderkey AS o, count(l_partkey) AS parts FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
_cypher("optional_missing", "Order Part", "MATCH (o:Order) OPTIONAL MATCH (o)-[:CONTAINS]->(p:Part) WITH o, p WHERE p.partkey IS NULL RETURN o.orderkey AS o", "SELECT o_orderkey AS o FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
_cypher("shared_variable", "Customer Supplier Nation", "MATCH (c:Customer)-[:IN_NATION]->(n:Nation), (s:Supplier)-[:IN_NATION]->(n) WHERE c.acctbal > 9000 RETURN c.custkey AS c, s.suppkey AS s", "SELECT c_custkey AS c, s_suppkey AS s FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_acctbal > 9000")
_cypher("cyclic_pattern", "User", "MATCH (a:User)-[x:NEXT]->(b:User)-[y:NEXT]->(a) RETURN a.user_id AS a, b.user_id AS b, COUNT(*) AS n", "WITH e AS (SELECT event_id, user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst FROM events) SELECT x.src AS a, x.dst AS b, count(*) AS n FROM e x JOIN e y ON x.dst = y.src AND y.dst = x.src AND x.event_id <> y.event_id GROUP BY 1, 2")

# Projection, aggregation, order

_cypher("with_having", "Customer Order", "MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c.nationkey AS nation, COUNT(*) AS n WHERE n > 500 RETURN nation, n", "SELECT c_nationkey AS nation, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1 HAVING count(*) > 500")
_cypher("with_then_match", "Customer Order", "MATCH (c:Customer) WITH c WHERE c.acctbal > 9500 MATCH (c)-[:PLACED]->(o:Order) RETURN c.custkey AS c, MAX(o.totalprice) AS top", "SELECT c_custkey AS c, max(o_totalprice) AS top FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_acctbal > 9500 GROUP BY 1")
_cypher("return_distinct", "Customer", "MATCH (c:Customer) RETURN DISTINCT c.mktsegment AS s", "SELECT DISTINCT c_mktsegment AS s FROM customer")
_cypher("basic_aggregates", "Order", "MATCH (o:Order) RETURN o.orderstatus AS s, COUNT(*) AS n, ROUND(SUM(o.totalprice), 1) AS total, ROUND(AVG(o.totalprice), 3) AS mean, MIN(o.orderpriority) AS low, MAX(o.totalprice) AS high, COUNT(DISTINCT o.custkey) AS customers", "SELECT o_orderstatus AS s, count(*) AS n, round(sum(o_totalprice), 1) AS total, round(avg(o_totalprice), 3) AS mean, min(o_orderpriority) AS low, max(o_totalprice) AS high, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
_cypher("group_by_clause", "Part", "MATCH (p:Part) RETURN p.brand AS brand, SUM(p.size) AS total, COUNT(p.size) AS n GROUP BY p.brand", "SELECT p_brand AS brand, sum(p_size)::BIGINT AS total, count(p_size) AS n FROM part GROUP BY 1")
_cypher("stdev", "Customer", "MATCH (c:Customer) RETURN c.mktsegment AS s, ROUND(STDEV(c.acctbal), 4) AS dev, ROUND(STDEVP(c.acctbal), 4) AS devp", "SELECT c_mktsegment AS s, round(stddev_pop(c_acctbal), 4) AS dev, round(stddev_pop(c_acctbal), 4) AS devp FROM customer GROUP BY 1")
_cypher("percentiles", "Part", "MATCH (p:Part) RETURN p.brand AS b, ROUND(PERCENTILECONT(p.retailprice, 0.9), 4) AS cont, PERCENTILEDISC(p.size, 0.6) AS disc, PERCENTILECONT(p.size) AS median", "SELECT p_brand AS b, round(quantile_cont(p_retailprice, 0.9), 4) AS cont, list_sort(list(p_size))[floor((count(*) - 1) * 0.6)::INT + 1]::DOUBLE AS disc, quantile_cont(p_size, 0.5) AS median FROM part GROUP BY 1")
_cypher("aggregate_of_nothing", "Customer", "MATCH (c:Customer) WHERE c.custkey < 0 RETURN COUNT(*) AS n, SUM(c.acctbal) AS s", "SELECT count(*) AS n, 0.0::DOUBLE AS s FROM customer WHERE c_custkey < 0 HAVING count(*) > 0")
_cypher("order_skip_limit", "Customer", "MATCH (c:Customer) RETURN c.custkey AS k, c.nationkey AS n, c.acctbal AS b ORDER BY n DESC, b SKIP 20 LIMIT 15", "SELECT c_custkey AS k, c_nationkey AS n, c_acctbal AS b FROM customer ORDER BY n DESC, b, k LIMIT 15 OFFSET 20")
_cypher("union_distinct", "Customer Supplier", "MATCH (c:Customer) RETURN c.nationkey AS n UNION MATCH (s:Supplier) RETURN s.nationkey AS n", "SELECT c_nationkey AS n FROM customer UNION SELECT s_nationkey FROM supplier")
_cypher("union_all", "Customer Supplier", "MATCH (c:Customer) RETURN c.nationkey AS n UNION ALL MATCH (s:Supplier) RETURN s.nationkey AS n", "SELECT c_nationkey AS n FROM customer UNION ALL SELECT s_nationkey FROM supplier")
_cypher("call_subquery", "Customer Nation", "CALL { MATCH (c:Customer)-[:IN_NATION]->(n:Nation) RETURN n.name AS nation, COUNT(*) AS n } RETURN nation, n ORDER BY n DESC, nation LIMIT 5", "SELECT n_name AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY n DESC, nation LIMIT 5")

# Fluent


@_add("fluent_hop_distinct", "SELECT DISTINCT n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'")
def fluent_hop_distinct(spark, sf):
    return NodeSet.label(from_star_schema(spark, sf, ("Customer", "Nation")), "Customer").prop_eq("mktsegment", "BUILDING").out("IN_NATION").distinct().df.select("name")


@_add("fluent_in_hop", "SELECT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'")
def fluent_in_hop(spark, sf):
    return NodeSet.label(from_star_schema(spark, sf, ("Customer", "Order")), "Order").prop_eq("orderpriority", "1-URGENT").in_("PLACED").df.select(F.col("custkey").alias("k"))


@_add("fluent_paginate", "SELECT p_partkey AS k, p_size AS s FROM part ORDER BY p_size DESC NULLS LAST, p_partkey LIMIT 25 OFFSET 100")
def fluent_paginate(spark, sf):
    return NodeSet.label(from_star_schema(spark, sf, ("Part",)), "Part").order_by("size", False).paginate(100, 25).df.select(F.col("partkey").alias("k"), F.col("size").alias("s"))


@_add("fluent_int_filter", "SELECT count(*) AS n, round(stddev_samp(c_acctbal), 4) AS dev, round(var_samp(c_acctbal), 2) AS var FROM customer WHERE c_nationkey > 3 AND c_nationkey <> 7")
def fluent_int_filter(spark, sf):
    s = NodeSet.label(from_star_schema(spark, sf, ("Customer",)), "Customer").int_gt("nationkey", 3).where("nationkey <> 7")
    return s.agg(F.count("id").alias("n"), F.round(F.stddev_samp("acctbal"), 4).alias("dev"), F.round(F.var_samp("acctbal"), 2).alias("var"))


# Paths

NEXT = "e AS (SELECT event_id, user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst FROM events), x AS (SELECT event_id, src, dst FROM e WHERE dst IS NOT NULL)"
EDGES = f"{NEXT}, s AS MATERIALIZED (SELECT DISTINCT src, dst FROM x)"


def _users(spark: SparkSession, sf: str) -> PropertyGraph:
    return from_star_schema(spark, sf, ("User",))


def _user(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[(F.col(c) - F.lit(USER)).alias("user_id" if c == "id" else c) if c in ("id", "start", "component", "community", "parent", "a", "b", "c") else F.col(c) for c in columns or df.columns])


#: Least depth of what user 0 reaches, a level a round until nothing is new.
_LEVELS = f"WITH RECURSIVE {EDGES}, l(id, depth) USING KEY (id) AS (SELECT 0::BIGINT, 0 UNION SELECT s.dst, min(l.depth) + 1 FROM l JOIN s ON l.id = s.src LEFT JOIN recurring.l AS r ON r.id = s.dst WHERE r.id IS NULL GROUP BY s.dst)"


@_add("var_length_hops", f"{_LEVELS}, m AS (SELECT id, depth FROM l WHERE id <> 0 UNION ALL SELECT 0, min(l.depth) + 1 FROM l JOIN s ON l.id = s.src WHERE s.dst = 0) SELECT id AS user_id FROM m WHERE depth BETWEEN 2 AND 4")
def var_length_hops(spark, sf):
    return cypher(_users(spark, sf), "MATCH (a:User {user_id: 0})-[:NEXT*2..4]->(b:User) RETURN b.user_id AS user_id")


@_add("var_length_all_starts", f"WITH {NEXT} SELECT src AS a, count(DISTINCT dst) AS n FROM (SELECT src, dst FROM x UNION SELECT p.src, q.dst FROM x p JOIN x q ON p.dst = q.src) GROUP BY 1")
def var_length_all_starts(spark, sf):
    return cypher(_users(spark, sf), "MATCH (a:User)-[:NEXT*1..2]->(b:User) RETURN a.user_id AS a, COUNT(b) AS n")


@_add("var_length_in", f"WITH {NEXT} SELECT DISTINCT src AS user_id FROM x WHERE dst = 3")
def var_length_in(spark, sf):
    return cypher(_users(spark, sf), "MATCH (a:User {user_id: 3})<-[:NEXT*1]-(b:User) RETURN b.user_id AS user_id")


@_add("bfs_depths", f"{_LEVELS} SELECT id AS user_id, depth FROM l")
def bfs_depths(spark, sf):
    return _user(paths.bfs(_users(spark, sf).edges(), USER))


@_add("undirected_bfs", f"WITH RECURSIVE {EDGES}, u AS (SELECT src, dst FROM s UNION SELECT dst, src FROM s), l(id, depth) AS (SELECT 0, 0 UNION SELECT u.dst, l.depth + 1 FROM l JOIN u ON l.id = u.src WHERE l.depth < 3) SELECT id AS user_id, min(depth) AS depth FROM l GROUP BY 1")
def undirected_bfs(spark, sf):
    return _user(paths.bfs(_users(spark, sf).edges(directed=False), USER, 3))


@_add("shortest_path_counts", f"WITH RECURSIVE {NEXT}, s AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM x GROUP BY 1, 2), l(id, depth, paths) USING KEY (id) AS (SELECT 0::BIGINT, 0, 1::HUGEINT UNION SELECT s.dst, min(l.depth) + 1, sum(l.paths * s.n)::HUGEINT FROM l JOIN s ON l.id = s.src LEFT JOIN recurring.l AS r ON r.id = s.dst WHERE r.id IS NULL GROUP BY s.dst) SELECT id AS user_id, depth, paths::BIGINT AS paths FROM l WHERE depth > 0")
def shortest_path_counts(spark, sf):
    return _user(paths.shortest_tree(_users(spark, sf).edges(), USER).where("depth > 0"), "id", "depth", "paths")


@_add("cheapest_costs", f"{_LEVELS} SELECT id AS user_id, depth::DOUBLE AS cost FROM l")
def cheapest_costs(spark, sf):
    return _user(paths.cheapest(_users(spark, sf).edges(), USER), "id", "cost")


@_add("weighted_costs", f"WITH RECURSIVE {NEXT}, s AS MATERIALIZED (SELECT DISTINCT src, dst, ((src * 7 + dst * 3) % 10 + 1)::DOUBLE AS w FROM x), l(id, cost) USING KEY (id) AS (SELECT 0::BIGINT, 0.0::DOUBLE UNION SELECT s.dst, min(l.cost + s.w) FROM l JOIN s ON l.id = s.src LEFT JOIN recurring.l AS r ON r.id = s.dst GROUP BY s.dst, r.cost HAVING r.cost IS NULL OR min(l.cost + s.w) < r.cost) SELECT id AS user_id, cost FROM l")
def weighted_costs(spark, sf):
    key = lambda c: F.col(c) - F.lit(USER)
    weighted = _users(spark, sf).edges().withColumn("w", ((key("src") * 7 + key("dst") * 3) % 10 + 1).cast("double"))
    return _user(paths.cheapest(weighted, USER, "w"), "id", "cost")


@_add("simple_paths", f"WITH RECURSIVE {EDGES}, p(last, path, n) AS (SELECT 0::BIGINT, [0::BIGINT], 0 UNION ALL SELECT s.dst, list_append(p.path, s.dst), p.n + 1 FROM p JOIN s ON p.last = s.src WHERE p.n < 4 AND NOT list_contains(p.path, s.dst)) SELECT last AS user_id, n AS hops, count(*) AS paths, sum(path[2])::BIGINT AS first_hops FROM p WHERE n >= 2 GROUP BY 1, 2")
def simple_paths(spark, sf):
    found = paths.simple_paths(_users(spark, sf).edges(), USER, None, 2, 4)
    found = found.select((F.element_at("nodes", -1) - F.lit(USER)).alias("user_id"), (F.size("nodes") - 1).alias("hops"), (F.element_at("nodes", 2) - F.lit(USER)).alias("hop"))
    return found.groupBy("user_id", "hops").agg(F.count("hop").alias("paths"), F.sum("hop").alias("first_hops"))


# Algorithms


def _pagerank_sql(n: int = 20) -> str:
    ctes = [f"WITH {NEXT}, v AS (SELECT DISTINCT user_id AS id FROM events), k AS (SELECT count(*)::DOUBLE AS n FROM v), o AS (SELECT src, count(*) AS out FROM x GROUP BY 1), w AS (SELECT x.src, x.dst, count(*)::DOUBLE / any_value(o.out) AS share FROM x JOIN o ON x.src = o.src GROUP BY 1, 2), r0 AS MATERIALIZED (SELECT id, 1.0 / n AS r FROM v, k)"]
    for i in range(n):
        ctes.append(f"r{i + 1} AS MATERIALIZED (SELECT v.id, 0.15 / any_value(k.n) + 0.85 * coalesce(sum(r{i}.r * w.share), 0) AS r FROM v CROSS JOIN k LEFT JOIN w ON w.dst = v.id LEFT JOIN r{i} ON r{i}.id = w.src GROUP BY 1)")
    return ", ".join(ctes) + f" SELECT id AS user_id, round(r / (SELECT sum(r) FROM r{n}), 9) AS rank FROM r{n}"


def _both(g: PropertyGraph) -> tuple[DataFrame, DataFrame]:
    return g.nodes(False), g.edges()


@_add("pagerank", _pagerank_sql())
def pagerank(spark, sf):
    return _user(algorithms.pagerank(*_both(_users(spark, sf)))).withColumn("rank", F.round("rank", 9))


@_add("degrees", f"WITH {NEXT}, v AS (SELECT DISTINCT user_id AS id FROM events) SELECT id AS user_id, (SELECT count(*) FROM x WHERE src = id) AS out_degree, (SELECT count(*) FROM x WHERE dst = id) AS in_degree, (SELECT count(*) FROM x WHERE src = id) + (SELECT count(*) FROM x WHERE dst = id) AS degree FROM v")
def degrees(spark, sf):
    return _user(algorithms.degrees(*_both(_users(spark, sf))))


@_add("degree_centrality", f"WITH {NEXT}, v AS (SELECT DISTINCT user_id AS id FROM events), e2 AS (SELECT src AS id FROM x UNION ALL SELECT dst FROM x) SELECT v.id AS user_id, round(count(e2.id) / ((SELECT count(*) FROM v) - 1), 9) AS centrality FROM v LEFT JOIN e2 ON v.id = e2.id GROUP BY 1")
def degree_centrality(spark, sf):
    return _user(algorithms.degree_centrality(*_both(_users(spark, sf)))).withColumn("centrality", F.round("centrality", 9))


_CLOSURE = f"WITH RECURSIVE {EDGES}, v AS (SELECT DISTINCT user_id AS id FROM events)"


@_add("components", f"{_CLOSURE}, u AS (SELECT src, dst FROM s UNION SELECT dst, src FROM s), c(a, b) AS (SELECT id, id FROM v UNION SELECT c.a, u.dst FROM c JOIN u ON c.b = u.src) SELECT a AS user_id, min(b) AS component FROM c GROUP BY 1")
def components(spark, sf):
    return _user(algorithms.components(*_both(_users(spark, sf))))


@_add("strong_components", f"{_CLOSURE}, c(a, b) AS (SELECT id, id FROM v UNION SELECT c.a, s.dst FROM c JOIN s ON c.b = s.src) SELECT p.a AS user_id, min(p.b) AS component FROM c p JOIN c q ON p.a = q.b AND p.b = q.a GROUP BY 1")
def strong_components(spark, sf):
    return _user(algorithms.strong_components(*_both(_users(spark, sf))))


@_add("strong_component_sizes", f"{_CLOSURE}, c(a, b) AS (SELECT id, id FROM v UNION SELECT c.a, s.dst FROM c JOIN s ON c.b = s.src), z AS (SELECT p.a, min(p.b) AS k FROM c p JOIN c q ON p.a = q.b AND p.b = q.a GROUP BY 1) SELECT size, count(*) AS n FROM (SELECT k, count(*) AS size FROM z GROUP BY 1) GROUP BY 1")
def strong_component_sizes(spark, sf):
    return algorithms.component_sizes(algorithms.strong_components(*_both(_users(spark, sf))))


def _lpa_sql(n: int = 10) -> str:
    ctes = [f"WITH {NEXT}, v AS (SELECT DISTINCT user_id AS id FROM events), u AS (SELECT src, dst, count(*) AS w FROM (SELECT src, dst FROM x WHERE src <> dst UNION ALL SELECT dst, src FROM x WHERE src <> dst) GROUP BY 1, 2), l0 AS MATERIALIZED (SELECT id, id AS c FROM v)"]
    for i in range(n):
        ctes.append(f"l{i + 1} AS MATERIALIZED (SELECT l{i}.id, coalesce(t.c, l{i}.c) AS c FROM l{i} LEFT JOIN (SELECT src, c FROM (SELECT src, c, row_number() OVER (PARTITION BY src ORDER BY w DESC, c) AS k FROM (SELECT src, l{i}.c AS c, sum(w) AS w FROM u JOIN l{i} ON u.dst = l{i}.id GROUP BY 1, 2)) WHERE k = 1) t ON t.src = l{i}.id)")
    return ", ".join(ctes) + f" SELECT id AS user_id, c AS community FROM l{n}"


@_add("label_propagation", _lpa_sql())
def label_propagation(spark, sf):
    return _user(algorithms.label_propagation(*_both(_users(spark, sf))))


_TRI = f"WITH {EDGES}, u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM s WHERE src <> dst), t AS (SELECT p.a, p.b, q.b AS c FROM u p JOIN u q ON p.a = q.a AND p.b < q.b JOIN u r ON r.a = p.b AND r.b = q.b)"


@_add("triangles", f"{_TRI} SELECT a, b, c FROM t")
def triangles(spark, sf):
    t = algorithms.triangles(_users(spark, sf).edges()).select(F.array_sort(F.array("a", "b", "c")).alias("t"))
    return _user(t.select(F.col("t")[0].alias("a"), F.col("t")[1].alias("b"), F.col("t")[2].alias("c")))


@_add("clustering", f"{_TRI}, v AS (SELECT DISTINCT user_id AS id FROM events), k AS (SELECT id, count(*) AS k FROM (SELECT a AS id FROM u UNION ALL SELECT b FROM u) GROUP BY 1), n AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) GROUP BY 1) SELECT v.id AS user_id, round(CASE WHEN k >= 2 THEN coalesce(n, 0) * 2.0 / (k * (k - 1)) ELSE 0 END, 9) AS coefficient FROM v LEFT JOIN k ON k.id = v.id LEFT JOIN n ON n.id = v.id")
def clustering(spark, sf):
    return _user(algorithms.clustering(*_both(_users(spark, sf)))).withColumn("coefficient", F.round("coefficient", 9))


#: Core numbers as the fixpoint of neighbours' estimates, from the degrees down; rounds end far beyond where the values stand still.
_K_CORE = f"WITH RECURSIVE {NEXT}, v AS (SELECT DISTINCT user_id AS id FROM events), m AS MATERIALIZED (SELECT a, b, count(*) AS n FROM (SELECT src AS a, dst AS b FROM x UNION ALL SELECT dst, src FROM x) GROUP BY 1, 2), h(id, core, step) AS (SELECT v.id, coalesce(sum(m.n), 0)::BIGINT, 0 FROM v LEFT JOIN m ON m.a = v.id GROUP BY 1 UNION ALL SELECT a, max(least(core, upto))::BIGINT, any_value(step) + 1 FROM (SELECT m.a, h.core, h.step, sum(m.n) OVER (PARTITION BY m.a ORDER BY h.core DESC) AS upto FROM m JOIN h ON h.id = m.b) WHERE step < 60 GROUP BY a) SELECT id AS user_id, core FROM h WHERE step = (SELECT max(step) FROM h)"


@_add("k_core", _K_CORE)
def k_core(spark, sf):
    return _user(algorithms.k_core(*_both(_users(spark, sf))), "id", "core")


@_add("betweenness", f"WITH RECURSIVE {NEXT}, v AS (SELECT DISTINCT user_id AS id FROM events), s AS MATERIALIZED (SELECT DISTINCT src, dst FROM x WHERE src <> dst), t(a, id, depth, parent) USING KEY (a, id) AS (SELECT id, id, 0, NULL::BIGINT FROM v UNION SELECT t.a, s.dst, min(t.depth) + 1, min(s.src) FROM t JOIN s ON t.id = s.src LEFT JOIN recurring.t AS r ON r.a = t.a AND r.id = s.dst WHERE r.id IS NULL GROUP BY t.a, s.dst), tree AS MATERIALIZED (SELECT * FROM t), up(a, id) AS (SELECT a, parent FROM tree WHERE depth > 1 UNION ALL SELECT up.a, tree.parent FROM up JOIN tree ON tree.a = up.a AND tree.id = up.id WHERE tree.depth > 1) SELECT v.id AS user_id, round(count(up.id) / greatest(1, ((SELECT count(*) FROM v) - 1) * ((SELECT count(*) FROM v) - 2)), 9) AS centrality FROM v LEFT JOIN up ON up.id = v.id GROUP BY 1")
def betweenness(spark, sf):
    return _user(algorithms.betweenness(*_both(_users(spark, sf)))).withColumn("centrality", F.round("centrality", 9))


# Lookups


def _label(spark, sf, label: str) -> DataFrame:
    return from_star_schema(spark, sf, (label,)).label(label)


_TOKENS = "list_filter(list_transform(string_split_regex(trim(text), '\\s+'), lambda x: lower(regexp_replace(x, '[^\\p{L}\\p{M}\\p{N}]', '', 'g'))), lambda x: x <> '')"


@_add("full_text_any", f"SELECT doc_id FROM documents WHERE list_has_any({_TOKENS}, ['thtion', 'whhaer', 'the'])")
def full_text_any(spark, sf):
    return search.full_text(_label(spark, sf, "Document"), "text", "Thtion whhaer, THE").select("doc_id")


@_add("full_text_every", f"SELECT doc_id FROM documents WHERE list_has_all({_TOKENS}, ['the', 'and', 'thon'])")
def full_text_every(spark, sf):
    return search.full_text(_label(spark, sf, "Document"), "text", "the and thon", every=True).select("doc_id")


@_add("range_lookups", "SELECT c_custkey AS k FROM customer WHERE c_acctbal > 5000 AND c_acctbal <= 6000 AND c_nationkey BETWEEN 3 AND 9")
def range_lookups(spark, sf):
    c = _label(spark, sf, "Customer")
    return search.between(search.less_or_equal(search.greater_than(c, "acctbal", 5000.0), "acctbal", 6000.0), "nationkey", 3, 9).select(F.col("custkey").alias("k"))


@_add("composite_prefix", "SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 4")
def composite_prefix(spark, sf):
    return search.composite(_label(spark, sf, "Customer"), ["mktsegment", "nationkey", "custkey"], ["BUILDING", 4]).select(F.col("custkey").alias("k"))


@_add("composite_range", "SELECT c_custkey AS k FROM customer WHERE (c_nationkey > 3 OR c_nationkey = 3 AND c_acctbal >= 500.0) AND (c_nationkey < 5 OR c_nationkey = 5 AND c_acctbal <= 100.0)")
def composite_range(spark, sf):
    return search.composite_range(_label(spark, sf, "Customer"), ["nationkey", "acctbal"], [3, 500.0], [5, 100.0]).select(F.col("custkey").alias("k"))


@_add("index_stats", "SELECT count(*) AS total, count(DISTINCT (c_mktsegment, c_nationkey)) AS \"unique\", round(count(DISTINCT (c_mktsegment, c_nationkey)) / count(*), 9) AS selectivity, round(count(*) / count(DISTINCT (c_mktsegment, c_nationkey)), 9) AS per_key FROM customer")
def index_stats(spark, sf):
    return search.index_stats(_label(spark, sf, "Customer"), ["mktsegment", "nationkey"]).withColumns({"selectivity": F.round("selectivity", 9), "per_key": F.round("per_key", 9)})


@_add("keyword_search", "SELECT r_name AS name FROM region WHERE contains(lower(r_name), 'as') UNION ALL SELECT n_name FROM nation WHERE contains(lower(n_name), 'as')")
def keyword_search(spark, sf):
    return search.keyword(from_star_schema(spark, sf, ("Region", "Nation")).nodes(), "AS").select("name")


@_add("graph_stats", "SELECT 'label' AS kind, 'Customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'label', 'Nation', count(*) FROM nation UNION ALL SELECT 'type', 'IN_NATION', count(*) FROM customer")
def graph_stats(spark, sf):
    return from_star_schema(spark, sf, ("Nation", "Customer")).stats()


# Changes


@_add("create_and_match", "SELECT c_custkey AS k, 'vip' AS level FROM customer WHERE c_acctbal > 9800")
def create_and_match(spark, sf):
    s = Session(from_star_schema(spark, sf, ("Customer",)))
    s.run("CREATE (b:Badge {level: 'vip'})")
    s.run("MATCH (c:Customer), (b:Badge) WHERE c.acctbal > 9800 CREATE (c)-[:HAS]->(b)")
    return s.run("MATCH (c:Customer)-[:HAS]->(b:Badge) RETURN c.custkey AS k, b.level AS level").df


@_add("set_property", "SELECT c_mktsegment AS s, round(sum(CASE WHEN c_nationkey = 2 THEN 0 ELSE c_acctbal END), 2) AS total FROM customer GROUP BY 1")
def set_property(spark, sf):
    s = Session(from_star_schema(spark, sf, ("Customer",)))
    s.run("MATCH (c:Customer) WHERE c.nationkey = 2 SET c.acctbal = 0")
    return s.run("MATCH (c:Customer) RETURN c.mktsegment AS s, ROUND(SUM(c.acctbal), 2) AS total").df


@_add("delete_nodes", "SELECT n_name AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal >= 0 GROUP BY 1")
def delete_nodes(spark, sf):
    s = Session(from_star_schema(spark, sf, ("Nation", "Customer")))
    s.run("MATCH (c:Customer) WHERE c.acctbal < 0 DELETE c")
    return s.run("MATCH (c:Customer)-[:IN_NATION]->(n:Nation) RETURN n.name AS nation, COUNT(*) AS n").df


@_add("merge_nodes", "SELECT n_name AS name, CASE WHEN n_nationkey = 3 THEN 'seen' END AS state FROM nation UNION ALL SELECT 'ATLANTIS', 'new'")
def merge_nodes(spark, sf):
    g = from_star_schema(spark, sf, ("Nation",))
    name = g.label("Nation").where("nationkey = 3").first()["name"]
    s = Session(g)
    s.run(f"MERGE (n:Nation {{name: '{name}'}}) ON CREATE SET n.state = 'new' ON MATCH SET n.state = 'seen'")
    s.run("MERGE (n:Nation {name: 'ATLANTIS'}) ON CREATE SET n.state = 'new' ON MATCH SET n.state = 'seen'")
    return s.run("MATCH (n:Nation) RETURN n.name AS name, n.state AS state").df


@_add("foreach_update", "SELECT r_regionkey AS k, CASE WHEN r_regionkey IN (1, 3) THEN 'x' ELSE r_name END AS name FROM region")
def foreach_update(spark, sf):
    s = Session(from_star_schema(spark, sf, ("Region",)))
    s.run("FOREACH (i IN [1, 3, 77] | SET i.name = 'x')")
    return s.run("MATCH (r:Region) RETURN r.regionkey AS k, r.name AS name").df


@_add("rollback", "SELECT count(*) AS n FROM region")
def rollback(spark, sf):
    s = Session(from_star_schema(spark, sf, ("Region",)))
    s.run("BEGIN")
    s.run("MATCH (r:Region) DELETE r")
    s.run("ROLLBACK")
    return s.run("MATCH (r:Region) RETURN COUNT(*) AS n").df


@_add("constraint_violations", "SELECT 'unique' AS kind, 'mktsegment' AS prop, count(*) AS n FROM customer UNION ALL SELECT 'exists', 'comment', count(*) FROM customer")
def constraint_violations(spark, sf):
    c = Constraints()
    c.add("unique", "Customer", "custkey")
    c.add("unique", "Customer", "mktsegment")
    c.add("exists", "Customer", "comment")
    return c.violations(from_star_schema(spark, sf, ("Customer",))).groupBy("kind", "prop").agg(F.count("id").alias("n"))


@_add("bulk_create", "SELECT count(*) AS n, count(DISTINCT p_brand) AS brands FROM part")
def bulk_create(spark, sf):
    g = from_star_schema(spark, sf, ("Part",))
    g = mutate.create_nodes_from(PropertyGraph(spark), ("Copy",), g.label("Part").select("brand", "size"))
    return cypher(g, "MATCH (c:Copy) RETURN COUNT(*) AS n, COUNT(DISTINCT c.brand) AS brands")


# Delivery and export


@_add("page", "SELECT o_orderkey AS k FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 150")
def page(spark, sf):
    return pages.page_frame(_label(spark, sf, "Order"), 3, 50).select(F.col("orderkey").alias("k"))


@_add("node_stream", "SELECT c_custkey AS k FROM customer WHERE c_nationkey = 11")
def node_stream(spark, sf):
    return pages.node_stream(from_star_schema(spark, sf, ("Nation", "Customer")).nodes(), "Customer", "nationkey", 11).select(F.col("custkey").alias("k"))


@_add("windowed_events", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_events(spark, sf):
    return pages.windowed_events(spark.read.parquet(f"{sf}/events.parquet")).withColumn("total", F.round("total", 4))


@_add("dot_export", "SELECT '  n' || (n_nationkey + 1099511627776) || ' -> n' || n_regionkey || ' [label=\"IN_REGION\"];' AS line FROM nation UNION ALL SELECT '  n' || r_regionkey || ' [label=\"' || r_name || '\"];' FROM region UNION ALL SELECT '  n' || (n_nationkey + 1099511627776) || ' [label=\"' || n_name || '\"];' FROM nation")
def dot_export(spark, sf):
    return export.dot_lines(*export.view(from_star_schema(spark, sf, ("Region", "Nation")))).select("line")


@_add("json_export", "SELECT 'node' AS kind, '{\"data\":{\"id\":\"' || r_regionkey || '\",\"label\":\"Region\",\"name\":\"' || r_name || '\",\"props\":\"{\\\"regionkey\\\":' || r_regionkey || ',\\\"name\\\":\\\"' || r_name || '\\\"}\"}}' AS element FROM region")
def json_export(spark, sf):
    return export.json_elements(*export.view(from_star_schema(spark, sf, ("Region",)))).select("kind", "element")


@_add("circle_layout", "SELECT n_nationkey AS k, round(cos(2 * pi() / 25 * n_nationkey) * 2500 / (2 * pi()), 4) AS x, round(sin(2 * pi() / 25 * n_nationkey) * 2500 / (2 * pi()), 4) AS y FROM nation")
def circle_layout(spark, sf):
    return export.circle(_label(spark, sf, "Nation")).select((F.col("id") - F.lit(SHIFT)).cast("int").alias("k"), F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@_add("layer_layout", "SELECT 'c' || c_custkey AS node, 0 AS layer FROM customer UNION ALL SELECT 'n' || n_nationkey, CASE WHEN n_nationkey IN (SELECT c_nationkey FROM customer) THEN 1 ELSE 0 END FROM nation")
def layer_layout(spark, sf):
    at = export.layers(from_star_schema(spark, sf, ("Nation", "Customer")))
    return at.select(F.concat(F.when(F.col("id") >= 2 * SHIFT, "c").otherwise("n"), F.col("id") % SHIFT).alias("node"), "layer")


from . import catalog_api  # noqa: E402, F401 - registers its queries here
