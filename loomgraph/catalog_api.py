"""Registered queries of the calls beside Cypher texts: lookups, paths, changes, transactions, delivery, indexes, export."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import _K_CORE, _LEVELS, EDGES, NEXT, USER, _add, _both, _cypher, _label, _user, _users
from .functions import scalar
from .graph import PropertyGraph
from .operators import algorithms, mutate, paths, search
from .operators.constraints import Constraints
from .operators.indexes import Indexes
from .operators.nodeset import NodeSet, QueryBuilder, simple_query
from .plans.cypher import cypher
from .plans.lineage import shared_dir
from .session import Session, Store
from .sinks import export
from .sources.star_schema import LABELS, SHIFT, from_star_schema, parquet_graph, write_parquet
from .streaming import pages


def _row(spark, **values) -> DataFrame:
    """One row of Python values."""
    kinds = {bool: "boolean", int: "bigint", float: "double", str: "string"}
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"`{k}` {kinds[type(v)]}" for k, v in values.items()))


def _folder(spark, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def _at(label: str) -> int:
    return list(LABELS).index(label) * SHIFT


# Cypher forms

_cypher("collect_values", "Nation Region", "MATCH (n:Nation)-[:IN_REGION]->(r:Region) WITH r.name AS region, COLLECT(n.nationkey) AS keys RETURN region, LISTSUM(keys) AS total, LISTSIZE(keys) AS n", "SELECT r_name AS region, sum(n_nationkey)::BIGINT AS total, count(*)::INT AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
scalar.register("listsum", lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x))
scalar.register("listsize", F.size)
_cypher("output_names", "Customer", "MATCH (c:Customer) RETURN c.mktsegment, COUNT(*), COUNT(c.custkey), MIN(c.acctbal)", "SELECT c_mktsegment AS \"c.mktsegment\", count(*) AS \"count\", count(c_custkey) AS \"count(c.custkey)\", min(c_acctbal) AS \"min(c.acctbal)\" FROM customer GROUP BY 1")
_cypher("group_without_aggregate", "Customer", "MATCH (c:Customer) RETURN c.mktsegment AS s, c.nationkey AS n GROUP BY c.mktsegment, c.nationkey", "SELECT DISTINCT c_mktsegment AS s, c_nationkey AS n FROM customer")
_cypher("item_outside_the_groups", "Customer", "MATCH (c:Customer) RETURN c.nationkey AS n, c.name AS first, COUNT(*) AS customers GROUP BY c.nationkey", "SELECT c_nationkey AS n, arg_min(c_name, c_custkey) AS first, count(*) AS customers FROM customer GROUP BY 1")
_cypher("optional_where_outer", "Customer Order", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.totalprice > c.acctbal * 40 RETURN c.custkey AS c, COUNT(o) AS n", "SELECT c_custkey AS c, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 40 GROUP BY 1")
_cypher("optional_where_before", "Customer Nation Supplier", "MATCH (c:Customer) WHERE c.acctbal > 8000 WITH c, c.acctbal AS limit MATCH (c)-[:IN_NATION]->(n:Nation) OPTIONAL MATCH (s:Supplier)-[:IN_NATION]->(n) WHERE s.acctbal > limit RETURN c.custkey AS c, COUNT(s) AS n", "SELECT c_custkey AS c, count(s_suppkey) AS n FROM customer LEFT JOIN supplier ON s_nationkey = c_nationkey AND s_acctbal > c_acctbal WHERE c_acctbal > 8000 GROUP BY 1")
_cypher("call_with_variables", "Customer Nation", "MATCH (n:Nation) WITH n.nationkey AS key, n.name AS nation CALL { MATCH (c:Customer) RETURN c.nationkey AS key, COUNT(*) AS customers } IN (key) RETURN nation, customers", "SELECT n_name AS nation, count(*) AS customers FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
_cypher("intersect", "Customer Supplier", "MATCH (c:Customer) WHERE c.acctbal > 9000 RETURN c.nationkey AS n INTERSECT MATCH (s:Supplier) RETURN s.nationkey AS n", "SELECT c_nationkey AS n FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier")
_cypher("except", "Customer Order", "MATCH (c:Customer) RETURN c.custkey AS c EXCEPT MATCH (o:Order) WHERE o.totalprice > 200000 RETURN o.custkey AS c", "SELECT c_custkey AS c FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 200000")
_cypher("semi_join_by_pattern", "Customer Order", "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.totalprice > 400000 RETURN DISTINCT c.custkey AS c", "SELECT DISTINCT o_custkey AS c FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 400000")
_cypher("var_length_in_far", "User", "MATCH (a:User {user_id: 3})<-[:NEXT*2..3]-(b:User) RETURN b.user_id AS user_id", f"WITH RECURSIVE {EDGES}, l(id, depth) USING KEY (id) AS (SELECT 3::BIGINT, 0 UNION SELECT s.src, min(l.depth) + 1 FROM l JOIN s ON l.id = s.dst LEFT JOIN recurring.l AS r ON r.id = s.src WHERE r.id IS NULL GROUP BY s.src), m AS (SELECT id, depth FROM l WHERE id <> 3 UNION ALL SELECT 3, min(l.depth) + 1 FROM l JOIN s ON l.id = s.dst WHERE s.src = 3) SELECT id AS user_id FROM m WHERE depth BETWEEN 2 AND 3")


@_add("reference_nulls", "SELECT c_custkey AS k FROM customer WHERE nullif(c_mktsegment, 'BUILDING') IS DISTINCT FROM 'MACHINERY'")
def reference_nulls(spark, sf):
    """A missing value differs from any other one."""
    g = from_star_schema(spark, sf, ("Customer",))
    g = mutate.update_nodes(g, g.label("Customer").where("mktsegment = 'BUILDING'").select("id", F.struct(F.lit(None).cast("string").alias("v")).alias("mktsegment")))
    return cypher(g, "MATCH (c:Customer) WHERE c.mktsegment <> 'MACHINERY' RETURN c.custkey AS k", "reference")


@_add("query_builder", "SELECT c_custkey AS k, c_acctbal AS b FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 1000 AND n_name = (SELECT n_name FROM nation WHERE n_nationkey = 5) ORDER BY b DESC, k LIMIT 20 OFFSET 5")
def query_builder(spark, sf):
    q = QueryBuilder(from_star_schema(spark, sf, ("Nation", "Customer"))).match("(c:Customer)-[:IN_NATION]->(n:Nation)").where("c.acctbal > 1000").where("n.nationkey = 5")
    return q.returns("c.custkey AS k", "c.acctbal AS b").order_by("b DESC", "k").skip(5).limit(20).run()


# Lookups


@_add("point_get", "SELECT c_custkey AS k, c_name AS name FROM customer WHERE c_custkey = 77")
def point_get(spark, sf):
    return from_star_schema(spark, sf, ("Nation", "Customer")).node(_at("Customer") + 77).select(F.col("custkey").alias("k"), "name")


@_add("point_get_rel", "SELECT o_custkey AS c, o_orderkey AS o FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey = 33")
def point_get_rel(spark, sf):
    return from_star_schema(spark, sf, ("Customer", "Order")).rel(33).select((F.col("start") - _at("Customer")).alias("c"), (F.col("end") - _at("Order")).alias("o"))


@_add("neighbours_of_a_node", "SELECT 'in' AS direction, c_custkey AS k FROM customer WHERE c_nationkey = 7 UNION ALL SELECT 'out', n_regionkey FROM nation WHERE n_nationkey = 7")
def neighbours_of_a_node(spark, sf):
    return from_star_schema(spark, sf, ("Region", "Nation", "Customer")).adjacent(_at("Nation") + 7).select("direction", (F.col("id") % SHIFT).alias("k"))


@_add("neighbours_summary", "SELECT (SELECT string_agg(n_regionkey::VARCHAR, ',') FROM nation WHERE n_nationkey = 7) AS outgoing, (SELECT string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey) FROM customer WHERE c_nationkey = 7) AS incoming")
def neighbours_summary(spark, sf):
    n = from_star_schema(spark, sf, ("Region", "Nation", "Customer")).neighbors(_at("Nation") + 7)
    return n.select(*[F.array_join(F.transform(c, lambda x: (x % SHIFT).cast("string")), ",").alias(c) for c in ("outgoing", "incoming")])


@_add("catalog_lists", "SELECT 'label' AS kind, unnest(['Customer', 'Nation', 'Region']) AS name UNION ALL SELECT 'type', unnest(['IN_NATION', 'IN_REGION'])")
def catalog_lists(spark, sf):
    g = from_star_schema(spark, sf, ("Region", "Nation", "Customer"))
    return spark.createDataFrame([("label", x) for x in g.labels()] + [("type", x) for x in g.types()], "kind string, name string")


@_add("range_bounds", "SELECT p_partkey AS k FROM part WHERE p_size >= 12 AND p_size < 15 AND p_retailprice <= 1400")
def range_bounds(spark, sf):
    p = search.less_than(search.greater_or_equal(_label(spark, sf, "Part"), "size", 12), "size", 15)
    return search.less_or_equal(p, "retailprice", 1400.0).select(F.col("partkey").alias("k"))


@_add("rest_simple_query", "SELECT n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'FURNITURE'")
def rest_simple_query(spark, sf):
    return simple_query(from_star_schema(spark, sf, ("Nation", "Customer")), "Customer", "mktsegment", "FURNITURE", out="IN_NATION").df.select("name")


@_add("rest_query_in", "SELECT c_custkey AS k FROM customer WHERE c_nationkey = 9")
def rest_query_in(spark, sf):
    return simple_query(from_star_schema(spark, sf, ("Nation", "Customer")), "Nation", "nationkey", 9, into="IN_NATION").df.select(F.col("custkey").alias("k"))


_WORDS = "SELECT doc_id, unnest(list_distinct(list_filter(list_transform(string_split_regex(trim(text), '\\s+'), lambda x: lower(regexp_replace(x, '[^\\p{L}\\p{M}\\p{N}]', '', 'g'))), lambda x: x <> ''))) AS term FROM documents"


@_add("inverted_search", f"WITH w AS ({_WORDS}) SELECT doc_id FROM w WHERE term IN ('the', 'and', 'thon') GROUP BY 1 HAVING count(*) = 3")
def inverted_search(spark, sf):
    docs = _label(spark, sf, "Document")
    return search.search_inverted(search.inverted(docs, "text", "doc_id"), "The and THON", every=True).select(F.col("id").alias("doc_id"))


@_add("inverted_stats", f"WITH w AS ({_WORDS}) SELECT count(DISTINCT term) AS terms, count(DISTINCT doc_id) AS docs FROM w WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'fr')")
def inverted_stats(spark, sf):
    docs = _label(spark, sf, "Document")
    return search.term_stats(search.remove_documents(search.inverted(docs, "text", "doc_id"), docs.where("lang = 'fr'").select("doc_id")))


# Indexes


@_add("index_find", "SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_nationkey = 12")
def index_find(spark, sf):
    ix = Indexes(from_star_schema(spark, sf, ("Customer",)))
    ix.create("Customer", "mktsegment", "nationkey")
    return ix.find("Customer", {"mktsegment": "MACHINERY", "nationkey": 12}).select((F.col("id") - _at("Customer")).alias("k"))


@_add("index_prefix", "SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'MACHINERY'")
def index_prefix(spark, sf):
    ix = Indexes(from_star_schema(spark, sf, ("Customer",)))
    ix.create("Customer", "mktsegment", "nationkey")
    return ix.find("Customer", {"mktsegment": "MACHINERY"}).select((F.col("id") - _at("Customer")).alias("k"))


@_add("index_single_int", "SELECT p_partkey AS k FROM part WHERE p_size = 17 AND p_type = (SELECT min(p_type) FROM part WHERE p_size = 17)")
def index_single_int(spark, sf):
    """The single index narrows the nodes, the other property is looked up in them."""
    g = from_star_schema(spark, sf, ("Part",))
    ix, kind = Indexes(g), g.label("Part").where("size = 17").agg(F.min("type")).first()[0]
    ix.create("Part", "size")
    return ix.find("Part", {"size": 17, "type": kind}).select((F.col("id") - _at("Part")).alias("k"))


@_add("index_range", "SELECT c_custkey AS k FROM customer WHERE (c_nationkey > 3 OR c_nationkey = 3 AND c_acctbal >= 500.0) AND (c_nationkey < 5 OR c_nationkey = 5 AND c_acctbal <= 100.0)")
def index_range(spark, sf):
    ix = Indexes(from_star_schema(spark, sf, ("Customer",)))
    ix.create("Customer", "nationkey", "acctbal")
    return ix.find_range("Customer", ["nationkey", "acctbal"], [3, 500.0], [5, 100.0]).select((F.col("id") - _at("Customer")).alias("k"))


@_add("index_upkeep", "SELECT c_custkey AS k FROM customer WHERE c_nationkey = 3 AND c_acctbal >= 0 UNION ALL SELECT 1000000 + s_suppkey FROM supplier WHERE s_nationkey = 3")
def index_upkeep(spark, sf):
    g = from_star_schema(spark, sf, ("Customer", "Supplier"))
    ix = Indexes(g)
    ix.create("Customer", "nationkey")
    ix.remove(g.label("Customer").where("acctbal < 0").select("id"), "Customer")
    ix.add(g.label("Supplier").select((F.col("suppkey") + _at("Customer") + 1_000_000).alias("id"), "nationkey"), "Customer")
    ix.rebuild("Customer", "nationkey")
    return ix.find("Customer", {"nationkey": 3}).select((F.col("id") - _at("Customer")).alias("k"))


@_add("index_catalog", "SELECT unnest(['Customer', 'Customer', 'Part']) AS label, unnest(['nationkey', 'mktsegment,nationkey', 'size']) AS columns, unnest(['single', 'composite', 'single']) AS kind")
def index_catalog(spark, sf):
    ix = Indexes(from_star_schema(spark, sf, ("Customer", "Part")))
    ix.create("Customer", "nationkey")
    ix.create("Customer", "mktsegment", "nationkey")
    ix.create("Part", "size")
    ix.create("Part", "brand")
    ix.drop("Part", "brand")
    return ix.catalog().select("label", F.array_join("columns", ",").alias("columns"), "kind")


@_add("index_all_stats", "SELECT 'Customer(mktsegment)' AS index, count(*) AS total, count(DISTINCT c_mktsegment) AS \"unique\", round(count(DISTINCT c_mktsegment) / count(*), 9) AS selectivity, round(count(*) / count(DISTINCT c_mktsegment), 9) AS per_key FROM customer UNION ALL SELECT 'Part(brand, size)', count(*), count(DISTINCT (p_brand, p_size)), round(count(DISTINCT (p_brand, p_size)) / count(*), 9), round(count(*) / count(DISTINCT (p_brand, p_size)), 9) FROM part")
def index_all_stats(spark, sf):
    ix = Indexes(from_star_schema(spark, sf, ("Customer", "Part")))
    ix.create("Customer", "mktsegment")
    ix.create("Part", "brand", "size")
    return ix.all_stats().withColumns({c: F.round(c, 9) for c in ("selectivity", "per_key")})


@_add("index_usable", "SELECT unnest(['Customer(mktsegment, nationkey, custkey)', 'Customer(mktsegment)']) AS index, unnest([0, 1]) AS place")
def index_usable(spark, sf):
    """Of the indexes that start as the query's columns do, the widest first."""
    ix = Indexes(from_star_schema(spark, sf, ("Customer",)))
    for columns in (("mktsegment",), ("nationkey",), ("mktsegment", "nationkey", "custkey"), ("nationkey", "mktsegment")):
        ix.create("Customer", *columns)
    return spark.createDataFrame([(x.name, k) for k, x in enumerate(ix.usable("Customer", ["mktsegment", "nationkey"]))], "index string, place int")


# Fluent


@_add("fluent_aggregates", "SELECT count(*) AS n, sum(c_nationkey)::BIGINT AS total, round(avg(c_nationkey), 9) AS mean, quantile_cont(c_nationkey, 0.25) AS quarter, round(stddev_samp(c_nationkey), 9) AS dev, round(var_samp(c_nationkey), 9) AS var FROM customer WHERE c_mktsegment = 'BUILDING'")
def fluent_aggregates(spark, sf):
    s = NodeSet.label(from_star_schema(spark, sf, ("Customer",)), "Customer").prop_eq("mktsegment", "BUILDING")
    return _row(spark, n=s.count(), total=int(s.sum_int("nationkey")), mean=round(s.avg_int("nationkey"), 9), quarter=float(s.percentile_cont("nationkey", 0.25)), dev=round(s.stdev("nationkey"), 9), var=round(s.variance("nationkey"), 9))


@_add("fluent_percentile_disc", "SELECT list_sort(list(p_size))[floor((count(*) - 1) * 0.4)::INT + 1]::DOUBLE AS p FROM part")
def fluent_percentile_disc(spark, sf):
    return _row(spark, p=float(NodeSet.label(from_star_schema(spark, sf, ("Part",)), "Part").percentile_disc("size", 0.4)))


@_add("fluent_int_eq", "SELECT s_suppkey AS k FROM supplier WHERE s_nationkey = 11")
def fluent_int_eq(spark, sf):
    return NodeSet.label(from_star_schema(spark, sf, ("Supplier",)), "Supplier").int_eq("nationkey", 11).df.select(F.col("suppkey").alias("k"))


@_add("fluent_hops_in", f"WITH {EDGES}, t AS (SELECT p.src FROM s p JOIN s q ON p.dst = q.src WHERE q.dst = 5 AND p.src NOT IN (SELECT src FROM s WHERE dst = 5)) SELECT DISTINCT src AS user_id FROM t")
def fluent_hops_in(spark, sf):
    return NodeSet.label(_users(spark, sf), "User").int_eq("user_id", 5).hops("NEXT", low=2, high=2, direction="in").df.select("user_id")


# Paths


@_add("shortest_path_ends", f"{_LEVELS} SELECT (SELECT depth FROM l WHERE id = 1) AS hops, true AS starts, true AS ends, true AS linked")
def shortest_path_ends(spark, sf):
    """The path's length, its ends, and whether all its steps are edges."""
    e = _users(spark, sf).edges().distinct()
    p = paths.shortest_path(e, USER, USER + 1)
    steps = spark.createDataFrame(list(zip(p, p[1:], strict=False)), "src bigint, dst bigint")
    return _row(spark, hops=len(p) - 1, starts=p[0] == USER, ends=p[-1] == USER + 1, linked=steps.join(e, ["src", "dst"], "left_anti").isEmpty()).withColumn("hops", F.col("hops").cast("int"))


_SHORT = f"{_LEVELS}, p(last, path, n) AS (SELECT 0::BIGINT, [0::BIGINT], 0 UNION ALL SELECT x.dst, list_append(p.path, x.dst), p.n + 1 FROM p JOIN x ON p.last = x.src JOIN l ON l.id = x.dst AND l.depth = p.n + 1 WHERE p.n < (SELECT depth FROM l WHERE id = 1))"


@_add("all_shortest_paths", f"{_SHORT} SELECT array_to_string(path, '>') AS path FROM p WHERE last = 1")
def all_shortest_paths(spark, sf):
    """Once for each choice of parallel edges."""
    return paths.all_shortest(_users(spark, sf).edges(), USER, USER + 1).select(F.array_join(F.transform("nodes", lambda x: (x - F.lit(USER)).cast("string")), ">").alias("path"))


@_add("count_shortest_paths", f"{_SHORT} SELECT count(*) AS n, true AS there, false AS nowhere FROM p WHERE last = 1")
def count_shortest_paths(spark, sf):
    e = _users(spark, sf).edges()
    return _row(spark, n=paths.count_shortest(e, USER, USER + 1), there=paths.has_path(e, USER, USER + 1), nowhere=paths.has_path(e, USER, USER - 1))


@_add("hydrated_paths", f"{_SHORT}, q AS (SELECT DISTINCT path FROM p WHERE last = 1), f AS (SELECT src, dst, min(event_id) AS rel FROM x GROUP BY 1, 2), h AS (SELECT path, unnest(range(1, len(path))) AS k FROM q) SELECT array_to_string(path, '>') AS path, string_agg(f.rel::VARCHAR, ',' ORDER BY k) AS rels FROM h JOIN f ON f.src = path[k] AND f.dst = path[k + 1] GROUP BY path")
def hydrated_paths(spark, sf):
    q = paths.PathQuery(_users(spark, sf), USER).to(USER + 1).via("NEXT")
    return q.hydrated(q.shortest()).select(F.array_join(F.transform("nodes", lambda x: (x - F.lit(USER)).cast("string")), ">").alias("path"), F.array_join(F.transform("rels", lambda x: x.cast("string")), ",").alias("rels"))


@_add("path_builder_in", f"WITH {EDGES} SELECT DISTINCT p.src AS a, p.dst AS b, q.dst AS c FROM s p JOIN s q ON p.dst = q.src WHERE q.dst = 4 AND p.src <> p.dst AND p.src <> 4 AND p.dst <> 4")
def path_builder_in(spark, sf):
    """Against the edges, two hops."""
    found = paths.PathQuery(_users(spark, sf), USER + 4).via("NEXT").along("in").depths(2, 2).paths()
    return found.select(*[(F.element_at("nodes", k) - F.lit(USER)).alias(c) for c, k in (("a", 3), ("b", 2), ("c", 1))])


@_add("path_between_ends", f"{_LEVELS} SELECT (SELECT depth FROM l WHERE id = 2) + 1 AS nodes, (SELECT depth FROM l WHERE id = 2) AS rels")
def path_between_ends(spark, sf):
    return paths.path_between(_users(spark, sf), USER, USER + 2, ("NEXT",)).select(F.size("nodes").alias("nodes"), F.size("rels").alias("rels"))


@_add("bfs_by_type", "SELECT 'n' AS kind, n_nationkey::BIGINT AS k, 1 AS depth FROM nation WHERE n_nationkey = (SELECT c_nationkey FROM customer WHERE c_custkey = 10) UNION ALL SELECT 'r', n_regionkey, 2 FROM nation WHERE n_nationkey = (SELECT c_nationkey FROM customer WHERE c_custkey = 10) UNION ALL SELECT 'c', 10, 0")
def bfs_by_type(spark, sf):
    e = from_star_schema(spark, sf, ("Region", "Nation", "Customer", "Order")).edges(("IN_NATION", "IN_REGION"))
    kind = F.when(F.col("id") < SHIFT, "r").when(F.col("id") < 2 * SHIFT, "n").otherwise("c")
    return paths.bfs(e, _at("Customer") + 10).select(kind.alias("kind"), (F.col("id") % SHIFT).alias("k"), "depth")


@_add("reachable", f"{_LEVELS} SELECT id AS user_id FROM l")
def reachable(spark, sf):
    return _user(paths.bfs(_users(spark, sf).edges(), USER).select("id"))


@_add("dfs_order", f"WITH {NEXT} SELECT (SELECT count(DISTINCT user_id) FROM events) AS visited, 0 AS first, (SELECT min(dst) FROM x WHERE src = 0 AND dst <> 0) AS second")
def dfs_order(spark, sf):
    """Pre-order, smaller neighbours first; all users are within reach."""
    order = paths.dfs(_users(spark, sf).edges(), USER)
    return _row(spark, visited=len(set(order)), first=order[0] - USER, second=order[1] - USER).withColumn("first", F.col("first").cast("int"))


_ROADS = "n AS (SELECT n_nationkey AS id, (n_nationkey * 7) % 11 AS x, (n_nationkey * 5) % 13 AS y FROM nation), d AS (SELECT a.id AS src, b.id AS dst, {measure} AS w FROM n a JOIN n b ON abs(a.id - b.id) IN (1, 5)), l(id, cost) USING KEY (id) AS (SELECT 0, 0.0::DOUBLE UNION SELECT d.dst, min(l.cost + d.w) FROM l JOIN d ON l.id = d.src LEFT JOIN recurring.l AS r ON r.id = d.dst GROUP BY d.dst, r.cost HAVING r.cost IS NULL OR min(l.cost + d.w) < r.cost)"


def _road(spark, sf, distance: str) -> DataFrame:
    n = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").cast("bigint").alias("id")).select("id", (F.col("id") * 7 % 11).alias("x"), (F.col("id") * 5 % 13).alias("y"))
    m = n.select(F.col("id").alias("dst"))
    e = n.select(F.col("id").alias("src"), F.explode(F.array(F.col("id") + 1, F.col("id") + 5)).alias("dst")).join(m, "dst", "left_semi")
    found = [paths.a_star(e.select("src", "dst"), 0, goal, n, distance) for goal in (13, 24)]
    return spark.createDataFrame([(p[-1], round(cost, 9)) for p, cost in found], "goal bigint, cost double")


@_add("a_star_euclidean", f"WITH RECURSIVE {_ROADS.format(measure='sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)')} SELECT id::BIGINT AS goal, round(cost, 9) AS cost FROM l WHERE id IN (13, 24)")
def a_star_euclidean(spark, sf):
    return _road(spark, sf, "euclidean")


@_add("a_star_manhattan", f"WITH RECURSIVE {_ROADS.format(measure='(abs(a.x - b.x) + abs(a.y - b.y))::DOUBLE')} SELECT id::BIGINT AS goal, round(cost, 9) AS cost FROM l WHERE id IN (13, 24)")
def a_star_manhattan(spark, sf):
    return _road(spark, sf, "manhattan")


# Algorithms


@_add("k_core_set", f"WITH core AS ({_K_CORE}) SELECT user_id, (SELECT max(core) FROM core) AS top FROM core WHERE core >= (SELECT max(core) FROM core)")
def k_core_set(spark, sf):
    v, e = _both(_users(spark, sf))
    top = algorithms.max_core(v, e)
    return _user(algorithms.k_core_nodes(v, e, top).withColumn("top", F.lit(top).cast("bigint")))


@_add("node_triangles", f"WITH {EDGES}, u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM s WHERE src <> dst), t AS (SELECT p.a, p.b, q.b AS c FROM u p JOIN u q ON p.a = q.a AND p.b < q.b JOIN u r ON r.a = p.b AND r.b = q.b), n AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) GROUP BY 1) SELECT DISTINCT user_id, coalesce(n, 0) AS triangles FROM events LEFT JOIN n ON id = user_id")
def node_triangles(spark, sf):
    return _user(algorithms.node_triangles(*_both(_users(spark, sf))))


# Changes


@_add("merge_after_match", "SELECT n_name AS nation, r_name AS region, CASE WHEN r_regionkey = 1 THEN 'again' ELSE 'once' END AS state FROM nation JOIN region ON r_regionkey = 1 OR r_regionkey = n_regionkey WHERE n_nationkey < 3")
def merge_after_match(spark, sf):
    """Bound ends: relationships that are missing are created between them, once."""
    s = Session(from_star_schema(spark, sf, ("Region", "Nation")))
    s.run("MATCH (n:Nation), (r:Region {regionkey: 1}) WHERE n.nationkey < 3 AND n.regionkey <> 1 MERGE (n)-[m:NEAR]->(r) ON CREATE SET m.state = 'once'")
    s.run("MATCH (n:Nation)-[:IN_REGION]->(r:Region) WHERE n.nationkey < 3 MERGE (n)-[m:NEAR]->(r) ON CREATE SET m.state = 'once'")
    s.run("MATCH (n:Nation), (r:Region {regionkey: 1}) WHERE n.nationkey < 3 MERGE (n)-[m:NEAR]->(r) ON CREATE SET m.state = 'late' ON MATCH SET m.state = 'again'")
    return s.run("MATCH (n:Nation)-[m:NEAR]->(r:Region) RETURN n.name AS nation, r.name AS region, m.state AS state").df


@_add("merge_chain", "SELECT n_name AS nation, 'Atlantis' AS city, 'Dock' AS place, 'RELATED' AS typ FROM nation WHERE n_nationkey = 3")
def merge_chain(spark, sf):
    """A chain that isn't there reuses the nodes that match and creates the others; a relationship without a type is RELATED."""
    s = Session(from_star_schema(spark, sf, ("Nation",)))
    s.run("CREATE (c:City {name: 'Atlantis'})")
    for _ in range(2):
        s.run("MERGE (n:Nation {nationkey: 3})-[:HAS]->(c:City {name: 'Atlantis'})-[]->(p:Place {name: 'Dock'})")
    return s.run("MATCH (n:Nation)-[:HAS]->(c:City)-[t]->(p:Place) RETURN n.name AS nation, c.name AS city, p.name AS place, TYPE(t) AS typ").df


@_add("merge_creates_from_one_start", "SELECT count(*) AS customers, (SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 1) AS start, 1 AS cities FROM customer")
def merge_creates_from_one_start(spark, sf):
    s = Session(from_star_schema(spark, sf, ("Customer",)))
    s.run("MERGE (c:Customer)-[:LIVES]->(x:City {name: 'Ys'})")
    return s.run("MATCH (c:Customer)-[:LIVES]->(x:City) RETURN c.custkey AS start, COUNT(x) AS cities").df.crossJoin(s.run("MATCH (c:Customer) RETURN COUNT(*) AS customers").df).withColumn("cities", F.col("cities").cast("int"))


@_add("api_updates", "SELECT n_nationkey AS k, CASE WHEN n_regionkey = 2 THEN 'two' ELSE n_name END AS name, CASE WHEN n_nationkey % 2 = 0 THEN 5 END AS w FROM nation WHERE n_nationkey <> 6 AND n_nationkey <> 8")
def api_updates(spark, sf):
    """update_nodes, update_rels, delete_rels and delete_nodes."""
    g = from_star_schema(spark, sf, ("Region", "Nation"))
    g = mutate.update_nodes(g, g.label("Nation").where("regionkey = 2").select("id", F.struct(F.lit("two").alias("v")).alias("name")))
    g = mutate.update_rels(g, g.rels(("IN_REGION",)).where("id % 2 = 0").select("id", F.struct(F.lit(5).alias("v")).alias("w")))
    g = mutate.delete_rels(g, spark.createDataFrame([(6,)], "id bigint"), ("IN_REGION",))
    g, _, _ = mutate.delete_nodes(g, spark.createDataFrame([(_at("Nation") + 8,)], "id bigint"))
    return cypher(g, "MATCH (n:Nation)-[e:IN_REGION]->(r:Region) RETURN n.nationkey AS k, n.name AS name, e.w AS w")


@_add("api_create", "SELECT 3 AS nodes, 2 AS rels, 1 AS dangling, true AS refused")
def api_create(spark, sf):
    g, ids = mutate.create_nodes(PropertyGraph(spark), ["A", "B"], [{"x": 1}, {"x": 2}, {"y": "z"}])
    g, rels = mutate.create_rels(g, "T", [(ids[0], ids[1], {}), (ids[1], 99, {"w": 1.5})])
    try:
        mutate.create_rels(g, "T", [(ids[0], 98, {})], enforce=True)
        refused = False
    except ValueError:
        refused = True
    return _row(spark, nodes=g.label("A").count(), rels=len(rels), dangling=g.dangling().count(), refused=refused).withColumns({c: F.col(c).cast("int") for c in ("nodes", "rels", "dangling")})


@_add("constraint_catalog", "SELECT 'exists' AS kind, 'name' AS prop, 0 AS broken UNION ALL SELECT 'unique', 'custkey', 0")
def constraint_catalog(spark, sf):
    c = Constraints()
    c.add("unique", "Customer", "custkey")
    c.add("exists", "Customer", "name")
    c.add("exists", "Nation", "name")
    c.drop("exists", "Nation", "name")
    bad = c.violations(from_star_schema(spark, sf, ("Customer",))).groupBy("kind", "prop").agg(F.count("id").cast("int").alias("n"))
    rows = spark.createDataFrame([(x.kind, x.prop) for x in c.items], "kind string, prop string")
    return rows.join(bad, ["kind", "prop"], "left").select("kind", "prop", F.coalesce("n", F.lit(0)).alias("broken"))


@_add("savepoints", "SELECT r_regionkey AS k, CASE r_regionkey WHEN 0 THEN 'a' WHEN 2 THEN 'c' ELSE r_name END AS name FROM region")
def savepoints(spark, sf):
    s = Session(from_star_schema(spark, sf, ("Region",)), timeout=3600)
    s.run("BEGIN")
    s.run("MATCH (r:Region {regionkey: 0}) SET r.name = 'a'")
    s.savepoint("one")
    s.run("MATCH (r:Region {regionkey: 1}) SET r.name = 'b'")
    s.rollback_to("one")
    s.run("MATCH (r:Region {regionkey: 2}) SET r.name = 'c'")
    s.release("one")
    s.run("COMMIT")
    return s.run("MATCH (r:Region) RETURN r.regionkey AS k, r.name AS name").df


@_add("isolation", "SELECT unnest(['read_committed', 'repeatable_read', 'serializable']) AS level, unnest(['both', 'first', 'first']) AS outcome")
def isolation(spark, sf):
    """Two sessions change the graph at once: at the first level the later commit runs its change again, at the others it fails."""
    rows = []
    for level in ("read_committed", "repeatable_read", "serializable"):
        store = Store(from_star_schema(spark, sf, ("Region",)))
        a, b = Session(store, timeout=3600), Session(store, timeout=3600)
        b.begin(level)
        b.run("MATCH (r:Region {regionkey: 1}) SET r.name = 'second'")
        a.run("MATCH (r:Region {regionkey: 0}) SET r.name = 'first'")
        try:
            b.commit()
        except ValueError:
            pass
        names = {r.name for r in a.run("MATCH (r:Region) RETURN r.name AS name").df.collect()}
        rows.append((level, "both" if {"first", "second"} <= names else "first" if "first" in names else "second"))
    return spark.createDataFrame(rows, "level string, outcome string")


@_add("snapshot", "SELECT (SELECT count(*) FROM nation) AS before, (SELECT count(*) FROM nation WHERE n_regionkey <> 1) AS after")
def snapshot(spark, sf):
    """A version stays as it was when later ones change."""
    s = Session(from_star_schema(spark, sf, ("Nation",)))
    old = s.graph
    s.run("MATCH (n:Nation {regionkey: 1}) DELETE n")
    return _row(spark, before=old.label("Nation").count(), after=s.graph.label("Nation").count())


# Delivery


@_add("cursor_pages", "SELECT c_nationkey AS n, count(*) AS rows FROM customer GROUP BY 1")
def cursor_pages(spark, sf):
    """All pages of a cursor over a key with many ties."""
    c, got = pages.Cursor(_label(spark, sf, "Customer").select("id", "nationkey"), 400, "nationkey"), []
    while c.has_more:
        got += [(r.id, r.nationkey) for r in c.next_page()]
    rows = spark.createDataFrame(got, "id bigint, n int").distinct()
    return rows.groupBy("n").agg(F.count("id").alias("rows"))


@_add("batches", "SELECT 10 AS size, (count(*) + 9) // 10 AS batches, count(*) AS rows, 100.0::DOUBLE AS progress FROM supplier")
def batches(spark, sf):
    b = pages.Batches(_label(spark, sf, "Supplier"), 10)
    got = [len(x) for x in b]
    return _row(spark, size=max(got), batches=len(got), rows=sum(got), progress=b.progress).withColumn("size", F.col("size").cast("int"))


@_add("rel_stream", "SELECT l_orderkey AS o, l_partkey AS p, l_linenumber AS line FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R'")
def rel_stream(spark, sf):
    found = pages.rel_stream(from_star_schema(spark, sf, ("Order", "Part")), ("CONTAINS",), "returnflag", "R")
    return found.select((F.col("start") - _at("Order")).alias("o"), (F.col("end") - _at("Part")).alias("p"), F.col("linenumber").alias("line"))


@_add("stream_consumers", "SELECT (SELECT count(*) FROM nation) AS nodes, (SELECT count(*) FROM nation) AS rels, 2 * (SELECT count(*) FROM nation) AS handled, (2 * (SELECT count(*) FROM nation) + 9) // 10 AS markers, 100.0::DOUBLE AS progress")
def stream_consumers(spark, sf):
    g, seen = from_star_schema(spark, sf, ("Region", "Nation")), []
    stream = pages.ItemStream(g.label("Nation"), pages.rel_stream(g, ("IN_REGION",)), 10)
    nodes, rels = len(stream.collect("node")), len(stream.collect("rel"))
    handled = pages.Backpressure(capacity=20, concurrency=3, batch=7).run((x for x in stream if x[0] != "batch_end"), seen.extend)
    return _row(spark, nodes=nodes, rels=rels, handled=handled if len(seen) == handled else -1, markers=sum(k == "batch_end" for k, _ in stream), progress=stream.progress)


@_add("batch_processor", "SELECT count(*) AS items, (count(*) + 63) // 64 AS lists FROM customer")
def batch_processor(spark, sf):
    lists: list[list] = []
    p = pages.BatchProcessor(64, lists.append)
    for r in _label(spark, sf, "Customer").select("id").toLocalIterator():
        p.add(r.id)
    p.flush()
    return _row(spark, items=sum(map(len, lists)), lists=len(lists))


@_add("stream_into_graph", "SELECT event_type AS t, count(*) AS n FROM events GROUP BY 1")
def stream_into_graph(spark, sf):
    """Events from a stream as nodes of the next version."""
    at = _folder(spark, "stream")
    pages.ingest_nodes(pages.event_stream(spark, sf), f"{at}/nodes", f"{at}/log").awaitTermination()
    g = pages.with_streamed(PropertyGraph(spark), ("Event",), f"{at}/nodes")
    return cypher(g, "MATCH (e:Event) RETURN e.event_type AS t, COUNT(*) AS n")


@_add("persistent_graph", "SELECT r_name AS region, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def persistent_graph(spark, sf):
    at = _folder(spark, "graph")
    write_parquet(from_star_schema(spark, sf, ("Region", "Nation")), at)
    return cypher(parquet_graph(spark, at), "MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN r.name AS region, COUNT(*) AS n")


# Export


@_add("induced_view", "SELECT 'node' AS kind, count(*) AS n FROM nation WHERE n_nationkey < 9 UNION ALL SELECT 'node', 0 WHERE false UNION ALL SELECT 'edge', count(*) FROM nation WHERE n_nationkey < 9 AND n_regionkey = 1")
def induced_view(spark, sf):
    """Nine nations and one region, and the edges between them."""
    g = from_star_schema(spark, sf, ("Region", "Nation"))
    ids = g.nodes(False).where((F.col("id") >= SHIFT) & (F.col("id") < SHIFT + 9)).select("id").unionAll(spark.createDataFrame([(1,)], "id bigint"))
    n, e = export.view(g, ids)
    n = n.where(F.col("id") >= SHIFT)
    return n.agg(F.count("id").alias("n")).select(F.lit("node").alias("kind"), "n").unionAll(e.agg(F.count("id").alias("n")).select(F.lit("edge"), "n"))


@_add("json_document", "SELECT (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS nodes, (SELECT count(*) FROM nation) AS edges, (SELECT count(*) FROM nation) AS placed")
def json_document(spark, sf):
    g = from_star_schema(spark, sf, ("Region", "Nation"))
    style = g.label("Nation").select("id", F.lit(1.5).alias("x"), F.lit(2.5).alias("y"), F.lit("#336699").alias("color"), F.lit(4).alias("size"))
    doc = json.loads(export.to_json(*export.view(g), style))
    styled = [n for n in doc["nodes"] if (n["data"].get("_x"), n["data"].get("_color"), n["data"].get("_size")) == (1.5, "#336699", 4)]
    return _row(spark, nodes=len(doc["nodes"]), edges=len(doc["edges"]), placed=len(styled))


@_add("dot_document", "SELECT 2 + 2 * (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS lines, (SELECT count(*) FROM nation) AS edges")
def dot_document(spark, sf):
    text = export.to_dot(*export.view(from_star_schema(spark, sf, ("Region", "Nation"))))
    return _row(spark, lines=len(text.split("\n")), edges=text.count(" -> "))


@_add("csv_round_trip", "SELECT n_nationkey AS k, 'He said \"' || n_name || '\", twice' AS name FROM nation")
def csv_round_trip(spark, sf):
    at = _folder(spark, "csv")
    quote = F.lit(chr(34))
    rows = _label(spark, sf, "Nation").select(F.col("nationkey").alias("k"), F.concat(F.lit("He said "), quote, "name", quote, F.lit(", twice")).alias("name"))
    export.write_csv(rows, at)
    return export.read_csv(spark, at, "k int, name string")


@_add("json_round_trip", "SELECT s_suppkey AS k, s_acctbal AS b FROM supplier")
def json_round_trip(spark, sf):
    at = _folder(spark, "json")
    export.write_json(_label(spark, sf, "Supplier").select(F.col("suppkey").alias("k"), F.col("acctbal").alias("b")), at)
    return spark.read.schema("k bigint, b double").json(at)


@_add("hierarchical_layout", "SELECT n_nationkey AS k, (row_number() OVER (ORDER BY n_nationkey) - 1) * 100.0::DOUBLE AS x, 0.0::DOUBLE AS y FROM nation UNION ALL SELECT 100 + r_regionkey, (row_number() OVER (ORDER BY r_regionkey) - 1) * 100.0::DOUBLE, 100.0 FROM region")
def hierarchical_layout(spark, sf):
    at = export.hierarchical(from_star_schema(spark, sf, ("Region", "Nation")))
    return at.select(F.when(F.col("id") < SHIFT, F.col("id") + 100).otherwise(F.col("id") - SHIFT).cast("int").alias("k"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))


@_add("force_layout", "SELECT (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS placed, true AS inside")
def force_layout(spark, sf):
    at = export.force_directed(from_star_schema(spark, sf, ("Region", "Nation")))
    inside = F.col("x").between(0, 1000) & F.col("y").between(0, 1000)
    return at.agg(F.count_distinct("id").alias("placed"), F.bool_and(inside).alias("inside"))
