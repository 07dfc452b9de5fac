"""The supplied star schema and event table as a property graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import NodeTable, PropertyGraph, RelTable

#: label: (table, key column, prefix of its columns). A node's id is the label's number times 2^40 plus its key.
LABELS = {
    "Region": ("region", "r_regionkey", "r_"), "Nation": ("nation", "n_nationkey", "n_"), "Customer": ("customer", "c_custkey", "c_"), "Supplier": ("supplier", "s_suppkey", "s_"),
    "Part": ("part", "p_partkey", "p_"), "Order": ("orders", "o_orderkey", "o_"), "User": ("events", "user_id", ""), "Document": ("documents", "doc_id", ""),
}
SHIFT = 1 << 40


def node_id(label: str, key: Column) -> Column:
    return key.cast("bigint") + F.lit(list(LABELS).index(label) * SHIFT)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node_table(spark: SparkSession, sf_dir: str, label: str) -> NodeTable:
    table, key, prefix = LABELS[label]
    df = _table(spark, sf_dir, table)
    if label == "User":
        df = df.select("user_id").distinct()
    return NodeTable((label,), df.select(node_id(label, F.col(key)).alias("id"), *[F.col(c).alias(c.removeprefix(prefix)) for c in df.columns]))


def rel_table(spark: SparkSession, sf_dir: str, typ: str, start: str, end: str, table: str, start_key: str, end_key: str, key: Column, props: tuple[str, ...] = ()) -> RelTable:
    df = _table(spark, sf_dir, table).where(F.col(start_key).isNotNull() & F.col(end_key).isNotNull())
    return RelTable(typ, df.select(key.cast("bigint").alias("id"), node_id(start, F.col(start_key)).alias("start"), node_id(end, F.col(end_key)).alias("end"), *[F.col(c).alias(c.partition("_")[2]) for c in props]), start, end)


def next_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, user_id, next_user) in order of time: which user acts after which.

    The whole table is one sequence. Each day is ordered by itself and its last
    event is joined to the first one of the next day that has any, so no task
    needs more than a day.
    """
    e = _table(spark, sf_dir, "events").select("event_id", "ts", "user_id").withColumn("day", F.to_date("ts"))
    in_day = Window.partitionBy("day").orderBy("ts", "event_id")
    e = e.withColumn("next_user", F.lead("user_id").over(in_day)).withColumn("last", F.lead("event_id").over(in_day).isNull())
    first = e.groupBy("day").agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("first_user"))
    after = first.select("day", F.lead("first_user").over(Window.orderBy("day")).alias("after"))  # one row a day
    return e.join(after, "day").select("event_id", "user_id", F.when(F.col("last"), F.col("after")).otherwise(F.col("next_user")).alias("next_user")).where("next_user IS NOT NULL")


def from_star_schema(spark: SparkSession, sf_dir: str, labels: tuple[str, ...] = tuple(LABELS)) -> PropertyGraph:
    """The graph, or the part of it between the labels."""
    user = lambda c: node_id("User", F.col(c))
    made = {
        ("IN_REGION", "Nation", "Region"): lambda: rel_table(spark, sf_dir, "IN_REGION", "Nation", "Region", "nation", "n_nationkey", "n_regionkey", F.col("n_nationkey")),
        ("IN_NATION", "Customer", "Nation"): lambda: rel_table(spark, sf_dir, "IN_NATION", "Customer", "Nation", "customer", "c_custkey", "c_nationkey", node_id("Customer", F.col("c_custkey"))),
        ("IN_NATION", "Supplier", "Nation"): lambda: rel_table(spark, sf_dir, "IN_NATION", "Supplier", "Nation", "supplier", "s_suppkey", "s_nationkey", node_id("Supplier", F.col("s_suppkey"))),
        ("PLACED", "Customer", "Order"): lambda: rel_table(spark, sf_dir, "PLACED", "Customer", "Order", "orders", "o_custkey", "o_orderkey", F.col("o_orderkey")),
        ("CONTAINS", "Order", "Part"): lambda: rel_table(spark, sf_dir, "CONTAINS", "Order", "Part", "lineitem", "l_orderkey", "l_partkey", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ("l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")),
        ("SUPPLIES", "Supplier", "Part"): lambda: RelTable("SUPPLIES", _table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct().select(F.xxhash64("l_suppkey", "l_partkey").alias("id"), node_id("Supplier", F.col("l_suppkey")).alias("start"), node_id("Part", F.col("l_partkey")).alias("end")), "Supplier", "Part"),
        ("NEXT", "User", "User"): lambda: RelTable("NEXT", next_events(spark, sf_dir).select(F.col("event_id").alias("id"), user("user_id").alias("start"), user("next_user").alias("end")), "User", "User"),
    }
    return PropertyGraph(spark, tuple(node_table(spark, sf_dir, x) for x in labels), tuple(make() for (_, s, e), make in made.items() if s in labels and e in labels))


def parquet_graph(spark: SparkSession, folder: str) -> PropertyGraph:
    """A graph written by write_parquet."""
    catalog = spark.read.parquet(f"{folder}/catalog").orderBy("k").collect()  # one row per table
    nodes = tuple(NodeTable(tuple(r.labels), spark.read.parquet(f"{folder}/{r.path}")) for r in catalog if r.typ is None)
    return PropertyGraph(spark, nodes, tuple(RelTable(r.typ, spark.read.parquet(f"{folder}/{r.path}"), r.start, r.end) for r in catalog if r.typ is not None))


def write_parquet(graph: PropertyGraph, folder: str) -> None:
    """Each table of the graph as Parquet, and a catalog of them."""
    rows = []
    for k, t in enumerate((*graph.node_tables, *graph.rel_tables)):
        is_rel, path = isinstance(t, RelTable), f"table-{k:04d}"
        t.df.write.mode("overwrite").parquet(f"{folder}/{path}")
        rows.append((k, path, None if is_rel else list(t.labels), t.typ if is_rel else None, t.start if is_rel else None, t.end if is_rel else None))
    graph.spark.createDataFrame(rows, "k int, path string, labels array<string>, typ string, start string, end string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/catalog")
