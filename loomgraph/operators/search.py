"""Lookups shaped like indexes: predicates that reach the Parquet scan, and an inverted table for texts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import tokens


def full_text(df: DataFrame, column: str, query: str, every: bool = False) -> DataFrame:
    """Rows whose text holds any word of the query, or every one; none for a query without words."""
    wanted = df.sparkSession.range(1).select(F.array_distinct(tokens(F.lit(query))).alias("w")).first().w
    if not wanted:
        return df.where(F.lit(False))
    text, own = F.col(f"`{column}`"), tokens(F.col(f"`{column}`"))
    words = F.array(*[F.lit(w) for w in wanted])
    return df.where(text.isNotNull() & ((F.size(F.array_except(words, own)) == 0) if every else F.arrays_overlap(own, words)))


def inverted(df: DataFrame, column: str, id_col: str = "id") -> DataFrame:
    """(term, id) once each, to be written for repeated searches."""
    return df.select(F.explode(F.array_distinct(tokens(F.col(f"`{column}`")))).alias("term"), F.col(id_col).alias("id"))


def search_inverted(index: DataFrame, query: str, every: bool = False) -> DataFrame:
    """(id) of an inverted table's documents with any word of the query, or every one; only the words' own rows are read and moved."""
    spark = index.sparkSession
    words = spark.range(1).select(F.array_distinct(tokens(F.lit(query))).alias("w")).first().w
    hits = index.where(F.col("term").isin(words) if words else F.lit(False)).groupBy("id").agg(F.count("term").alias("n"))
    return (hits.where(F.col("n") == len(words)) if every else hits).select("id")


def remove_documents(index: DataFrame, ids: DataFrame) -> DataFrame:
    """An inverted table without the documents (first column: id)."""
    gone = ids.select(F.col(ids.columns[0]).alias("__gone")).distinct()
    return index.join(gone, F.col("id") == F.col("__gone"), "left_anti")


def term_stats(index: DataFrame) -> DataFrame:
    """One row: terms and documents of an inverted table."""
    return index.agg(F.count_distinct("term").alias("terms"), F.count_distinct("id").alias("docs"))


def greater_than(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(F.col(f"`{column}`") > F.lit(value))


def greater_or_equal(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(F.col(f"`{column}`") >= F.lit(value))


def less_than(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(F.col(f"`{column}`") < F.lit(value))


def less_or_equal(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(F.col(f"`{column}`") <= F.lit(value))


def between(df: DataFrame, column: str, low, high) -> DataFrame:
    """Both ends included."""
    return df.where(F.col(f"`{column}`").between(F.lit(low), F.lit(high)))


def composite(df: DataFrame, columns: Sequence[str], values: Sequence) -> DataFrame:
    """Rows that have the values in the columns, of which leading ones may be given alone."""
    return df.where(reduce(lambda a, b: a & b, [F.col(f"`{c}`") == F.lit(v) for c, v in zip(columns, values, strict=False)], F.lit(True)))


def _tuple(columns: Sequence[str]) -> Column:
    return F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)])


def composite_range(df: DataFrame, columns: Sequence[str], low: Sequence, high: Sequence) -> DataFrame:
    """Rows whose values lie between two tuples in lexicographic order, both included.

    The bounds on the first column are also stated alone, so that they reach the scan.
    """
    kinds = dict(df.dtypes)
    bound = lambda v: F.struct(*[F.lit(x).cast(kinds[c]).alias(f"c{k}") for k, (c, x) in enumerate(zip(columns, v, strict=True))])
    lead = F.col(f"`{columns[0]}`").between(F.lit(low[0]), F.lit(high[0]))
    return df.where(lead & (_tuple(columns) >= bound(low)) & (_tuple(columns) <= bound(high)))


def index_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: rows, distinct keys, keys per row and rows per key, of rows that have all the columns."""
    keys = df.dropna(subset=list(columns)).groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.count(F.lit(1)).alias("n"))
    total = keys.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("n").alias("unique"))
    return total.select("total", "unique", F.try_divide("unique", "total").alias("selectivity"), F.try_divide("total", "unique").alias("per_key"))


def keyword(df: DataFrame, word: str) -> DataFrame:
    """Nodes (id, labels, properties) with the word, whatever the case, in a label, a property's name or a text; each once."""
    word, hit = word.lower(), F.exists("labels", lambda x: F.contains(F.lower(x), F.lit(word.lower())))
    for name, kind in df.dtypes:
        if name not in ("id", "labels"):
            c = F.col(f"`{name}`")
            if word in name.lower():
                hit = hit | c.isNotNull()
            if kind == "string":
                hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(word)), F.lit(False))
    return df.where(hit).dropDuplicates(["id"])
