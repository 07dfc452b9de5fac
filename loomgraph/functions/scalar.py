"""Scalar expressions that graph operators share."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Functions of columns that queries may call besides the built-in ones, by lower-case name.
FUNCTIONS: dict[str, Callable[..., Column]] = {}


def register(name: str, function: Callable[..., Column]) -> None:
    """Let queries call function(*columns); a built-in expression, or a pandas UDF where none can say it."""
    FUNCTIONS[name.lower()] = function



def tokens(text: Column) -> Column:
    """Lower-case words between white space, letters and digits only, empty ones dropped."""
    return F.filter(F.transform(F.split(F.trim(text), r"\s+"), lambda x: F.lower(F.regexp_replace(x, r"[^\p{IsAlphabetic}\p{N}]", ""))), lambda x: x != "")


def percentile_disc_floor(value: Column, q: float) -> Column:
    """Element at floor((n - 1) q) of the sorted values, as double; holds a group's values, so percentile_disc() is for groups of any size."""
    own = F.array_sort(F.collect_list(value.cast("double")))
    return F.try_element_at(own, (F.floor((F.count(value) - 1) * F.lit(q)) + 1).cast("int"))


def percentile_disc(df: DataFrame, keys: dict[str, Column], value: Column, q: float, name: str = "p") -> DataFrame:
    """(keys, name): for each group the element at floor((n - 1) q) of its sorted values, as double; no row for a group without values.

    Equal values are counted before they move, and the counts of a group are
    ordered by a window that can spill, so no group is held in an array.
    """
    names = list(keys)
    counted = df.select(*[c.alias(n) for n, c in keys.items()], value.cast("double").alias("__v")).where("__v IS NOT NULL").groupBy(*names, "__v").agg(F.count("__v").alias("__n"))
    total = counted.groupBy(*names).agg(F.sum("__n").alias("__t")).select(*[F.col(n).alias(f"__of_{n}") for n in names], "__t")
    upto = counted.withColumn("__u", F.sum("__n").over(Window.partitionBy(*names or [F.lit(0)]).orderBy("__v")))
    on = functools.reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"__of_{n}")) for n in names], F.lit(True))
    found = upto.join(total, on) if names else upto.crossJoin(total)  # one row
    return found.where(F.col("__u") > F.floor((F.col("__t") - 1) * F.lit(q))).groupBy(*names).agg(F.min("__v").alias(name))


def euclidean(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt(F.pow(x1 - x2, 2) + F.pow(y1 - y2, 2))


def manhattan(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.abs(x1 - x2) + F.abs(y1 - y2)


def display_name(name: Column, node_id: Column) -> Column:
    return F.coalesce(name, node_id.cast("string"))


def dot_escape(text: Column) -> Column:
    """Backslash, quote and line ends escaped for a DOT string."""
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text
