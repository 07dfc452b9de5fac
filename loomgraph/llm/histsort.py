"""Sharding by histogram sort. DataFrame functions only.

Rows are ordered by (hash of the text, id), which keeps equal texts together.
Splitters between shards are found by counting: each round takes equally spaced
probes in every interval that may still hold a splitter, counts the exact bytes
between them over all partitions, and keeps the probe interval where the
shard's share of bytes is reached, until a probe is within the tolerance or an
interval is one hash wide; there the ids of its rows are probed likewise. Then
the rows move once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions

PROBES = 256
TOLERANCE = 0.001


@dataclass
class Interval:
    """Where a splitter lies: keys in [lo, hi), with `below` bytes under lo; inside hash `at` if that isn't None."""

    goal: float
    lo: int
    hi: int
    below: int
    at: int | None = None
    done: bool = False


def _step(x: Interval) -> int:
    return max(1, -(-(x.hi - x.lo) // PROBES))


def _wide(key: Column, lo: int, step: int) -> Column:
    """(key - lo) / step, whole; in decimals, as the difference may pass 64 bits."""
    return F.floor((key.cast("decimal(20,0)") - F.lit(str(lo)).cast("decimal(20,0)")) / F.lit(str(step)).cast("decimal(20,0)")).cast("int")


def splitters(keys: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, int | None]]:
    """shards - 1 boundaries (hash, id): rows below are (h < hash), or (h = hash and id < the boundary's id).

    keys: (h bigint >= 0, i bigint, size bigint). Each round returns at most
    PROBES counts for each splitter to the driver.
    """
    total, low, high = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.min("i"), F.max("i")).first()
    if not total:
        return [(0, None)] * (shards - 1)
    slack = tolerance * total / shards
    spans = [Interval(total * k / shards, 0, 1 << 63, 0) for k in range(1, shards)]
    while todo := [x for x in spans if not x.done]:
        probes = []
        for k, x in enumerate(todo):
            key = F.col("h") if x.at is None else F.col("i")
            inside = (key >= F.lit(x.lo)) & (F.lit(True) if x.hi >= 1 << 63 else key < F.lit(x.hi)) & (F.lit(True) if x.at is None else F.col("h") == F.lit(x.at))
            probes.append(F.when(inside, F.struct(F.lit(k).alias("k"), _wide(key, x.lo, _step(x)).alias("b"), key.alias("key"))))
        probed = keys.select("size", F.explode(F.filter(F.array(*probes), lambda p: p.isNotNull())).alias("p"))
        counted = probed.groupBy("p.k", "p.b").agg(F.sum("size").alias("size"), F.min("p.key").alias("first"), F.max("p.key").alias("last")).collect()
        for k, x in enumerate(todo):
            below = x.below
            for r in sorted((r for r in counted if r.k == k), key=lambda r: r.b):
                if below + r["size"] > x.goal:
                    break
                below += r["size"]
            else:
                x.lo, x.done = x.hi, True
                continue
            under, over = x.goal - below, below + r["size"] - x.goal
            if min(under, over) <= slack or r.first == r.last and (x.at is not None or r["size"] <= slack):
                x.lo, x.done = (r.first if under <= over else r.last + 1), True
            elif r.first == r.last:  # one hash that holds too much
                x.at, x.lo, x.hi, x.below = r.first, low, high + 1, below
            else:
                x.lo, x.hi, x.below = r.first, r.last + 1, below
    return [(x.lo, None) if x.at is None else (x.at, x.lo) for x in spans]


def _below(bound: tuple[int, int | None]) -> Column:
    h, i = bound
    if h >= 1 << 63:
        return F.lit(True)
    if i is None:
        return F.col("h") < F.lit(h)
    return (F.col("h") < F.lit(h)) | ((F.col("h") == F.lit(h)) & ((F.col("i") < F.lit(i)) if i < 1 << 63 else F.lit(True)))


def shard(docs: DataFrame, shards: int = 8, id_col="doc_id", text_col="text", tolerance: float = TOLERANCE, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row, and the columns named in carry.

    law is `bytes`: sizes (UTF-8 bytes of the text plus 1; a null text has
    none) add up nearly equally. Equal texts are neighbours and so in one shard,
    unless the boundary that balance asks for lies inside their group; within it
    rows are in the order of ids. Rows that repeat id and text are not parted.
    A null id sorts as the smallest. slot counts from 0 in each shard without
    gaps. Splitters come from (hash, id, size) alone; what is carried is read
    again and moves once.
    """
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(
        F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 1).alias("h"),
        F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(-(1 << 63))).alias("i"),
        *[F.col(f"`{c}`").alias(f"__carry_{k}") for k, c in enumerate(carry)],
    )
    if not carry:
        rows = cut(rows)
    bounds = splitters(rows.select("h", "i", "size"), shards, tolerance)
    number = F.lit(shards - 1)
    for k in range(shards - 2, -1, -1):
        number = F.when(_below(bounds[k]), k).otherwise(number)
    # Slots: a shard is dealt by hash of the id into parts that one task numbers; parts start where the counts of those before end.
    parts = max(1, shuffle_partitions(docs.sparkSession))
    rows = rows.withColumn("shard", number.cast("int")).withColumn("part", F.pmod(F.xxhash64("i", "text_crc32"), F.lit(parts)).cast("int"))
    sizes = rows.groupBy("shard", "part").agg(F.count("h").alias("n"))
    first = sizes.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("first"))
    within = Window.partitionBy("shard", "part").orderBy("h", "i", "size")
    out = rows.withColumn("slot", F.row_number().over(within) - 1).join(F.broadcast(first), ["shard", "part"])  # shards x parts rows, whatever the input
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("slot") + F.col("first")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *[F.col(f"__carry_{k}").alias(c) for k, c in enumerate(carry)])
