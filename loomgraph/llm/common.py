"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut, shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: bytes.translate table that lower-cases A-Z only.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def until_exit(spark: SparkSession, path: str) -> str:
    """Have the file system delete the path when the driver's JVM ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """df as written to the shared folder, which cuts lineage and holds it compressed; gone when the driver ends."""
    spark, path = df.sparkSession, scratch(df.sparkSession, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(until_exit(spark, path))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        top = Path(__file__).resolve().parent.parent
        file = Path(tempfile.mkdtemp(prefix="loomgraph-"), f"{top.name}.zip")
        with zipfile.ZipFile(file, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, str(p.relative_to(top.parent)))
        sc.addPyFile(str(file))
        _shipped.add(sc.applicationId)


#: Rows that a step which holds Python copies of texts takes at a time.
FEW = 512


def give_back() -> None:
    """Return a worker's free memory to the system: the worker waits for its next task, maybe of another step."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


_lasting: dict[str, list] = {}


def lasting(make: Callable) -> Callable:
    """functools.cache for what a worker keeps from task to task, until map_arrow gives it a task of another module: steps of one session share the workers, and what one keeps would take memory beside the next."""
    kept = cache(make)
    _lasting.setdefault(make.__module__, []).append(kept)
    return kept


def drop_others(module: str) -> None:
    """Let go of what operators of other modules keep in this process."""
    others = [f for m, kept in _lasting.items() if m != module for f in kept if f.cache_info().currsize]
    for f in others:
        f.cache_clear()
    if others:
        gc.collect()  # what is kept may hold itself
        give_back()


def map_arrow(df: DataFrame, run, schema, rows: int | None = None) -> DataFrame:
    """mapInArrow, with this package at hand in the workers; run() gets slices of `rows` rows at most if given, and finds only what its own module keeps (lasting)."""
    ship(df.sparkSession)

    def slices(batches):
        for b in batches:
            for at in range(0, b.num_rows, rows):
                yield b.slice(at, rows)

    def held(batches):
        drop_others(run.__module__)
        yield from run(slices(batches) if rows else batches)
        give_back()

    return df.mapInArrow(held, schema)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def two_columns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id bigint, text string): whatever else the input holds, clashing names included, stays out of the work."""
    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def raw_texts(column) -> list:
    """UTF-8 bytes (None for null) of an Arrow string column."""
    import pyarrow as pa

    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def row_key(id_col: str = "doc_id", text_col: str = "text") -> tuple[Column, Column]:
    """What tells rows apart: the id and a hash of it and the whole text; both columns compare null-safely.

    Rows of one id but different texts are different documents; rows that
    repeat both are the same one.
    """
    i, t = F.col(f"`{id_col}`").cast("bigint"), F.col(f"`{text_col}`").cast("string")
    return i, F.xxhash64(i, t, t.isNull())


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where df has such columns already, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def drop_rows(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs whose row_key isn't in gone (two columns); columns are those of docs."""
    g = gone.select(F.col(gone.columns[0]).alias("__gone_id"), F.col(gone.columns[1]).alias("__gone_key")).distinct()
    i, k = row_key(id_col, text_col)
    return docs.join(g, i.eqNullSafe(g["__gone_id"]) & (k == g["__gone_key"]), "left_anti")
