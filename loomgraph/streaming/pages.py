"""Paged delivery of results, and streamed ingest."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators.mutate import append_nodes


@dataclass(frozen=True)
class Page:
    rows: list[Row]
    page: int
    size: int
    total: int

    @property
    def pages(self) -> int:
        return -(-self.total // self.size)

    @property
    def has_more(self) -> bool:
        return (self.page + 1) * self.size < self.total


def page(df: DataFrame, number: int, size: int, key: str = "id", most: int = 100_000) -> Page:
    """A page in order of the key; past the end it is empty. A page is one list on the driver, so sizes beyond `most` are an error."""
    if size > most:
        raise ValueError(f"a page of more than {most} rows; use page_frame()")
    return Page(page_frame(df, number, size, key).collect(), number, size, df.count())


def page_frame(df: DataFrame, number: int, size: int, key: str = "id") -> DataFrame:
    return df.orderBy(key).offset(number * size).limit(size)


class Cursor:
    """Pages in order of a key, missing keys last: each asks only for what doesn't lie before the last key, so late pages cost what early ones do.

    Rows that tie on the key follow the order of their other columns, and a page
    that ends among them is continued by their number; equal rows are all given.
    """

    def __init__(self, df: DataFrame, size: int, key: str = "id") -> None:
        self.df, self.size, self.key = df, size, key
        self.order = [F.col(f"`{c}`").asc_nulls_last() for c, kind in sorted(df.dtypes, key=lambda c: c[0] != key) if not kind.startswith("map")]
        self.reset()

    def reset(self) -> None:
        self.last, self.ties, self.position, self.has_more = None, 0, 0, True

    def next_page(self) -> list[Row]:
        if not self.has_more:
            return []
        key, rest = F.col(f"`{self.key}`"), self.df
        if self.position:
            rest = rest.where(key.isNull() if self.last is None else key.isNull() | (key >= F.lit(self.last)))
        got = rest.orderBy(*self.order).offset(self.ties).limit(self.size + 1).collect()
        self.has_more, got = len(got) > self.size, got[: self.size]
        if got:
            end = got[-1][self.key]
            same = sum(r[self.key] == end for r in got)
            self.ties = same + (self.ties if self.position and self.last == end else 0)
            self.last = end
        self.position += len(got)
        return got


class Batches:
    """Rows in lists of `size`, a partition at a time on the driver, with progress from a count made up front."""

    def __init__(self, df: DataFrame, size: int = 100) -> None:
        self.df, self.size, self.total, self.done, self.began = df, size, df.count(), 0, time.monotonic()

    def __iter__(self) -> Iterator[list[Row]]:
        some: list[Row] = []
        for row in self.df.toLocalIterator(prefetchPartitions=True):
            some.append(row)
            if len(some) == self.size:
                self.done += len(some)
                yield some
                some = []
        if some:
            self.done += len(some)
            yield some

    @property
    def progress(self) -> float:
        """Percent."""
        return 100.0 if not self.total else 100.0 * self.done / self.total

    @property
    def throughput(self) -> float:
        return self.done / max(1e-9, time.monotonic() - self.began)

    @property
    def remaining_seconds(self) -> float | None:
        return None if not self.done else (self.total - self.done) / self.throughput


def node_stream(df: DataFrame, label: str | None = None, prop: str | None = None, value=None) -> DataFrame:
    """Nodes (id, labels, properties) with a label and a property's value, to be consumed in batches."""
    if label is not None:
        df = df.where(F.array_contains("labels", label))
    return df if prop is None else df.where(F.col(f"`{prop}`").eqNullSafe(F.lit(value)))


def rel_stream(graph, types: tuple[str, ...] = (), prop: str | None = None, value=None) -> DataFrame:
    """Relationships (id, start, end, typ, properties) of the types with a property's value, to be consumed in batches."""
    df = graph.rels(types, props=True)
    if prop is None:
        return df
    return df.where(F.col(f"`{prop}`").eqNullSafe(F.lit(value))) if prop in df.columns else df.where(F.lit(value is None))


class ItemStream:
    """Nodes and relationships as (kind, row) items, with ("batch_end", number of items so far) behind each `batch` of them and at the end.

    Rows are pulled, a partition ahead, so a slow consumer holds the source
    back. foreach_partition() consumes on the executors instead.
    """

    def __init__(self, nodes: DataFrame | None = None, rels: DataFrame | None = None, batch: int = 100) -> None:
        self.sources, self.batch, self.done = [(k, df) for k, df in (("node", nodes), ("rel", rels)) if df is not None], batch, 0
        self.began, self._total = time.monotonic(), None

    @property
    def total(self) -> int:
        if self._total is None:
            self._total = sum(df.count() for _, df in self.sources)
        return self._total

    def __iter__(self) -> Iterator[tuple[str, Row | int]]:
        self.done, held = 0, 0
        for kind, df in self.sources:
            for row in df.toLocalIterator(prefetchPartitions=True):
                self.done, held = self.done + 1, held + 1
                yield kind, row
                if held == self.batch:
                    held = 0
                    yield "batch_end", self.done
        if held or not self.done:
            yield "batch_end", self.done

    @property
    def progress(self) -> float:
        """Percent."""
        return 100.0 * self.done / self.total if self.total else 100.0

    def collect(self, kind: str | None = None) -> list[Row]:
        """All rows, or those of one kind; for results that a driver can hold."""
        return [row for k, row in self if k != "batch_end" and kind in (None, k)]

    def for_each(self, handle: Callable[[str, Row], None], kind: str | None = None) -> int:
        """Hand every item (of one kind) to handle; how many there were."""
        n = 0
        for k, row in self:
            if k != "batch_end" and kind in (None, k):
                handle(k, row)
                n += 1
        return n

    def foreach_partition(self, handle: Callable[[Iterator[Row]], None]) -> None:
        for _, df in self.sources:
            df.foreachPartition(handle)


class Backpressure:
    """Hands rows in batches to `concurrency` threads; at most `capacity` rows are taken from the source before they are handled."""

    def __init__(self, capacity: int = 1000, concurrency: int = 10, batch: int = 100) -> None:
        self.batch, self.slots, self.workers = batch, threading.BoundedSemaphore(max(1, capacity // batch)), concurrency

    def acquire(self) -> None:
        self.slots.acquire()

    def try_acquire(self) -> bool:
        return self.slots.acquire(blocking=False)

    def release(self) -> None:
        self.slots.release()

    def run(self, rows: Iterable, handle: Callable[[list], None]) -> int:
        """How many rows were handled; the first error of a handler is raised."""
        done, n, source = [], 0, iter(rows)
        with ThreadPoolExecutor(self.workers) as pool:
            while some := list(islice(source, self.batch)):
                self.acquire()
                job = pool.submit(handle, some)
                job.add_done_callback(lambda _: self.release())
                done.append(job)
                n += len(some)
                if len(done) > 4 * self.workers:
                    done.pop(0).result()
        for job in done:
            job.result()
        return n


class BatchProcessor:
    """Collects items and hands them on in lists of `size`."""

    def __init__(self, size: int, handle: Callable[[list], None]) -> None:
        self.size, self.handle, self.items = size, handle, []

    def add(self, item) -> bool:
        """Whether this item filled the batch."""
        self.items.append(item)
        if len(self.items) >= self.size:
            self.flush()
            return True
        return False

    def flush(self) -> None:
        if self.items:
            items, self.items = self.items, []
            self.handle(items)


def ingest(stream: DataFrame, folder: str, checkpoint: str, **trigger):
    """Append a stream of rows to a Parquet table, exactly once by the sink's commit log."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def windowed_events(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Count and value of events per window and type; works on a stream (with a watermark) and on a table. An extension."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", size), "event_type").agg(F.count("ts").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def event_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet", files_per_trigger: int = 1) -> DataFrame:
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", pattern).parquet(folder)


def ingest_nodes(stream: DataFrame, folder: str, checkpoint: str, first_id: int = 0, **trigger):
    """Append a stream of property rows to a node table (id, properties), exactly once: a batch that runs again replaces its own folder."""

    def append(batch: DataFrame, number: int) -> None:
        batch.withColumn("id", F.monotonically_increasing_id() + F.lit(first_id + (number << 46))).select("id", *batch.columns).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def with_streamed(graph, labels: tuple[str, ...], folder: str):
    """The version of a graph that also has what ingest_nodes has written so far."""
    return append_nodes(graph, labels, graph.spark.read.parquet(folder).drop("batch"))
