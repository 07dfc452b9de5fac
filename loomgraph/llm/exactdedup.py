"""Exact duplicates by Patricia-trie owners.

Each input partition first inserts its normalised texts into a compressed
radix trie of its own, so a text that fills a third of the table leaves every
partition once. What is left moves to partitions by length and content hash,
where full byte strings go into a trie again; a terminal node is the owner of
its text and keeps the smallest or largest identifier and the count.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, FEW, ascii_lower, fresh, map_arrow, raw_texts, shuffle_partitions, two_columns

#: Bytes of strings that one trie holds before it spills a subtree.
TRIE_BYTES = 64 << 20


class Patricia:
    """Compressed radix trie over byte strings; a node is [label, children by first byte, value].

    Beyond max_bytes of labels the largest subtree goes to a temporary file.
    Its place is kept by a node without label, whose value is the file; later
    strings of that subtree go there, and items() builds it when its turn comes.
    """

    def __init__(self, merge, max_bytes: int = TRIE_BYTES) -> None:
        self.merge, self.max_bytes = merge, max_bytes
        self.root: list = [b"", {}, None]
        self.bytes = self.spills = 0

    def insert(self, key: bytes, value) -> None:
        node, rest = self.root, key
        while rest:
            child = node[1].get(rest[0])
            if child is None:
                node[1][rest[0]] = [rest, {}, value]
                self.bytes += len(rest)
                if self.bytes > self.max_bytes:
                    self._spill()
                return
            label = child[0]
            if label is None:
                pickle.dump((rest[1:], value), child[2])
                return
            if rest.startswith(label):
                node, rest = child, rest[len(label) :]
                continue
            lo, hi = 0, min(len(label), len(rest))  # the longest common prefix, by halving
            while lo < hi:
                mid = (lo + hi + 1) // 2
                lo, hi = (mid, hi) if label[:mid] == rest[:mid] else (lo, mid - 1)
            middle = [label[:lo], {label[lo]: child}, None]
            child[0] = label[lo:]
            node[1][rest[0]] = middle
            node, rest = middle, rest[lo:]
        node[2] = value if node[2] is None else self.merge(node[2], value)

    def _spill(self) -> None:
        node = self.root
        while len(live := [(b, c) for b, c in node[1].items() if c[0] is not None]) == 1:
            node = live[0][1]
        if not live:  # one chain of prefixes, no longer than its longest string
            return
        sizes = {b: self._size(c) for b, c in live}
        first = max(sizes, key=sizes.get)
        file = tempfile.TemporaryFile()
        for key, value in self._walk(node[1][first]):
            pickle.dump((key[1:], value), file)
        node[1][first] = [None, {}, file]
        self.bytes -= sizes[first]
        self.spills += 1

    @staticmethod
    def _size(node: list) -> int:
        total, stack = 0, [node]
        while stack:
            label, children, _ = stack.pop()
            total += len(label or b"")
            stack += children.values()
        return total

    def _walk(self, node: list):
        stack = [(b"", 0, node)]
        while stack:
            above, byte, (label, children, value) = stack.pop()
            if label is None:
                above += bytes([byte])
                value.seek(0)
                sub = Patricia(self.merge, self.max_bytes)
                while True:
                    try:
                        sub.insert(*pickle.load(value))
                    except EOFError:
                        break
                value.close()
                for key, v in sub.items():
                    yield above + key, v
                continue
            here = above + label
            if value is not None:
                yield here, value
            stack += [(here, b, c) for b, c in children.items()]

    def items(self):
        """Each inserted string once, with its merged value; empties the trie."""
        root, self.root, self.bytes = self.root, [b"", {}, None], 0
        yield from self._walk(root)


def _merge(best):
    def both(a, b):
        ids = [x for x in (a[0], b[0]) if x is not None]
        return (best(ids) if ids else None, a[1] + b[1])

    return both


def owners(docs: DataFrame, keep: str = "max", trie_bytes: int = TRIE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(rows, owners): rows (doc_id, sha) of docs (doc_id, text); owners (sha, keep_id, group_size), one row per distinct text."""
    best = {"max": max, "min": min}[keep]

    def digest(batches):
        import pyarrow as pa

        for b in batches:
            sha = [hashlib.sha256((t or b"").translate(ASCII_LOWER)).digest() for t in raw_texts(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sha, pa.binary())], ["doc_id", "sha"])

    schema = "len bigint, sha binary, text binary, keep_id bigint, n bigint"

    def out_of(pairs):
        import pyarrow as pa

        some, size = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([f(*x) for x in some], t) for f, t in ((lambda k, v: len(k), pa.int64()), (lambda k, v: hashlib.sha256(k).digest(), pa.binary()), (lambda k, v: k, pa.binary()), (lambda k, v: v[0], pa.int64()), (lambda k, v: v[1], pa.int64()))], ["len", "sha", "text", "keep_id", "n"])

        for pair in pairs:
            some.append(pair)
            size += len(pair[0])
            if size > 8 << 20 or len(some) >= 10_000:
                yield batch()
                some, size = [], 0
        if some:
            yield batch()

    def local(batches):
        trie = Patricia(_merge(best), trie_bytes)
        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), raw_texts(b.column("text")), strict=True):
                trie.insert((t or b"").translate(ASCII_LOWER), (i, 1))
            if trie.bytes > trie_bytes // 2:  # what a partition has gathered goes on; owners merge it
                yield from out_of(trie.items())
                trie = Patricia(_merge(best), trie_bytes)
        yield from out_of(trie.items())

    def own(batches):
        """Texts come by length: one trie holds a task's texts of a length, and spills beyond trie_bytes."""
        import pyarrow as pa

        key, trie, ready = None, None, []

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*ready, strict=True), (pa.binary(), pa.int64(), pa.int64()), strict=True)], ["sha", "keep_id", "group_size"])
            ready.clear()
            return out

        def done():
            for text, v in trie.items() if trie else ():
                ready.append((hashlib.sha256(text).digest(), *v))
                if len(ready) >= 10_000:
                    yield batch()

        for b in batches:
            for n, text, i, count in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if n != key:
                    yield from done()
                    key, trie = n, Patricia(_merge(best), trie_bytes)
                trie.insert(text, (i, count))
        yield from done()
        if ready:
            yield batch()

    n = shuffle_partitions(docs.sparkSession)
    moved = map_arrow(docs, local, schema).repartition(n, "len", "sha").sortWithinPartitions("len").select("len", "text", "keep_id", "n")
    return map_arrow(docs, digest, "doc_id bigint, sha binary"), map_arrow(moved, own, "sha binary, keep_id bigint, group_size bigint")


def duplicates(docs: DataFrame, id_col="doc_id", text_col="text", keep: str = "max", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row, dropped ones too.

    Null texts count as empty and are one group. A null id never is the one
    that stays, unless all of its group are null (then keep_id is null and all
    of them stay). Rows that repeat an id and its text are all counted, and all
    stay if the id does. text_sha256 is of the normalised text.
    """
    rows, own = owners(two_columns(docs, id_col, text_col), keep, trie_bytes)
    out = rows.join(own.withColumnRenamed("sha", "__sha"), F.col("sha") == F.col("__sha"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def unique(docs: DataFrame, id_col="doc_id", text_col="text", keep: str = "max", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row of docs for each distinct text (A-Z lower-cased, null as empty), columns unchanged: the one of the largest (or smallest) id.

    A null id stays only where the whole group has none. Of rows with equal id
    and text, repeated rows included, the one whose other columns have the
    smallest hash stays, so nothing depends on the order of rows and nothing is
    dropped for its id alone. Whole rows move, each partition's owners only,
    and the owners in each partition of lengths and content hashes, whose rows
    come in order of these, are the result: no join back. An empty table gives none.
    """
    at, names = [c.lower() for c in docs.columns].index(text_col.lower()), fresh(docs, "__len", "__sha", "__id", "__tie")
    sign = 1 if keep == "max" else -1
    text = ascii_lower(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    i = F.col(f"`{id_col}`").cast("bigint")
    own = (F.octet_length(text).cast("bigint"), F.sha2(text, 256), i, F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if not kind.startswith("map")]))
    keyed = docs.select(*[F.col(f"`{c}`") for c in docs.columns], *[c.alias(n) for c, n in zip(own, names, strict=True)])

    def ranked(b):
        """(row, text, rank): what the trie keeps of a text is its largest rank, and where that row is."""
        k = b.num_columns - 4
        for row, (t, j, tie) in enumerate(zip(raw_texts(b.column(at)), b.column(k + 2).to_pylist(), b.column(k + 3).to_pylist(), strict=True)):
            yield row, (t or b"").translate(ASCII_LOWER), (j is not None, sign * (j or 0), -tie)

    def run(batches):
        """Owners among what comes, a chunk at a time; the last text's owner goes on to the next chunk, as its run may."""
        import pyarrow as pa

        def owned(last):
            rows: dict[int, list[int]] = {}
            on = None
            for t, (*_, batch, row) in trie.items():
                if t == last:
                    on = held[batch].take(pa.array([row]))
                else:
                    rows.setdefault(batch, []).append(row)
            return [held[k].take(pa.array(sorted(rows[k]))) for k in sorted(rows)], on

        held, size, trie = [], 0, Patricia(max, trie_bytes)
        for b in batches:
            for row, t, rank in ranked(b):
                trie.insert(t, (*rank, len(held), row))
            held.append(b)
            size += b.nbytes
            if size > trie_bytes // 2 and b.num_rows:
                out, on = owned(t)
                yield from out
                held, size, trie = [on], on.nbytes, Patricia(max, trie_bytes)
                for row, t, rank in ranked(on):
                    trie.insert(t, (*rank, 0, row))
        yield from owned(None)[0]

    n = shuffle_partitions(docs.sparkSession)
    moved = map_arrow(keyed, run, keyed.schema, FEW).repartition(n, *names[:2]).sortWithinPartitions(*names[:2])
    return map_arrow(moved, run, keyed.schema, FEW).select(*[F.col(f"`{c}`") for c in docs.columns])


SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, (count(*) OVER (PARTITION BY t))::BIGINT AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
