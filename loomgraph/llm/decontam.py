"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of the benchmark items: WINDOW consecutive words, or
all words of a shorter item. For each pattern length m, blocks of two words at
the search position either are in the shift table, or let the search skip
m - 1 words at once; blocks with shift 0 lead to the bucket of their suffix
hash, whose candidates are compared word by word.
"""

from __future__ import annotations

from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FEW, drop_rows, map_arrow, raw_texts, row_key, written

WINDOW = 10
#: Bytes of benchmark text that one broadcast searcher covers; a larger benchmark is searched in blocks of so much. 2 MB of text make tables of 22 MB pickled, and about 170 MB while they are built.
BLOCK_BYTES = 2 << 20
#: Lower-cases A-Z and turns all bytes that aren't 0-9, a-z or of a non-ASCII character into spaces.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORDS).split()


class Searcher:
    """Wu-Manber tables over word numbers, one set for each pattern length.

    The distinct patterns of a length are rows of one array, in order of their
    last block; a bucket is a range of rows.
    """

    def __init__(self, items: list[tuple[int | None, bytes | None]], window: int = WINDOW) -> None:
        self.number: dict[bytes, int] = {}
        words: dict[int, list[list[int]]] = {}
        owner: dict[int, list[int]] = {}
        for k, (_, text) in enumerate(items):
            w = [self.number.setdefault(x, len(self.number) + 1) for x in words_of(text)]
            m = min(window, len(w))
            if m:
                words.setdefault(m, []).append(w)
                owner.setdefault(m, []).append(k)
        self.ids = [i for i, _ in items]
        self.base = len(self.number) + 1
        self.tables = [self._table(m, words[m], owner[m]) for m in sorted(words)]

    def _table(self, m: int, texts: list[list[int]], owner: list[int]) -> tuple:
        windows = np.concatenate([np.lib.stride_tricks.sliding_window_view(np.array(w, np.int32), m) for w in texts])
        item = np.repeat(np.array(owner, np.int32), [len(w) - m + 1 for w in texts])
        patterns, of = np.unique(windows, axis=0, return_inverse=True)
        b = min(2, m)
        blocks = [patterns[:, end - 1].astype(np.int64) + (patterns[:, end - 2].astype(np.int64) * self.base if b == 2 else 0) for end in range(b, m + 1)]
        order = np.argsort(blocks[-1], kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        pairs = np.unique(np.stack([place[of.ravel()], item], 1), axis=0)  # (pattern, item) once each
        patterns, last = patterns[order], blocks[-1][order]
        shift: dict[int, int] = {}
        for k, block in enumerate(blocks):  # later positions have smaller shifts
            shift.update(dict.fromkeys(np.unique(block).tolist(), m - b - k))
        starts = np.flatnonzero(np.r_[True, last[1:] != last[:-1]])
        buckets = dict(zip(last[starts].tolist(), starts.tolist(), strict=True))
        ends = np.r_[starts[1:], len(last)]
        end_of = np.zeros(len(last), np.int32)
        end_of[starts] = ends
        first_item = np.searchsorted(pairs[:, 0], np.arange(len(patterns) + 1)).astype(np.int32)
        return m, b, shift, buckets, end_of, patterns.astype(np.int32).tobytes(), first_item, pairs[:, 1].astype(np.int32)

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans of words (start, end) inside occurrences, merged and in order, and the items that occur."""
        get, base = self.number.get, self.base
        w = [get(x, 0) for x in words]
        n, spans, found = len(w), [], set()
        for m, b, shift, buckets, end_of, patterns, first_item, items in self.tables:
            at, skip, size = m - 1, m - b + 1, 4 * m
            look = shift.get
            while at < n:
                last = w[at]
                if not last:  # no pattern holds this word, so none covers this position
                    at += m
                    continue
                block = last + w[at - 1] * base if b == 2 else last
                step = look(block, skip)
                if step:
                    at += step
                    continue
                start = at - m + 1
                here = array("i", w[start : at + 1]).tobytes()
                bucket = buckets[block]
                for p in range(bucket, int(end_of[bucket])):
                    if patterns[p * size : (p + 1) * size] == here:
                        spans.append((start, at + 1))
                        found.update(items[first_item[p] : first_item[p + 1]].tolist())
                        break
                at += 1
        spans.sort()
        merged: list[tuple[int, int]] = []
        for s, e in spans:
            if merged and s <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
            else:
                merged.append((s, e))
        return merged, {self.ids[k] for k in found} - {None}


def _blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int):
    """The items in lists of about block_bytes; the driver holds one at a time."""
    rows = items.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).cast("string").alias("t")).where("t IS NOT NULL")
    some, size = [], 0
    for r in rows.toLocalIterator():
        text = r.t.encode()
        some.append((r.i, text))
        size += len(text)
        if size >= block_bytes:
            yield some
            some, size = [], 0
    if some:
        yield some


def mark(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", item_id="item_id", item_text="text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, row, n_words, spans array<struct<s,e>> of hit words, items array<bigint>, sorted), one row for each row of docs.

    row tells rows of one id apart (common.row_key). A benchmark of more than
    block_bytes is searched in blocks, one broadcast after another; what a block
    finds is written to the shared folder without the texts, and the findings
    are put together by row at the end. Windows never cross items, so blocks
    lose none. Null texts have no words; items with null or wordless text match
    nothing; a null item id still marks words, but isn't listed. An empty
    benchmark marks nothing, an empty table has no rows.
    """
    i, key = row_key(id_col, text_col)
    own = docs.select(i.alias("doc_id"), key.alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    send = docs.sparkSession.sparkContext.broadcast
    found: list[DataFrame] = []
    last = None
    for block in _blocks(items, item_id, item_text, block_bytes):
        if last is not None:
            found.append(written(_search(own, send(Searcher(last, window))).where("size(spans) > 0"), "decontamination"))
        last = block
    out = _search(own, send(Searcher(last or [], window)))
    if not found:
        return out
    for more in found[1:]:
        found[0] = found[0].unionByName(more)
    # What several blocks find in a row of docs: only rows with a hit meet here, each with one row for a block at most.
    before = found[0].distinct().groupBy(F.col("doc_id").alias("__i"), F.col("row").alias("__r")).agg(F.flatten(F.collect_list("spans")).alias("__s"), F.flatten(F.collect_list("items")).alias("__t"))
    both = out.join(before, F.col("doc_id").eqNullSafe(F.col("__i")) & (F.col("row") == F.col("__r")), "left")
    none = F.array().cast("array<struct<s:bigint,e:bigint>>")
    spans = F.array_sort(F.concat("spans", F.coalesce("__s", none)))
    merged = F.aggregate(spans, none, lambda a, x: F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["e"] >= x["s"]), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.try_element_at(a, F.lit(-1))["s"].alias("s"), F.greatest(F.try_element_at(a, F.lit(-1))["e"], x["e"]).alias("e"))))).otherwise(F.concat(a, F.array(x))))
    listed = F.array_sort(F.array_distinct(F.concat("items", F.coalesce("__t", F.array().cast("array<bigint>")))))
    return both.select("doc_id", "row", "n_words", merged.alias("spans"), listed.alias("items"))


_MARKED = "doc_id bigint, row bigint, n_words bigint, spans array<struct<s:bigint,e:bigint>>, items array<bigint>"


def _search(own: DataFrame, searcher) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        find, span = searcher.value.find, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
        for b in batches:
            counts, spans, lists = [], [], []
            for text in raw_texts(b.column("text")):
                words = words_of(text)
                got, found = find(words)
                counts.append(len(words))
                spans.append([{"s": s, "e": e} for s, e in got])
                lists.append(sorted(found))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array(counts, pa.int64()), pa.array(spans, span), pa.array(lists, pa.list_(pa.int64()))], ["doc_id", "row", "n_words", "spans", "items"])

    return map_arrow(own, run, _MARKED, FEW)


def report(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    m = mark(docs, items, id_col, text_col, **options)
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x["e"] - x["s"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    m = m.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"))
    return m.withColumn("contaminated", F.col("n_hit") > 0)


def clean(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", item_id="item_id", item_text="text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs without a hit word, columns unchanged, whatever their names.

    A benchmark of one block is searched while the rows stream past; of more,
    the rows that any block hits are dropped by id and text.
    """
    at, send = [c.lower() for c in docs.columns].index(text_col.lower()), docs.sparkSession.sparkContext.broadcast
    blocks = _blocks(items, item_id, item_text, block_bytes)
    first = next(blocks, [])
    second = next(blocks, None)
    if second is not None:
        hit = mark(docs, items, id_col, text_col, item_id, item_text, window, block_bytes).where("size(spans) > 0")
        return drop_rows(docs, hit.select("doc_id", "row"), id_col, text_col)
    searcher = send(Searcher(first, window))

    def run(batches):
        import pyarrow as pa

        find = searcher.value.find
        for b in batches:
            yield b.filter(pa.array([not find(words_of(t))[0] for t in raw_texts(b.column(at))], pa.bool_()))

    return map_arrow(docs, run, docs.schema, FEW)


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, m, array_to_string(w[k : k + m - 1], ' ') AS win FROM (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT m FROM p),
g AS (SELECT doc_id, m, k, array_to_string(w[k : k + m - 1], ' ') AS win FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, lens WHERE len(w) >= m)),
h AS (SELECT g.doc_id, g.m, g.k, p.item_id FROM g JOIN p ON g.m = p.m AND g.win = p.win),
n AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS pos FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(d.w), 0)::BIGINT AS n_words, coalesce(n.n_hit, 0)::BIGINT AS n_hit, coalesce(i.n_items, 0)::BIGINT AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)
"""
