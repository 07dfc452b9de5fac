"""Substring deduplication by hashing lines and the clauses in them.

A unit is a line, cut again after `.`, `!`, `?`, `,`, `;` or `:` before white
space, so that a passage is also found in the middle of a longer line or
sentence. Units are normalised (lower case, one space between words) and
hashed; each digest's earliest occurrence, by id, text and then position, stays
and the others are repeats. Neighbouring repeats, with nothing but white space
between them, are one run with its offsets in the original text; every run of
min_words or more is removed.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import FEW, cut, fresh, map_arrow, row_key, shuffle_partitions, written

#: Words of the shortest run that the query removes; shorter repeats are ordinary phrases (README).
PASSAGE_WORDS = 20
_ENDS = re.compile(r"[.!?,;:](?=\s)|\n")


def units_of(text: str):
    """(start, end, words, normalised) of each unit with a word; offsets in characters, white space around left out."""
    at = 0
    for end in [*(m.end() for m in _ENDS.finditer(text)), len(text)]:
        unit = text[at:end]
        words = unit.lower().split()
        if words:
            yield at + len(unit) - len(unit.lstrip()), at + len(unit.rstrip()), len(words), " ".join(words)
        at = end


_PLACE = ["none", "doc", "row", "at"]  # ranks occurrences: documents without an id last
_UNIT = ["d1", "d2", "part", *_PLACE, "start", "end", "n"]
_UNIT_SCHEMA = "d1 bigint, d2 bigint, part int, none int, doc bigint, row bigint, at int, start int, `end` int, n int"
#: A digest met OFTEN times among the CHUNK units or so that are hashed at once is dealt into PARTS parts there, by place.
CHUNK, OFTEN, PARTS = 50_000, 8, 64
#: Owners of dealt digests that are broadcast at most (40 bytes each); more are joined by shuffle.
MAX_OWNERS = 500_000


def _units(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every unit with its digest and place. Part 0 but for digests that are frequent in a chunk: their units have parts 1..PARTS, and the earliest stands for them in part 0 with n = 0."""
    i, key = row_key(id_col, text_col)
    own = docs.select(i.alias("doc_id"), key.alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def dealt(rows):
        import pyarrow as pa

        d, rest = np.array([x[:2] for x in rows], np.int64), np.array([x[2:] for x in rows], np.int64)
        order = np.lexsort((*rest[:, 3::-1].T, d[:, 1], d[:, 0]))
        d, rest = d[order], rest[order]
        new = np.r_[True, (d[1:] != d[:-1]).any(1)]
        starts = np.flatnonzero(new)
        often = np.diff(np.r_[starts, len(d)]) >= OFTEN
        part = np.where(often[np.cumsum(new) - 1], 1 + (rest[:, 2] ^ rest[:, 3]) % PARTS, 0)
        first = starts[often]
        d, part, rest = np.r_[d, d[first]], np.r_[part, np.zeros(len(first), np.int64)], np.r_[rest, rest[first] * [1, 1, 1, 1, 1, 1, 0]]
        kinds = [pa.int64()] * 2 + [pa.int32()] * 2 + [pa.int64()] * 2 + [pa.int32()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c).cast(k) for c, k in zip([d[:, 0], d[:, 1], part, *rest.T], kinds, strict=True)], _UNIT)

    def run(batches):
        import xxhash

        rows: list[tuple] = []
        for b in batches:
            for i, r, text in zip(b.column("doc_id").to_pylist(), b.column("row").to_pylist(), b.column("text").to_pylist(), strict=True):
                none, i = int(i is None), i or 0
                for at, (s, e, n, unit) in enumerate(units_of(text or "")):
                    d = xxhash.xxh3_128_intdigest(unit.encode("utf-8", "surrogatepass"))
                    rows.append(((d >> 64) - (1 << 63), (d & 0xFFFFFFFFFFFFFFFF) - (1 << 63), none, i, r, at, s, e, n))
                if len(rows) >= CHUNK:
                    yield dealt(rows)
                    rows = []
        if rows:
            yield dealt(rows)

    return map_arrow(own, run, _UNIT_SCHEMA, FEW)


def _after_first(batches):
    """From units in order of digest, part and place: (kind 0) those of part 0 behind the first, with its place; (1) those of other parts; (2) the first of each digest that has such parts."""
    import pyarrow as pa

    first = None  # digest and place of the group that is open
    for b in batches:
        if not b.num_rows:
            continue
        x = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(10)], 1)
        yield from (pa.RecordBatch.from_arrays([pa.array(np.full(len(y), kind), pa.int32()), *[pa.array(c) for c in y.T]], _FOUND) for kind, y in _split(x, first) if len(y))
        zero = x[x[:, 2] == 0]
        if len(zero):
            last = zero[-1]
            same = zero[(zero[:, :2] == last[:2]).all(1)]
            if first is None or (first[:2] != last[:2]).any():
                first = np.r_[last[:2], same[0][3:7]]


_FOUND = ["kind", "d1", "d2", "part", *_PLACE, "start", "end", "n", "f_none", "f_doc", "f_row", "f_at"]
_FOUND_SCHEMA = ", ".join(f"`{c}` {'int' if c == 'kind' else 'bigint'}" for c in _FOUND)


def _split(x, first):
    zero, more = x[x[:, 2] == 0], x[x[:, 2] > 0]
    if len(zero):
        new = np.r_[first is None or bool((zero[0, :2] != first[:2]).any()), (zero[1:, :2] != zero[:-1, :2]).any(1)]
        at = np.cumsum(new) - (1 if new[0] else 0)
        starts = zero[new][:, 3:7]
        of = (starts if new[0] else np.vstack([first[None, 2:], starts]))[at]
        stands = zero[:, 9] == 0
        later = ~stands & (zero[:, 3:7] != of).any(1)
        yield 0, np.hstack([zero[later], of[later]])
        yield 2, np.hstack([zero[stands], of[stands]])
    yield 1, np.hstack([more, np.zeros((len(more), 4), np.int64)])


def repeats(docs: DataFrame, id_col="doc_id", text_col="text", min_words: int = 1) -> DataFrame:
    """(doc_id, start, end, n_words, first_doc_id, row): one row per removed run, offsets in characters of the original text.

    first_doc_id is the document that keeps the run's first unit; row tells
    rows of one id apart (common.row_key). Documents are ranked by id, then by
    row; those without an id come last. Rows that repeat id and text are one
    document. Null, empty and wordless texts have no units; an empty table has
    no runs.

    Units move once, to the digest they have, and stream past in order, so no
    group is held. A digest that is frequent somewhere is dealt into parts by
    place there; only its earliest unit of each chunk meets the others, and
    the parts learn their owner from it in a second, salted join.
    """
    spark = docs.sparkSession
    n, order = shuffle_partitions(spark), ["d1", "d2", "part", *_PLACE]
    found = _units(docs, id_col, text_col).repartition(n, "d1", "d2", "part").sortWithinPartitions(*order)
    found = written(map_arrow(found, _after_first, _FOUND_SCHEMA), "repeats")
    place, first = F.struct(*_PLACE), F.struct(*[F.col(f"f_{c}").alias(c) for c in _PLACE])
    rest = ["none", "doc", "row", "at", "start", "end", "n"]
    owners = found.where("kind = 2").groupBy(F.col("d1").alias("o1"), F.col("d2").alias("o2")).agg(F.min(first).alias("first"))
    dealt = found.where("kind = 1")
    on = (F.col("d1") == F.col("o1")) & (F.col("d2") == F.col("o2"))
    if (known := cut(owners)).count() <= MAX_OWNERS:
        dealt = dealt.join(F.broadcast(known), on)
    else:
        dealt = dealt.join(known.withColumn("p", F.explode(F.sequence(F.lit(1), F.lit(PARTS)))), on & (F.col("part") == F.col("p")))
    again = found.where("kind = 0").select(*rest, first.alias("first")).unionByName(dealt.where(place != F.col("first")).select(*rest, "first"))
    mine = ["none", "doc", "row"]
    again = again.repartition(n, *mine).dropDuplicates([*mine, "at"])
    by_doc = Window.partitionBy(*mine).orderBy("at")
    runs = again.withColumn("run", F.col("at") - F.row_number().over(by_doc)).groupBy(*mine, "run")
    runs = runs.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n_words"), F.min_by(F.struct("first.none", "first.doc"), "at").alias("of"))
    known_id = lambda none, doc: F.when(F.col(none) == 0, F.col(doc))
    return runs.where(F.col("n_words") >= min_words).select(known_id("none", "doc").alias("doc_id"), F.col("start").cast("int"), F.col("end").cast("int"), "n_words", known_id("of.none", "of.doc").alias("first_doc_id"), "row")


def clean(docs: DataFrame, runs: DataFrame, id_col="doc_id", text_col="text", spans_col: str = "removed_spans") -> DataFrame:
    """docs with the runs cut out of text_col, and spans_col array<struct<start,end>> of offsets in the original text.

    Runs meet their own row by id and text, so rows that share an id lose
    nothing of each other's. A column spans_col that docs has already is an
    error; other names can't clash.
    """
    if spans_col.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the input has a column {spans_col}")
    held, i_, r_ = fresh(docs, "__spans", "__run_id", "__run_row")
    spans = runs.groupBy(F.col("doc_id").alias(i_), F.col("row").alias(r_)).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(held))  # a document's own runs
    i, key = row_key(id_col, text_col)
    text, spans_ = F.col(f"`{text_col}`"), F.col(held)
    before = F.transform(spans_, lambda x, k: F.substring(text, F.when(k > 0, F.try_element_at(spans_, k)["end"]).otherwise(0) + 1, x["start"] - F.when(k > 0, F.try_element_at(spans_, k)["end"]).otherwise(0)))
    tail = F.substring(text, F.element_at(spans_, -1)["end"] + 1, F.length(text))
    kept = F.when(spans_.isNotNull(), F.concat(F.array_join(before, ""), tail)).otherwise(text)
    out = docs.join(spans, i.eqNullSafe(F.col(i_)) & (key == F.col(r_)), "left")
    return out.withColumns({text_col: kept, spans_col: F.coalesce(spans_, F.array().cast("array<struct<start:int,end:int>>"))}).drop(held, i_, r_)
