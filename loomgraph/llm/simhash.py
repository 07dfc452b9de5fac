"""SimHash near-duplicates, linked by BK-trees.

Fingerprints that differ in at most RADIUS = 2 of 64 bits agree in at least two
of four 16-bit blocks. So each distinct fingerprint is dealt to six shards, one
for each pair of blocks and their value; every link lies whole in some shard.
A task builds the BK-tree of its shard (children keyed by the integer Hamming
distance to their parent), follows only edges within the radius of a query's
distance, and returns one link per fingerprint, to its root in the shard.

The trees aren't Spark broadcasts: all fingerprints would have to meet all
trees, work that grows with the square of the input. A shard's tree is sent to
one task, with the fingerprints that can be within the radius.
"""

from __future__ import annotations

import functools
import math
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stars import components
from .common import ASCII_LOWER, FEW, cut, drop_rows, fresh, map_arrow, raw_texts, row_key, shuffle_partitions, two_columns, written
from .urlfilter import bloom_blocks, maybe_listed

RADIUS = 2
#: Shards of more fingerprints are dealt again by the rest of their bits.
HOT_SHARD = 4096


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of the lower-cased UTF-8 text, repeats included; of the whole sequence if it has fewer words."""
    import xxhash

    parts = (text or b"").translate(ASCII_LOWER).split()  # bytes.split() cuts at \x20 and \x09-\x0D
    if not parts:
        return np.zeros(0, np.uint64)
    joined, ends, starts, at = b" ".join(parts), [], [], 0
    for p in parts:
        starts.append(at)
        at += len(p) + 1
        ends.append(at - 1)
    if len(parts) > words:
        ends = ends[words - 1 :]
    else:
        starts, ends = [0], [len(joined)]
    of = xxhash.xxh64_intdigest
    return np.fromiter((of(joined[s:e], 42) for s, e in zip(starts, ends)), np.uint64, len(ends))  # noqa: B905 - the last starts have no shingle


def _majority(hashes: np.ndarray) -> bytes:
    """Big-endian 64 bits, each 1 if set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        some = hashes[k : k + (1 << 16)].astype(">u8")
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes)).tobytes()


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """Unsigned 64-bit SimHash of the UTF-8 text's shingles; 0 without words."""
    return int.from_bytes(_majority(shingle_hashes(text, words)), "big")


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text", words: int = 3) -> DataFrame:
    """(doc_id, fp) of every row, fp as signed bigint. Null and wordless texts: 0."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            fps = np.array([fingerprint(t, words) for t in raw_texts(b.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return map_arrow(two_columns(docs, id_col, text_col), run, "doc_id bigint, fp bigint")


class BKTree:
    """Integers under Hamming distance; a node is [value, {distance: child}]."""

    def __init__(self) -> None:
        self.root: list | None = None

    def find(self, value: int, radius: int):
        """The values within radius, one by one."""
        stack = [self.root] if self.root else []
        while stack:
            at, children = stack.pop()
            d = (at ^ value).bit_count()
            if d <= radius:
                yield at
            if children:
                stack += [children[k] for k in range(d - radius, d + radius + 1) if k in children]

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = [value, {}]
            return
        node = self.root
        while (d := (node[0] ^ value).bit_count()) and d in node[1]:
            node = node[1][d]
        if d:
            node[1][d] = [value, {}]

    def add_and_find(self, value: int, radius: int) -> list[int]:
        """The values within radius that were added before; then adds value."""
        found = list(self.find(value, radius))
        self.add(value)
        return found


def shard_links(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """(value, root) for the values of one shard that have a link in it; roots are the smallest of what hangs together."""
    tree, parent = BKTree(), {}

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for v in values:
        if v in parent:
            continue
        parent[v] = v
        for other in tree.add_and_find(v, radius):
            a, b = top(v), top(other)
            parent[max(a, b)] = min(a, b)
    return [(v, r) for v in parent if (r := top(v)) != v]


def links(fps: DataFrame, hot: int = HOT_SHARD) -> DataFrame:
    """(a, b): links among the distinct column `fp` that connect what a distance of RADIUS or less connects."""
    block = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF).cast("bigint")) for i in range(4)]
    pairs = list(combinations(range(4), 2))
    shard = lambda k, i, j: F.struct(F.lit(k).alias("pair"), F.call_function("shiftleft", block[i], F.lit(16)).bitwiseOR(block[j]).alias("value"))
    dealt = fps.select("fp", F.explode(F.array(*[shard(k, i, j) for k, (i, j) in enumerate(pairs)])).alias("s")).select("s.*", "fp")
    sizes = dealt.groupBy("pair", "value").count()
    big = sizes.where(F.col("count") > hot).select("pair", "value", F.lit(True).alias("big"))
    if big.isEmpty():
        dealt = dealt.withColumn("sub", F.lit(-1).cast("bigint"))
    else:  # the other two blocks hold both differing bits: of three parts of them one agrees
        rest = F.lit(None).cast("bigint")
        for k, (i, j) in enumerate(pairs):
            x, y = (z for z in range(4) if z not in (i, j))
            rest = F.when(F.col("pair") == k, F.call_function("shiftleft", block[x], F.lit(16)).bitwiseOR(block[y])).otherwise(rest)
        parts = [F.lit(n << 16).cast("bigint").bitwiseOR(F.shiftrightunsigned(rest, at).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))) for n, (at, bits) in enumerate(((0, 11), (11, 11), (22, 10)))]
        dealt = dealt.join(big, ["pair", "value"], "left").select("pair", "value", "fp", F.explode(F.when(F.col("big"), F.array(*parts)).otherwise(F.array(F.lit(-1).cast("bigint")))).alias("sub"))
    n = shuffle_partitions(fps.sparkSession)
    dealt = dealt.select("pair", "value", "sub", "fp").repartition(n, "pair", "value", "sub").sortWithinPartitions("pair", "value", "sub", "fp")

    def run(batches):
        import pyarrow as pa

        key, values, out = None, [], []

        def flushed(force: bool):
            if out and (force or len(out) > 50_000):
                a = np.array(out, np.uint64).view(np.int64)
                out.clear()
                return pa.RecordBatch.from_arrays([pa.array(a[:, 0].copy()), pa.array(a[:, 1].copy())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            fp = batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
            edge = np.zeros(len(fp), bool)
            for c in cols:
                edge[1:] |= c[1:] != c[:-1]
            starts = [0, *np.flatnonzero(edge).tolist(), len(fp)]
            for s, e in zip(starts, starts[1:], strict=False):
                k = tuple(int(c[s]) for c in cols) if s == 0 or e == len(fp) else (s,)
                if k != key:
                    if len(values) > 1:
                        out += shard_links(values)
                        if (got := flushed(False)) is not None:
                            yield got
                    key, values = k, []
                if e - s > 1 or values or e == len(fp):
                    values += fp[s:e].tolist()
            # A run that ends the batch may go on in the next one.
        if len(values) > 1:
            out += shard_links(values)
        if (got := flushed(True)) is not None:
            yield got

    return map_arrow(dealt, run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", words: int = 3, hot: int = HOT_SHARD) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest id reachable over links.

    Rows with a null id are linked like others and can carry the links on, but
    are never a component's id unless all its ids are null. Repeated rows are
    all returned. Equal fingerprints (copies by the thousands included) count
    once in the link search; nothing grows with the square of a group.
    """
    rows = cut(fingerprints(docs, id_col, text_col, words))
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    roots = components(links(distinct.select("fp"), hot))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_fp = rooted.join(named, "root").select(F.col("fp").alias("__fp"), "component_id")
    return rows.join(by_fp, rows["fp"] == by_fp["__fp"]).select("doc_id", "fp", "component_id")


def hex_fingerprint(c):
    """16 lowercase hex digits of a signed 64-bit column."""
    return F.lower(F.lpad(F.hex(c), 16, "0"))


# Similar documents: wide fingerprints, shards of documents that share least shingle hashes

#: 64-bit words of a wide fingerprint.
WIDE = 4
#: Shards of a document, and least hashes that make the key of one.
BANDS, ROWS = 10, 3
#: Groups of more members, or of more shingles, are dealt into blocks.
HOT_GROUP, HOT_SIZE = 1024, 1 << 22
#: Blocks, of 64 bits, of the Bloom filter that picks the candidates' texts before they move; more candidates make more false positives, which the join removes.
MAX_WORDS = 1 << 18
_ODD = np.random.default_rng(42).integers(1, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


#: Sets of up to so many shingles are counted out: ties of even ones make bits differ more often than the angle says.
SMALL = 24


def differ(a: int, b: int, both: int) -> float:
    """Chance that a bit differs between sets of a and b random hashes that share `both`; a bit is 1 if set in over half."""

    def ones(x: int, n: int) -> float:
        return sum(math.comb(n - both, k) for k in range(n - both + 1) if 2 * (x + k) > n) / 2 ** (n - both)

    return sum(math.comb(both, x) / 2**both * (p * (1 - q) + q * (1 - p)) for x in range(both + 1) for p, q in [(ones(x, a), ones(x, b))])


@functools.cache
def radius_of(similarity: float, bits: int = 64 * WIDE) -> int:
    """Bits within which all but a few in 100,000 pairs of shingle sets of this Jaccard similarity lie: the expected number and four standard deviations, at the sizes where it is largest."""
    small = [differ(a, b, both) for a in range(1, SMALL + 1) for b in range(a, SMALL + 1) for both in range(a + 1) if both >= similarity * (a + b - both)]
    p = max([math.acos(2 * similarity / (1 + similarity)) / math.pi, *small])
    return round(bits * p + 4 * math.sqrt(bits * p * (1 - p)))


def wide_fingerprint(h: np.ndarray) -> bytes:
    """64 * WIDE bits, each 1 if set in over half of the hashes as they are and as WIDE - 1 mixes make them."""
    counts = np.zeros(64 * WIDE, np.int64)
    for at in range(0, len(h), 255):  # as many as a byte counts
        some = h[at : at + 255]
        wide = np.empty((len(some), WIDE), ">u8")
        wide[:, 0] = some
        for k in range(1, WIDE):
            x = (some + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            wide[:, k] = x ^ (x >> np.uint64(31))
        counts += np.unpackbits(wide.view(np.uint8), axis=1).sum(0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(h)).tobytes()


def shard_keys(h: np.ndarray) -> list[int]:
    """BANDS keys, each of ROWS least hashes."""
    import xxhash

    least = np.min([(h[at : at + 4096] * _ODD[:, None]).min(1) for at in range(0, len(h), 4096)], 0).astype("<u8").reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(row.tobytes(), k) - (1 << 63) for k, row in enumerate(least)]


def shingle_set(text: bytes | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    return np.unique(shingle_hashes(text, words))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays without repeats."""
    if not len(a) or not len(b):
        return 0.0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return both / (len(a) + len(b) - both)


def groups_of(values, radius: int, same=lambda v, other: True) -> list[tuple[int, int]]:
    """(id, first id of its group) among (id, wide fingerprint); pairs within the radius for which same() holds make the groups.

    Equal fingerprints belong together. A search ends once it has met all
    groups there are, so a group of near copies costs a step for each.
    """
    tree, owner, order, parent, groups, out = BKTree(), {}, {}, {}, 0, []

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, v in values:
        if v in owner:
            out.append((i, owner[v]))
            continue
        met: set[int] = set()
        if groups:
            for other in tree.find(v, radius):
                if (root := top(other)) not in met and same(v, other):
                    met.add(root)
                    if len(met) == groups:
                        break
        tree.add(v)
        owner[v], order[v] = i, len(order)
        first = min(met, key=order.get, default=v)
        parent[v] = first
        for r in met:
            parent[r] = first
        groups += 1 - len(met)
    return out + [(owner[v], owner[r]) for v in owner if (r := top(v)) != v]


def _each_group(dealt: DataFrame, row, links_of) -> DataFrame:
    """(a, b): links_of(list of row(columns beyond the block's)) for each block of dealt (key, part, other, id, ...)."""
    block = ["key", "part", "other"]
    dealt = dealt.repartition(shuffle_partitions(dealt.sparkSession), *block).sortWithinPartitions(*block, "id")

    def run(batches):
        import pyarrow as pa

        key, values = None, []

        def linked():
            got = links_of(values) if len(values) > 1 else []
            return [pa.RecordBatch.from_arrays([pa.array([x[k] for x in got], pa.int64()) for k in (0, 1)], ["a", "b"])] if got else []

        for batch in batches:
            raw = [raw_texts(c) if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) else c.to_pylist() for c in batch.columns]
            for *k, i, x in zip(*raw, strict=True):
                if k != key:
                    yield from linked()
                    key, values = k, []
                values.append(row(i, x))
        yield from linked()

    return map_arrow(dealt, run, "a bigint, b bigint", FEW)


def _roots_of_groups(members: DataFrame, row, links_of, hot: int, hot_size: int, read=lambda placed: placed) -> DataFrame:
    """(node, root) over the links that links_of finds within the groups of members (key, id, size, ...).

    row(id, x) makes what links_of takes; x is a fourth column of members, or
    what read() joins to them once they are placed.

    A group of up to `hot` members, of up to `hot_size` together, is one block.
    A larger one is dealt into blocks by a hash of the id, all of which get its
    pivot, the member of least id. What isn't joined to the pivot by then, over
    whatever links, is the rest: it meets every block, in blocks of its own if
    it is large too. So each pair is either joined already or meets in a block,
    no task holds more than two blocks, and only the rest is sent more than
    once. Rows sent for a group: its members times the blocks of its rest.
    """

    more = [c for c in members.columns if c not in ("key", "id", "size")]

    def run(placed: DataFrame) -> DataFrame:
        return _each_group(read(placed), row, links_of)

    def blocks(n: str, size: str):
        return F.greatest(F.ceil(F.col(n) / hot), F.ceil(F.col(size) / hot_size)).cast("int").alias("blocks")

    def block(of: str):
        return F.pmod(F.xxhash64("id"), F.col(of)).cast("int")

    def upto(of: str):
        return F.sequence(F.lit(0), F.col(of) - 1)

    zero = F.lit(0)
    large = cut(members.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.min("id").alias("pivot")).where((F.col("n") > hot) | (F.col("size") > hot_size) & (F.col("n") > 1)).select("key", blocks("n", "size"), "pivot"))
    if large.isEmpty():
        return components(run(members.select("key", zero.alias("part"), zero.alias("other"), "id", *more)))
    first = members.join(large, "key", "left").select("key", F.explode(F.when(F.col("blocks").isNull(), F.array(zero)).when(F.col("id") == F.col("pivot"), upto("blocks")).otherwise(F.array(block("blocks")))).alias("part"), zero.alias("other"), "id", *more)
    links_ = cut(run(first))
    roots = components(links_)
    pivots = large.join(roots.withColumnsRenamed({"node": "pivot", "root": "main"}), "pivot", "left").select("key", "blocks", F.coalesce("main", "pivot").alias("main"))
    held = members.join(pivots, "key").join(roots.withColumnRenamed("node", "id"), "id", "left")
    held = cut(held.select("key", "id", "size", "blocks", *more, (F.coalesce("root", "id") != F.col("main")).alias("rest")))
    if held.where("rest").isEmpty():
        return roots
    rests = held.where("rest").groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("size")).select("key", blocks("n", "size").alias("others"))
    cell = lambda part, other: F.struct(part.alias("part"), other.alias("other"))
    across = F.transform(upto("others"), lambda k: cell(block("blocks"), k))
    along = F.when(F.col("rest"), F.transform(upto("blocks"), lambda k: cell(k, block("others")))).otherwise(F.slice(across, 1, 0))
    second = held.join(rests, "key").select("key", F.explode(F.array_union(across, along)).alias("c"), "id", *more).select("key", "c.part", "c.other", "id", *more)
    return components(links_.unionByName(run(second)))


def _similar(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float, hot: int, hot_size: int) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): rows (doc_id, row, unit) of docs, unit null without words; groups (unit, root), one row per distinct shingle fingerprint."""

    def signed(batches):
        import pyarrow as pa

        for b in batches:
            got = [(wide_fingerprint(h), shard_keys(h) if len(h) else [], len(h)) for h in (shingle_set(t, words) for t in raw_texts(b.column("text")))]
            kinds = pa.binary(), pa.list_(pa.int64()), pa.int64()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), *(pa.array([x[k] for x in got], kind) for k, kind in enumerate(kinds))], ["doc_id", "row", "fp", "keys", "size"])

    radius = radius_of(similarity)
    i, key = row_key(id_col, text_col)
    own = docs.select(i.alias("doc_id"), key.alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = cut(map_arrow(own, signed, "doc_id bigint, row bigint, fp binary, keys array<bigint>, size bigint", FEW))
    linked = rows.where("size > 0")
    # A number for each distinct fingerprint, which the written table keeps; the row that stands for it is read again by its key.
    units = linked.groupBy("fp").agg(F.min_by(F.struct("doc_id", "row", "keys", "size"), F.struct("size", "doc_id", "row")).alias("of")).select("fp", "of.*")
    units = cut(units.withColumn("unit", F.monotonically_increasing_id()))
    shards = units.select(F.explode("keys").alias("key"), F.col("unit").alias("id"), F.lit(0).alias("size"), "fp")
    near = _roots_of_groups(shards, lambda i, fp: (i, int.from_bytes(fp, "big")), lambda values: groups_of(values, radius), hot, 1)
    members = cut(near.join(units.select(F.col("unit").alias("id"), "size"), F.col("node") == F.col("id")).select(F.col("root").alias("key"), "id", "size"))
    # The texts of the candidates, read and written once. Their keys grow with the input, so they meet the texts by a shuffle; a filter of bounded size, which is all that is broadcast, keeps other texts out of it.
    wanted = cut(units.join(members.select(F.col("id").alias("unit")), "unit", "left_semi").select("unit", F.col("doc_id").alias("__i"), F.col("row").alias("__r")))
    size = min(MAX_WORDS, 1 << max(4, (wanted.count() // 4).bit_length()))
    some = maybe_listed(own.withColumn("key", F.col("row")), bloom_blocks(wanted.select(F.col("__r").alias("key")), size), size).where("key IS NOT NULL")
    same_id = F.coalesce(F.col("doc_id") == F.col("__i"), F.col("doc_id").isNull() & F.col("__i").isNull())  # no key of the join, so that its shuffle serves the grouping too
    texts = some.join(wanted, (F.col("row") == F.col("__r")) & same_id).groupBy("row", "unit").agg(F.first("text").alias("text"))  # repeated rows once
    texts = written(texts.select("unit", "text"), "candidates")

    def compared(i, text):
        h = shingle_set(text, words)
        return i, int.from_bytes(wide_fingerprint(h), "big"), h

    def verified(values):
        sets = {v: h for _, v, h in values}
        return groups_of(((i, v) for i, v, _ in values), radius, lambda v, other: jaccard(sets[v], sets[other]) >= similarity)

    def read(placed: DataFrame) -> DataFrame:
        return placed.join(texts, placed["id"] == texts["unit"]).select(*placed.columns, "text")

    roots = _roots_of_groups(members, compared, verified, hot, hot_size, read)
    groups = units.join(roots, units["unit"] == roots["node"], "left").select("fp", "unit", F.coalesce("root", "unit").alias("root"))
    by_fp = groups.select(F.col("fp").alias("__fp"), "unit", "root")
    placed = linked.join(by_fp, linked["fp"] == by_fp["__fp"]).select("doc_id", "row", "unit", "root")
    return placed.unionByName(rows.where("size = 0").select("doc_id", "row"), allowMissingColumns=True), groups


def similar(docs: DataFrame, id_col="doc_id", text_col="text", words: int = 5, similarity: float = 0.8, hot: int = HOT_GROUP, hot_size: int = HOT_SIZE) -> DataFrame:
    """(doc_id, component_id) of every row; documents link whose shingle sets have a Jaccard similarity of `similarity` or more.

    A departure from plain SimHash, which no radius makes exact at such
    similarities: the shards of the trees are named by least hashes, and shingle
    sets decide. A document goes to BANDS shards, each named by ROWS least
    hashes of its shingles: two documents of similarity s share a shard with
    probability 1 - (1 - s^ROWS)^BANDS (0.999 at 0.8), whatever the size of the
    corpus. In a shard a BK-tree of wide fingerprints finds what lies within
    radius_of(similarity). Only documents with such a candidate are read
    again: trees over each group of candidates compare their shingle sets.
    Large shards and groups are dealt into blocks (_roots_of_groups), and the
    texts of all candidates are written once for that.

    Groups are what links connect, so two documents of one need not be similar
    themselves. component_id is the smallest id of a group, null where all its
    ids are null. Texts without words link to nothing and are their own
    component. Rows that share an id but not a text are different documents.
    Rows of equal fingerprints are one node, so copies count once before
    anything moves. An empty table gives none.
    """
    rows, _ = _similar(docs, id_col, text_col, words, similarity, hot, hot_size)
    rows = cut(rows)
    named = rows.where("root IS NOT NULL").groupBy(F.col("root").alias("__root")).agg(F.min("doc_id").alias("component_id"))
    linked = rows.where("root IS NOT NULL").join(named, F.col("root") == F.col("__root")).select("doc_id", "component_id")
    return linked.unionByName(rows.where("root IS NULL").select("doc_id", F.col("doc_id").alias("component_id")))


def unique(docs: DataFrame, id_col="doc_id", text_col="text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each group of similar ones, columns unchanged: the one with the smallest id, a null id only where there is no other.

    Of documents with equal ids the one of least row_key stays. Rows are
    dropped by id and text together, so a document that shares its id with a
    copy of another isn't lost. Rows that repeat id and text are one document,
    and one row of them stays (any one).
    """
    rows, _ = _similar(docs, id_col, text_col, words, similarity, HOT_GROUP, HOT_SIZE)
    rows = cut(rows)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    best = rows.where("root IS NOT NULL").groupBy(F.col("root").alias("__root")).agg(F.min(rank).alias("best"))
    gone = rows.where("root IS NOT NULL").join(best, F.col("root") == F.col("__root")).where(~(F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("row") == F.col("best.row")))).select("doc_id", "row")
    kept = drop_rows(docs, gone, id_col, text_col)
    again = rows.groupBy(F.col("doc_id").alias("__i"), F.col("row").alias("__r")).agg(F.count("row").alias("n")).where("n > 1").select("__i", "__r")
    if again.isEmpty():
        return kept
    names = fresh(docs, "__own_id", "__own_row")
    keyed = kept.withColumns(dict(zip(names, row_key(id_col, text_col), strict=True)))
    on = F.col(names[0]).eqNullSafe(F.col("__i")) & (F.col(names[1]) == F.col("__r"))
    both = keyed.join(again, on, "left_anti").unionByName(keyed.join(again, on, "left_semi").dropDuplicates(names))
    return both.select(*[F.col(f"`{c}`") for c in docs.columns])
