"""Token ids in binary files of shuffled planes.

File: MAGIC, then blocks, document index, block index, footer (JSON), length of
the footer (4 bytes, little-endian), MAGIC. A block has BLOCK ids (the last one
fewer), transposed into 4 byte planes or 32 bit planes, lowest first; each
plane is compressed by zstandard, and an all-zero plane has no bytes. The block
index holds for each block its offset, number of ids, and lengths of planes;
the document index the ids of the documents and how many token ids each has.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from array import array
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, raw_texts, scratch, shuffle_partitions, two_columns
from .prefixbpe import Recent, groups, letter_table, lowers_letters, plain

MAGIC = b"LGPLANE1"
BLOCK = 1 << 16
CACHE = 400_000
END_ID = 2
#: Ids after which a task begins its next file; a file's indexes are held while it is written or read.
FILE_IDS = 1 << 28


def split_planes(ids: np.ndarray, mode: str) -> list[bytes]:
    """Byte or bit planes of unsigned 32-bit ids, lowest first."""
    data = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if mode == "byte":
        return [data[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(data, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def join_planes(planes: list[bytes], n: int, mode: str) -> np.ndarray:
    """The n ids of split_planes; an empty plane is all zeros."""
    if mode == "byte":
        data = np.zeros((n, 4), np.uint8)
        for k, p in enumerate(planes):
            if p:
                data[:, k] = np.frombuffer(p, np.uint8)
    else:
        bits = np.zeros((n, 32), np.uint8)
        for k, p in enumerate(planes):
            if p:
                bits[:, k] = np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little")
        data = np.packbits(bits, axis=1, bitorder="little")
    return data.reshape(-1).view("<u4")


class PlaneWriter:
    """Streams documents into one file; holds one block and the index."""

    def __init__(self, out, mode: str = "byte", level: int = 3) -> None:
        import zstandard

        self.out, self.mode, self.pack = out, mode, zstandard.ZstdCompressor(level=level).compress
        self.buffer, self.held, self.at, self.blocks = [], 0, len(MAGIC), []
        self.doc_ids: list[int | None] = []
        self.sizes: list[int] = []
        self.ids = 0
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """Append one document; ids are little-endian unsigned 32-bit integers."""
        self.doc_ids.append(doc_id)
        self.sizes.append(len(ids) // 4)
        self.ids += len(ids) // 4
        self.buffer.append(ids)
        self.held += len(ids)
        if self.held >= 4 * BLOCK:
            data = b"".join(self.buffer)
            whole = len(data) // (4 * BLOCK) * 4 * BLOCK
            for k in range(0, whole, 4 * BLOCK):
                self._block(data[k : k + 4 * BLOCK])
            self.buffer, self.held = [data[whole:]], len(data) - whole

    def _block(self, data: bytes) -> None:
        planes = [self.pack(p) if p.count(0) < len(p) else b"" for p in split_planes(np.frombuffer(data, "<u4"), self.mode)]
        self.blocks.append([self.at, len(data) // 4, *map(len, planes)])
        for p in planes:
            self.out.write(p)
            self.at += len(p)

    def close(self) -> dict:
        if self.held:
            self._block(b"".join(self.buffer))
        index = {
            "doc_ids": np.array([i or 0 for i in self.doc_ids], "<i8").tobytes(),
            "null_ids": np.packbits([i is None for i in self.doc_ids]).tobytes(),
            "sizes": np.array(self.sizes, "<u8").tobytes(),
            "blocks": np.array(self.blocks, "<u8").tobytes(),
        }
        footer = {"mode": self.mode, "block": BLOCK, "docs": len(self.sizes), "ids": sum(self.sizes), "n_blocks": len(self.blocks), "at": {}}
        for name, raw in index.items():
            packed = self.pack(raw)
            footer["at"][name] = [self.at, len(packed)]
            self.out.write(packed)
            self.at += len(packed)
        end = json.dumps(footer).encode()
        self.out.write(end + struct.pack("<I", len(end)) + MAGIC)
        return footer


class PlaneReader:
    """Reads a file by its indexes; `file` needs seek and read."""

    def __init__(self, file, size: int) -> None:
        import zstandard

        self.file, self.unpack = file, zstandard.ZstdDecompressor().decompress
        file.seek(size - 12)
        n, magic = struct.unpack("<I8s", file.read(12))
        if magic != MAGIC:
            raise ValueError("not a plane file")
        file.seek(size - 12 - n)
        self.footer = json.loads(file.read(n))
        planes = 4 if self.footer["mode"] == "byte" else 32
        self.doc_ids = np.frombuffer(self._index("doc_ids"), "<i8")
        self.null_ids = np.unpackbits(np.frombuffer(self._index("null_ids"), np.uint8), count=len(self.doc_ids)).astype(bool)
        self.sizes = np.frombuffer(self._index("sizes"), "<u8").astype(np.int64)
        self.blocks = np.frombuffer(self._index("blocks"), "<u8").astype(np.int64).reshape(-1, 2 + planes)

    def _index(self, name: str) -> bytes:
        at, n = self.footer["at"][name]
        self.file.seek(at)
        return self.unpack(self.file.read(n))

    def block(self, k: int) -> np.ndarray:
        """Ids of the k-th block."""
        at, n, *lengths = self.blocks[k].tolist()
        self.file.seek(at)
        return join_planes([self.unpack(self.file.read(x)) if x else b"" for x in lengths], n, self.footer["mode"])

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids start..end of the file; reads only the blocks that hold them."""
        parts = [self.block(k)[max(0, start - k * BLOCK) : end - k * BLOCK] for k in range(start // BLOCK, (max(end, start + 1) - 1) // BLOCK + 1) if end > start]
        return np.concatenate(parts) if parts else np.zeros(0, "<u4")

    def documents(self):
        """(doc_id, first id, ids) of each document in order; holds a block besides the document."""
        at, k, rest = 0, 0, np.zeros(0, "<u4")
        for i, null, n in zip(self.doc_ids.tolist(), self.null_ids.tolist(), self.sizes.tolist(), strict=True):
            parts, got = [rest], len(rest)
            while got < n:
                parts.append(self.block(k))
                got += len(parts[-1])
                k += 1
            data = parts[0] if len(parts) == 1 else np.concatenate(parts)
            yield None if null else i, at, data[:n]
            rest, at = data[n:], at + n


class LibraryEncoder:
    """Ids of whole texts by the tokenizers library.

    ASCII white space ends a word in the file's normaliser and pre-tokenizer
    and is no token, so the library encodes each chunk between it alone; what
    it gave for a chunk is kept in a bounded cache. A chunk of letters and one
    closing `.` or `,` is two words for the pre-tokenizer. Letters below U+0250
    (but U+0130) are already composed and lower-cased one by one, so a chunk of
    these goes straight to the library's model, in the pre-tokenizer's letters.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if not lowers_letters(spec):
            raise ValueError("only files that lower-case, drop white space and have plain added tokens are supported")
        self.library = Tokenizer.from_file(path)
        self.word = self.library.model.tokenize
        self.letters = letter_table(self.library)
        self.chunks = Recent(self._chunks, CACHE)

    def _chunks(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        own, out = {}, {}

        def ids(chunk: bytes) -> bytes:
            got = own.get(chunk)
            if got is None:
                text = chunk.decode("utf-8")
                if plain(text):
                    got = array("I", [t.id for t in self.word(text.lower().translate(self.letters))]).tobytes()
                else:
                    got = array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
                own[chunk] = got
            return got

        for c in chunks:
            if c[-1:] in (b".", b",") and len(c) > 1 and plain(c[:-1].decode("utf-8", "replace")):
                out[c] = ids(c[:-1]) + ids(c[-1:])
            else:
                out[c] = ids(c)
        return out

    def encode_all(self, texts: list[bytes | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of whole texts."""
        out: list[bytes] = []
        for s, e in groups([len(t or b"") for t in texts]):
            out += map(b"".join, self.chunks.all([(t or b"").split() for t in texts[s:e]]))
        return out

    def encode(self, text: bytes | None) -> bytes:
        return self.encode_all([text])[0]


@cache
def encoder(path: str) -> LibraryEncoder:
    """One for each worker process and file, so that its cache lives on from task to task."""
    return LibraryEncoder(path)


def _at(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")


def write(docs: DataFrame, folder: str, path: str, end_id: int = END_ID, mode: str = "byte", id_col="doc_id", text_col="text", file_ids: int = FILE_IDS) -> list[tuple[str, int, int, int]]:
    """Encode docs and write files in ascending order of the id; returns (file, first id, documents, ids) of each.

    The documents move once, to ranges of (id, crc32 of the text), so an id
    that many rows share is dealt over tasks. A task streams its range into
    files of about file_ids ids, whatever the size of the range, each under a
    name of its own that is changed when it is whole: a task that runs again
    replaces its files by the same bytes. Null ids come first; null texts
    have the end id only; rows with equal ids are in the order of their texts'
    crc32 and then texts. The driver learns one row a file.
    """
    n = shuffle_partitions(docs.sparkSession)
    rows = two_columns(docs, id_col, text_col).withColumn("c", F.crc32(F.coalesce("text", F.lit(""))))
    dealt = rows.repartitionByRange(n, F.asc_nulls_first("doc_id"), "c").sortWithinPartitions(F.asc_nulls_first("doc_id"), "c", "text")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        own, part, tail = encoder(path), TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes()
        store, base = _at(folder)
        writer, name, k = None, "", 0

        def whole():
            footer = writer.close()
            writer.out.close()
            store.move(temporary, f"{base}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, k, f"{folder}/{name}", footer["docs"], footer["ids"])], ["part", "k", "file", "docs", "ids"])

        for b in batches:
            for at in range(0, b.num_rows, 1000):
                some = b.slice(at, 1000)
                for i, ids in zip(some.column("doc_id").to_pylist(), own.encode_all(raw_texts(some.column("text"))), strict=True):
                    if writer is None:
                        store.create_dir(base, recursive=True)
                        name = f"ids-{part:06d}-{k:04d}.planes"
                        temporary = f"{base}/.{name}.{uuid.uuid4().hex}"
                        writer = PlaneWriter(store.open_output_stream(temporary), mode)
                    writer.add(i, ids + tail)
                    if writer.ids >= file_ids:
                        yield whole()
                        writer, k = None, k + 1
        if writer is not None:
            yield whole()

    files, first = [], 0
    for r in sorted(map_arrow(dealt.select("doc_id", "text"), run, "part bigint, k bigint, file string, docs bigint, ids bigint").collect(), key=lambda r: (r.part, r.k)):
        files.append((r.file, first, r.docs, r.ids))
        first += r.ids
    return files


def read(spark: SparkSession, files: list[tuple[str, int, int, int]], with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files, a task per file; with its ids on request."""

    def run(batches):
        import pyarrow as pa

        names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
        types = [pa.int64()] * 4 + [pa.binary()] * with_ids
        for b in batches:
            for file, first in zip(b.column("file").to_pylist(), b.column("first").to_pylist(), strict=True):
                store, name = _at(file)
                with store.open_input_file(name) as f:
                    some, held = [], 0
                    for i, at, ids in PlaneReader(f, f.size()).documents():
                        raw = ids.tobytes()
                        some.append((i, first + at, len(ids), zlib.crc32(raw)) + (raw,) * with_ids)
                        held += len(raw) * with_ids
                        if len(some) >= 10_000 or held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], names)
                            some, held = [], 0
                    if some:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], names)

    rows = spark.createDataFrame([(k, f, at) for k, (f, at, _, _) in enumerate(files)], "k bigint, file string, first bigint")
    if files:
        rows = rows.repartitionByRange(len(files), "k")
    return map_arrow(rows, run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


def round_trip(docs: DataFrame, path: str, folder: str | None = None, **options) -> DataFrame:
    """Write docs into a fresh shared folder, and what reading them back gives."""
    spark = docs.sparkSession
    return read(spark, write(docs, folder or scratch(spark, "token-ids"), path, **options))
