"""Byte-level BPE with a rank file: encoding by prefix dynamic programming, and decoding."""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from operator import itemgetter

from pyspark.sql import DataFrame

from .common import lasting, map_arrow, two_columns
from .prefixbpe import ByteTable, PrefixTable, Recent, Vocabulary, groups

#: Entries of each half of a worker's caches, and characters that are cut into pieces at once, for each such entry.
CACHE, AT_ONCE = 250_000, 10
#: Before a space that a non-space follows, no match of the pattern goes on; these are safe places to cut a text.
_CUTS = re.compile(r" (?=\S)")
_FIRST = itemgetter(0)


class ByteBPE:
    """Encoder and decoder of a rank file (base64 token, space, rank, per line) and a pattern that cuts texts into pieces."""

    def __init__(self, path: str, pattern: str, entries: int = CACHE) -> None:
        import regex

        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens: list[bytes | None] = [None] * (max(self.ids.values()) + 1)
        for token, i in self.ids.items():
            self.tokens[i] = token
        ranks = self.ids
        self.vocabulary = Vocabulary(ranks, lambda a, b: ranks.get(a + b), max(map(len, ranks)))
        self.find = regex.compile(pattern).findall
        self.pieces = Recent(self._pieces, entries)
        self.segments = Recent(self._segments, entries)
        self.most = AT_ONCE * entries

    def table(self, piece: bytes) -> PrefixTable:
        """The prefix table of one piece; it can be appended to and edited."""
        return PrefixTable(self.vocabulary, [piece[i : i + 1] for i in range(len(piece))])

    def _pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of each piece; in sorted order one table serves all, as neighbours share prefixes."""
        out, table = {}, ByteTable(self.vocabulary)
        for piece in sorted(pieces):
            data = piece.encode("utf-8")
            i = self.ids.get(data)  # as the library does, a piece that is a token is that token
            if i is None:
                table.become(data)
                out[piece] = array("I", table.tokens()).tobytes()
            else:
                out[piece] = array("I", (i,)).tobytes()
        return out

    def _segments(self, segments: list[str]) -> dict[str, bytes]:
        return dict(zip(segments, map(b"".join, self.pieces.all(list(map(self.find, segments)))), strict=True))

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts as little-endian 32-bit integers; none for null."""
        out: list[bytes] = []
        for s, e in groups([len(t or "") for t in texts], self.most):
            out += map(b"".join, self.segments.all([_safe_cuts(t) if t else [] for t in texts[s:e]]))
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, array("I", ids)))


def _safe_cuts(text: str) -> list[str]:
    """The text in parts that the pattern never matches across."""
    chunks = text.split(" ")
    if len(chunks) > 1:
        if all(chunks[1:]) and not any(map(str.isspace, map(_FIRST, chunks[1:]))):
            chunks[1:] = map(" ".__add__, chunks[1:])
        else:
            at = [0, *(m.start() for m in _CUTS.finditer(text)), len(text)]
            chunks = [text[s:e] for s, e in zip(at, at[1:], strict=False)]
        if not chunks[0]:
            del chunks[0]
    return chunks


@lasting
def codec(path: str, pattern: str, entries: int = CACHE) -> ByteBPE:
    """One for each worker process and file, so that its caches live on from task to task."""
    return ByteBPE(path, pattern, entries)


def encode(docs: DataFrame, path: str, pattern: str, id_col="doc_id", text_col="text", ids: bool = True, entries: int = CACHE) -> DataFrame:
    """(doc_id, ids binary, n_tokens, ids_sha256, decoded_sha256) of every row; without the ids on request.

    ids are little-endian unsigned 32-bit integers. Null and empty texts have
    none. decoded_sha256 is of the bytes that the ids decode to. path is a file
    that every executor has. Fewer entries of the caches take less memory and
    more time, and give the same ids.
    """

    def run(batches):
        import pyarrow as pa

        own = codec(path, pattern, entries)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                some = b.slice(at, 1000)
                got = own.encode_all(some.column("text").to_pylist())
                cols = [some.column("doc_id"), pa.array([len(x) // 4 for x in got], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in got]), pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in got])]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(got, pa.binary())] * ids, names + ["ids"] * ids)

    return map_arrow(two_columns(docs, id_col, text_col), run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary" * ids)
