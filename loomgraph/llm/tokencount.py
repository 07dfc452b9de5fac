"""Token counts by prefix dynamic programming, for BPE files with merges, word ends and added tokens.

The count of every prefix of a word is stored with its last token, so a text's
count, the counts at all its word ends, and the longest prefix within a budget
come from one pass, without encoding anything again.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from functools import cache
from itertools import accumulate

from pyspark.sql import DataFrame

from .common import map_arrow, raw_texts, two_columns
from .prefixbpe import PrefixTable, Recent, Vocabulary, groups, letter_table, lowers_letters, plain

CACHE = 400_000


class TokenCounter:
    """Counts as the tokenizers library gives them for a .json file: its normaliser and pre-tokenizer cut words, the tables count."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, library = spec["model"], Tokenizer.from_file(path)
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")) or not lowers_letters(spec):
            raise ValueError("only plain BPE files with merges that lower-case, drop white space and have plain added tokens are supported")
        self.end = model.get("end_of_word_suffix") or ""
        order = {tuple(m.split(" ") if isinstance(m, str) else m): k for k, m in enumerate(model["merges"])}
        self.vocabulary = Vocabulary(model["vocab"], lambda a, b: order.get((a, b)), max(map(len, model["vocab"])))
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.normal = library.normalizer.normalize_str if library.normalizer else str
        self.cut = library.pre_tokenizer.pre_tokenize_str
        self.letters = letter_table(library)
        self.words = Recent(self._words, CACHE)
        self.chunks = Recent(self._chunks, CACHE)

    def table(self, word: str) -> PrefixTable:
        """Prefix table of one word as the pre-tokenizer gives it."""
        return PrefixTable(self.vocabulary, self._symbols(word))

    def _symbols(self, word: str) -> list[str]:
        return [*word[:-1], word[-1] + self.end]

    def _words(self, words: list[str]) -> dict[str, int]:
        """Count of each word; in sorted order one table serves all, as neighbours share prefixes."""
        out, table = {}, PrefixTable(self.vocabulary)
        for w in sorted(words):
            table.become(self._symbols(w))
            out[w] = table.count[-1]
        return out

    def _chunks(self, chunks: list[bytes]) -> dict[bytes, int]:
        lists, added = [], []
        for c in chunks:
            text, n = c.decode("utf-8"), 0
            word = text[:-1] if text[-1] in ".," and len(text) > 1 else text
            if plain(word):  # what the normaliser and the pre-tokenizer make of it, without asking them
                lists.append([word.lower().translate(self.letters), *text[len(word) :]])
                added.append(0)
                continue
            parts = [text]
            if self.added and self.added.search(text):
                parts, n = self.added.split(text), len(self.added.findall(text))
            lists.append([w for plain in parts if plain for w, _ in self.cut(self.normal(plain))])
            added.append(n)
        return {c: sum(counts) + n for c, counts, n in zip(chunks, self.words.all(lists), added, strict=True)}

    def count_all(self, texts: list[bytes | None]) -> list[int]:
        """Tokens of whole texts. ASCII white space ends words in these files and is no token, so chunks between it count by themselves."""
        out: list[int] = []
        for s, e in groups([len(t or b"") for t in texts]):
            out += map(sum, self.chunks.all([(t or b"").split() for t in texts[s:e]]))
        return out

    def count(self, text: bytes | None) -> int:
        return self.count_all([text])[0]

    def prefix_counts(self, text: bytes | None) -> list[int]:
        """Exact count of the prefix that ends with each white-space separated chunk."""
        return list(accumulate(self.chunks.all([(text or b"").split()])[0]))

    def truncate(self, text: bytes, budget: int) -> bytes:
        """The longest prefix in whole characters with at most budget tokens; the whole text if it fits.

        Chunks are counted once and, in the first that doesn't fit, words; in the
        word where the budget runs out the prefix table counts every prefix, its
        last character as a word's end. Where the normal form of that chunk has
        another length, a prefix within the budget is searched by halves and may
        not be the longest.
        """
        fit = bisect_right(counts := self.prefix_counts(text), budget)
        if fit == len(counts):
            return text
        end, chunk, start = 0, "", 0
        for k, m in enumerate(re.finditer(rb"[^\x20\x09-\x0D]+", text)):
            if k == fit:
                chunk, start = m[0].decode("utf-8"), m.start()
                break
            end = m.end()
        n = self._fitting(chunk, budget - (counts[fit - 1] if fit else 0))
        return text[:start] + chunk[:n].encode("utf-8") if n else text[:end]

    def _fitting(self, chunk: str, left: int) -> int:
        """Characters of a prefix of the chunk, which doesn't fit, with at most `left` tokens."""
        if left <= 0:
            return 0
        exact = lambda n: self.count(chunk[:n].encode("utf-8"))
        normal = self.normal(chunk)
        words = self.cut(normal)
        if len(normal) == len(chunk) and not (self.added and self.added.search(chunk)) and sum(len(w) for w, _ in words) == len(normal.encode("utf-8")):
            done = at = 0
            for (word, (start, end)), n in zip(words, self.words.all([[w for w, _ in words]])[0], strict=True):
                if done + n > left:
                    break
                done, at = done + n, end
            letters = list(accumulate(len(c.encode("utf-8")) for c in normal[start:end]))  # the file's words hold a letter for each byte
            table = PrefixTable(self.vocabulary, list(word))
            for k in range(end - start - 1, 0, -1):
                table.truncate(letters[k - 1] - 1)
                table.append([word[letters[k - 1] - 1] + self.end])
                if done + table.count[-1] <= left and exact(start + k) <= left:
                    return start + k
            return at
        low, high = 0, len(chunk)
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if exact(mid) <= left else (low, mid)
        return low


@cache
def counter(path: str) -> TokenCounter:
    """One for each worker process and file, so that its caches live on from task to task."""
    return TokenCounter(path)


def counts(docs: DataFrame, path: str, limit: int = 2048, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; null counts as empty. path is a file that every executor has."""

    def run(batches):
        import pyarrow as pa

        own = counter(path)
        for b in batches:
            texts = raw_texts(b.column("text"))
            n = own.count_all(texts)
            cols = [b.column("doc_id"), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_arrow(two_columns(docs, id_col, text_col), run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
