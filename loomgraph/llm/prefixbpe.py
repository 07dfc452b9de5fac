"""Byte pair encoding by dynamic programming over prefixes.

Every prefix of a piece has one token that its encoding ends with: the token t
that is a suffix of the prefix and fits behind the last token of the shorter
prefix it leaves. Two neighbours fit when merging their own symbols gives them
back unchanged; an encoding is right exactly when all its neighbours fit.
Storing that last token for each prefix gives the encoding of any prefix by
walking back, lets symbols be appended without looking back further than one
token, and after an edit only recomputes up to where the table is in step again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence


class Vocabulary:
    """Tokens of one BPE file.

    ids: token key (the concatenation of its symbols) to id. rank(a, b): order
    in which the neighbours a and b (keys) merge, or None.
    """

    MEMO = 400_000

    def __init__(self, ids: dict, rank: Callable, longest: int) -> None:
        self.ids, self.rank, self.longest = ids, rank, longest
        #: Every end of a token, with its id if it is a token itself, else -1; a prefix's end outside these ends no token.
        self.ends = {t[k:]: -1 for t in ids for k in range(1, len(t))} | ids
        self.fit: dict[int, bool] = {}

    def merged(self, symbols: Sequence) -> list:
        """The encoding by its definition: merge the neighbours of lowest rank, leftmost first, until none merges."""
        parts = list(symbols)
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                r = self.rank(parts[i], parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: int, left_symbols: Sequence, right: int, right_symbols: Sequence) -> bool:
        """Whether the token right may stand behind the token left, or come first if left is -1."""
        key = (left + 1) << 32 | right
        got = self.fit.get(key)
        if got is None:
            if len(self.fit) >= self.MEMO:
                self.fit.clear()
            want = [_join(right_symbols)] if left < 0 else [_join(left_symbols), _join(right_symbols)]
            got = self.fit[key] = self.merged([*left_symbols, *right_symbols]) == want
        return got


def _join(symbols: Sequence):
    return (b"" if symbols and isinstance(symbols[0], bytes) else "").join(symbols)


class PrefixTable:
    """For each prefix of a sequence of symbols the id and length of its last token, and its number of tokens."""

    def __init__(self, vocabulary: Vocabulary, symbols: Sequence = ()) -> None:
        self.v, self.symbols, self.raw, self.off = vocabulary, [], None, [0]
        self.last, self.count, self.ids = [0], [0], [-1]
        self.append(symbols)

    def append(self, symbols: Sequence) -> None:
        """Exact: what is stored of shorter prefixes stays as it is."""
        if not symbols:
            return
        more = _join(symbols)
        raw = self.raw = more if self.raw is None else self.raw + more
        v, own, off, last, count, ids = self.v, self.symbols, self.off, self.last, self.count, self.ids
        ends, fit, longest, n = v.ends.get, v.fit.get, v.longest, len(own)
        for s in symbols:
            own.append(s)
            end = off[-1] + len(s)
            off.append(end)
            n += 1
            for j in range(n - 1, max(-1, n - 1 - longest), -1):
                token = ends(raw[off[j] : end])
                if token is None:
                    j = -1
                    break
                if token >= 0:
                    ok = fit((ids[j] + 1) << 32 | token)
                    if ok is None:
                        ok = v.fits(ids[j], own[j - last[j] : j], token, own[j:n])
                    if ok:
                        break
            else:
                j = -1
            if j < 0:
                raise ValueError(f"no token ends with symbol {s!r}")
            last.append(n - j)
            count.append(count[j] + 1)
            ids.append(token)

    def truncate(self, n: int) -> None:
        """Keep the first n symbols."""
        if n < len(self.symbols):
            for x, k in ((self.symbols, n), (self.off, n + 1), (self.last, n + 1), (self.count, n + 1), (self.ids, n + 1)):
                del x[k:]
            self.raw = self.raw[: self.off[-1]] if n else None

    def edit(self, start: int, end: int, symbols: Sequence) -> int:
        """Replace symbols[start:end]; returns how many prefixes had to be computed again.

        Once as many last tokens as a token may be long agree with those before
        the edit, all later ones do: each depends on that many only.
        """
        tail, last, ids, count = self.symbols[end:], self.last[end + 1 :], self.ids[end + 1 :], self.count[end + 1 :]
        self.truncate(start)
        self.append(symbols)
        same = done = 0
        for k, s in enumerate(tail):
            self.append([s])
            done += 1
            same = same + 1 if (self.last[-1], self.ids[-1]) == (last[k], ids[k]) else 0
            if same > self.v.longest:
                rest, more = tail[k + 1 :], self.count[-1] - count[k]
                if rest:
                    self.raw += _join(rest)
                for x in rest:
                    self.symbols.append(x)
                    self.off.append(self.off[-1] + len(x))
                self.last += last[k + 1 :]
                self.ids += ids[k + 1 :]
                self.count += [c + more for c in count[k + 1 :]]
                break
        return len(symbols) + done

    def become(self, symbols: Sequence) -> None:
        """Make this the table of other symbols, keeping the prefix that they share."""
        own, n = self.symbols, 0
        for a, b in zip(own, symbols, strict=False):
            if a != b:
                break
            n += 1
        self.truncate(n)
        self.append(symbols[n:])

    def tokens(self, end: int | None = None) -> list[int]:
        """Token ids of the prefix of `end` symbols (all by default)."""
        at, out = len(self.symbols) if end is None else end, []
        while at:
            out.append(self.ids[at])
            at -= self.last[at]
        return out[::-1]


class ByteTable:
    """What a PrefixTable holds of a piece whose symbols are its bytes, for going from one piece to the next."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v, self.raw, self.last, self.ids = vocabulary, b"", [0], [-1]

    def become(self, raw: bytes) -> None:
        """Keeps the prefix that the pieces share."""
        old, last, ids, v = self.raw, self.last, self.ids, self.v
        n, most = 0, min(len(old), len(raw))
        if old[:most] == raw[:most]:
            n = most
        else:
            while old[n] == raw[n]:
                n += 1
        del last[n + 1 :], ids[n + 1 :]
        self.raw = raw
        ends, fit, longest, found, length = v.ends.get, v.fit.get, v.longest, ids.append, last.append
        for end in range(n + 1, len(raw) + 1):
            for j in range(end - 1, max(-1, end - 1 - longest), -1):
                token = ends(raw[j:end])
                if token is None:
                    raise ValueError(f"no token ends with {raw[end - 1 : end]!r}")
                if token >= 0:
                    ok = fit((ids[j] + 1) << 32 | token)
                    if ok is None:
                        ok = v.fits(ids[j], _single(raw[j - last[j] : j]), token, _single(raw[j:end]))
                    if ok:
                        break
            else:
                raise ValueError(f"no token ends with {raw[end - 1 : end]!r}")
            length(end - j)
            found(token)

    def tokens(self) -> list[int]:
        at, out = len(self.raw), []
        while at:
            out.append(self.ids[at])
            at -= self.last[at]
        return out[::-1]


def _single(raw: bytes) -> list[bytes]:
    return [raw[k : k + 1] for k in range(len(raw))]


class Recent:
    """Values of a bounded number of keys, made for many keys at once.

    When the young half is full it becomes the old half, and what is used of
    that comes back.
    """

    def __init__(self, make_all: Callable, half: int) -> None:
        self.make_all, self.half, self.young, self.old = make_all, half, {}, {}

    def all(self, lists: list[list]) -> list[list]:
        """The values of the keys in each list, in order."""
        need: set = set()
        for keys in lists:
            need.update(keys)
        if len(self.young) >= self.half:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        missing = []
        for k in need.difference(young):
            got = old.get(k)
            if got is None:
                missing.append(k)
            else:
                young[k] = got
        if missing:
            young.update(self.make_all(missing))
        return [list(map(young.__getitem__, keys)) for keys in lists]


def groups(sizes: list[int], most: int = 4 << 20, rows: int = 1000):
    """(start, end) of neighbours that add up to about `most`."""
    start = total = 0
    for k, n in enumerate(sizes):
        if k > start and (total + n > most or k - start >= rows):
            yield start, k
            start, total = k, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def plain(word: str) -> bool:
    """Only letters below U+0250 but U+0130: already composed, lower-cased one by one, and one word for a pre-tokenizer."""
    return word.isalpha() and max(word) < "\u0250" and "\u0130" not in word


def letter_table(library) -> dict[int, str]:
    """For str.translate: what the library's pre-tokenizer makes of each letter that plain() allows."""
    cut = library.pre_tokenizer.pre_tokenize_str
    return {k: "".join(piece for piece, _ in cut(chr(k))) for k in range(0x250) if plain(chr(k))}


def lowers_letters(spec: dict) -> bool:
    """Whether the file composes, drops white space, lower-cases and cuts words at what aren't letters, and nothing else."""
    kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
    return kinds == ["NFC", "Replace", "Lowercase"] and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"])
