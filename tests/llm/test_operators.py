import hashlib
import random
import re
import string
import weakref
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from loomgraph.llm import bytebpe, decontam, exactdedup, histsort, langid, linededup, simhash, tokenbin, tokencount, urlfilter
from loomgraph.operators.stars import components
from loomgraph.llm.common import map_arrow, row_key
from loomgraph.llm.langid import LanguageModel, Landmarks, has_letter, ngrams, ridge
from loomgraph.llm.prefixbpe import PrefixTable

WORD_FILE = public_tokenizers.path("word_bpe_49k.json")
RANK_FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def key(x):
    return repr(x)


def same(got, want):
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


# 1


def kernel(a, b, max_n):
    def own(t):
        t = t.lower()
        return {t[k : k + n] for n in range(1, max_n + 1) for k in range(len(t) - n + 1)}

    x, y = own(a), own(b)
    return len(x & y) / np.sqrt(max(1, len(x)) * max(1, len(y)))


def test_kernel_against_sets(rows):
    texts = [t for _, t, _ in rows if t][:40]
    marks = texts[::7]
    got = Landmarks.of(marks, 3).kernel(texts)
    assert np.allclose(got, [[kernel(t, m, 3) for m in marks] for t in texts], atol=1e-5)


def test_ngrams_are_exact_over_pieces(monkeypatch):
    text = "".join(random.Random(1).choices("abcdeé😀", k=500))
    whole = ngrams(text, 3)
    monkeypatch.setattr(langid, "PIECE", 16)
    assert all((a == b).all() for a, b in zip(ngrams(text, 3), whole, strict=True))


def test_language_held_out_accuracy(docs, rows, no_docs):
    learn = F.crc32(F.col("doc_id").cast("string")) % 3 != 1
    model = langid.fit(docs, learn, marks_per_lang=4)
    got = langid.classify(docs, model).withColumn("held_out", langid.held_out()).collect()
    assert len(got) == len(rows)
    truth = {i: lang for i, t, lang in rows if i is not None and i < 100}
    held = [r for r in got if r.doc_id in truth and r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.9 * len(held) > 0
    assert all(0 <= r.score <= 1 for r in got)
    texts = defaultdict(set)
    for i, t, _ in rows:
        texts[i].add(t)
    for r in got:
        if not any(map(has_letter, texts[r.doc_id])):
            assert (r.lang_pred, r.score) == ("und", 0)
    assert {r.doc_id: r.held_out for r in got if r.doc_id is not None} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, _, _ in rows if i is not None}
    kept = langid.keep_known(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.lang_pred != "und" for r in got)
    empty = langid.fit(no_docs, learn)
    assert empty.langs == [] and langid.classify(no_docs, empty).count() == 0
    assert {r.lang_pred for r in langid.classify(docs, empty).collect()} == {"und"}


def test_language_id_end_to_end_by_brute_force(spark, docs, rows):
    """Sample, landmarks, kernels, map, regression and scores again, from sets and dense algebra."""
    more = [(200, "the same id, other text", "en"), (200, "le même texte que non", "fr"), (3, rows[3][1], rows[3][2])]
    df = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(more, "doc_id bigint, text string, lang string"))
    model = langid.fit(df, F.crc32(F.col("doc_id").cast("string")) % 3 != 1, marks_per_lang=3, penalty=0.1)
    keys = key_of(df)
    learned = {(lang, keys[i, t], i, t) for i, t, lang in [*rows, *more] if None not in (i, t, lang) and zlib.crc32(str(i).encode()) % 3 != 1 and regex.search(r"\p{L}", t)}
    order = sorted(learned)
    marks = [t for x in ("de", "en", "fr") for t in [t for lang, _, _, t in order if lang == x and len(t) <= langid.MARK_CHARS][:3]]
    k = lambda a, b: np.array([[kernel(x, y, 3) for y in b] for x in a])
    values, vectors = np.linalg.eigh(k(marks, marks))
    to_map = vectors[:, values > 1e-6 * values.max()] / np.sqrt(values[values > 1e-6 * values.max()])
    phi = k([t for *_, t in order], marks) @ to_map
    y = np.array([[1.0 if lang == x else -1.0 for x in ("de", "en", "fr")] for lang, *_ in order])
    w = np.linalg.solve(phi.T @ phi + 0.1 * np.eye(phi.shape[1]), phi.T @ y)
    some = [(i, t) for i, t, _ in [*rows, *more] if t is None or len(t) < 2000]
    langs, scores = model.predict([t for _, t in some])
    for (_, t), lang, score in zip(some, langs, scores, strict=True):
        if not has_letter(t):
            assert (lang, score) == ("und", 0)
            continue
        decided = (k([t], marks) @ to_map @ w)[0]
        assert abs(score - min(1, max(0, (decided.max() + 1) / 2))) < 2e-3
        assert lang == ("de", "en", "fr")[decided.argmax()] or np.ptp(np.sort(decided)[-2:]) < 2e-3


def test_sparse_landmarks_equal_dense_ones(rows):
    texts = [t for _, t, _ in rows if t][:30] + ["", "é"]
    dense, sparse = (Landmarks.of(texts[::5], 3, size) for size in (1 << 26, 0))
    assert dense.matrix is not None and sparse.matrix is None
    assert np.allclose(dense.kernel(texts), sparse.kernel(texts), atol=1e-6)


def test_ridge_solves_the_normal_equations():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(30, 5))
    marks = x[:8]
    own, k, y = marks @ marks.T, x @ marks.T, rng.normal(size=(30, 2))
    got = k @ ridge(k, own, y, 0.5)
    values, vectors = np.linalg.eigh(own)
    phi = k @ (vectors[:, values > 1e-6 * values.max()] / np.sqrt(values[values > 1e-6 * values.max()]))
    want = phi @ np.linalg.solve(phi.T @ phi + 0.5 * np.eye(phi.shape[1]), phi.T @ y)
    assert np.allclose(got, want, atol=1e-3)
    assert isinstance(LanguageModel([], Landmarks.of([""], 2), np.zeros((1, 0))), LanguageModel)


# 2

URLS = [
    None, "", "no scheme", "http://", "http://EXAMPLE.com/en/1", "https://www.Example.COM/en/1?x", "http://a.www.example.com/en/", "http://com", "http://com/", "http://xcom/en/", "http://a.net/es/#/fr/",
    "http://net/es", "http://net/fr/x", "ftp://notexample.com/en/q", "http://a.b.c.d.e.net/es/x/y", "x://h?p/en/", "x://h#p", "http://É.example.com/en/", "http://example.com:80/en/", "http://user@example.com/en/", "//a://net/es/", "http://example.com./en/", "http://.com/",
]


def url_of(url, rules, default):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path, host = re.match(r"[^?#]*", rest[len(host) :])[0], host.translate(LOWER)
    fit = [(h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fit, key=lambda x: len(x[0]), default=(None, default)))


@pytest.mark.parametrize("broadcast", [True, False])
@pytest.mark.parametrize("more", [0, 300, 3000])
def test_url_filter(spark, monkeypatch, broadcast, more):
    if not broadcast:
        monkeypatch.setattr(urlfilter, "MAX_BROADCAST", 0)
    rules = urlfilter.RULES + [(f"site{k}.org", "/a" + "b" * (k % 5), "block" if k % 2 else "allow") for k in range(more)]
    urls = URLS + [f"http://w.site{k}.org/abbbb{k}" for k in range(0, 400, 7)] + ["http://" + "a." * 3000 + "example.com/en/" + "x/" * 20_000]
    pages = [(k % 60, u, "x", "x", "x") for k, u in enumerate(urls * 2)] + [(None, "http://a.com/", "x", "x", "x")] * 3 + [(7, URLS[4], "x", "x", "x")] * 5
    df = spark.createDataFrame(pages, "page_id bigint, url string, host string, rule string, action string")
    got = urlfilter.judge(df, spark.createDataFrame(rules, "host string, path string, action string"))
    same(got.collect(), [(i, *url_of(u, rules, "allow")) for i, u, *_ in pages])
    assert urlfilter.judge(df.limit(0), spark.createDataFrame(rules, "host string, path string, action string")).count() == 0


def test_url_filter_with_an_empty_list(spark):
    df = spark.createDataFrame([(1, "http://a.com/x")], "page_id bigint, url string")
    none = spark.createDataFrame([(None, "/", "block")], "host string, path string, action string")
    assert [tuple(r) for r in urlfilter.judge(df, none, default="block").collect()] == [(1, "a.com", "/x", None, "block")]


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    probe = spark.range(10_000).select(F.concat(F.lit("k"), "id").alias("key"), F.concat(F.lit("k"), "id").alias("own"))
    met = urlfilter.maybe_listed(probe, urlfilter.bloom_blocks(keys, 1024), 1024).collect()
    got = {r.key for r in met if r.key is not None}
    assert len(met) == 10_000 and all(r.key in (None, r.own) for r in met)
    assert {f"k{i}" for i in range(5000)} <= got and len(got) < 8000


# 3


def slow_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def slow_components(ids, fps):
    parent = list(range(len(ids)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                parent[top(a)] = top(b)
    least = defaultdict(lambda: None)
    for k, i in enumerate(ids):
        t = top(k)
        if i is not None:
            least[t] = i if least[t] is None else min(least[t], i)
    return [least[top(k)] for k in range(len(ids))]


def test_simhash(docs, rows, no_docs):
    fps = [slow_fingerprint(t) for _, t, _ in rows]
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hex_fingerprint(F.col("fp")), "component_id").collect()
    same(got, [(i, f"{f:016x}", c) for (i, _, _), f, c in zip(rows, fps, slow_components([r[0] for r in rows], fps), strict=True)])
    assert simhash.near_duplicates(no_docs).count() == 0


def slow_similar(docs):
    """{id: least id of its group} by the similarity of all pairs of sets of five-word shingles."""
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    least = {i: i for i in sets}

    def top(x):
        while least[x] != x:
            x = least[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) > 0:
                low, high = sorted((top(a), top(b)))
                least[high] = low
    return {i: top(i) for i in sets}


def test_similar_documents(docs, rows, no_docs):
    group, least = slow_similar([(k, t) for k, (_, t, _) in enumerate(rows)]), defaultdict(list)
    for k, (i, _, _) in enumerate(rows):
        least[group[k]] += [] if i is None else [i]
    want = [(i, min(least[group[k]], default=None)) for k, (i, _, _) in enumerate(rows)]
    for size in ((simhash.HOT_GROUP, simhash.HOT_SIZE), (2, 50)):
        same(simhash.similar(docs, hot=size[0], hot_size=size[1]).collect(), want)
    assert simhash.similar(no_docs).count() == 0


def test_one_of_each_similar_group_stays(spark, docs, rows, no_docs):
    words = " ".join(f"w{k}" for k in range(60))
    odd = [(500, words), (900, words + " x"), (900, "an unrelated text of the same id"), (None, words + " y"), (None, words + " z"), (None, "both without an id " * 9), (None, "both without an id " * 9 + "but"), (7000, "same same"), (7000, "same same"), (7001, None), (7001, "")]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id bigint, text string")).withColumns({"__row": F.lit("x"), "fp": F.lit(1)}).repartition(4)
    all_rows = sorted({(i, t) for i, t, *_ in [*rows, *odd]}, key=lambda r: (r[0] is None, r[0] or 0))
    group = slow_similar([(k, t) for k, (_, t) in enumerate(all_rows)])
    best = {}
    for k, (i, _) in enumerate(all_rows):
        if i is not None or group[k] not in best:
            best.setdefault(group[k], i)
    got = simhash.unique(df)
    assert got.columns == df.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert len(kept) == len(set(kept)) == len(best) and {(900, "an unrelated text of the same id"), (500, words)} <= set(kept)
    same([(i,) for i, _ in kept], [(i,) for i in best.values()])
    assert simhash.unique(no_docs).count() == 0


@pytest.mark.parametrize(("edits", "hot", "hot_size"), [(1, 1024, 1 << 22), (6, 1024, 1 << 22), (6, 8, 1 << 22), (12, 8, 1 << 22), (6, 1024, 2000)])
def test_similar_groups_of_edited_copies(spark, edits, hot, hot_size):
    """Groups of up to 150 edited copies, some on this and some on that side of the threshold, whole and dealt into blocks."""
    rng = random.Random(edits)
    texts = []
    for size in (150, 20, 5, 2, 2, 2, 1, 1):
        base = [f"w{rng.randrange(5000)}" for _ in range(300)]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in simhash.similar(df, hot=hot, hot_size=hot_size).collect()}
    assert got == slow_similar(list(enumerate(texts)))


@pytest.mark.parametrize("hot", [4096, 3])
def test_links_reach_everything_within_two_bits(spark, hot):
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for f in fps[:30]:
        for _ in range(6):
            f ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            fps.append(f)
    fps += [0] + [1 << k for k in range(0, 64, 3)] + [(1 << 64) - 1]
    fps = sorted(set(fps))
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp bigint")
    linked = simhash.links(df, hot)
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() > 0 for r in linked.collect())
    roots = {r.node: r.root for r in components(linked).collect()}
    label = [roots.get(int(np.uint64(f).astype(np.int64)), int(np.uint64(f).astype(np.int64))) for f in fps]
    want = slow_components(list(range(len(fps))), fps)
    assert len(set(zip(label, want, strict=True))) == len(set(label)) == len(set(want))


def test_bk_tree_against_all_pairs():
    rng = random.Random(5)
    values = list({rng.getrandbits(12) for _ in range(300)})
    tree, seen = simhash.BKTree(), []
    for v in values:
        assert sorted(tree.add_and_find(v, 2)) == sorted(x for x in seen if (x ^ v).bit_count() <= 2)
        seen.append(v)


def test_components_on_long_chains(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 100), (50, 60), (60, 55), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(41)} | {50: 50, 55: 50, 60: 50}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_radius_holds_pairs_of_small_sets():
    rng, radius = np.random.default_rng(1), simhash.radius_of(0.8)
    for n in (4, 12):
        for _ in range(2000):
            h = rng.integers(0, 1 << 63, n * 5 // 4, np.uint64) * np.uint64(2) + rng.integers(0, 2, n * 5 // 4, np.uint64)
            x, y = (int.from_bytes(simhash.wide_fingerprint(some), "big") for some in (h, h[:n]))
            assert (x ^ y).bit_count() <= radius


# 4

ITEMS = [(1, "The quick brown fox jumps over the lazy dog again and again today"), (2, "short one"), (10, "café é 5"), (3, ""), (4, None), (5, "!!!"), (6, "quick quick quick quick quick quick quick quick quick quick quick quick"), (None, "null item words here"), (2, "short one"), (11, "single")]
TEXTS = [
    "x the QUICK brown-fox jumps_over the lazy dog, again AND again today y", "the quick brown fox jumps over the lazy dog", "short one short one", "shortone one short", "CAFé é 5!", "quick " * 25, "quick " * 9, "a null item words here b", None, "", "...",
    "single SINGLE", "brown fox jumps over the lazy dog again and again today", "fox jumps over the lazy dog again and again today café É 5 café é 5",
]


def slow_report(texts, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall((t or "").translate(LOWER))
    wins = []
    for i, t in items:
        w = split(t)
        m = min(window, len(w))
        wins += [(i, w[k : k + m]) for k in range(len(w) - m + 1) if m]
    for d, t in texts:
        w, hit, ids = split(t), set(), set()
        for i, p in wins:
            for k in range(len(w) - len(p) + 1):
                if w[k : k + len(p)] == p:
                    hit |= set(range(k, k + len(p)))
                    ids |= {i} - {None}
        yield d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [1 << 20, 30])
def test_decontamination(spark, block):
    texts = list(enumerate(TEXTS)) + [(None, TEXTS[0]), (0, TEXTS[0]), (1, "of the same id"), (None, "nothing of it"), (90, "long " * 60_000 + TEXTS[0])]
    df = spark.createDataFrame([(i, t, "x", 1, "x", 2, "x") for i, t in texts], "doc_id bigint, text string, n_hit string, item_id int, __items string, __spans int, row string")
    items = spark.createDataFrame([(*x, "x") for x in ITEMS], "item_id bigint, text string, doc_id string")
    same(decontam.report(df, items, block_bytes=block).collect(), slow_report(texts, ITEMS))
    kept = decontam.clean(df, items, block_bytes=block)
    assert kept.columns == df.columns and kept.count() == sum(not x[-1] for x in slow_report(texts, ITEMS))
    assert decontam.report(df.limit(0), items).count() == 0
    none = decontam.report(df, items.limit(0)).collect()
    assert len(none) == len(texts) and not any(r.contaminated for r in none)


def test_decontamination_on_random_words():
    rng = random.Random(11)
    items = [(k, " ".join(rng.choices("abcd", k=rng.randint(1, 14)))) for k in range(12)]
    searcher = decontam.Searcher([(i, t.encode()) for i, t in items], window=5)
    for d in range(60):
        text = " ".join(rng.choices("abcde", k=rng.randint(0, 40)))
        spans, ids = searcher.find(decontam.words_of(text.encode()))
        (_, n, hit, n_items, _, _), = slow_report([(d, text)], items, 5)
        assert (sum(e - s for s, e in spans), len(ids)) == (hit, n_items)


# 5


def library_ids(text):
    from tokenizers import Tokenizer

    global _library
    try:
        _library
    except NameError:
        _library = Tokenizer.from_file(WORD_FILE)
    return _library.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize(("mode", "file_ids"), [("byte", tokenbin.FILE_IDS), ("byte", 500), ("bit", tokenbin.FILE_IDS)])
def test_token_files(docs, rows, mode, file_ids, tmp_path):
    some = docs.where("doc_id IS NULL OR doc_id <> 110")
    got = tokenbin.read(docs.sparkSession, files := tokenbin.write(some, str(tmp_path / "out"), WORD_FILE, mode=mode, file_ids=file_ids), with_ids=True).collect()
    assert (len(files) > 8) == (file_ids == 500)
    crc = lambda t: zlib.crc32((t or "").encode())
    want, at = [], 0
    for i, t, _ in sorted((r for r in rows if r[0] != 110), key=lambda r: (r[0] is not None, r[0] or 0, crc(r[1]), r[1] is not None)):
        ids = np.array(library_ids(t) + [2], "<u4").tobytes()
        want.append((i, at, len(ids) // 4, zlib.crc32(ids), ids))
        at += len(ids) // 4
    same([(r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in got], want)
    assert sum(f[3] for f in files) == at
    stream = np.frombuffer(b"".join(w[-1] for w in want), "<u4")
    for file, first, _, n in files:
        with open(file, "rb") as f:
            reader = tokenbin.PlaneReader(f, f.seek(0, 2))
            for s, e in ((0, 1), (n // 3, n // 2), (0, n), (n, n)):
                assert (reader.ids(s, e) == stream[first + s : first + e]).all()


def test_token_files_of_nothing(no_docs, tmp_path):
    assert tokenbin.round_trip(no_docs, WORD_FILE, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("mode", ["byte", "bit"])
def test_planes_round_trip(mode):
    rng = np.random.default_rng(2)
    for n in (0, 1, 7, 8, 9, 1000):
        ids = rng.integers(0, 2**32, n, dtype=np.uint64).astype("<u4")
        assert (tokenbin.join_planes(tokenbin.split_planes(ids, mode), n, mode) == ids).all()


# 6


@pytest.fixture(scope="module")
def tik():
    import base64

    import tiktoken

    with open(RANK_FILE, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(docs, rows, no_docs, tik):
    got = bytebpe.encode(docs, RANK_FILE, public_tokenizers.PATTERN).collect()
    want = []
    for i, t, _ in rows:
        ids = np.array(tik.encode_ordinary(t or ""), "<u4").tobytes()
        want.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids))
    same([(*r[:4], bytes(r.ids)) for r in got], want)
    assert bytebpe.encode(no_docs, RANK_FILE, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_on_odd_texts(tik):
    own, rng = bytebpe.codec(RANK_FILE, public_tokenizers.PATTERN), random.Random(4)
    alphabet = list("aeéßñ1½٣ \n\t\r.,'!") + ["  ", " \n", "\u00a0", "\u2003", "\x1c", "\u0301", "😀", "'s", "the", "日本", "\u200d", "\x00", "\x85"]
    for _ in range(1500):
        t = "".join(rng.choices(alphabet, k=rng.randint(0, 30)))
        ids = tik.encode_ordinary(t)
        assert np.frombuffer(own.encode(t), "<u4").tolist() == ids, repr(t)
        assert own.decode(own.encode(t)) == t.encode()


def test_byte_bpe_with_small_caches(docs, rows, tik):
    own = bytebpe.codec(RANK_FILE, public_tokenizers.PATTERN, 200)
    texts = [t for _, t, _ in rows]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_all(texts)] == [tik.encode_ordinary(t or "") for t in texts]
    longest = max(len(set(bytebpe._safe_cuts(t))) for t in texts if t)
    for c in (own.segments, own.pieces):
        assert len(c.young) + len(c.old) <= 2 * (200 + longest + 10 * 200)
    few = bytebpe.encode(docs, RANK_FILE, public_tokenizers.PATTERN, entries=200)
    all_ = bytebpe.encode(docs, RANK_FILE, public_tokenizers.PATTERN)
    assert few.exceptAll(all_).isEmpty() and few.count() == all_.count()


def test_a_worker_keeps_the_caches_of_its_last_operator_only(spark):
    class Frame:
        sparkSession = spark

        def mapInArrow(self, task, schema):
            return list(task([]))

    def encoding(batches):
        yield bytebpe.codec(RANK_FILE, public_tokenizers.PATTERN)

    def other(batches):
        yield kept()

    encoding.__module__ = bytebpe.encode.__module__
    (first,), (second,) = (map_arrow(Frame(), encoding, "") for _ in range(2))
    assert first is second
    kept = weakref.ref(first)
    del first, second
    assert map_arrow(Frame(), other, "") == [None]


def test_prefix_table_appends_and_edits(tik):
    own, rng = bytebpe.codec(RANK_FILE, public_tokenizers.PATTERN), random.Random(8)
    for _ in range(40):
        text = "".join(rng.choices("thinged reatéß", k=60)).encode()
        table = own.table(text[:20])
        table.append([text[k : k + 1] for k in range(20, len(text))])
        merged = lambda x: [own.ids[t] for t in own.vocabulary.merged(x)]
        split = lambda b: [b[k : k + 1] for k in range(len(b))]
        assert all(table.tokens(n) == merged(split(text[:n])) for n in range(1, len(text) + 1))
        s = rng.randrange(len(text))
        e = min(len(text), s + rng.randrange(4))
        new = "".join(rng.choices("abé", k=rng.randrange(4))).encode()
        table.edit(s, e, split(new))
        text = text[:s] + new + text[e:]
        assert b"".join(table.symbols) == text and table.tokens() == merged(split(text))
        assert table.count == PrefixTable(own.vocabulary, split(text)).count and table.last == PrefixTable(own.vocabulary, split(text)).last
        table.append(split(b"ing"))
        assert table.tokens() == merged(split(text + b"ing"))


# 7


def slow_repeats(rows, min_words, key):
    """Documents in order of rank, cut into pieces that add up to the text; a piece met before is a repeat."""
    seen, out = {}, []
    for none, i, r, text in sorted({(i is None, i or 0, key[i, t], t) for i, t in rows if t}):
        at, run, i = 0, [], None if none else i

        def close():
            if run and sum(x[2] for x in run) >= min_words:
                out.append((i, run[0][0], run[-1][1], sum(x[2] for x in run), run[0][3], r))
            run.clear()

        for piece in re.split(r"(?<=\n)|(?<=[.!?,;:])(?=\s)", text):
            words, start, end = piece.lower().split(), at + len(piece) - len(piece.lstrip()), at + len(piece.rstrip())
            at += len(piece)
            if words and " ".join(words) in seen:
                run.append((start, end, len(words), seen[" ".join(words)]))
            elif words:
                seen[" ".join(words)] = i
                close()
        close()
    return out


def key_of(docs):
    """{(doc_id, text): row_key}; the key is only compared."""
    return {(r.doc_id, r.text): r.k for r in docs.select("doc_id", "text", row_key()[1].alias("k")).collect()}


def check_repeats(docs, pairs, min_words):
    keys = key_of(docs)
    runs, want = linededup.repeats(docs, min_words=min_words), slow_repeats(pairs, min_words, keys)
    same(runs.collect(), want)
    cleaned = []
    for i, t in pairs:
        spans = sorted((s, e) for d, s, e, _, _, k in want if (d, k) == (i, keys[i, t]))
        for s, e in reversed(spans):
            t = t[:s] + t[e:]
        cleaned.append((i, t, spans))
    got = linededup.clean(docs, runs)
    assert got.columns == [*docs.columns, "removed_spans"]
    same([(r.doc_id, r.text, [tuple(x) for x in r.removed_spans]) for r in got.collect()], cleaned)
    return want


@pytest.mark.parametrize(("min_words", "often", "owners"), [(1, 8, 1000), (1, 2, 1000), (1, 2, 0), (linededup.PASSAGE_WORDS, 8, 1000)])
def test_line_dedup(monkeypatch, docs, rows, no_docs, min_words, often, owners):
    monkeypatch.setattr(linededup, "MAX_OWNERS", owners)
    monkeypatch.setattr(linededup, "OFTEN", often)
    want = check_repeats(docs, [(i, t) for i, t, _ in rows], min_words)
    assert 117 in {w[0] for w in want} and (min_words == 1 or 112 not in {w[0] for w in want})
    assert linededup.repeats(no_docs).count() == 0


def test_line_dedup_tells_rows_of_an_id_apart(spark):
    """Rows that share an id, null ids, repeated rows, and short text between repeats."""
    a, b = "One long sentence that is said twice here. Call 911! Another long sentence, said twice as well.", "First things first. One long sentence that is said twice here.\nNo call.\nAnother long sentence, said twice as well."
    pairs = [(2, a), (2, "nobody else has a word of this text, " * 3), (2, b), (2, b), (None, a + "\nend"), (None, b), (9, ""), (9, None), (1, "No call. x " + a.upper())]
    df = spark.createDataFrame([(i, t, "x", "x") for i, t in pairs], "doc_id bigint, text string, __spans string, row string").repartition(3)
    want = check_repeats(df, pairs, 1)
    assert None in {w[0] for w in want} and len({w[-1] for w in want if w[0] == 2}) >= 2
    with pytest.raises(ValueError):
        linededup.clean(df.withColumnRenamed("row", "Removed_Spans"), linededup.repeats(df))


def test_a_run_ends_at_what_is_not_repeated(spark):
    docs = spark.createDataFrame([(1, "Said before by all. Again and again it is."), (2, "Said before by all. Call 911! Again and again it is.")], "doc_id bigint, text string")
    assert [tuple(r)[:3] for r in sorted(linededup.repeats(docs).collect())] == [(2, 0, 19), (2, 30, 52)]


def test_line_dedup_finds_passages_inside_sentences(spark):
    words = [f"w{k}{',' if k % 7 == 3 else '.' if k % 23 == 5 else ''}" for k in range(60)]
    passage = " ".join(words)
    docs = spark.createDataFrame([(k, f"{chr(97 + k) * 5} own words of document {k} and {passage} then more own words {k}") for k in range(3)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in linededup.repeats(docs, min_words=linededup.PASSAGE_WORDS).collect()}
    assert set(got) == {1, 2} and all(r.n_words >= 50 and r.first_doc_id == 0 for r in got.values())


def test_units_lose_no_text_and_find_a_passage_inside_a_line():
    passage = "Alpha beta gamma delta. Epsilon zeta eta theta! Iota kappa lambda mu? Nu xi omicron pi."
    a, b = [{u for *_, u in linededup.units_of(f"{x} {passage} {y}")} for x, y in (("start of one", "end of one"), ("another head", "tail"))]
    assert len(a & b) == 3


def test_line_dedup_takes_repeats_of_any_length(spark):
    nine = "this line of nine words is on every page"
    docs = spark.createDataFrame([(1, f"first here\n{nine}\nFin"), (2, f"other start\n{nine}\nmore\nfin\nits own end")], "doc_id bigint, text string")
    same([tuple(r)[:5] for r in linededup.repeats(docs).collect()], [(2, 12, 52, 9, 1), (2, 58, 61, 1, 1)])


# 8


def test_token_counts(docs, rows, no_docs):
    got = tokencount.counts(docs, WORD_FILE).collect()
    same(got, [(i, len((t or "").encode()), n := len(library_ids(t)), n > 2048) for i, t, _ in rows])
    assert tokencount.counts(no_docs, WORD_FILE).count() == 0


def test_token_counts_on_odd_texts():
    own, rng = tokencount.counter(WORD_FILE), random.Random(6)
    encoder = tokenbin.encoder(WORD_FILE)
    alphabet = list("aeéßñİΣ1½٣ \n\t.,'!<|>") + ["\u00a0", "\u2003", "\x1c", "\x0b", "\u0301", "😀", "'s", "the", "日本", "<|endoftext|>", "<|STARTOFTEXT|>", "\x00", "\x85", "ﬁ", "ǅ", "Å"]
    for _ in range(1500):
        t = "".join(rng.choices(alphabet, k=rng.randint(0, 30)))
        ids = library_ids(t)
        assert own.count(t.encode()) == len(ids), repr(t)
        assert np.frombuffer(encoder.encode(t.encode()), "<u4").tolist() == ids, repr(t)


def test_prefix_counts_and_truncation():
    own = tokencount.counter(WORD_FILE)
    text = "The thinging ereatly, and naïve  words don't\nstop<|endoftext|>ping here."
    chunks = text.split()
    counts = own.prefix_counts(text.encode())
    assert counts == [len(library_ids(" ".join(chunks[: k + 1]))) for k in range(len(chunks))]
    for budget in range(counts[-1] + 2):
        cut = own.truncate(text.encode(), budget).decode()
        assert len(library_ids(cut)) <= budget and text.startswith(cut)
        assert len(cut.split()) >= sum(c <= budget for c in counts)
    word = "thereation"
    table = own.table(word)
    assert table.tokens() == [own.vocabulary.ids[t] for t in own.vocabulary.merged([*word[:-1], word[-1] + "</w>"])]


def test_truncation_inside_a_chunk():
    own, rng = tokencount.counter(WORD_FILE), random.Random(3)
    for k in range(40):
        text = "".join(rng.choices(["th", "er", "ing", "é", "1", ".", "don't", "ß", " " if k % 2 else "x"], k=25))
        whole = len(library_ids(text))
        for budget in range(0, whole + 1, 3):
            best = max(n for n in range(len(text) + 1) if len(library_ids(text[:n])) <= budget)
            assert own.truncate(text.encode(), budget).decode().rstrip() == text[:best].rstrip(), (text, budget)
    long = "thereation" * 6000
    assert len(library_ids(own.truncate(long.encode(), 10).decode())) <= 10 < len(library_ids(own.truncate(long.encode(), 11).decode())) + 1
    assert len(own.truncate(long.encode(), 2000)) > 2000


# 9


def slow_duplicates(rows, best):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[(t or "").translate(LOWER)].append(i)
    for i, t, _ in rows:
        t = (t or "").translate(LOWER)
        ids = [x for x in groups[t] if x is not None]
        keep = best(ids) if ids else None
        yield i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()


@pytest.mark.parametrize("keep", ["max", "min"])
@pytest.mark.parametrize("trie_bytes", [1 << 26, 200])
def test_exact_dedup(docs, rows, no_docs, keep, trie_bytes):
    same(exactdedup.duplicates(docs, keep=keep, trie_bytes=trie_bytes).collect(), list(slow_duplicates(rows, {"max": max, "min": min}[keep])))
    assert exactdedup.duplicates(no_docs).count() == 0


def slow_unique(rows, best):
    """Of each text the id that stays; a null id only where there is no other."""
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[(t or "").translate(LOWER)].append(i)
    return [(best(x) if (x := [i for i in ids if i is not None]) else None, t) for t, ids in groups.items()]


@pytest.mark.parametrize("keep", ["max", "min"])
@pytest.mark.parametrize("trie_bytes", [1 << 26, 200])
def test_exact_dedup_of_whole_rows(spark, docs, rows, no_docs, keep, trie_bytes):
    odd = [(5, "A dup", "x"), (9, "a dup", "y"), (5, "only here", "z"), (7, "same", "q"), (7, "same", "q"), (None, "both null", "a"), (None, "Both null", "b"), (None, "a DUP", "c")]
    df = docs.unionByName(spark.createDataFrame([(i, t, None, x, None, *["x"] * 6) for i, t, x in odd], docs.schema)).repartition(5)
    got = exactdedup.unique(df, keep=keep, trie_bytes=trie_bytes)
    assert got.columns == df.columns
    all_rows = [*rows, *odd]
    same([(r.doc_id, (r.text or "").translate(LOWER)) for r in got.collect()], slow_unique(all_rows, {"max": max, "min": min}[keep]))
    have = {tuple(r) for r in df.collect()}
    assert all(tuple(r) in have for r in got.collect())
    assert exactdedup.unique(no_docs).count() == 0


@pytest.mark.parametrize("max_bytes", [1 << 20, 60])
def test_patricia_trie(max_bytes):
    rng = random.Random(9)
    trie, want = exactdedup.Patricia(lambda a, b: a + b, max_bytes), Counter()
    for _ in range(2000):
        s = bytes(rng.choices(b"ab\x00", k=rng.randint(0, 9)))
        trie.insert(s, 1)
        want[s] += 1
    assert bool(trie.spills) == (max_bytes < 1000)
    got = list(trie.items())
    assert len(got) == len(want) and dict(got) == want


# 10


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_sharding(docs, rows, no_docs, shards):
    got = histsort.shard(docs, shards, carry=("text", "source")).collect()
    size = lambda t: len((t or "").encode()) + 1
    same([(r.doc_id, r["size"], r.text_crc32, r.law, r.grown_shard, r.source) for r in got], [(i, size(t), zlib.crc32((t or "").encode()), "bytes", None, "s") for i, t, _ in rows])
    assert all(r["size"] == size(r.text) for r in got)
    sums, slots = Counter(), defaultdict(list)
    for r in got:
        sums[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(sums) <= set(range(shards))
    goal, largest = sum(sums.values()) / shards, max(size(t) for _, t, _ in rows)
    assert all(abs(sums[k] - goal) <= largest for k in range(shards))
    assert histsort.shard(no_docs).count() == 0


def test_sharding_parts_a_hot_group(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 < 2, F.lit("the same text")).otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    got = histsort.shard(df).groupBy("shard").agg(F.sum("size").alias("s"), F.count("slot").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("top")).collect()
    sizes = [r.s for r in got]
    assert len(got) == 8 and max(sizes) - min(sizes) <= 2 * 0.002 * sum(sizes) / 8 + 30
    assert all(r.n == r.d == r.top + 1 for r in got)
    spread = histsort.shard(df.where("doc_id % 3 = 2")).join(df, "doc_id").groupBy("text").agg(F.countDistinct("shard").alias("n"))
    assert spread.agg(F.max("n")).first()[0] == 1


def test_pattern_module_agrees():
    assert regex.findall(public_tokenizers.PATTERN, "a b's") == ["a", " b", "'s"]


def test_keys_of_candidates_are_not_broadcast(spark, monkeypatch):
    """All that is broadcast is a filter of bounded size, however many near copies there are; a filter too small for them loses none."""
    from pyspark.sql import functions

    sizes, broadcast = [], functions.broadcast
    monkeypatch.setattr(functions, "broadcast", lambda df: (sizes.append(df.count()), broadcast(df))[1])
    monkeypatch.setattr(simhash, "MAX_WORDS", 16, raising=False)
    texts = [" ".join(f"w{k}x{j}" for j in range(40)) + end for k in range(150) for end in ("", " end")]
    df = spark.createDataFrame([(None if i == 0 else i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = sorted(r.doc_id for r in simhash.unique(df.unionAll(df)).collect())
    assert got == [1, *range(2, 300, 2)]
    assert sizes and max(sizes) <= 16
