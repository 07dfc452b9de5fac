"""Language identification by string kernels.

The kernel of two texts is the number of character n-grams (n = 1..max_n, the
blended spectrum, presence only) that both hold, divided by the geometric mean
of their own numbers. Nystrom landmarks turn it into a finite feature map,
one-versus-rest kernel ridge regression is solved on the driver from a bounded
sample, and executors score every whole text by products of presence matrices
with the landmark matrix.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import FEW, map_arrow, row_key, two_columns, written

UND = "und"
#: Code points handled at once; longer texts are cut with an overlap, which loses no n-gram.
PIECE = 1 << 20
#: Times the wanted sample that passes the first, hash-bounded choice.
OVERSAMPLE = 16
#: Characters of the longest landmark: their whole texts reach the driver.
MARK_CHARS = 1 << 16
#: Bytes up to which the landmark matrix is held whole; beyond, only its entries are.
DENSE_BYTES = 64 << 20


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def ngrams(text: str, max_n: int) -> list[np.ndarray]:
    """For n = 1..max_n (3 at most) the sorted distinct n-grams of the lower-cased text, packed exactly, 21 bits a code point."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    out = []
    for n in range(1, max_n + 1):
        parts = []
        for at in range(0, max(0, len(points) - n + 1), PIECE):
            p = points[at : at + PIECE + n - 1]
            code = p[: len(p) - n + 1].copy()
            for k in range(1, n):
                code = (code << np.uint64(21)) | p[k : len(p) - n + 1 + k]
            code.sort()
            parts.append(code[np.r_[True, code[1:] != code[:-1]]])
        out.append(parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64))
    return out


@dataclass
class Landmarks:
    """Presence matrix of the landmark texts: vocab[n-1] are sorted codes, rows from first[n-1] on belong to them.

    The rows' landmarks are `marks`, from starts[row] to starts[row + 1]. Up to
    DENSE_BYTES the matrix is also held whole, which multiplies faster.
    """

    max_n: int
    vocab: list[np.ndarray]
    first: list[int]
    starts: np.ndarray
    marks: np.ndarray
    own: np.ndarray  # n-grams of each landmark
    matrix: np.ndarray | None

    @classmethod
    def of(cls, texts: list[str], max_n: int, dense_bytes: int = DENSE_BYTES) -> Landmarks:
        grams = [ngrams(t, max_n) for t in texts]
        vocab = [np.unique(np.concatenate([g[n] for g in grams])) for n in range(max_n)]
        first = np.cumsum([0, *map(len, vocab)]).tolist()
        rows = np.concatenate([first[n] + np.searchsorted(vocab[n], g[n]) for g in grams for n in range(max_n)]).astype(np.int64)
        marks = np.repeat(np.arange(len(texts), dtype=np.int32), [sum(map(len, g)) for g in grams])
        starts = np.searchsorted(np.sort(rows), np.arange(first[-1] + 1))
        matrix = None
        if 4 * first[-1] * len(texts) <= dense_bytes:
            matrix = np.zeros((first[-1], len(texts)), np.float32)
            matrix[rows, marks] = 1
        own = np.maximum(1, np.bincount(marks, minlength=len(texts)))
        return cls(max_n, vocab, first[:-1], starts, marks[np.argsort(rows, kind="stable")], own, matrix)

    def rows_of(self, text: str) -> tuple[np.ndarray, int]:
        """Rows of the n-grams that the text shares with the landmarks, and how many it has."""
        found, total = [], 0
        for n, codes in enumerate(ngrams(text, self.max_n)):
            total += len(codes)
            vocab = self.vocab[n]
            if len(codes) and len(vocab):
                few, many = (codes, vocab) if len(codes) < len(vocab) else (vocab, codes)
                at = np.searchsorted(many, few)
                at[at == len(many)] = 0
                hit = many[at] == few
                found.append(self.first[n] + (at[hit] if few is codes else np.flatnonzero(hit)))
        return np.concatenate(found) if found else np.zeros(0, np.int64), total

    def kernel(self, texts: list[str], batch: int = 128) -> np.ndarray:
        """Normalised kernel of each text with each landmark, a batch of texts per matrix product."""
        out = np.zeros((len(texts), len(self.own)), np.float32)
        for at in range(0, len(texts), batch):
            rows, totals = zip(*map(self.rows_of, texts[at : at + batch]), strict=True)
            if self.matrix is not None:
                x = np.zeros((len(rows), len(self.matrix)), np.float32)
                for i, r in enumerate(rows):
                    x[i, r] = 1
                both = x @ self.matrix
            else:  # rows of the sparse matrix, added up a text at a time
                both = np.zeros((len(rows), len(self.own)), np.float32)
                for i, r in enumerate(rows):
                    n = self.starts[r + 1] - self.starts[r]
                    places = np.repeat(self.starts[r] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    both[i] = np.bincount(self.marks[places], minlength=len(self.own))
            out[at : at + len(rows)] = both / np.sqrt(np.maximum(1, totals))[:, None] / np.sqrt(self.own)
        return out


@dataclass
class LanguageModel:
    langs: list[str]
    landmarks: Landmarks
    weights: np.ndarray  # landmarks x languages

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; `und` and 0 without a letter or without languages."""
        langs, scores = [UND] * len(texts), np.zeros(len(texts))
        if self.langs and (ok := [i for i, t in enumerate(texts) if has_letter(t)]):
            decided = self.landmarks.kernel([texts[i] for i in ok]) @ self.weights
            for i, row in zip(ok, decided, strict=True):
                best = int(row.argmax())
                langs[i], scores[i] = self.langs[best], min(1.0, max(0.0, (float(row[best]) + 1) / 2))
        return langs, scores


def ridge(kernels: np.ndarray, own: np.ndarray, targets: np.ndarray, penalty: float) -> np.ndarray:
    """Weights on raw landmark kernels: Nystrom map own^(-1/2), then ridge regression of each column of targets."""
    values, vectors = np.linalg.eigh(own.astype(np.float64))
    keep = values > 1e-6 * values.max()
    to_map = vectors[:, keep] / np.sqrt(values[keep])
    phi = kernels.astype(np.float64) @ to_map
    solved = np.linalg.solve(phi.T @ phi + penalty * np.eye(phi.shape[1]), phi.T @ targets)
    return (to_map @ solved).astype(np.float32)


def fit(docs: DataFrame, learn: Column, id_col="doc_id", text_col="text", lang_col="lang", per_lang=400, marks_per_lang=16, max_n=3, penalty=0.05) -> LanguageModel:
    """Learn from rows where `learn` holds and text, id and language aren't null.

    The sample is bounded: of each language the per_lang rows with the smallest
    hash of id and text (fewer if most of a language's texts are null or without
    a letter), and of these the first marks_per_lang of up to MARK_CHARS
    characters are landmarks. Rows that share an id are told apart by their
    texts; repeated rows count once. The table is read twice, for the number of
    rows of each language and for what may be in the sample, which is written.
    Rows of the sample reach the driver as kernel values only, the landmarks
    whole. No labelled row, or no landmark: a model that says `und`.
    """
    i, key = row_key(id_col, text_col)
    t, lang = F.col(f"`{text_col}`").cast("string"), F.col(f"`{lang_col}`").cast("string")
    rows = docs.where(learn).select(i.alias("i"), t.alias("t"), lang.alias("l"), key.alias("h")).where("i IS NOT NULL AND t IS NOT NULL AND l IS NOT NULL")
    # Hashes that could be among the smallest: OVERSAMPLE times as many as wanted, so that a language's one task gets as many rows at any size.
    known = docs.where(learn).select(lang.alias("l")).where("l IS NOT NULL").groupBy("l").agg(F.count("l").alias("n"))
    share = F.least(F.lit(1.0), F.lit(float(OVERSAMPLE * per_lang)) / F.col("n"))
    known = known.select(F.col("l").alias("kl"), (F.lit(-(2.0**63)) + share * F.lit(2.0**64)).alias("most"))
    low = rows.join(F.broadcast(known), F.col("l") == F.col("kl")).where(F.col("h").cast("double") <= F.col("most")).where("t RLIKE '\\\\p{L}'")  # a row a language
    low = written(low.select("i", "t", "l", "h"), "languages")
    by_hash = Window.partitionBy("l").orderBy("h", "i")
    chosen = low.select("i", "l", "h", (F.length("t") <= MARK_CHARS).alias("fits")).distinct().withColumn("rank", F.row_number().over(by_hash)).where(F.col("rank") <= per_lang)
    chosen = chosen.withColumn("mark", F.when(F.col("fits"), F.sum(F.col("fits").cast("int")).over(by_hash))).select(F.col("l").alias("cl"), F.col("h").alias("ch"), F.col("i").alias("ci"), "mark")
    sample = low.join(F.broadcast(chosen), (F.col("l") == F.col("cl")) & (F.col("h") == F.col("ch")) & (F.col("i") == F.col("ci"))).dropDuplicates(["l", "h", "i"]).select("l", "h", "i", "t", "mark")  # per_lang rows a language: a bound that doesn't grow
    marks = sorted(sample.where(F.col("mark") <= marks_per_lang).collect(), key=lambda r: (r.l, r.mark))
    if not marks:
        return LanguageModel([], Landmarks.of([""], max_n), np.zeros((1, 0), np.float32))
    landmarks = Landmarks.of([r.t for r in marks], max_n)
    own = landmarks.kernel([r.t for r in marks])
    shared = docs.sparkSession.sparkContext.broadcast(landmarks)

    def kernels(batches):
        import pyarrow as pa

        for b in batches:
            k = shared.value.kernel(b.column("t").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("l"), b.column("h"), pa.array(list(k), pa.list_(pa.float32()))], ["l", "h", "k"])

    got = sorted(map_arrow(sample.select("l", "h", "t"), kernels, "l string, h bigint, k array<float>").collect(), key=lambda r: (r.l, r.h))
    langs = sorted({r.l for r in got})
    targets = np.array([[1.0 if r.l == x else -1.0 for x in langs] for r in got])
    return LanguageModel(langs, landmarks, ridge(np.array([r.k for r in got]), (own + own.T) / 2, targets, penalty))


def classify(docs: DataFrame, model: LanguageModel, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, lang_pred, score) of each row, by its whole text. Null and letterless texts: `und`, 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            langs, scores = shared.value.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return map_arrow(two_columns(docs, id_col, text_col), run, "doc_id bigint, lang_pred string, score double")


def keep_known(docs: DataFrame, model: LanguageModel, min_score: float = 0.0, text_col="text") -> DataFrame:
    """Rows of docs, columns unchanged, whose text has a language with at least min_score; `und` goes.

    Works on Arrow batches and filters them in place, so no join is needed.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    at = [c.lower() for c in docs.columns].index(text_col.lower())

    def run(batches):
        import pyarrow as pa

        for b in batches:
            langs, scores = shared.value.predict(b.column(at).to_pylist())
            yield b.filter(pa.array([x != UND and s >= min_score for x, s in zip(langs, scores, strict=True)], pa.bool_()))

    return map_arrow(docs, run, docs.schema, FEW)


def held_out(id_col="doc_id") -> Column:
    """crc32 of the id as text, modulo 3, is 1; a null id is not held out (and never learned from)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))
