"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer numpy network with a calibrated temperature.

Random indexing: each word and each shape (case, marks at the end, whether it repeats the word before) has a sparse random index
vector; the vector of a word, or of a shape, is the sum of the index vectors of the words and shapes around it in the training
texts. So rare words, which have no vector of their own, are still placed by their shape. A document is the mean of its words'
vectors beside the mean of its shapes' vectors. A network with one hidden layer gives a logit; its temperature is fitted on labelled
texts that it hasn't learnt from.

It learns from at most ``most_rows`` labelled ids, one row of each, with at most ``most_chars`` characters together (documented bounds),
chosen by a hash of doc_id among the rows whose crc32 (doc_id as text) modulo 4 is not 2; every row of the table is scored, over its whole text. The model (about 1 MB, whatever the
input) goes to the workers; there is no shuffle of texts.

Null texts count as empty; an empty text has the zero vector and a score like any other, and so have very long ones; an empty table has
no scores. Rows without doc_id are scored, and in no fold. Repeated labels of a document count by
their mean; null labels are left out. Without labelled rows all scores are 0.5; with one class only, near that class.
Rows are kept as they are, repeated ones too; lang, source, labels and other columns are not read for a score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import trimmed, written

DIM, VOCABULARY, SHAPES, NONZERO, HIDDEN = 32, 4096, 1024, 6, 32
THRESHOLD = 0.7
MARKS = re.compile(r"[^\w\s]+\Z")


def shape_of(word: str) -> str:
    """Case, the marks at the end, whether there are digits or other signs, and whether it is long."""
    core = MARKS.sub("", word)
    case = "u" if len(core) > 1 and core.isupper() else "t" if core[:1].isupper() else "l" if core else "-"
    inner = "d" if any(map(str.isdigit, core)) else "s" if core and not core.isalpha() else ""
    return f"{case}{inner}{'x' if len(word) > 40 else ''}{word[len(core):][:4]}"


class Keys(dict):
    """word -> its own hash (32 bits), its shape's number (9 bits) and its number in the vocabulary (12 bits); a bounded cache."""

    def __init__(self, vocabulary: list[str], most: int = 200_000):
        super().__init__()
        self.most = most
        self.known = {w: i + 1 for i, w in enumerate(vocabulary)}

    def __missing__(self, word: str) -> int:
        if len(self) > self.most:
            self.clear()
        own = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        shape = zlib.crc32(shape_of(word).encode("utf-8", "surrogatepass")) % (SHAPES // 2)
        found = self[word] = (own << 21) | (shape << 12) | self.known.get(word.lower(), 0)
        return found

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The text's words as numbers in the vocabulary (0: none) and as shapes; a repeated word has another shape."""
        words = (text or "").split()
        key = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        shape = (key >> 12) & (SHAPES // 2 - 1)
        shape[1:][key[1:] == key[:-1]] += SHAPES // 2
        return key & (VOCABULARY - 1), shape


class Model:
    def __init__(self, vocabulary: list[str], words: np.ndarray, shapes: np.ndarray):
        self.vocabulary, self.words, self.shapes = vocabulary, words, shapes
        self.mean, self.scale = np.zeros(2 * DIM), np.ones(2 * DIM)
        self.layers, self.temperature, self.constant = None, 1.0, 0.5

    def pooled(self, words: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        n = max(1, len(words))
        return np.concatenate([np.bincount(words, minlength=VOCABULARY) @ self.words, np.bincount(shapes, minlength=SHAPES) @ self.shapes]) / n

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh(((x - self.mean) / self.scale) @ w1 + b1) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def index_vectors(n: int, rng: np.random.Generator) -> np.ndarray:
    out = np.zeros((n, DIM))
    for row in out:
        row[rng.choice(DIM, NONZERO, replace=False)] = rng.choice([-1.0, 1.0], NONZERO)
    return out


def frequent(texts: list[str | None]) -> list[str]:
    """The most frequent words, but for those seen once or twice. Hash counts leave most rare words out before any word is held."""
    size = 1 << 20
    counts = np.zeros(size, np.int64)
    own = lambda w: zlib.crc32(w.encode("utf-8", "surrogatepass")) & (size - 1)
    for t in texts:
        words = (t or "").lower().split()
        np.add.at(counts, np.fromiter(map(own, words), np.int64, len(words)), 1)
    least = max(3, int(np.sort(counts)[-2 * VOCABULARY]))  # more words than the vocabulary holds reach this count, or all do
    seen: Counter = Counter()
    for t in texts:
        seen.update(w for w in (t or "").lower().split() if counts[own(w)] >= least)
    return [w for w, c in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[: VOCABULARY - 1] if c > 2]


def fit(texts: list[str | None], labels: list[int], seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    vocabulary = frequent(texts)
    keys = Keys(vocabulary, 100_000)
    rows = [keys.of(t) for t in texts]
    index_w, index_s = index_vectors(VOCABULARY, rng), index_vectors(SHAPES, rng)
    index_w[0] = 0
    words, shapes = np.zeros((VOCABULARY, DIM)), np.zeros((SHAPES, DIM))
    for k in range(0, len(rows), 50):
        part = rows[k : k + 50]
        for step in (1, 2):
            a, b = (np.concatenate([r[i][:-step] if len(r[i]) > step else r[i][:0] for r in part]) for i in (0, 1))
            c, d = (np.concatenate([r[i][step:] for r in part]) for i in (0, 1))
            for own, left, right in ((words, a, c), (shapes, b, d)):
                near = [np.take(index_w, c, 0) + np.take(index_s, d, 0), np.take(index_w, a, 0) + np.take(index_s, b, 0)]
                for j in range(DIM):
                    own[:, j] += np.bincount(left, near[0][:, j], len(own)) + np.bincount(right, near[1][:, j], len(own))
    words[0] = 0
    for v, index in ((words, index_w), (shapes, index_s)):  # a vector's own place counts as much as what is around it
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        v += index / np.sqrt(NONZERO)
    model = Model(vocabulary, words, shapes)
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        model.constant = float((y.sum() + 1) / (len(y) + 2))
        return model
    x = np.array([model.pooled(*r) for r in rows])
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-6
    held = np.arange(len(y)) % 5 == 4 if len(y) >= 20 else np.zeros(len(y), bool)
    model.layers = train((x[~held] - model.mean) / model.scale, y[~held], rng)
    probe = held if held.any() and 0 < y[held].mean() < 1 else ~held
    z = model.logits(x[probe])

    def loss(t: float) -> float:
        p = np.clip(1 / (1 + np.exp(-np.clip(z / t, -30, 30))), 1e-9, 1 - 1e-9)
        return -float(np.mean(y[probe] * np.log(p) + (1 - y[probe]) * np.log(1 - p)))

    model.temperature = min(np.geomspace(0.25, 8, 41).tolist(), key=loss)
    return model


def train(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, epochs: int = 40, size: int = 64, rate: float = 0.004, decay: float = 1e-4) -> list[np.ndarray]:
    """Adam on the cross-entropy of a network with HIDDEN tanh units."""
    p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(())]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(y), size):
            i = order[k : k + size]
            h = np.tanh(x[i] @ p[0] + p[1])
            g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[i]) / len(i)
            back = np.outer(g, p[2]) * (1 - h * h)
            t += 1
            for j, d in enumerate((x[i].T @ back + decay * p[0], back.sum(0), h.T @ g + decay * p[2], g.sum())):
                m[j] = 0.9 * m[j] + 0.1 * d
                v[j] = 0.999 * v[j] + 0.001 * d * d
                p[j] = p[j] - rate * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
    return p


def held_out() -> Column:
    """Whether the crc32 of the doc_id as text modulo 4 is 2; a row without doc_id is in no fold."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, most_rows: int, most_chars: int) -> list[Row]:
    """doc_id, text, label: one row (that of the least text hash) for each of the first ``most_rows`` labelled ids in the order of a hash of doc_id,
    as far as their texts have ``most_chars`` characters together. The driver gets no more than that."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    place = F.md5(F.col("doc_id").cast("string").cast("binary"))
    chosen = known.orderBy(place, "doc_id").limit(most_rows).collect()
    ids = docs.sparkSession.createDataFrame([(r[0], r[1]) for r in chosen], "doc_id long, label int")
    # texts stay where they are written; rows are chosen by numbers only
    rows = written(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").withColumn("row", F.monotonically_increasing_id()), "labelled")
    one = rows.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n"), F.xxhash64("text").alias("h"), "row").groupBy("doc_id").agg(F.min(F.struct("h", "row", "n")).alias("k"))
    upto = F.sum("k.n").over(Window.orderBy(place, "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    held = one.select(F.col("k.row").alias("row"), upto.alias("upto")).where(F.col("upto") <= most_chars).select("row")
    return rows.join(F.broadcast(held), "row").select("doc_id", "text", "label").collect()


def fit_on(docs: DataFrame, labels: DataFrame, most_rows: int = 4000, most_chars: int = 60_000_000) -> Model:
    """Learns from at most ``most_rows`` labelled documents of ``most_chars`` characters together, outside the held-out fold."""
    rows = sample(docs, labels, most_rows, most_chars)
    rows.sort(key=lambda r: (r["doc_id"] * 2654435761 % 4294967296, r["doc_id"]))
    return fit([r["text"] for r in rows], [r["label"] for r in rows])


def _scorer(model: Model):  # noqa: ANN202
    keys = Keys(model.vocabulary)

    def scores(texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return model.scores(np.array([model.pooled(*keys.of(t)) for t in texts]))

    return scores


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "held_out", "score", "predicted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(sent.value)
        for b in batches:
            s = scorer(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32), pa.int32())], names)

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(trimmed(run), "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that the classifier doesn't reject, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(sent.value)
        for b in batches:
            yield b.filter(pa.array(scorer(b.column("text").to_pylist()) >= THRESHOLD, pa.bool_()))

    return docs.mapInArrow(trimmed(run), docs.schema)
