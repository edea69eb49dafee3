"""Quality classifier: supervised subword embeddings trained by stochastic gradient descent in numpy.

Words, pairs of adjacent words and the character n-grams of words are hashed to learned vectors; a document is the mean of
its vectors, followed by a softmax of two classes. Once trained, a word's share of the score is a number that does not depend on the document.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import in_arrow, lean, map_rows, slices

BUCKETS, PAIRS, WIDTH, GRAM = 1 << 15, 1 << 16, 8, 3
#: Labelled rows that a model is fitted on, at most.
TRAINING_ROWS = 4000
EPOCHS, RATE = 4, 0.5
CACHE = 600_000


def features_of(word: str) -> list[int]:
    """Hash of a word, its bucket and those of its character n-grams; digits count alike."""
    if not word.isalpha():
        word = "".join("0" if c.isdigit() else c for c in word)
    raw = f"<{word}>".encode()
    own = crc32(raw)
    return [own, own % BUCKETS, *[crc32(raw[i : i + GRAM]) % BUCKETS for i in range(len(raw) - GRAM + 1)]]


def pair_buckets(words: np.ndarray) -> np.ndarray:
    """Hash buckets of the pairs of adjacent words, from the words' own hashes.

    A pair's hash is that of its words' exclusive or, so all pairs of equal words share a bucket and what is learned of a
    repeated word holds for words never seen.
    """
    x = words[:-1] ^ words[1:]
    return BUCKETS + (x ^ x >> 16) % PAIRS


def document(text: str, known: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's words, character n-grams and word pairs, and the share of each."""
    ids: list[int] = []
    own: list[int] = []
    for w in text.split():
        f = known.get(w)
        if f is None:
            f = known[w] = features_of(w)
        own.append(f[0])
        ids += f[1:]
    all_ = np.concatenate([np.array(ids, np.int64), pair_buckets(np.array(own, np.int64))]) if ids else np.zeros(0, np.int64)
    buckets, counts = np.unique_counts(all_)
    return buckets, counts / max(1, len(all_))


def train(texts: list[str], labels: list[int], seed: int = 7) -> tuple[np.ndarray, float]:
    """Score weight of each bucket and the bias, for label 1 against label 0."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS + PAIRS, WIDTH))
    vectors[BUCKETS:] = 0  # most pairs are never seen in training and then say nothing
    out, bias = np.zeros((2, WIDTH)), np.zeros(2)
    known: dict[str, list[int]] = {}
    docs = [document(t, known) for t in texts]
    y = np.array(labels, int)
    if len(set(labels)) < 2:
        return np.zeros(BUCKETS + PAIRS), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    bias[:] = np.log(np.bincount(y, minlength=2) / len(y))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(len(docs)):
            buckets, share = docs[i]
            own = vectors[buckets]
            mean = share @ own
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            step = out.T @ p
            out -= rate * np.outer(p, mean)
            bias -= rate * 0.1 * p
            vectors[buckets] = own - (rate * 20) * share[:, None] * step  # a bucket's share is small, so its step is larger
    return vectors @ (out[1] - out[0]), float(bias[1] - bias[0])


def held_out(id_col: str) -> Column:
    """Whether a row is kept from training: the checksum of its id as text is a multiple of 5."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAINING_ROWS) -> tuple[np.ndarray, float]:
    """Fit on at most ``rows`` labelled documents that are not held out, taken in the order of a hash of their ids.

    The sample is bounded, so it is trained in one task; only the weights (one number a bucket) return to the driver. Null
    labels and ids are left out; an id's label is its smallest. Without labelled rows every score is one half.
    """
    chosen = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_label")).where(F.col("_id").isNotNull() & F.col("_label").isin(0, 1) & ~held_out("_id"))
    chosen = chosen.groupBy("_id").agg(F.min("_label").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    sample = texts.join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.min("_label").alias("_label"), F.min("_text").alias("_text"))

    @lean
    def run(batches):
        found = [(b.column(0)[i].as_py(), b.column(1)[i].as_py(), b.column(2)[i].as_py()) for b in batches for i in range(b.num_rows)]
        found.sort()
        if found:
            weights, bias = train([t for _, _, t in found], [n for _, n, _ in found])
            yield pa.RecordBatch.from_arrays([pa.array([weights.astype("<f4").tobytes()]), pa.array([bias])], names=["weights", "bias"])

    got = sample.repartition(1).transform(in_arrow, run, "weights binary, bias double").collect()
    return (np.frombuffer(got[0][0], "<f4").astype(float), got[0][1]) if got else (np.zeros(BUCKETS + PAIRS), 0.0)


class Scorer:
    """Scores texts; each distinct word's share is computed once."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = np.asarray(weights, float), bias
        self.list = self.weights.tolist()
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.sums, self.counts, self.hashes = np.zeros(1024), np.zeros(1024, np.int64), np.zeros(1024, np.int64)

    def learn(self, words: set[str]) -> None:
        """Number the new words and keep the sum of their buckets' weights, how many these are, and the word's hash."""
        if len(self.known) > CACHE:
            self.forget()
        new = [w for w in words if w not in self.known]
        while len(self.sums) < len(self.known) + len(new):
            self.sums, self.counts, self.hashes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.sums, self.counts, self.hashes))
        weights = self.list
        for w in new:
            k = self.known[w] = len(self.known)
            own, *ids = features_of(w)
            self.sums[k], self.counts[k], self.hashes[k] = sum([weights[i] for i in ids]), len(ids), own

    def __call__(self, text: str) -> float:
        words = text.split()
        if not words:
            return self.squashed(0.0)
        try:
            at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        except KeyError:
            self.learn(set(words))
            at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        pairs = self.weights[pair_buckets(self.hashes[at])]
        return self.squashed(float(self.sums[at].sum() + pairs.sum()) / (int(self.counts[at].sum()) + len(pairs)))

    def squashed(self, mean: float) -> float:
        return 1 / (1 + float(np.exp(-np.clip(mean + self.bias, -50, 50))))


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Scores of all texts: the id, held_out, score, predicted (1 from ``threshold`` on).

    A null or empty text has the score of the bias alone, repeated ids are scored row by row, a null id is not held out, no
    rows give no rows, and other columns are not read.
    """
    weights, bias = model
    packed = weights.astype("<f4").tobytes()

    def make():
        s = Scorer(np.frombuffer(packed, "<f4"), bias)

        def run(part: pa.RecordBatch) -> list:
            scores = np.array([s(t or "") for t in part.column(2).to_pylist()])
            return [part.column(0), part.column(1), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))]

        return run

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias(text_col))
    return map_rows(rows, make, f"{id_col} long, held_out boolean, score double, predicted int", text=2)


def keep_good(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``, with all their columns."""
    weights, bias = model
    packed, at = weights.astype("<f4").tobytes(), docs.columns.index(text_col)

    @lean
    def run(batches):
        s = Scorer(np.frombuffer(packed, "<f4"), bias)
        for batch in batches:
            for part in slices(batch, at):
                yield part.filter(pa.array([s(t or "") >= threshold for t in part.column(at).to_pylist()], pa.bool_()))

    return docs.transform(in_arrow, run, docs.schema)
