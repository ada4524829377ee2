"""Supervised text classifier on averaged subword embeddings.

Features of a document are its words, the character n-grams of each word, and a mark for each word
that repeats, with the word before it, an earlier place of the text. Features are hashed to rows of
an embedding table; a document is the mean of its features' vectors; a softmax layer follows. Both
are learned by stochastic gradient descent in numpy, on a bounded sample of labelled rows. Tasks
count the features of whole texts; the driver gets only the counts.

The score is linear in the mean, so for scoring each word needs one number, remembered while a task
runs: a text costs one look-up for each word.
"""

from __future__ import annotations

import zlib
from collections import Counter as Words
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipscope.llm.common import GOLDEN, id_remainder, mix

#: Labelled rows of each class to learn from, at most; rows of the table of vectors; and so on.
SAMPLE_ROWS, BUCKETS, WIDTH = 2_000, 1 << 16, 8
GRAMS = (3, 4)
EPOCHS, RATE, SEED = 6, 0.5, 7
AGAIN = b"\x00again"
Counts = tuple[np.ndarray, np.ndarray]


def word_features(word: bytes, buckets: int = BUCKETS) -> list[int]:
    """Rows of a word and of the n-grams of its characters between edge marks."""
    marked = "\x02" + word.decode("utf-8", "replace") + "\x03"
    found = [xxhash.xxh3_64_intdigest(word) % buckets]
    for n in GRAMS:
        found += [xxhash.xxh3_64_intdigest(marked[i:i + n].encode("utf-8", "replace"), n) % buckets
                  for i in range(len(marked) - n + 1)]
    return found


def words_with_marks(text: str | None) -> tuple[list[bytes], int]:
    """Words of a text as they are spelled, and how many repeat an earlier pair of words."""
    words = (text or "").encode("utf-8").split()
    if len(words) < 3:
        return words, 0
    keys = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    pairs = mix(keys[:-1] * GOLDEN + keys[1:])
    return words, len(pairs) - len(np.unique(pairs))


@dataclass
class Model:
    vectors: np.ndarray
    weights: np.ndarray  # of the softmax: width x 2
    bias: np.ndarray

    def word_value(self, features: list[int]) -> float:
        """What the features add to the difference of the two classes' scores, before averaging."""
        side = self.weights[:, 1] - self.weights[:, 0]
        return float(self.vectors[features].sum(axis=0) @ side)


class WordNumbers(dict):
    """Word -> a number, under which ``values`` and ``counts`` hold what its features add and how
    many they are."""

    def __init__(self, table: np.ndarray):
        super().__init__()
        self.table = table
        self.values, self.counts = np.zeros(1 << 12), np.zeros(1 << 12, np.int64)

    def __missing__(self, word: bytes) -> int:
        features = word_features(word, len(self.table))
        number = self[word] = len(self)
        if number == len(self.values):
            self.values = np.concatenate([self.values, np.zeros(number)])
            self.counts = np.concatenate([self.counts, np.zeros(number, np.int64)])
        self.values[number] = self.table[features].sum()
        self.counts[number] = len(features)
        return number


class Scorer:
    """Scores texts with a model. A text becomes the array of its words' numbers, from which come
    the sums over its features and, as pairs of neighbours, the repeats."""

    def __init__(self, model: Model, limit: int = 300_000):
        self.limit = limit
        self.table = model.vectors @ (model.weights[:, 1] - model.weights[:, 0])
        self.bias = float(model.bias[1] - model.bias[0])
        again = word_features(AGAIN, len(self.table))
        self.again = float(self.table[again].sum()), len(again)
        self.numbers = WordNumbers(self.table)

    def score(self, text: str | None) -> float:
        if len(self.numbers) > self.limit:
            self.numbers = WordNumbers(self.table)
        words = (text or "").encode("utf-8").split()
        known = self.numbers
        at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        repeats = 0
        if len(at) > 2:
            pairs = (at[:-1] << 32) | at[1:]
            pairs.sort()
            repeats = int(np.count_nonzero(pairs[1:] == pairs[:-1]))
        total = known.values[at].sum() + repeats * self.again[0]
        n = int(known.counts[at].sum()) + repeats * self.again[1]
        return 1.0 / (1.0 + np.exp(-np.clip(total / max(n, 1) + self.bias, -500.0, 500.0)))


class FeatureCounter:
    """Counts the hashed features of whole texts, remembering the features of words."""

    def __init__(self, buckets: int = BUCKETS, limit: int = 50_000):
        self.buckets, self.limit = buckets, limit
        self.known: dict[bytes, np.ndarray] = {}

    def count(self, text: str | None) -> Counts:
        """Rows of the table, ascending, and how often each occurs."""
        words, repeats = words_with_marks(text)
        if len(self.known) > self.limit:
            self.known.clear()
        often = Words(words)
        if repeats:
            often[AGAIN] += repeats
        for word in often.keys() - self.known.keys():
            self.known[word] = np.array(word_features(word, self.buckets), np.int32)
        parts = [self.known[w] for w in often]
        rows = np.concatenate(parts or [np.empty(0, np.int32)])
        times = np.repeat(np.fromiter(often.values(), np.int64, len(often)), [*map(len, parts)])
        total = np.bincount(rows, times, self.buckets)
        found = np.flatnonzero(total)
        return found.astype(np.int32), total[found].astype(np.int32)


def fit(texts: list[str], labels: np.ndarray, *, buckets: int = BUCKETS, **options) -> Model:
    """Learn from whole texts; see ``fit_counts``."""
    return fit_counts([*map(FeatureCounter(buckets).count, texts)], labels, buckets=buckets, **options)


def fit_counts(docs: list[Counts], labels: np.ndarray, *, epochs: int = EPOCHS, rate: float = RATE,
               buckets: int = BUCKETS, width: int = WIDTH, seed: int = SEED) -> Model:
    """Learn the table and the softmax layer; classes weigh the same in the loss.

    Without rows of both classes the model gives every text one half, or the one class there is.
    """
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1.0 / width, 1.0 / width, (buckets, width))
    weights, bias = np.zeros((width, 2)), np.zeros(2)
    counts = np.bincount(labels.astype(int), minlength=2)[:2] if len(labels) else np.zeros(2)
    if not counts.all():
        bias[:] = np.where(counts > 0, 2.0, 0.0)
        return Model(vectors, weights, bias)
    balance = counts.sum() / (2.0 * counts)
    steps, total = 0, epochs * len(docs)
    # The softmax starts at zero, so the vectors move only once it has a direction.
    for _ in range(epochs):
        for k in random.permutation(len(docs)):
            rows, n = docs[k]
            step = rate * (1.0 - steps / total)
            steps += 1
            label = int(labels[k])
            if not len(rows):
                hidden = np.zeros(width)
            else:
                share = n / n.sum()
                hidden = share @ vectors[rows]
            logits = hidden @ weights + bias
            p = np.exp(logits - logits.max())
            error = p / p.sum()
            error[label] -= 1.0
            error *= balance[label]
            if len(rows):
                vectors[rows] -= step * np.outer(share, weights @ error) * width
            weights -= step * np.outer(hidden, error)
            bias -= step * error
    return Model(vectors, weights, bias)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, *, parts: int, apart: int,
                  rows: int) -> DataFrame:
    """At most ``rows`` labelled texts of each class, chosen by a hash of the id; none of those
    whose crc32(doc_id as text) mod ``parts`` is ``apart``."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"),
                          F.col(label).cast("int").alias("label"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)
                        & (id_remainder("doc_id", parts) != apart))
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    dealt = known.withColumn("_h", F.xxhash64("doc_id"))
    chosen = [dealt.where(F.col("label") == k).orderBy("_h", "doc_id").limit(rows) for k in (0, 1)]
    # 2 x rows ids, so the side that is broadcast has a fixed size.
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.col("text").cast("string").alias("text"))
    return texts.join(ids, "doc_id").select("doc_id", "text", "label", "_h")


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counter = FeatureCounter()
    for batch in batches:
        counts = [counter.count(t) for t in batch["text"]]
        yield batch[["doc_id", "label", "_h"]].assign(
            features=[_packed(np.diff(rows, prepend=0)) for rows, _ in counts],
            times=[_packed(n) for _, n in counts])


def _packed(numbers: np.ndarray) -> bytes:
    return zlib.compress(numbers.astype("<i4").tobytes(), 1)


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), "<i4")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", *, parts: int = 3,
          apart: int = 1, rows: int = SAMPLE_ROWS) -> Model:
    """Fit on the bounded sample of rows. Tasks count the features of each whole text, so the
    driver gets at most ``BUCKETS`` pairs of numbers for each."""
    sample = training_rows(docs, labels, label, parts=parts, apart=apart, rows=rows)
    counted = sample.mapInPandas(
        _counted, "doc_id long, label int, _h long, features binary, times binary")
    # Of rows that share an id, one text teaches.
    found = counted.groupBy("doc_id", "label", "_h").agg(
        F.min(F.struct("features", "times")).alias("text"))
    got = sorted(found.select("doc_id", "label", "_h", "text.*").collect(),
                 key=lambda r: (r["_h"], r["doc_id"]))
    counts = [(_unpacked(r["features"]).cumsum(dtype=np.int32), _unpacked(r["times"])) for r in got]
    return fit_counts(counts, np.array([r["label"] for r in got], int))


def _scores(model):
    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model.value)
        for batch in texts:
            yield pd.Series([scorer.score(t) for t in batch], dtype=float)
    return score


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", *, parts: int = 3,
                   apart: int = 1, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Probability of label 1 for each whole text of ``docs`` (doc_id, text).

    ``labels`` (doc_id, ``label`` of 0 or 1) teaches by rows whose remainder is not ``apart``; only
    the text enters a score. Runs jobs while it is built (sample and fit).
    Defined cases: a null or empty text has no features and gets the score of the bias; a null id
    counts as the empty text in the split and comes back null; repeated rows are scored each; an
    empty table gives no rows; labels other than 0 and 1 are ignored, an id with both counts as 0;
    without labels every score is one half; other columns are ignored.
    """
    model = train(docs, labels, label, parts=parts, apart=apart, rows=rows)
    score = _scores(docs.sparkSession.sparkContext.broadcast(model))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (id_remainder("doc_id", parts) == apart).alias("held_out"),
        score(F.col("text").cast("string")).alias("score"),
    ).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int"))


def keep_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", *,
                 taught_by: DataFrame | None = None) -> DataFrame:
    """Rows of ``docs`` that the classifier does not reject, with all their columns. It learns from
    the labelled rows of ``taught_by``, or of ``docs`` themselves.

    Defined cases: null and empty texts are judged by the bias alone; a null id does not matter;
    repeated rows all stay or go; an empty table gives no rows; without labels all rows stay; other
    columns may have any name.
    """
    model = train(docs if taught_by is None else taught_by, labels, label)
    score = _scores(docs.sparkSession.sparkContext.broadcast(model))
    return docs.where(score(F.col("text").cast("string")) >= 0.5)
