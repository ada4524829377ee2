"""Spelling variants: words one edit apart, by blocked Gram matrices of letter counts.

A word is the vector of its letter counts. One inserted or deleted letter moves it by a squared
distance of 1, one replaced letter by 2, so only pairs at a squared distance of at most 2 can be near;
a product of two blocks of vectors gives the distances of all their pairs, and what is left is
verified letter by letter.

Blocks are words of one length and one split of their letters over a few classes. One edit changes the
split by at most one letter in or out of a class, so a block meets only its neighbours: the same
split, one letter moved between two classes (same length), or one letter more (next length). Blocks
are cut into chunks of bounded size, and a pair of chunks is the unit of work, so no block, however
large, comes together in one task. Letters are all of Latin-1: a byte each.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tipscope.session import materialize

#: Letters of a run, and the share of runs that lose a letter.
LETTERS = "A-Za-zÀ-ÿ"
DROP_ONE_IN = 199
#: Shortest word and fewest occurrences; how much more frequent the form of a word must be.
MIN_LETTERS, MIN_COUNT, FACTOR = 6, 5, 5
CLASSES = 5
#: Words of a chunk at most, and letters of a chunk at most (one word may be longer).
CHUNK_WORDS, CHUNK_LETTERS = 2048, 1 << 18
#: Distinct words that a counting task remembers before it hands them on.
REMEMBERED = 300_000
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def misspelt(doc_id: str, run: str) -> str:
    """The run, without one of its letters where the hash of id and run says so."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % DROP_ONE_IN:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def _counted(min_letters: int, remembered: int):
    runs = re.compile(f"[{LETTERS}]+").findall

    def flush(counts: Counter) -> pd.DataFrame:
        kept = [(w, n) for w, n in counts.items() if len(w) >= min_letters]
        return pd.DataFrame(kept, columns=["word", "n"]).astype({"n": "int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                for word, n in Counter(runs((text or "").translate(_LOWER))).items():
                    if len(word) >= min_letters:  # a shorter one cannot grow
                        counts[misspelt(doc_id, word)] += n
                if len(counts) > remembered:
                    yield flush(counts)
                    counts.clear()
        yield flush(counts)
    return run


def word_counts(docs: DataFrame, *, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT,
                remembered: int = REMEMBERED) -> DataFrame:
    """(word, n) of the distinct words of whole texts; counted in the tasks before any shuffle."""
    texts = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"),
        F.col("text").cast("string").alias("text"))
    parts = texts.mapInPandas(_counted(min_letters, remembered), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def block_key(classes: int) -> Column:
    """[length, letters of class 1, 2, ...]; the last class is what remains."""
    letters = [c for c in (*range(97, 123), *range(0xC0, 0x100))]
    sizes = []
    for k in range(classes - 1):
        of_class = "".join(chr(c) for c in letters if c % classes == k)
        sizes.append(F.length("word") - F.length(F.translate("word", of_class, "")))
    return F.array(F.length("word"), *sizes)


def _moves(classes: int) -> list[list[int]]:
    """Changes of a key by which each pair of neighbouring blocks is met once."""
    def change(length: int, more: int, less: int | None = None) -> list[int]:
        key = [length] + [0] * (classes - 1)
        if more < classes - 1:
            key[more + 1] += 1
        if less is not None and less < classes - 1:
            key[less + 1] -= 1
        return key

    return ([[0] * classes] + [change(1, k) for k in range(classes)]
            + [change(0, i, j) for i in range(classes) for j in range(i + 1, classes)])


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chunks of the sorted words of a partition: one key each, of bounded size."""
    key, words, counts, letters = None, [], [], 0

    def chunk():
        return pd.DataFrame({
            "key": [list(key)], "length": [key[0]],
            "words": ["".join(words).encode("latin-1")],
            "counts": [np.array(counts, "<i8").tobytes()]})

    for batch in batches:
        for block, word, n in zip(batch["key"], batch["word"], batch["n"]):
            block = tuple(map(int, block))
            if words and (block != key or len(words) >= CHUNK_WORDS
                          or letters + len(word) > CHUNK_LETTERS):
                yield chunk()
                words, counts, letters = [], [], 0
            key = block
            words.append(word)
            counts.append(n)
            letters += len(word)
    if words:
        yield chunk()


def word_chunks(words: DataFrame, classes: int = CLASSES) -> DataFrame:
    """(chunk, key, length, words, counts) of words (word, n). Ranges of (key, word) spread a
    large block over several partitions."""
    keyed = words.select(block_key(classes).alias("key"), "word", "n")
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartitionByRange(parts, "key", "word").sortWithinPartitions("key", "word")
    chunks = ordered.mapInPandas(_cut, "key array<int>, length int, words binary, counts binary")
    return chunks.withColumn("chunk", F.monotonically_increasing_id())


def _codes(words: bytes, length: int) -> np.ndarray:
    return np.frombuffer(words, np.uint8).reshape(-1, length)


def _letter_counts(codes: np.ndarray) -> np.ndarray:
    n = len(codes)
    places = codes + 256 * np.arange(n, dtype=np.int64)[:, None]
    return np.bincount(places.ravel(), minlength=256 * n).reshape(n, 256)


def within_two(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two blocks of letters whose counts are at a squared distance of at most 2.

    One matrix product: |x|^2 + |y|^2 - 2 x.y with the norms as two more columns. Whole numbers
    below 2^24 are exact in single precision, others are taken in double.
    """
    x, y = _letter_counts(left), _letter_counts(right)
    used = np.flatnonzero(x.any(axis=0) | y.any(axis=0))
    kind = np.float32 if max(left.shape[1], right.shape[1]) < 2048 else np.float64
    x, y = x[:, used].astype(kind), y[:, used].astype(kind)
    xx, yy = (x * x).sum(axis=1)[:, None], (y * y).sum(axis=1)[:, None]
    gram = np.hstack([-2 * x, xx, np.ones_like(xx)]) @ np.hstack([y, np.ones_like(yy), yy]).T
    return np.nonzero(gram <= 2)


def one_edit(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether each row of ``left`` becomes the same row of ``right`` by one edit. Rows of
    ``right`` are as long, or one letter longer."""
    if left.shape[1] == right.shape[1]:
        return (left != right).sum(axis=1) == 1
    same_start = np.logical_and.accumulate(left == right[:, :-1], axis=1).sum(axis=1)
    same_end = np.logical_and.accumulate((left == right[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return same_start + same_end >= left.shape[1]


def _near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Both directions of all near pairs of two chunks (or of one chunk with itself)."""
    step = 1 << 18
    for batch in batches:
        for row in batch.itertuples(index=False):
            left, right = _codes(row.words, row.length), _codes(row.words2, row.length2)
            i, j = within_two(left, right)
            if row.chunk == row.chunk2:
                i, j = i[i < j], j[i < j]
            kept = [one_edit(left[i[k:k + step]], right[j[k:k + step]])
                    for k in range(0, len(i), step)]
            if not kept:
                continue
            keep = np.concatenate(kept)
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            names = [[bytes(w).decode("latin-1") for w in left],
                     [bytes(w).decode("latin-1") for w in right]]
            n, m = np.frombuffer(row.counts, "<i8"), np.frombuffer(row.counts2, "<i8")
            first, second = [names[0][k] for k in i], [names[1][k] for k in j]
            yield pd.DataFrame({"word": first + second, "other": second + first,
                                "other_n": np.concatenate([m[j], n[i]])})


def near_words(words: DataFrame, *, classes: int = CLASSES) -> DataFrame:
    """(word, other, other_n): each word of (word, n) with each word one edit away."""
    chunks = materialize(word_chunks(words, classes), "word-chunks")
    moves = F.array(*[F.array(*[F.lit(x) for x in move]) for move in _moves(classes)])
    meeting = F.transform(moves, lambda move: F.zip_with("key", move, lambda a, b: a + b))
    left = chunks.select("chunk", F.col("key").alias("own"), F.explode(meeting).alias("key"))
    right = chunks.select(F.col("chunk").alias("chunk2"), "key")
    pairs = left.join(right, "key").where(
        (F.col("own") != F.col("key")) | (F.col("chunk") <= F.col("chunk2")))
    sides = [chunks.select("chunk", "length", "words", "counts"),
             chunks.select(*[F.col(c).alias(c + "2")
                             for c in ("chunk", "length", "words", "counts")])]
    met = pairs.select("chunk", "chunk2").join(sides[0], "chunk").join(sides[1], "chunk2")
    return met.mapInPandas(_near, "word string, other string, other_n long")


def _roots(forms: DataFrame, most: int, factor: int) -> DataFrame:
    """(word, root) of words with a form (word, form), by doubling: each form is ``factor`` times
    as frequent as the word before it, so the longest chain follows from the largest count."""
    hops = materialize(forms.select("word", F.col("form").alias("root")), "forms")
    longest, reach = 1, 1
    while factor ** longest <= most:
        longest += 1
    while reach < longest:
        ahead = hops.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        hops = materialize(hops.join(ahead, "root", "left").select(
            "word", F.coalesce("_next", "root").alias("root")), "forms")
        reach *= 2
    return hops


def spelling_variants(docs: DataFrame, *, min_letters: int = MIN_LETTERS,
                      min_count: int = MIN_COUNT, factor: int = FACTOR,
                      classes: int = CLASSES) -> DataFrame:
    """Frequent words of ``docs`` (doc_id, text): (word, form, root, n, n_near, form_n).

    A word's form is its most frequent near word, if that is ``factor`` times as frequent; its root
    is where forms lead to. Jobs run while this is built.
    Defined cases: null and empty texts have no words; a null id counts as the empty text in the
    hash; repeated rows count each; of near words equally frequent the first in code-point order is
    the form; an empty table gives no rows; other columns are ignored.
    """
    if factor < 2:
        raise ValueError("a form must be more frequent than the word, or forms may lead in circles")
    words = materialize(word_counts(docs, min_letters=min_letters, min_count=min_count), "words")
    near = near_words(words, classes=classes).groupBy("word").agg(
        F.count("*").alias("n_near"),
        F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("other")))
        .alias("_best"))
    often = -F.col("_best.minus") >= factor * F.col("n")
    judged = materialize(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(often, F.col("_best.other")).alias("form"),
        F.when(often, -F.col("_best.minus")).alias("form_n")), "judged-words")
    most = words.agg(F.max("n").alias("n")).first()["n"] or 0
    roots = _roots(judged.where(F.col("form").isNotNull()), most, factor)
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
