"""Alignment of two tokenizers on the same texts: divide and conquer at shared cuts.

Tokenizer A is a byte-level vocabulary (``tokenizers``, encodes a space and the text), B a piece
vocabulary with byte fallback (``sentencepiece``, adds the space itself). Both cover the same bytes,
so an offset at which tokens of both end cuts the text in two parts that align independently.

An interval is split at a shared end near its middle, found by bisecting ends of A among the ends of
B in growing windows; both halves go on alone. Intervals of few tokens bisect all their ends at once.
What lies between two neighbouring cuts holds no shared end and is one group.

Encoding is most of the work, and words repeat. A text is cut at single spaces between printable ASCII
or Latin letters: there A's pattern starts a new match, and no piece of B holds a space behind another
character, so neither merges across such a place. Both are checked when the files are loaded. What lies
between is encoded once and remembered; with other files texts are encoded whole.

Two linked tokens end at the same byte, so the bytes of one are a suffix of the other's. The pairs
that can ever be linked are therefore known from the two vocabularies alone; their counts over a
corpus of any size are one array of that fixed length (``Pairing.keys``), which may be broadcast.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tipscope.llm.retrieval_packing import _byte_letters
from tipscope.session import materialize

#: Intervals of so many tokens of A bisect all their ends at once; first window of a middle cut.
BLOCK, WINDOW = 1024, 8
#: Characters that are encoded together, and that an output batch holds, at least.
BATCH_CHARS, OUT_CHARS = 1 << 18, 1 << 23
SPACE_MARK = "▁"
#: Stretches between safe cuts that a worker remembers.
REMEMBERED = 400_000
_SAFE = "[!-~À-ÖØ-öø-ÿ]"
_STRETCHES = re.compile(f" (?<={_SAFE} )(?={_SAFE})").split
# Fixed values of the tokenizer file: how A cuts a text before it merges.
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True,
               "use_regex": True}

ALIGNED = ("doc_id long, n_a long, n_b long, n_groups long, groups string, "
           "pairs binary, times binary")


class _Growing:
    """An array that numbers are appended to. Place -1 holds a zero."""

    def __init__(self, kind: type):
        self.values, self.used = np.zeros(1 << 12, kind), 0

    def add(self, more: np.ndarray) -> None:
        used = self.used + len(more)
        if used >= len(self.values):  # the last place stays free
            self.values = np.concatenate([self.values, np.zeros(used, self.values.dtype)])
        self.values[self.used:used] = more
        self.used = used

    def of(self, places: np.ndarray) -> np.ndarray:
        return self.values[places].astype(np.int64)


class Stretches(dict):
    """Stretch of a text -> its number; under it the ends of its ids in two long arrays."""

    def __init__(self):
        super().__init__()
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.ids_a, self.ids_b = _Growing(np.int32), _Growing(np.int32)
        self.ends_a, self.ends_b = _Growing(np.int64), _Growing(np.int64)
        self.odd = _Growing(np.int8)  # those that the tokens do not spell

    def __missing__(self, part: str) -> int:
        number = self[part] = len(self)
        self.new.append(part)
        return number

    def learn(self, both: Pairing) -> None:
        """Encode the stretches that were asked for and not known."""
        if not self.new:
            return
        found = list(zip(*both.whole(self.new)))
        spelt = [b" " + part.encode("utf-8") for part in self.new]
        sizes = np.fromiter(map(len, spelt), np.int64, len(spelt))
        fine = True
        for by, ids, ends, size, known in (
                (found[0], self.ids_a, self.ends_a, both.size_a, both.bytes_a),
                (found[1], self.ids_b, self.ends_b, both.size_b, both.bytes_b)):
            counts = np.fromiter(map(len, by), np.int64, len(by))
            flat = np.fromiter(chain.from_iterable(by), np.int32, counts.sum())
            ends.add(counts.cumsum() + ids.used)
            ids.add(flat)
            # All bytes together and the length of each stretch: then each one's bytes.
            upto = np.append(0, size[flat].cumsum())[np.append(0, counts.cumsum())]
            fine = (fine and np.array_equal(np.diff(upto), sizes)
                    and b"".join(map(known.__getitem__, flat.tolist())) == b"".join(spelt))
        odd = (np.zeros(len(self.new), np.int8) if fine else np.array(
            [not both.covers(part, *ids) for part, *ids in zip(self.new, *found)], np.int8))
        self.odd.add(odd)
        self.new = []


class Pairing:
    """Both tokenizers, the bytes of their tokens, and all pairs of ids that can be linked."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task on each core
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # special strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte = {letter: k for k, letter in enumerate(_byte_letters())}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, k in self.a.get_vocab().items():
            self.bytes_a[k] = bytes(byte[c] for c in token if c in byte)
        self.bytes_b = [
            bytes([int(p[1:-1], 16)]) if self.b.is_byte(k)
            else b"" if self.b.is_control(k) or self.b.is_unknown(k)
            else p.replace(SPACE_MARK, " ").encode("utf-8")
            for k, p in ((k, self.b.id_to_piece(k)) for k in range(self.b.get_piece_size()))]
        self.size_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.keys = self._linkable()
        self.separable = self._separable()
        self.known = Stretches()
        largest = max(len(self.bytes_a), len(self.bytes_b))
        self.width = largest
        self.printed = [f"{k}{mark}" for mark in ",|;" for k in range(largest)]

    def _linkable(self) -> np.ndarray:
        """Sorted keys a * (size of B) + b of the pairs of which one is a suffix of the other."""
        def by_bytes(tokens):
            known: dict[bytes, list[int]] = {}
            for k, token in enumerate(tokens):
                if token:
                    known.setdefault(token, []).append(k)
            return known

        in_a, in_b, n = by_bytes(self.bytes_a), by_bytes(self.bytes_b), len(self.bytes_b)
        keys = [a * n + b for k, token in enumerate(self.bytes_a) for s in range(len(token))
                for a, b in ((k, b) for b in in_b.get(token[s:], ()))]
        keys += [a * n + b for b, token in enumerate(self.bytes_b) for s in range(1, len(token))
                 for a in in_a.get(token[s:], ())]
        return np.unique(np.array(keys, np.int64))

    def _separable(self) -> bool:
        """Whether stretches between safe cuts may be encoded apart."""
        spec = json.loads(self.a.to_str())
        return (spec["normalizer"] is None and spec["pre_tokenizer"] == _BYTE_LEVEL
                and not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in
                            map(self.b.id_to_piece, range(self.b.get_piece_size()))))

    def whole(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids by A and by B of each text as a whole."""
        encoded = self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        for by_a, by_b in zip(encoded, self.b.encode(texts, num_threads=1)):
            yield by_a.ids, by_b

    def covers(self, text: str, a: list[int], b: list[int]) -> bool:
        """Whether the bytes of both token lists are those of a space and the text."""
        whole = b" " + text.encode("utf-8")
        return (whole == b"".join(map(self.bytes_a.__getitem__, a))
                and whole == b"".join(map(self.bytes_b.__getitem__, b)))

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """Ids by A and by B of each text that is not empty; None where they do not spell it."""
        parts = [_STRETCHES(t) if self.separable else [t] for t in texts]
        known = self.known
        if len(known) > REMEMBERED or not self.separable:
            known.forget()
        at = np.fromiter(map(known.__getitem__, chain.from_iterable(parts)), np.int64)
        known.learn(self)
        first = np.cumsum([0, *map(len, parts[:-1])])
        odd = np.logical_or.reduceat(known.odd.of(at) != 0, first)
        sides = []
        for ids, ends in ((known.ids_a, known.ends_a), (known.ids_b, known.ends_b)):
            stop = ends.of(at)
            size = stop - ends.of(at - 1)  # the place before the first holds a zero
            place = np.arange(size.sum()) + np.repeat(stop - size.cumsum(), size)
            sides.append(np.split(ids.of(place), np.add.reduceat(size, first).cumsum()[:-1]))
        for k, (a, b) in enumerate(zip(*sides)):
            yield None if odd[k] else (a, b)

    def groups_text(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray,
                    last_b: np.ndarray) -> str:
        """``a1,a2|b1;a3|b2,b3``: ids of A and of B, group by group."""
        n = len(last_a)
        group_a = np.repeat(np.arange(n), np.diff(last_a, prepend=-1))
        group_b = np.repeat(np.arange(n), np.diff(last_b, prepend=-1))
        before_b = np.append(0, last_b + 1)
        out = np.empty(len(a) + len(b), np.int64)
        marked_a, marked_b = a.copy(), b.copy()
        marked_a[last_a] += self.width
        marked_b[last_b] += 2 * self.width
        out[np.arange(len(a)) + before_b[group_a]] = marked_a
        out[np.arange(len(b)) + last_a[group_b] + 1] = marked_b
        return "".join(map(self.printed.__getitem__, out.tolist()))[:-1]


@lru_cache(maxsize=2)
def pairing(path_a: str, path_b: str) -> Pairing:
    return Pairing(path_a, path_b)


def _bisect(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ends of A that are ends of B too, and their places in B."""
    at = np.searchsorted(ends_b, ends_a)
    inside = np.flatnonzero(at < len(ends_b))
    shared = inside[ends_b[at[inside]] == ends_a[inside]]
    return shared, at[shared]


def middle_cut(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[int, int] | None:
    """The shared end nearest to the middle token of A; None where the interval has none."""
    middle, reach = len(ends_a) // 2, WINDOW
    while True:
        low, high = max(0, middle - reach), min(len(ends_a), middle + reach)
        shared, places = _bisect(ends_a[low:high], ends_b)
        if len(shared):
            k = int(np.argmin(np.abs(shared + low - middle)))
            return int(shared[k]) + low, int(places[k])
        if low == 0 and high == len(ends_a):
            return None
        reach *= 4


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray,
                block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Places in A and in B of all ends they share, ascending, by divide and conquer."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    todo = [(0, len(ends_a), 0, len(ends_b))]
    while todo:
        low_a, high_a, low_b, high_b = todo.pop()
        a, b = ends_a[low_a:high_a], ends_b[low_b:high_b]
        if not len(a) or not len(b):
            continue
        if len(a) <= block:
            places_a, places_b = _bisect(a, b)
            found.append((places_a + low_a, places_b + low_b))
            continue
        cut = middle_cut(a, b)
        if cut is None:
            continue
        i, j = cut[0] + low_a, cut[1] + low_b
        found.append((np.array([i]), np.array([j])))
        todo += [(i + 1, high_a, j + 1, high_b), (low_a, i, low_b, j)]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    places_a, places_b = (np.concatenate(side) for side in zip(*found))
    return np.sort(places_a), np.sort(places_b)  # both ascend with the offset


def _batches(texts: list[str | None]) -> Iterator[list[tuple[int, str]]]:
    """Places and texts that are not empty, in lots of about ``BATCH_CHARS`` characters."""
    lot, chars = [], 0
    for k, text in enumerate(texts):
        if text:
            lot.append((k, text))
            chars += len(text)
            if chars >= BATCH_CHARS:
                yield lot
                lot, chars = [], 0
    if lot:
        yield lot


def _aligned(path_a: str, path_b: str, block: int):
    names = [c.split()[0] for c in ALIGNED.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = pairing(path_a, path_b)
        for batch in batches:
            ids, texts = batch["doc_id"].tolist(), batch["text"].tolist()
            blank = [(ids[k], 0, 0, 0, "", b"", b"") for k, t in enumerate(texts) if not t]
            rows, chars = blank, 0
            for lot in _batches(texts):
                encoded = both.encode([t for _, t in lot])
                for (k, _), found in zip(lot, encoded):
                    if found is None:
                        rows.append((ids[k], 0, 0, 0, "", b"", b""))
                        continue
                    a, b = found
                    last_a, last_b = shared_cuts(both.size_a[a].cumsum(), both.size_b[b].cumsum(),
                                                 block)
                    groups = both.groups_text(a, b, last_a, last_b)
                    linked, times = np.unique(a[last_a] * len(both.bytes_b) + b[last_b],
                                              return_counts=True)
                    pairs = np.searchsorted(both.keys, linked)
                    rows.append((ids[k], len(a), len(b), len(last_a), groups,
                                 pairs.astype("<i4").tobytes(), times.astype("<i4").tobytes()))
                    chars += len(groups)
                    if chars > OUT_CHARS:
                        yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})
                        rows, chars = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})
    return run


def aligned(docs: DataFrame, path_a: str, path_b: str, *, block: int = BLOCK) -> DataFrame:
    """Groups of each whole text of ``docs`` (doc_id, text), as ``a1,a2|b1;a3|b2,b3``.

    ``pairs`` and ``times`` are little-endian int32 arrays: which of the linkable pairs
    (``Pairing.keys``) are linked in the text, and how often. Texts that are null, empty or whose
    tokens do not spell a space and the text have no tokens, no groups and no links.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.col("text").cast("string").alias("text"))
    return texts.mapInPandas(_aligned(path_a, path_b, block), ALIGNED)


def _pair_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        pairs = np.frombuffer(b"".join(batch["pairs"]), "<i4")
        times = np.frombuffer(b"".join(batch["times"]), "<i4")
        if len(pairs):
            part = np.bincount(pairs, times, len(total)).astype(np.int64)
            part[:len(total)] += total
            total = part
    found = np.flatnonzero(total)
    yield pd.DataFrame({"pair": found.astype(np.int32), "n": total[found]})


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, n): how many links of the whole table hold each pair. A task gives one row for each
    pair it met, never more than there are linkable pairs."""
    return links.select("pairs", "times").mapInPandas(_pair_sums, "pair int, n long").groupBy(
        "pair").agg(F.sum("n").alias("n"))


def _link_sums(path_a: str, path_b: str, counts):
    @F.pandas_udf("n_links long, n_best long, count_sum long")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        both, n = pairing(path_a, path_b), counts.value
        of_b = both.keys % len(both.bytes_b)
        highest = np.zeros(len(both.bytes_b), np.int64)
        np.maximum.at(highest, of_b, n)
        best = n == highest[of_b]
        for pairs, times in batches:
            rows = []
            for p, t in zip(pairs, times):
                p, t = np.frombuffer(p, "<i4"), np.frombuffer(t, "<i4").astype(np.int64)
                rows.append((t.sum(), t[best[p]].sum(), (t * n[p]).sum()))
            yield pd.DataFrame(rows, columns=["n_links", "n_best", "count_sum"], dtype="int64")
    return run


def alignment_counts(docs: DataFrame, path_a: str, path_b: str, *,
                     block: int = BLOCK) -> DataFrame:
    """Per document: tokens by A and B, groups, links, links to the best partner of their token of
    B, the sum of their pairs' corpus-wide counts, and the digest of the groups.

    Texts are encoded once; the links are stored beside the digest and read twice, for the counts
    and for the sums. The counts of all linkable pairs are one array whose length follows from the
    vocabularies, so the driver may gather and broadcast it. Jobs run while this is built.
    Defined cases: null, empty or unspellable texts (see ``aligned``) give zeros and an empty
    digest; a null id comes back null; repeated rows each count and give a row each; ties for the
    best partner all count; an empty table gives no rows; other columns are ignored.
    """
    found = aligned(docs, path_a, path_b, block=block)
    links = materialize(found.select(
        "doc_id", "n_a", "n_b", "n_groups", "pairs", "times",
        F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
        .alias("groups_sha256")), "links")
    counted = pair_counts(links).toPandas()  # at most one row for each linkable pair
    counts = np.zeros(len(pairing(path_a, path_b).keys), np.int64)
    counts[counted["pair"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    sums = _link_sums(path_a, path_b, docs.sparkSession.sparkContext.broadcast(counts))
    return links.withColumn("_sums", sums("pairs", "times")).select(
        "doc_id", "n_a", "n_b", "n_groups", "_sums.n_links", "_sums.n_best", "_sums.count_sum",
        "groups_sha256")
