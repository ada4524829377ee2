"""Packing token sequences by lexical retrieval.

Documents are dealt into shards so that texts with the same rare tokens meet. Each shard has a BM25
inverted index over its documents. A seed document opens a window; the index returns the best
unused neighbours of the seed, which fill the window one after another; the one that no longer fits
is cut, and its rest opens the next window. When a shard has no documents left, what remains is cut
into windows of powers of two, which need no padding.

Terms are the tokenizer's ids, so the table of document frequencies, over the whole corpus, has one
number for each id of the vocabulary. A shard holds a bounded number of tokens.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import BPE

from tipscope.session import materialize

WINDOW, END = 4096, 2
SHARD_TOKENS = 2_000_000
#: A query is the seed's strongest terms by BM25 weight; BM25's usual constants.
QUERY_TERMS, K1, B = 24, 1.2, 0.75
_BLANKS = re.compile(r"[ \t\n\r\x0b\x0c]+")
#: Texts of these characters alone are the same in NFC, and their letters, digits and blanks are
#: told apart alike by every library: printable ASCII, usual blanks, Latin letters with accents.
_PLAIN = re.compile(r"[\x20-\x7e\t\n\rÀ-ÖØ-öø-ÿ]*")
# Fixed values of the tokenizer file: its pattern, its normalizer and its marker of a word's end.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
               {"type": "Lowercase"}]
_WORD_END = "</w>"
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class RankedPieces(dict):
    """Lower-cased piece -> its ids, two bytes each, by a table of ranks over bytes in place of the
    file's merges; a blank ends each piece.

    A file merges given pairs in order; a table of ranks merges any two neighbours whose bytes
    together are listed. Both give the same ids if every listed token, taken alone, is merged by
    the file into itself: two neighbours that spell a token are then always its given pair. The
    constructor checks that for the whole vocabulary and raises ValueError otherwise.
    """

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, vocab = spec["model"], spec["model"]["vocab"]
        splits = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if (splits != _PATTERN or spec["normalizer"]["normalizers"] != _NORMALIZER
                or model["end_of_word_suffix"] != _WORD_END):
            raise ValueError(f"{path}: not the tokenizer that the ranks stand for")
        letters = _byte_letters()
        byte = {letter: b for b, letter in enumerate(letters)}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        # Single bytes, bytes at a word's end (their merge with the blank comes first), merges.
        tokens = letters + [a + _WORD_END for b, a in enumerate(letters) if b != 32]
        tokens += [a + b for a, b in merges]
        inner = BPE(vocab=vocab, merges=merges)
        last = BPE(vocab=vocab, merges=merges, end_of_word_suffix=_WORD_END)
        ranks = {}
        for rank, token in enumerate(tokens):
            ends = token.endswith(_WORD_END)
            letters_of = token.removesuffix(_WORD_END)
            if [t.id for t in (last if ends else inner).tokenize(letters_of)] != [vocab[token]]:
                raise ValueError(f"{path}: {token} is not made by its own merges")
            ranks[bytes(byte[c] for c in letters_of) + b" " * ends] = rank
        if len(ranks) != len(tokens):
            raise ValueError(f"{path}: two tokens of the same bytes")
        self.ids = [vocab[t].to_bytes(2, "little") for t in tokens]
        self.ranks_of = tiktoken.Encoding("pieces", pat_str="[^ ]+ ", mergeable_ranks=ranks,
                                          special_tokens={}).encode_ordinary

    def made(self, piece: str) -> bytes:
        return b"".join([self.ids[rank] for rank in self.ranks_of(piece + " ")])

    def __missing__(self, piece: str) -> bytes:
        ids = self[piece] = self.made(piece)
        return ids


class PlainWords(dict):
    """Lower-cased word of a plain text without special strings -> its ids, by its pieces."""

    def __init__(self, pieces: RankedPieces):
        super().__init__()
        self.pieces = pieces

    def __missing__(self, word: str) -> bytes:
        if word.isalpha():  # one piece, remembered here already
            ids = self.pieces.made(word)
        else:
            ids = b"".join(map(self.pieces.__getitem__, _PIECE.findall(word)))
        self[word] = ids
        return ids


class WordIds(dict):
    """Blank-separated word -> its ids, two bytes each. The tokenizer drops white space before any
    merge, so the ids of a text are those of its words in a row, and those of a plain word are its
    pieces'. Words of other characters, or with special strings, are left to the tokenizer."""

    def __init__(self, path: str, limit: int = 300_000):
        super().__init__()
        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.pieces = RankedPieces(path)
        self.plain = PlainWords(self.pieces)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def __missing__(self, word: str) -> bytes:
        if _PLAIN.fullmatch(word) and not any(s in word for s in self.special):
            ids = self.plain[word.lower()]
        else:
            found = self.tokenizer.encode(word, add_special_tokens=False).ids
            ids = np.array(found, "<u2").tobytes()
        self[word] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        for kept in (self, self.plain, self.pieces):
            if len(kept) > self.limit:
                kept.clear()
        lowered = text.lower()
        # Lower case lets more words share an entry, unless it would make a special string.
        plain = _PLAIN.fullmatch(text) and not any(s in lowered for s in self.special)
        if plain:
            ids = map(self.plain.__getitem__, lowered.split())
        else:
            ids = map(self.__getitem__, _BLANKS.split(text))
        return np.frombuffer(b"".join(ids), "<u2")


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def _tokenized(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = word_ids(path)
        for batch in batches:
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64"),
                "ids": [np.append(known.encode(t or ""), np.uint16(END)).astype("<u2").tobytes()
                        for t in batch["text"]]})
    return run


def _frequencies(vocabulary: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, last = np.zeros(vocabulary, np.int64), np.zeros(vocabulary, np.int64)
        n = 0
        for batch in batches:
            for packed in batch["ids"]:
                ids = np.frombuffer(packed, "<u2")
                places = np.arange(len(ids))
                last[ids] = places
                counts[ids[last[ids] == places]] += 1  # each id once, at its last place
            n += len(batch)
        used = np.flatnonzero(counts)
        yield pd.DataFrame({"term": np.append(used, -1), "n": np.append(counts[used], n)})
    return run


def _keyed(idf):
    """Adds the two rarest terms of each document, the key that shards are cut by."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_rarity = np.argsort(-idf.value, kind="stable")
        rarity = np.empty(len(by_rarity), np.int32)
        rarity[by_rarity] = np.arange(len(by_rarity))
        for batch in batches:
            keys = []
            for ids in batch["ids"]:
                rare = rarity[np.frombuffer(ids, "<u2")]
                first = rare.min()
                second = rare[rare > first].min(initial=len(by_rarity))
                pair = first, second if second < len(by_rarity) else first
                keys.append(tuple(int(by_rarity[place]) for place in pair))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "ids": batch["ids"],
                                "first": [k[0] for k in keys], "second": [k[1] for k in keys]})
    return run


class Shard:
    """BM25 index of some documents; neighbours are those not used yet."""

    def __init__(self, texts: list[np.ndarray], idf: np.ndarray):
        lengths = np.array([len(t) for t in texts], float)
        owner, term, weight = [], [], []
        self.queries = []
        norm = K1 * (1 - B + B * lengths / lengths.mean())
        for k, ids in enumerate(texts):
            terms, counts = np.unique(ids, return_counts=True)
            score = idf[terms] * counts * (K1 + 1) / (counts + norm[k])
            owner.append(np.full(len(terms), k, np.int32))
            term.append(terms.astype(np.int32))
            weight.append(score.astype(np.float32))
            self.queries.append(terms[np.argsort(-score, kind="stable")[:QUERY_TERMS]])
        term = np.concatenate(term)
        order = np.argsort(term, kind="stable")
        self.owner, self.weight = np.concatenate(owner)[order], np.concatenate(weight)[order]
        self.start = np.searchsorted(term[order], np.arange(len(idf) + 1))
        self.unused = np.ones(len(texts), bool)

    def neighbours(self, seed: int) -> np.ndarray:
        """Unused documents that share a query term with the seed, best first."""
        spans = [slice(self.start[t], self.start[t + 1]) for t in self.queries[seed]]
        owner = np.concatenate([self.owner[s] for s in spans])
        scores = np.bincount(owner, np.concatenate([self.weight[s] for s in spans]),
                             len(self.unused))
        found = np.flatnonzero(self.unused & (scores > 0))
        return found[np.argsort(-scores[found], kind="stable")]


def pack(doc_ids: list, texts: list[np.ndarray], idf: np.ndarray, window: int = WINDOW):
    """Pieces (doc_id, start, ids, tokens of the document, window number, offset) of a shard."""
    shard, total = Shard(texts, idf), sum(map(len, texts))
    room = number = filled = 0
    doc, at, queue, fresh = None, 0, iter(()), 0
    while total:
        if not room:
            # A last stretch shorter than a window is filled by powers of two, largest first.
            number += bool(filled)
            filled, room = 0, window if total >= window else 1 << (total.bit_length() - 1)
            queue = None
        if doc is None:
            if queue is None and filled == 0:
                while not shard.unused[fresh]:
                    fresh += 1
                doc = fresh
            else:
                queue = iter(shard.neighbours(seed)) if queue is None else queue
                doc = next((d for d in queue if shard.unused[d]), None)
                if doc is None:
                    while not shard.unused[fresh]:
                        fresh += 1
                    doc = fresh
            shard.unused[doc], at = False, 0
        if filled == 0:
            seed = doc
        ids = texts[doc][at:at + room]
        yield doc_ids[doc], at, ids, len(texts[doc]), number, filled
        at, filled, room, total = at + len(ids), filled + len(ids), room - len(ids), total - len(ids)
        if at == len(texts[doc]):
            doc = None


PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")


def _packed(idf, shard_tokens: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = TaskContext.get().partitionId() << 32
        ids, texts, tokens, used = [], [], 0, 0

        def flush() -> pd.DataFrame:
            nonlocal ids, texts, tokens, used
            rows = [(d, at, len(piece), zlib.crc32(piece.astype("<u4").tobytes()), n,
                     base + used + number, offset)
                    for d, at, piece, n, number, offset in pack(ids, texts, idf.value)]
            used += rows[-1][5] - base - used + 1
            ids, texts, tokens = [], [], 0
            return pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")]).astype(
                {"doc_id": "Int64"})

        for batch in batches:
            for doc_id, packed in zip(batch["doc_id"], batch["ids"]):
                ids.append(doc_id)
                texts.append(np.frombuffer(packed, "<u2"))
                tokens += len(texts[-1])
                if tokens >= shard_tokens:
                    yield flush()
        if ids:
            yield flush()
    return run


def _weights(spark: SparkSession, tokens: DataFrame, vocabulary: int):
    """Broadcast idf of each id, from all documents; the table has ``vocabulary`` numbers."""
    counted = tokens.select("ids").mapInPandas(_frequencies(vocabulary), "term long, n long")
    found = counted.groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    number = dict(zip(found["term"], found["n"]))
    n = number.pop(-1, 0)
    df = np.zeros(vocabulary, float)
    df[np.array(list(number), int)] = list(number.values())
    return spark.sparkContext.broadcast(np.log(1 + (n - df + 0.5) / (df + 0.5)))


def packed_pieces(docs: DataFrame, path: str, *, vocabulary: int = 1 << 16,
                  shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Pieces of the windows for all rows of ``docs`` (doc_id, text).

    ``path`` names a tokenizer file with at most 2 ** 16 ids. Each document is its ids and an end
    id. Shards are stretches of the order (rarest term, second rarest, doc_id), so texts of a hot
    term spread over many shards. Runs jobs while it is built (tokens are stored once).
    Defined cases: a null text is empty (its one id is the end); a null id comes back null;
    repeated rows are packed each; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.col("text").cast("string").alias("text"))
    tokens = materialize(texts.mapInPandas(_tokenized(path), "doc_id long, ids binary"), "tokens")
    idf = _weights(spark, tokens, vocabulary)
    total = tokens.agg(F.sum(F.octet_length("ids")).alias("n")).first()["n"] or 0
    keyed = tokens.mapInPandas(_keyed(idf), "doc_id long, ids binary, first int, second int")
    shards = keyed.repartitionByRange(max(1, total // 2 // shard_tokens), "first", "second", "doc_id")
    ordered = shards.sortWithinPartitions("first", "second", "doc_id", F.crc32("ids"))
    return ordered.select("doc_id", "ids").mapInPandas(_packed(idf, shard_tokens), PIECES)
