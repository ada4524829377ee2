"""Byte-level BPE by monoid tree reduction: encode halves, join neighbours, decode up the tree.

An encoded stretch of text is an element of a monoid: joining two of them gives what encoding the
joined text would have given. A join re-encodes a window around the seam, grown until both of its
ends lie where a blank follows a non-blank. No match of the splitting pattern holds a non-blank
followed by a blank, so such a place is the end of a match in any surrounding, what is left of it
was split without looking further, and what is right of it is split anew from there: the tokens
outside the window cannot change. Where no such place exists, the window grows to the whole.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Longest text that a leaf encodes at once, and longest that one task reduces alone.
LEAF_CHARS = 8_192
ROW_CHARS = 65_536
#: A non-blank before a blank. Python's \S leaves out more than the splitting pattern's blanks and
#: the ASCII blanks are among them, so every place found is one for the pattern too.
_STABLE = re.compile(r"\S(?=[\t-\r ])")


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@dataclass
class Node:
    """A text with its ids."""

    text: str
    ids: list[int]


def _ids_of_prefix(ids: list[int], size: int, enc: tiktoken.Encoding, *, back: bool) -> int:
    """How many ids from the front (or back) make up exactly ``size`` bytes."""
    n = total = 0
    step = -1 if back else 1
    for token in ids[::step]:
        if total >= size:
            break
        total += len(enc.decode_single_token_bytes(token))
        n += 1
    if total != size:
        raise ValueError("no token ends at a place where a match must end")
    return n


def _last_stable(text: str, window: int) -> int:
    """Start of the text after the last stable place in the last ``window`` characters, or -1."""
    found = -1
    for match in _STABLE.finditer(text, max(0, len(text) - window)):
        found = match.end()
    return found


def join(left: Node, right: Node, enc: tiktoken.Encoding, window: int = 64) -> Node:
    """The node of ``left.text + right.text``."""
    if not left.text or not right.text:
        return Node(left.text + right.text, left.ids + right.ids)
    while True:
        first = _last_stable(left.text, window)
        seek = _STABLE.search(right.text, 0, window + 1)
        last = seek.end() if seek else -1
        if first < 0 and window >= len(left.text):
            first = 0
        if last < 0 and window >= len(right.text):
            last = len(right.text)
        if first >= 0 and last >= 0:
            break
        window *= 2
    a, b = left.text[first:], right.text[:last]
    keep = len(left.ids) - _ids_of_prefix(left.ids, len(a.encode()), enc, back=True)
    drop = _ids_of_prefix(right.ids, len(b.encode()), enc, back=False)
    return Node(left.text + right.text,
                left.ids[:keep] + enc.encode_ordinary(a + b) + right.ids[drop:])


def encode(text: str, enc: tiktoken.Encoding, leaf: int = LEAF_CHARS) -> Node:
    """Encode halves recursively down to leaves and join them on the way up."""
    if len(text) <= leaf:
        return Node(text, enc.encode_ordinary(text))
    half = len(text) // 2
    return join(encode(text[:half], enc, leaf), encode(text[half:], enc, leaf), enc)


def decode(ids: list[int], enc: tiktoken.Encoding, leaf: int = LEAF_CHARS) -> bytes:
    """Bytes of the ids; halves are decoded apart and concatenated."""
    if len(ids) <= leaf:
        return enc.decode_bytes(ids)
    half = len(ids) // 2
    return decode(ids[:half], enc, leaf) + decode(ids[half:], enc, leaf)


NODES = "row_id long, doc_id long, copies long, part int, text string, ids array<int>"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digests(path: str, pattern: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(path, pattern)
        for batch in batches:
            rows = []
            for k, doc_id in enumerate(batch["doc_id"]):
                ids = (encode(batch["text"].iloc[k] or "", enc).ids if "ids" not in batch
                       else batch["ids"].iloc[k].tolist())
                rows.append((doc_id, len(ids),
                             hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                             hashlib.sha256(decode(ids, enc)).hexdigest()))
            out = pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256",
                                              "decoded_sha256"])
            yield out.astype({"doc_id": "Int64"})
    return run


def _leaves(path: str, pattern: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(path, pattern)
        for batch in batches:
            batch["ids"] = [encode(t or "", enc).ids for t in batch["text"]]
            yield batch.astype({"doc_id": "Int64"})
    return run


def _pairs(path: str, pattern: str):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        enc = encoding(path, pattern)
        group = group.sort_values("part")
        nodes = [Node(t, list(i)) for t, i in zip(group["text"], group["ids"])]
        node = nodes[0] if len(nodes) == 1 else join(nodes[0], nodes[1], enc)
        out = group.head(1)[["row_id", "doc_id", "copies", "part"]].astype({"doc_id": "Int64"})
        return out.assign(part=out["part"] // 2, text=[node.text], ids=[node.ids])
    return run


def _split(docs: DataFrame, row_chars: int) -> tuple[DataFrame, DataFrame]:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    long = F.length("text") > row_chars
    return rows.where(~long), rows.where(long)


def encoded_parts(long_docs: DataFrame, path: str, pattern: str, *,
                  row_chars: int = ROW_CHARS) -> DataFrame:
    """(doc_id, ids) of each long document.

    Parts of a document are encoded by different tasks; then neighbours are joined level by level,
    one grouping for each level, as many as the longest document needs. The one job that runs
    while this is built finds that number. Equal rows are reduced once and multiplied at the end.
    """
    longest = long_docs.agg(F.max(F.length("text")).alias("n")).first()["n"]
    if not longest:
        return long_docs.sparkSession.createDataFrame([], "doc_id long, ids array<int>")
    cut = F.posexplode(F.transform(
        F.sequence(F.lit(0), F.floor((F.length("text") - 1) / F.lit(row_chars)).cast("int")),
        lambda k: F.substring(F.col("text"), k * row_chars + 1, F.lit(row_chars))))
    parts = (
        long_docs.groupBy("doc_id", "text").agg(F.count("*").alias("copies"))
        .withColumn("row_id", F.xxhash64("doc_id", "text"))
        .select("row_id", "doc_id", "copies", cut.alias("part", "text"))
    )
    nodes = parts.repartition("row_id", "part").mapInPandas(_leaves(path, pattern), NODES)
    for _ in range(math.ceil(math.log2(math.ceil(longest / row_chars)))):
        nodes = (nodes.groupBy("row_id", "doc_id", F.floor(F.col("part") / 2).alias("pair"))
                 .applyInPandas(_pairs(path, pattern), NODES))
    each = F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")
    return nodes.select("doc_id", "ids", each).drop("copy")


def bpe_digests(docs: DataFrame, path: str, pattern: str, *,
                row_chars: int = ROW_CHARS) -> DataFrame:
    """Token number and digests of ids and of decoded bytes for each row of ``docs``.

    ``path`` names a rank file, ``pattern`` the splitting pattern. Texts of up to ``row_chars``
    are reduced by the task that reads them; longer ones are cut and reduced across tasks.
    Defined cases: a null text is empty (no ids, digests of the empty string); a null id comes
    back null; repeated rows give a row each; an empty table gives none; other columns are
    ignored.
    """
    short, long = _split(docs, row_chars)
    many = encoded_parts(long, path, pattern, row_chars=row_chars)
    return short.mapInPandas(_digests(path, pattern), DIGESTS).unionByName(
        many.mapInPandas(_digests(path, pattern), DIGESTS))


def bpe_encode(docs: DataFrame, path: str, pattern: str, *,
               row_chars: int = ROW_CHARS) -> DataFrame:
    """(doc_id, ids) of each row; the cases are those of ``bpe_digests``."""
    short, long = _split(docs, row_chars)

    def ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(path, pattern)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"),
                                "ids": [encode(t, enc).ids for t in batch["text"]]})

    return short.mapInPandas(ids, "doc_id long, ids array<int>").unionByName(
        encoded_parts(long, path, pattern, row_chars=row_chars))
