"""Token counts of huge texts: overlapping chunks, spliced where their tokens agree again.

A text is cut into chunks that overlap. Each chunk is encoded by itself, with offsets. In an
overlap the two encodings differ near the cut ends and then fall into step: the splice is a
boundary at which both have the same token before and the same token after.

Why that is exact. A sequence of BPE tokens is the encoding of its text if and only if each two
neighbouring tokens are the encoding of their joined text. In the spliced sequence every pair of
neighbours, the pair at the splice included, stands side by side in one of the chunks' encodings,
so each pair passes that test. If an overlap holds no such boundary, the document is cut again
into larger chunks with wider overlaps, in the end into one chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tipscope.session import materialize

CHUNK_CHARS, OVERLAP_CHARS, WIDEN = 16_384, 256, 4

PARTS = ("row_id string, part int, parts int, n_tokens long, head_ids array<int>, "
         "head_at array<int>, tail_ids array<int>, tail_at array<int>")


@lru_cache(maxsize=2)
def processor(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


def encode_with_offsets(text: str, model: sentencepiece.SentencePieceProcessor):
    """Ids and the code point at which each starts; bytes of one character share a start."""
    pieces = model.encode(text, return_type="proto").pieces
    ids = np.array([p.id for p in pieces], np.int64)
    at = np.array([p.begin for p in pieces], np.int64)  # bytes
    first = (np.frombuffer(text.encode("utf-8"), np.uint8) & 0xC0) != 0x80
    return ids, np.append(0, np.cumsum(first))[at]


def splice(left_ids, left_at, right_ids, right_at, middle: int):
    """(tokens of the left list to keep, tokens of the right list to drop), or None.

    The lists are two encodings of one stretch of text. Chosen is the boundary nearest to
    ``middle``; a start that occurs twice in a list belongs to no boundary.
    """
    def starts(at):
        values, first, counts = np.unique(at, return_index=True, return_counts=True)
        return dict(zip(values[counts == 1].tolist(), first[counts == 1].tolist()))

    left, right = starts(left_at), starts(right_at)
    best = None
    for at, i in left.items():
        j = right.get(at)
        if (j is None or i == 0 or j == 0 or left_ids[i] != right_ids[j]
                or left_ids[i - 1] != right_ids[j - 1] or left_at[i - 1] != right_at[j - 1]
                or int(left_at[i - 1]) not in left or int(right_at[j - 1]) not in right):
            continue
        if best is None or abs(at - middle) < best[0]:
            best = (abs(at - middle), i, j)
    return best and best[1:]


def _encode_parts(path: str, chunk: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = processor(path)
        for batch in batches:
            rows = []
            for row_id, part, parts, text in batch[["row_id", "part", "parts", "text"]].itertuples(
                    index=False, name=None):
                ids, at = encode_with_offsets(text, model)
                at = at + max(0, part * chunk - overlap)
                head = at < part * chunk + overlap if part else np.zeros(len(at), bool)
                tail = (at >= (part + 1) * chunk - overlap if part < parts - 1
                        else np.zeros(len(at), bool))
                rows.append((row_id, part, parts, len(ids), ids[head].tolist(), at[head].tolist(),
                             ids[tail].tolist(), at[tail].tolist()))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PARTS.split(", ")])
    return run


def _excess(chunk: int):
    """Tokens of a part and of the next that the splice between them drops; -1 without one."""
    @F.pandas_udf("long")
    def run(part: pd.Series, tail_ids: pd.Series, tail_at: pd.Series, head_ids: pd.Series,
            head_at: pd.Series) -> pd.Series:
        out = []
        for k, li, la, ri, ra in zip(part, tail_ids, tail_at, head_ids, head_at):
            if ri is None:  # the last part of a document
                out.append(0)
                continue
            cut = splice(li, la, ri, ra, (k + 1) * chunk)
            out.append(-1 if cut is None else len(li) - cut[0] + cut[1])
        return pd.Series(out, dtype="int64")
    return run


def _long_counts(rows: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(row_id, n_tokens) of long texts; n_tokens is null where some overlap never agrees."""
    parts = F.ceil(F.length("text") / F.lit(chunk)).cast("int")
    begin = F.greatest(F.col("part") * chunk - overlap, F.lit(0))
    end = (F.col("part") + 1) * chunk + overlap
    cut = (
        rows.select("row_id", "text", parts.alias("parts"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("row_id", "part", "parts",
                F.substring("text", begin + 1, end - begin).alias("text"))
        .repartition("row_id", "part")
    )
    encoded = cut.mapInPandas(_encode_parts(path, chunk, overlap), PARTS)
    following = Window.partitionBy("row_id").orderBy("part")
    joined = encoded.select(
        "row_id", "part", "n_tokens", "tail_ids", "tail_at",
        F.lead("head_ids").over(following).alias("head_ids"),
        F.lead("head_at").over(following).alias("head_at"))
    spare = _excess(chunk)("part", "tail_ids", "tail_at", "head_ids", "head_at")
    return joined.select("row_id", "n_tokens", spare.alias("spare")).groupBy("row_id").agg(
        F.when(F.min("spare") >= 0, F.sum("n_tokens") - F.sum("spare")).alias("n_tokens"))


def token_counts(docs: DataFrame, path: str, *, limit: int = 4096, chunk: int = CHUNK_CHARS,
                 overlap: int = OVERLAP_CHARS) -> DataFrame:
    """UTF-8 bytes and tokens of each whole text of ``docs`` (doc_id, text).

    Texts of up to ``chunk`` characters are encoded at once by the task that reads them; the chunks
    of longer ones are spread over the cluster. Jobs for the long texts run while this is built:
    one for each widening of the overlaps, usually one in all. ``chunk`` must be at least four
    times ``overlap``, so that the two splices of a chunk keep apart.
    Defined cases: a null text is empty (0 bytes, 0 tokens); a null id comes back null; repeated
    rows give a row each; an empty table gives none; other columns are ignored.
    """
    if chunk < 4 * overlap:
        raise ValueError("chunk must be at least four overlaps long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    is_long = F.length("text") > chunk

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = processor(path)
        for batch in batches:
            ids = model.encode(batch["text"].tolist(), num_threads=1)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"),
                                "n_bytes": batch["n_bytes"],
                                "n_tokens": np.array([len(x) for x in ids], np.int64)})

    size = F.octet_length("text").cast("long").alias("n_bytes")
    short = rows.where(~is_long).select("doc_id", "text", size).mapInPandas(
        count, "doc_id long, n_bytes long, n_tokens long")

    keyed = rows.where(is_long).withColumn("row_id", F.md5("text"))
    # Copies of a text are encoded once.
    todo = keyed.groupBy("row_id").agg(F.min("text").alias("text"))
    counts = None
    while True:
        found = materialize(_long_counts(todo, path, chunk, overlap), "spliced")
        good = found.where(F.col("n_tokens").isNotNull())
        counts = good if counts is None else counts.unionByName(good)
        failed = found.where(F.col("n_tokens").isNull()).select("row_id")
        if failed.isEmpty():
            break
        todo = todo.join(failed, "row_id", "left_semi")
        chunk, overlap = chunk * WIDEN, overlap * WIDEN
    long = keyed.select("doc_id", "row_id", size).join(counts, "row_id").select(
        "doc_id", "n_bytes", "n_tokens")
    return short.unionByName(long).withColumn("over_limit", F.col("n_tokens") > limit)
