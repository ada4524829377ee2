"""Language-model scoring by deleted interpolation.

Maximum-likelihood estimates of orders 0 (uniform), 1 and 2 are mixed; the mixture weights depend
on how often the context was seen and are learned by expectation-maximisation on held-out counts.

How it runs. Documents are dealt into *units* by hash, n-gram keys into *shards* by range of their
64-bit hash. A unit sends its distinct keys with counts to the shards (one packed block for each
shard); a shard adds the blocks up and answers each block with the totals of its keys. The message
that counts is the request as well, so a hot n-gram costs one entry for each unit. Units, shards
and thus the memory of a task have a fixed size; only their number follows the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipscope.llm.common import GOLDEN, WordKeys, id_remainder, mix, total_chars
from tipscope.session import materialize

#: Characters of a unit's texts, and of the corpus for each shard.
UNIT_CHARS, SHARD_CHARS = 2_000_000, 8_000_000
BUCKETS = 40
ESTIMATE, TUNE, APART = 0, 1, 2
# Low bits of a key: what kind of n-gram it is.
UNIGRAM, BIGRAM, CONTEXT_ONLY = 0, 1, 2
_END = np.uint64(0x51ED270B0A1F3C9D)
_START = np.uint64(0x2545F4914F6CDD1D)

SCORES = ("doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, "
          "score double")


def _bundled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a unit in one batch become one row with their texts compressed together: texts are
    what is shuffled most."""
    pack = zstandard.ZstdCompressor(3)
    for batch in batches:
        rows = []
        for (unit, role), group in batch.groupby(["unit", "role"], sort=False):
            texts = [(t or "").encode("utf-8") for t in group["text"]]
            ids = [None if pd.isna(i) else int(i) for i in group["doc_id"]]
            rows.append((unit, role, ids, [len(t) for t in texts], pack.compress(b"".join(texts))))
        yield pd.DataFrame(rows, columns=["unit", "role", "ids", "sizes", "texts"])


BUNDLES = "unit long, role int, ids array<long>, sizes array<int>, texts binary"


def _texts(bundles: pd.DataFrame) -> Iterator[bytes]:
    unpack = zstandard.ZstdDecompressor()
    for sizes, block in zip(bundles["sizes"], bundles["texts"]):
        whole, at = unpack.decompress(block), 0
        for size in sizes:
            yield whole[at:at + size]
            at += size


def _keys(texts, known: WordKeys) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unigram, context and bigram key of each token of the texts, and the texts' lengths."""
    parts, lengths = [], []
    for text in texts:
        words = known.array(text.lower().split())
        parts += [words, np.array([_END])]
        lengths.append(len(words) + 1)
    token = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    lengths = np.array(lengths, np.int64)
    context = np.empty_like(token)
    context[1:] = token[:-1]
    context[np.cumsum(lengths) - lengths] = _START
    pair = mix(context * GOLDEN + token)
    two = np.uint64(2)
    unigram = (mix(token.copy()) << two) | np.uint64(UNIGRAM)
    before = (mix(context) << two) | np.uint64(UNIGRAM)
    before[np.cumsum(lengths) - lengths] |= np.uint64(CONTEXT_ONLY)
    return unigram, before, (pair << two) | np.uint64(BIGRAM), lengths


def _distinct(unigram, before, bigram, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    starts = before[(before & np.uint64(3)) == CONTEXT_ONLY][:1]
    keys, counts = np.unique(np.concatenate([unigram, bigram, starts]), return_counts=True)
    if len(starts):
        counts[np.searchsorted(keys, starts[0])] = n_texts
    return keys, counts


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def _pack(keys: np.ndarray) -> bytes:
    """Sorted keys of one shard, cut to 48 bits: the first one, then the steps from each to the
    next in as many bytes as the largest step needs. The bits that are cut off are fixed by the
    shard and the order, in all but about (keys of a shard) / 2^46 of the cases."""
    low = keys & np.uint64((1 << 48) - 1)
    steps = low[1:] - low[:-1] & np.uint64((1 << 48) - 1)
    width = (int(steps.max()).bit_length() + 7) // 8 if len(steps) else 1
    packed = steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
    return bytes([width]) + int(low[0]).to_bytes(6, "little") + packed


def _unpack(block: bytes) -> np.ndarray:
    width = block[0]
    steps = np.zeros(((len(block) - 7) // width + 1, 8), np.uint8)
    steps[0, :6] = np.frombuffer(block, np.uint8, 6, 1)
    steps[1:, :width] = np.frombuffer(block, np.uint8, offset=7).reshape(-1, width)
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64) & np.uint64((1 << 48) - 1)


def _small(numbers: np.ndarray) -> bytes:
    return zstandard.compress(numbers.astype(np.uint32).tobytes(), 1)


def _numbers(block: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(block), np.uint32)


def _requests(shards: int):
    def request(group: pd.DataFrame) -> pd.DataFrame:
        unigram, before, bigram, lengths = _keys(_texts(group), WordKeys())
        keys, counts = _distinct(unigram, before, bigram, len(lengths))
        cuts = np.flatnonzero(np.diff(_shard(keys, shards))) + 1
        unit, role = int(group["unit"].iloc[0]), int(group["role"].iloc[0])
        blocks = zip(np.split(keys, cuts), np.split(counts, cuts))
        rows = [(unit, role, int(_shard(k[:1], shards)[0]), _pack(k), _small(c))
                for k, c in blocks if len(k)]
        return pd.DataFrame(rows, columns=["unit", "role", "shard", "keys", "counts"])
    return request


def _answer(group: pd.DataFrame) -> pd.DataFrame:
    """Totals of a shard: for each block the counts of its keys among the texts of estimation and
    among all training texts; one more row (unit -1) with the shard's tokens and word types."""
    group = group.sort_values("unit")
    blocks = [_unpack(b) for b in group["keys"]]
    counts = np.concatenate([_numbers(b) for b in group["counts"]])
    sizes = np.array([len(b) for b in blocks])
    role = np.repeat(group["role"].to_numpy(), sizes)
    keys, at = np.unique(np.concatenate(blocks), return_inverse=True)
    estimate = np.bincount(at, counts * (role == ESTIMATE), len(keys)).astype(np.uint32)
    train = np.bincount(at, counts * (role != APART), len(keys)).astype(np.uint32)
    word = (keys & np.uint64(3)) == UNIGRAM
    cuts = np.cumsum(sizes)[:-1]
    rows = [(unit, shard, _small(e), _small(t), 0, 0, 0, 0)
            for unit, shard, e, t in zip(group["unit"], group["shard"],
                                         np.split(estimate[at], cuts), np.split(train[at], cuts))]
    rows.append((-1, group["shard"].iloc[0], b"", b"",
                 int(estimate[word].sum(dtype=np.int64)), int((estimate[word] > 0).sum()),
                 int(train[word].sum(dtype=np.int64)), int((train[word] > 0).sum())))
    return pd.DataFrame(rows, columns=["unit", "shard", "estimate", "train", "estimate_tokens",
                                       "estimate_types", "train_tokens", "train_types"])


ANSWERS = ("unit long, shard int, estimate binary, train binary, estimate_tokens long, "
           "estimate_types long, train_tokens long, train_types long")


def _looked_up(docs: pd.DataFrame, answers: pd.DataFrame, column: str):
    """Counts of word, context and pair of each token; and the texts' lengths. Shards are ranges
    of keys, so the answers in their order line up with the sorted distinct keys."""
    unigram, before, bigram, lengths = _keys(_texts(docs), WordKeys())
    keys, _ = _distinct(unigram, before, bigram, len(lengths))
    blocks = answers.sort_values("shard")[column]
    totals = np.concatenate([_numbers(b) for b in blocks]).astype(np.int64)
    return (*(totals[np.searchsorted(keys, k)] for k in (unigram, before, bigram)), lengths)


def context_bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else one more than the floor of the count's binary logarithm."""
    return np.minimum(np.frexp(context.astype(float))[1], BUCKETS - 1)


def _held_out(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    if not len(docs):
        return pd.DataFrame(columns=["bucket", "word", "context", "pair", "n"])
    word, context, pair, _ = _looked_up(docs, answers, "estimate")
    frame = pd.DataFrame({"bucket": context_bucket(context), "word": word,
                          "context": np.where(pair > 0, context, 0), "pair": pair})
    return frame.groupby(list(frame.columns)).size().reset_index(name="n")


def learn_weights(held_out: DataFrame, tokens: int, types: int, *, rounds: int = 40,
                  gain: float = 1e-5) -> np.ndarray:
    """Weights (uniform, unigram, bigram) of each context bucket, by expectation-maximisation.

    ``held_out`` has one row for each different (bucket, word, context, pair) of counts with its
    number of held-out tokens. Each round is one aggregation to at most ``BUCKETS`` rows; it ends
    when a round gains less than ``gain`` of log-likelihood a token. Row ``BUCKETS`` of the result
    is pooled over all buckets and stands in for buckets without held-out tokens.
    """
    weights = np.full((BUCKETS + 1, 3), 1.0 / 3.0)
    last = -math.inf
    rows = held_out.select("bucket", "n", "word", "context", "pair")
    for _ in range(rounds):
        each = [F.get(F.lit([float(x) for x in weights[:, k]]), F.col("bucket"))
                for k in range(3)]
        parts = [each[0] / F.lit(types + 1.0), each[1] * F.col("word") / F.lit(float(max(tokens, 1))),
                 each[2] * F.when(F.col("pair") > 0, F.col("pair") / F.col("context")).otherwise(0.0)]
        p = rows.select("bucket", "n", *[x.alias(f"p{k}") for k, x in enumerate(parts)])
        whole = F.col("p0") + F.col("p1") + F.col("p2")
        sums = p.groupBy("bucket").agg(
            *[F.sum(F.col("n") * F.col(f"p{k}") / whole).alias(f"s{k}") for k in range(3)],
            F.sum(F.col("n") * F.log(whole)).alias("fit"), F.sum("n").alias("n")).collect()
        if not sums:
            break
        for row in sums:
            share = np.array([row["s0"], row["s1"], row["s2"]])
            weights[row["bucket"]] = share / share.sum()
        pooled = np.array([[row[f"s{k}"] for k in range(3)] for row in sums]).sum(axis=0)
        weights[BUCKETS] = pooled / pooled.sum()
        fit = sum(row["fit"] for row in sums) / sum(row["n"] for row in sums)
        if fit - last < gain:
            break
        last = fit
    learned = {row["bucket"] for row in sums} if rounds else set()
    for bucket in range(BUCKETS):
        if bucket not in learned:
            weights[bucket] = weights[BUCKETS]
    weights[0, 2] = 0.0  # there is no bigram estimate without a context
    weights[:, 0] = np.maximum(weights[:, 0], 1e-6)  # unknown words keep a chance
    return weights / weights.sum(axis=1, keepdims=True)


def _scores(weights: np.ndarray, tokens: int, types: int):
    def score(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        columns = [c.split()[0] for c in SCORES.split(", ")]
        if not len(docs):
            return pd.DataFrame(columns=columns)
        word, context, pair, lengths = _looked_up(docs, answers, "train")
        w = weights[context_bucket(context)]
        p = (w[:, 0] / (types + 1.0) + w[:, 1] * word / max(tokens, 1)
             + w[:, 2] * pair / np.maximum(context, 1))
        starts = np.cumsum(lengths) - lengths
        base = np.log10((word + 1.0) / (tokens + types + 1.0))
        return pd.DataFrame({
            "doc_id": pd.array([None if pd.isna(i) else i for ids in docs["ids"] for i in ids],
                               "Int64"), "n_tokens": lengths,
            "n_known": np.add.reduceat((word > 0).astype(np.int64), starts),
            "train_tokens": tokens, "base_score": np.add.reduceat(base, starts),
            "score": np.add.reduceat(np.log10(p), starts)})[columns]
    return score


def interpolated_scores(docs: DataFrame, *, parts: int = 7, apart: int = 2, tune: int = 3,
                        unit_chars: int = UNIT_CHARS, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """Log10 probability of every whole text of ``docs`` (doc_id, text).

    Documents whose crc32(doc_id as text) mod ``parts`` is ``apart`` teach nothing. Of the others,
    remainder ``tune`` supplies the held-out counts on which the weights are learned; the final
    estimates then count all training documents. Tokens are words with A-Z lower-cased and one end
    after each text; the first word's context is a start mark.

    Runs jobs while it is built (counts, expectation-maximisation); what it returns is lazy.
    Defined cases: a null text is empty (its one token is the end); a null id counts as the empty
    text in the split and comes back null; repeated rows are scored, and counted, each; an empty
    table gives no rows; if no document may teach, N and V are 0 and every probability is that of
    the uniform part, 1; other columns are ignored.
    """
    chars = total_chars(docs)
    n, shards = (max(1, math.ceil(chars / size)) for size in (unit_chars, shard_chars))
    remainder = id_remainder("doc_id", parts)
    role = (F.when(remainder == apart, APART).when(remainder == tune, TUNE).otherwise(ESTIMATE))
    dealt = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        role.cast("int").alias("role"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).alias("unit"),
    ).withColumn("unit", F.col("unit") * 3 + F.col("role")).mapInPandas(_bundled, BUNDLES)
    requests = dealt.groupBy("unit").applyInPandas(
        _requests(shards), "unit long, role int, shard int, keys binary, counts binary")
    answers = materialize(requests.groupBy("shard").applyInPandas(_answer, ANSWERS), "ngrams")
    sums = answers.where("unit < 0").agg(*[
        F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in
        ("estimate_tokens", "estimate_types", "train_tokens", "train_types")]).first()
    replies = answers.where("unit >= 0").select("unit", "shard", "estimate", "train")

    held = (
        dealt.where(F.col("role") == TUNE).groupBy("unit")
        .cogroup(replies.where(F.col("unit") % 3 == TUNE).drop("train").groupBy("unit"))
        .applyInPandas(_held_out, "bucket int, word long, context long, pair long, n long")
        .groupBy("bucket", "word", "context", "pair").agg(F.sum("n").alias("n"))
    )
    weights = learn_weights(materialize(held, "heldout"), sums["estimate_tokens"],
                            sums["estimate_types"])
    if not sums["train_tokens"]:
        weights[:] = (1.0, 0.0, 0.0)
    scored = dealt.groupBy("unit").cogroup(replies.drop("estimate").groupBy("unit")).applyInPandas(
        _scores(weights, sums["train_tokens"], sums["train_types"]), SCORES)
    return scored.select("doc_id", (id_remainder("doc_id", parts) == apart).alias("held_out"),
                         "n_tokens", "n_known", "train_tokens", "base_score", "score")
