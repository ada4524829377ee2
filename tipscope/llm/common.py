"""Small helpers that the operators share."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space and the ASCII controls tab to carriage return.
WORD = "[^\\x20\\x09-\\x0D]+"
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(column: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(divisor))


def lower_ascii_words(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased; bytes.split() knows just the six ASCII blanks."""
    return (text or "").encode("utf-8").lower().split()


class WordKeys(dict):
    """Word -> 64-bit hash, remembered for at most ``limit`` words."""

    def __init__(self, limit: int = 500_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        key = self[word] = xxhash.xxh3_64_intdigest(word)
        return key

    def array(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(keys: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit keys (in place)."""
    keys ^= keys >> np.uint64(31)
    keys *= GOLDEN
    keys ^= keys >> np.uint64(29)
    keys *= np.uint64(0xBF58476D1CE4E5B9)
    keys ^= keys >> np.uint64(32)
    return keys


def total_chars(docs: DataFrame, column: str = "text") -> int:
    """Code points of all texts; sizes partitions, never results."""
    return docs.agg(F.sum(F.length(column)).alias("n")).first()["n"] or 0
