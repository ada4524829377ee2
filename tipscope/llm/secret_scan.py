"""Secrets in texts: fixed shapes, and random strings found by how badly a tokenizer packs them.

A byte-pair vocabulary packs words and names into few tokens. Random strings fall into tokens of
one or two characters. A run of key characters with fewer characters a token than a threshold is
taken for a secret unless it has the shape of a known digest, or of an identifier made of words.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipscope.llm.tree_bpe import encoding

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                    r"""([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
LEAST = {"assign": 6, "access": 20, "hex": 24}

#: A run of key characters, and the shapes that are no secrets.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
DIGEST_LENGTHS = frozenset((32, 40, 56, 64, 96, 128))  # MD5, SHA-1, SHA-224 to SHA-512
DIGEST = re.compile(r"[0-9A-Fa-f]+")
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
NUMBER = re.compile(r"[0-9+/_=-]+")
#: Letter parts of one case, perhaps joined or numbered: file and variable names, paths, dates; but
#: also keys, so the letters must pack like words too.
IDENTIFIER = re.compile(r"(?:[A-Za-z]?[a-z]{2,}|[A-Z]{2,}|[0-9]{1,8})(?:[-_/+=]+"
                        r"(?:[A-Za-z]?[a-z]{2,}|[A-Z]{2,}|[0-9]{1,8}))*[-_/+=]*")
LETTERS = re.compile(r"[A-Za-z]+")
CHARS_A_TOKEN = 1.9

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed shapes, kind by kind."""
    found = []
    lowered = text.lower()
    if any(word in lowered for word in ("passw", "secret", "token", "api")):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text)
                  if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)
                  if m.end() - m.start() >= LEAST["access"]]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def is_known_shape(run: str) -> bool:
    """Digests by length, UUIDs and numbers."""
    return bool((DIGEST.fullmatch(run) and len(run) in DIGEST_LENGTHS) or UUID.fullmatch(run)
                or NUMBER.fullmatch(run))


def is_name(run: str, enc, chars_a_token: float) -> bool:
    """Whether a run has the shape of an identifier and its letters pack like words; digits and
    joining marks, which cost a token each, don't count against it."""
    if not IDENTIFIER.fullmatch(run):
        return False
    parts = LETTERS.findall(run)
    return sum(map(len, parts)) >= chars_a_token * sum(len(enc.encode_ordinary(p)) for p in parts)


def random_spans(text: str, enc, chars_a_token: float) -> list[Span]:
    """Runs that a token covers fewer than ``chars_a_token`` characters of, on average."""
    return [("random", m.start(), m.end()) for m in RUN.finditer(text)
            if not is_known_shape(m[0])
            and len(m[0]) < chars_a_token * len(enc.encode_ordinary(m[0]))
            and not is_name(m[0], enc, chars_a_token)]


def scan(text: str | None, enc, chars_a_token: float) -> tuple[list[Span], list[Span]]:
    """(spans of the fixed shapes, spans that the token test adds); the latter overlap none."""
    text = text or ""
    base = base_spans(text)
    added = random_spans(text, enc, chars_a_token)
    if base:
        added = [r for r in added if all(r[2] <= b[1] or r[1] >= b[2] for b in base)]
    return base, added


def spelled(spans: list[Span]) -> str:
    ordered = sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in ordered)


def redacted(text: str | None, spans: list[Span]) -> str | None:
    """The text with each stretch that spans cover replaced by one mark."""
    if not spans:
        return text
    out, at, end = [], 0, 0
    for _, start, stop in sorted(spans, key=lambda s: s[1]):
        if start >= end:
            out += [text[end:start], "[SECRET]"]
        end = max(end, stop)
        at = end
    return "".join(out) + text[at:]


FOUND = ("doc_id long, n_assign long, n_access long, n_hex long, n_random long, "
         "base_sha256 string, spans string")


def secret_spans(docs: DataFrame, path: str, pattern: str, *,
                 chars_a_token: float = CHARS_A_TOKEN) -> DataFrame:
    """Counts, digest and spans of the secrets of each row of ``docs`` (doc_id, text).

    Spans are kind:start:end in code points, by start, then kind. ``path`` and ``pattern`` give the
    tokenizer. Defined cases: a null text is empty (no spans); a null id comes back null; repeated
    rows give a row each; an empty table gives none; other columns are ignored.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(path, pattern)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                base, added = scan(text, enc, chars_a_token)
                kinds = [s[0] for s in base]
                rows.append((doc_id, kinds.count("assign"), kinds.count("access"),
                             kinds.count("hex"), len(added),
                             hashlib.sha256(spelled(base).encode()).hexdigest(),
                             spelled(base + added)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FOUND.split(", ")]).astype(
                {"doc_id": "Int64"})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.col("text").cast("string").alias("text"))
    return texts.mapInPandas(run, FOUND)


def without_secrets(docs: DataFrame, path: str, pattern: str, *,
                    chars_a_token: float = CHARS_A_TOKEN) -> DataFrame:
    """``docs`` with secrets masked in ``text`` and, where there is such a column, n_chars counted
    again. All rows and columns stay; texts without a secret stay as they are.

    Defined cases: a null or empty text stays as it is; repeated rows are masked alike; an empty
    table gives no rows; other columns may have any name.
    """
    @F.pandas_udf("string")
    def mask(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:  # noqa: D103
        enc = encoding(path, pattern)
        for batch in texts:
            yield pd.Series([redacted(t, sum(scan(t, enc, chars_a_token), [])) for t in batch],
                            dtype=object)

    clean, taken = "_clean", {c.lower() for c in docs.columns}
    while clean in taken:
        clean += "_"
    out = docs.withColumn(clean, mask(F.col("text").cast("string")))
    columns = [F.col(clean).alias("text") if c == "text"
               else F.when(F.col(clean) == F.col("text"), F.col(c))
               .otherwise(F.length(clean)).cast(docs.schema[c].dataType).alias(c)
               if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*columns)
