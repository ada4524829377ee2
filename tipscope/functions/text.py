"""Message text to tip columns, as expressions that stay inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tipscope.functions.vocabulary import DEFAULT, Vocabulary

# A word character is any letter, digit-like character or underscore. Combining marks and the
# emoji variation selector are not, so "⚡️buy" still holds the word "buy".
WORD = r"[\p{L}\p{N}_]"

# The patterns that read numbers out of a message.
TARGET_PATTERN = (
    r"(?:target|tgt|trgt|tp)\s*(?:price)?\s*[:\-=]?\s*(?:rs\.?|inr|₹)?\s*"
    r"([0-9]{1,7}(?:\.[0-9]{1,2})?)"
)
DAYS_PATTERN = r"([0-9]{1,3})\s*(?:day|days|din)"
WEEKS_PATTERN = r"([0-9]{1,3})\s*(?:week|weeks|hafte|hafta)"
MONTHS_PATTERN = r"([0-9]{1,3})\s*(?:month|months|mahine|mahina)"
TICKER_PATTERN = r"[A-Z][A-Z0-9&\-]{2,}"
ALIAS_KEPT = "[a-z0-9&]"
# Words that carry no identity in a company name.
NAME_STOP_WORDS = ("limited", "ltd", "the", "company", "co", "india")

_UNICODE = "(?iuU)"
_JAVA_META = re.compile(r"([\\.\[\]{}()*+?^$|\-&#~])")


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _quote(term: str) -> str:
    return _JAVA_META.sub(r"\\\1", term)


def contains_term(text_lower: Column | str, terms: Iterable[str]) -> Column:
    """Does the lower-cased text hold any of the terms?

    A term that starts with a letter or digit must stand as whole words; any other term (an
    emoji) may occur anywhere.
    """
    text = _col(text_lower)
    terms = [term for term in terms if term]
    if not terms:
        return F.lit(False)
    return F.coalesce(text.rlike(_term_pattern(terms)), F.lit(False))


def _is_word(term: str) -> bool:
    return term[0].isalnum()


def _choice(words: Iterable[str]) -> str:
    """Alternatives, longest first, grouped by first character: one comparison rules out most."""
    longest_first = sorted(set(words), key=len, reverse=True)
    return "|".join(
        _quote(head) + "(?:" + "|".join(_quote(w[1:]) for w in longest_first if w[0] == head) + ")"
        for head in sorted({w[0] for w in longest_first})
    )


def _split_terms(terms: Iterable[str]) -> tuple[list[str], list[str]]:
    """(word terms in lower case, other terms)."""
    terms = [t for t in terms if t]
    return [t.lower() for t in terms if _is_word(t)], [t for t in terms if not _is_word(t)]


def _term_pattern(terms: Iterable[str]) -> str:
    words, marks = _split_terms(terms)
    branches = [f"(?<!{WORD})(?:{_choice(words)})(?!{WORD})"] if words else []
    return "|".join(branches + [_quote(t) for t in marks])


def term_hits(text_lower: Column | str, vocabulary: Vocabulary = DEFAULT) -> Column:
    """Distinct vocabulary terms of a text, the longest at each place, in one scan.

    Every match takes one word (or one mark) with the separators behind it. The capture, in a
    look-ahead, is the term that starts there, if any; so terms are only tried where a word
    starts, and terms that start inside a longer one are found as well.
    """
    words, marks = _split_terms(vocabulary.phrases())
    branches = [f"(?:{_choice(words)})(?!{WORD})"] if words else []
    branches += [_quote(t) for t in sorted(marks, key=len, reverse=True)]
    stops = "".join(_quote(head) for head in sorted({t[0] for t in marks}))
    separator = "[^" + WORD[1:]
    pattern = (f"(?=({'|'.join(branches)})?+)(?:{WORD}++|{separator})"
               f"{separator[:-1]}{stops}]*+")
    found = F.regexp_extract_all(_col(text_lower), F.lit(pattern), F.lit(1))
    return F.array_distinct(found)


TermTest = Callable[[Iterable[str]], Column]


def scan_test(text_lower: Column | str) -> TermTest:
    """Tests that scan the text once per list."""
    return lambda terms: contains_term(text_lower, terms)


def hit_test(hits: Column | str, vocabulary: Vocabulary = DEFAULT) -> TermTest:
    """Tests on the result of ``term_hits``.

    A term that is not the longest at its place is the beginning of the one that is, up to a
    word end. So a list is hit if any term is found that equals or so begins with one of its
    own.
    """
    def begins(longer: str, term: str) -> bool:
        if not longer.startswith(term):
            return False
        rest = longer[len(term):]
        return not rest or not _is_word(term) or not (rest[0].isalnum() or rest[0] == "_")

    words, marks = _split_terms(vocabulary.phrases())

    def test(terms: Iterable[str]) -> Column:
        wanted = [t.lower() if _is_word(t) else t for t in terms if t]
        telling = [
            found for found in sorted({*words, *marks})
            if any(begins(found, term) for term in wanted)
        ]
        if not telling:
            return F.lit(False)
        return F.coalesce(
            F.arrays_overlap(_col(hits), F.array(*[F.lit(t) for t in telling])), F.lit(False))

    return test


def language(text_lower: Column | str, vocabulary: Vocabulary = DEFAULT) -> Column:
    """``hi-Latn``, ``mixed`` or ``en`` by marker words among the runs of a-z.

    English needs one run of two or more letters that is no marker; the search stops there.
    """
    marker = f"(?:{_choice(vocabulary.hinglish)})(?![a-z])"
    text = _col(text_lower)
    hinglish = text.rlike(f"(?<![a-z]){marker}")
    english = text.rlike(f"(?<![a-z])(?!{marker})[a-z]{{2,}}")
    return (
        F.when(hinglish & english, "mixed").when(hinglish, "hi-Latn").otherwise("en")
    )


def direction(has: TermTest, vocabulary: Vocabulary = DEFAULT) -> Column:
    up, down = has(vocabulary.long), has(vocabulary.short)
    return F.when(up & ~down, "long").when(down & ~up, "short").otherwise("unclear")


def _captured(text: Column | str, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(_col(text), pattern, 1), F.lit(""))


def target_price(text: Column | str) -> Column:
    """The number behind an explicit target key word; bare numbers do not count."""
    return _captured(text, _UNICODE + TARGET_PATTERN).try_cast("double")


def horizon_days(text: Column | str, has: TermTest,
                 vocabulary: Vocabulary = DEFAULT) -> Column:
    """Days, then weeks, then months in the text; failing those the horizon key words."""

    def count_of(pattern: str) -> Column:
        return _captured(text, f"{_UNICODE}{pattern}(?!{WORD})").try_cast("int")

    by_word = (
        F.when(has(vocabulary.intraday), F.lit(1)).when(has(vocabulary.positional), F.lit(5))
    )
    return F.coalesce(
        count_of(DAYS_PATTERN), count_of(WEEKS_PATTERN) * 7, count_of(MONTHS_PATTERN) * 30,
        by_word,
    )


def urgency(has: TermTest, vocabulary: Vocabulary = DEFAULT) -> Column:
    return (
        F.when(has(vocabulary.urgency_high), "high")
        .when(has(vocabulary.urgency_medium), "medium").otherwise("low")
    )


TIP_COLUMNS = ("language", "direction", "target_price", "horizon_days", "urgency",
               "guarantee_claim", "insider_claim", "disclosure_present")


def with_tip_columns(df: DataFrame, text: str = "text",
                     vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """Add all columns that depend on nothing but the text.

    The lower-cased text and its term hits are steps of their own, so each text is scanned once
    for all lists together.
    """
    scanned = df.withColumn("_lower", F.lower(_col(text))).withColumn(
        "_hits", term_hits("_lower", vocabulary))
    has = hit_test("_hits", vocabulary)
    return scanned.select(
        *[F.col(name) for name in df.columns],
        language("_lower", vocabulary).alias("language"),
        direction(has, vocabulary).alias("direction"),
        target_price(text).alias("target_price"),
        horizon_days(text, has, vocabulary).alias("horizon_days"),
        urgency(has, vocabulary).alias("urgency"),
        has(vocabulary.guarantee).alias("guarantee_claim"),
        has(vocabulary.insider).alias("insider_claim"),
        has(vocabulary.disclosure).alias("disclosure_present"),
    )


def ticker_tokens(text: Column | str) -> Column:
    """Distinct all-caps tokens that could be ticker symbols."""
    return F.array_distinct(
        F.regexp_extract_all(_col(text), F.lit(f"({TICKER_PATTERN})"), F.lit(1))
    )


def alias_key(text: Column | str) -> Column:
    return F.regexp_replace(F.lower(_col(text)), f"[^{ALIAS_KEPT[1:-1]}]", "")


def _words(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(_col(text)), F.lit("[a-z0-9]+"), F.lit(0))


def _without_stop_words(words: Column) -> Column:
    for stop in NAME_STOP_WORDS:
        words = F.array_remove(words, stop)
    return words


def with_sorted_name(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the normalised name of a text with its words in order.

    Lower-cased words without stop words, unless nothing would be left. In steps, so that the
    text is split into words once.
    """
    return (
        df.withColumn("_words", _words(text))
        .withColumn("_kept", _without_stop_words(F.col("_words")))
        .withColumn(name, F.array_join(F.sort_array(
            F.when(F.size("_kept") > 0, F.col("_kept")).otherwise(F.col("_words"))), " "))
        .drop("_words", "_kept")
    )
