"""Weak supervision of text quality: rules vote or abstain, a latent-class model weighs them.

Each rule votes good, bad or abstains. Expectation-maximisation estimates, for each rule, how often
it votes either way on good and on bad texts, and the share of good texts; the posterior probability
of "good" then decides, in place of the demand that every rule be passed. The model only sees how
often each pattern of votes occurs: at most 3 ** rules rows, whatever the corpus.

Built-in functions alone; nothing leaves the JVM but one row of sums in each round.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tipscope.session import materialize

ABSTAIN, GOOD, BAD = 0, 1, 2
#: name: (measure, good from, good to, bad below, bad above); measures are columns of ``measured``.
RULES = {
    "length": ("n_words", 50, 100_000, 20, 1_000_000),
    "word_length": ("mean_word", 3.5, 6.5, 3.0, 7.5),
    "symbols": ("symbol_share", 0.0, 0.02, -1.0, 0.1),
    "same_lines": ("dup_line_share", 0.0, 0.25, -1.0, 0.4),
    "repeats": ("repeat_share", 0.0, 0.1, -1.0, 0.3),
    "capitals": ("capital_share", 0.0, 0.1, -1.0, 0.3),
    "variety": ("distinct_share", 0.5, 1.0, 0.3, 2.0),
    "marks": ("mark_share", 0.0, 0.4, -1.0, 0.8),
}
ROUNDS = 25
# Start of the estimation, as chances of (abstain, good, bad): bad votes are rare among good texts,
# and a text with a single bad vote is about as likely to be bad as good.
START = {"share": 0.7, "good": (0.09, 0.9, 0.01), "bad": (0.15, 0.65, 0.2)}
SMOOTH = 1.0
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = "!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~"


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of three found twice or more; ``words`` must be a plain column.

    Windows are compared by 64-bit hash within one text. After sorting by (hash, place), equal
    windows are neighbours; each start covers at most three words not covered by the start before.
    """
    windows = F.transform(words, lambda w, i: F.struct(
        F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))
    return F.sort_array(F.slice(windows, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))))


def _covered(windows: Column) -> Column:
    twice = F.filter(windows, lambda w, k: (
        F.coalesce(w["h"] == F.get(windows, k - 1)["h"], F.lit(False))
        | F.coalesce(w["h"] == F.get(windows, k + 1)["h"], F.lit(False))))
    starts = F.sort_array(F.transform(twice, lambda w: w["i"]))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(starts, start, lambda done, at: F.struct(
        at.alias("last"), (done["n"] + F.least(F.lit(3), at - done["last"])).alias("n")),
        lambda done: done["n"])


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and the counts and shares that the rules look at, for each row.

    Counts are those of the whole text; a null text has none. Scratch columns start with "_".
    """
    words = docs.select(
        *keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    words = words.withColumn("_words", F.array_remove(F.split("_text", r"[\x20\x09-\x0D]+"), ""))
    words = words.withColumn("_lines", F.filter(
        F.split("_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    sorted_ = words.withColumn("_windows", repeated_words(F.col("_words")))
    counts = sorted_.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))).cast("long")
        .alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _covered(F.col("_windows")).alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("_n_lines"),
        (F.length("_text") - F.length(F.translate("_text", CAPITALS, ""))).alias("_capitals"),
        F.size(F.array_distinct("_words")).alias("_distinct"),
        (F.length("_text") - F.length(F.translate("_text", MARKS, ""))).alias("_marks"),
    )

    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole))

    return counts.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share("word_chars", "n_words").alias("mean_word"),
        share("n_symbols", "n_words").alias("symbol_share"),
        F.when(F.col("_n_lines") > 1, F.col("n_dup_lines") / F.col("_n_lines"))
        .alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("_capitals", "word_chars").alias("capital_share"),
        share("_distinct", "n_words").alias("distinct_share"),
        share("_marks", "n_words").alias("mark_share"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def votes(rows: DataFrame) -> DataFrame:
    """One column ``_vote_<rule>`` for each rule; a missing measure makes it abstain."""
    for name, (column, low, high, under, over) in RULES.items():
        x = F.col(column)
        rows = rows.withColumn(f"_vote_{name}", F.when(x.isNull(), ABSTAIN)
                               .when((x < under) | (x > over), BAD)
                               .when((x >= low) & (x <= high), GOOD).otherwise(ABSTAIN))
    return rows


def _posterior(share: float, chance: dict[str, dict[int, tuple[float, ...]]]) -> Column:
    """Probability of "good" under the current estimates.

    The weights are one array: as a value, not as code, so all rounds run the same compiled plan.
    """
    weights = [math.log(share / (1.0 - share))]
    for name in RULES:
        weights += [math.log(g / b) for g, b in zip(chance[name][GOOD], chance[name][BAD])]
    known = F.array(*[F.lit(w) for w in weights])
    odds = known[0]
    for k, name in enumerate(RULES):
        odds = odds + known[F.col(f"_vote_{name}") + F.lit(3 * k + 1)]
    return 1.0 / (1.0 + F.exp(-odds))


def learn(patterns: DataFrame, rounds: int = ROUNDS):
    """Share of good texts and chances of each vote, from (votes, n); ``patterns`` is small."""
    share = START["share"]
    chance = {name: {GOOD: START["good"], BAD: START["bad"]} for name in RULES}
    for _ in range(rounds):
        rows = patterns.withColumn("_good", _posterior(share, chance))
        sums = [F.sum(F.col("n") * F.col("_good")).alias("good"), F.sum("n").alias("all")]
        for name in RULES:
            for value in (ABSTAIN, GOOD, BAD):
                hit = F.when(F.col(f"_vote_{name}") == value, F.col("n")).otherwise(0)
                sums += [F.sum(hit * F.col("_good")).alias(f"g_{name}_{value}"),
                         F.sum(hit * (1.0 - F.col("_good"))).alias(f"b_{name}_{value}")]
        got = rows.agg(*sums).first()
        if not got["all"]:
            break
        good, bad = got["good"] + SMOOTH, got["all"] - got["good"] + SMOOTH
        share = good / (good + bad)
        chance = {name: {
            GOOD: tuple((got[f"g_{name}_{v}"] + SMOOTH) / (good + 2 * SMOOTH) for v in range(3)),
            BAD: tuple((got[f"b_{name}_{v}"] + SMOOTH) / (bad + 2 * SMOOTH) for v in range(3)),
        } for name in RULES}
    return share, chance


def learned_from(rows: DataFrame, rounds: int = ROUNDS):
    """Estimates from the votes on ``measured`` rows. Texts that fail the base rule are out
    already; the model is fitted to those it decides on."""
    names = [f"_vote_{name}" for name in RULES]
    rows = rows.withColumn("_at", F.monotonically_increasing_id())
    patterns = votes(rows).where(~base_failed() & (F.col("_at") >= 0)).groupBy(*names).agg(F.count("*").alias("n"))
    return learn(materialize(patterns.coalesce(1), "votes"), rounds)


def judged(rows: DataFrame, share: float, chance) -> DataFrame:
    """``measured`` rows with base_failed, p_good and kept."""
    return (
        votes(rows).withColumn("base_failed", base_failed())
        .withColumn("p_good", _posterior(share, chance))
        .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))
        .drop(*[f"_vote_{name}" for name in RULES])
    )


def quality_votes(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Counts, p_good and verdict for each row of ``docs`` (doc_id, text).

    Runs jobs while it is built (the counts are stored once, then the rounds of estimation).
    Defined cases: a null or empty text has no words, fails the base rule and is not kept; a null
    id comes back null; repeated rows are judged each and count each in the estimation, which
    leaves out texts that fail the base rule; an empty table gives no rows; other columns are ignored.
    """
    stored = materialize(measured(docs.select(F.col("doc_id"), F.col("text")), ["doc_id"]),
                         "measures")
    return judged(stored, *learned_from(stored, rounds)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", F.round("p_good", 4).alias("p_good"))


def keep_good(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Rows of ``docs`` that ``quality_votes`` keeps, with all their columns.

    Texts are measured twice, for the estimates and for the verdicts, rather than stored with their
    measures: that would write every text once more. Defined cases: null and empty texts go; a null
    id does not matter; repeated rows are judged alike and all stay or go; an empty table gives no
    rows; other columns may have any name.
    """
    estimates = learned_from(measured(docs.select("text"), []), rounds)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                         F.col("text"))
    # A column that is not deterministic keeps the verdict above the measures: pushed below them,
    # it would repeat them for each use.
    rows = measured(packed, ["_row"]).withColumn("_at", F.monotonically_increasing_id())
    return judged(rows, *estimates).where(F.col("kept") & (F.col("_at") >= 0)).select("_row.*")
