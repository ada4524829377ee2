import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tipscope.functions import text as X
from tipscope.functions.vocabulary import DEFAULT, Vocabulary, load_vocabulary


def parse(spark, texts, vocabulary=DEFAULT):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return X.with_tip_columns(df, "text", vocabulary).orderBy("i").collect()


def test_language(spark):
    got = parse(spark, ["Kal RELIANCE me tezi aayegi", "pakka lelo bhai turant",
                        "strong breakout expected today", "12 34", "a b", "abhi2 5"])
    assert [r.language for r in got] == ["mixed", "hi-Latn", "en", "en", "en", "hi-Latn"]


def test_direction(spark):
    got = parse(spark, ["buy karo abhi", "bech do turant", "reliance ka result aaya",
                        "buy or sell", "a long term view", "buyback planned"])
    assert [r.direction for r in got] == ["long", "short", "unclear", "unclear", "long",
                                          "unclear"]


def test_target_price(spark):
    got = parse(spark, ["SUZLON ka target 80, pakka", "tgt: 1500 in 2 weeks", "target rs 45.5",
                        "no target mentioned here", "stock at 250 levels looking good",
                        "http 500", "TARGET PRICE = ₹ 12.345", "trgt 1,500"])
    assert [r.target_price for r in got] == [80.0, 1500.0, 45.5, None, None, 500.0, 12.34, 1.0]


def test_horizon(spark):
    got = parse(spark, ["intraday call book fast", "hold for 5 days", "target in 2 weeks",
                        "1 month view", "long term invest karo", "positional trade",
                        "2 weeks or 3 din", "5 dayss", "10 HAFTE"])
    assert [r.horizon_days for r in got] == [1, 5, 14, 30, None, 5, 3, None, 70]


def test_urgency(spark):
    got = parse(spark, ["buy now 🚀🚀", "accumulate today slowly", "decent long term company",
                        "snowball", "up 🔥", "⚡️now", "nowé", "dont miss"])
    assert [r.urgency for r in got] == ["high", "medium", "low", "low", "high", "high", "low",
                                        "high"]


def test_claims_and_disclosure(spark):
    got = parse(spark, ["sure shot profit", "100% guaranteed returns", "looks reasonable",
                        "operator support confirmed", "insider news aaya hai",
                        "read the public results", "100%", "1100%", "INH000012345", "ra reg inh0 x",
                        "SEBI registered research analyst", "just forwarding a tip"])
    assert [r.guarantee_claim for r in got] == [True, True, False, True, False, False, True,
                                                False, False, False, False, False]
    assert [r.insider_claim for r in got] == [False] * 3 + [True, True] + [False] * 7
    assert [r.disclosure_present for r in got] == [False] * 9 + [True, True, False]


def test_hit_scan_equals_term_by_term_search(spark):
    rng = random.Random(4)
    pieces = [*DEFAULT.phrases(), " ", ", ", "-", "é", "x", "_", "7", "️", "बुय", "aaj", "sure"]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " ", " "]) for _ in range(12))
             for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(
        F.lower("text").alias("text")).withColumn("hits", X.term_hits("text"))
    names = ("long", "short", "urgency_high", "urgency_medium", "guarantee", "insider",
             "disclosure", "intraday", "positional", "long_term")
    has = X.hit_test("hits")
    got = df.select("text", *[has(getattr(DEFAULT, n)).alias(n) for n in names],
                    *[X.contains_term("text", getattr(DEFAULT, n)).alias(n + "_scan")
                      for n in names]).collect()

    def found(text, term):
        if term[0].isalnum():
            return re.search(rf"(?<!\w){re.escape(term)}(?!\w)", text) is not None
        return term in text

    for row in got:
        for name in names:
            want = any(found(row.text, t) for t in getattr(DEFAULT, name))
            assert row[name] == want, (row.text, name)
            assert row[name + "_scan"] == want, (row.text, name)


def test_other_vocabulary(spark, tmp_path):
    path = tmp_path / "words.json"
    path.write_text(json.dumps({"direction": {"long": ["moon", "#go"], "short": []},
                                "urgency": {"high": ["asap"]}}))
    words = load_vocabulary(str(path))
    got = parse(spark, ["to the moon asap", "x#go", "buy now"], words)
    assert [(r.direction, r.urgency) for r in got] == [
        ("long", "high"), ("long", "low"), ("unclear", "low")]
    assert words.guarantee == Vocabulary().guarantee


def test_name_keys(spark):
    df = spark.createDataFrame([("Maruti Suzuki India Limited",), ("The Company Ltd.",),
                                ("Mahindra & Mahindra",), ("!!",)], "t string")
    got = [r.k for r in X.with_sorted_name(df, "t", "k").collect()]
    assert got == ["maruti suzuki", "company ltd the", "mahindra mahindra", ""]


@pytest.mark.parametrize("text, tokens", [
    ("buy SUZLON, M&M and BAJAJ-AUTO now", ["SUZLON", "M&M", "BAJAJ-AUTO"]),
    ("Reliance TCS TCS LT aTATA", ["TCS", "TATA"]),
])
def test_ticker_tokens(spark, text, tokens):
    row = spark.createDataFrame([(text,)], "t string").select(X.ticker_tokens("t")).first()
    assert row[0] == tokens
