"""Alignment, toxicity and spelling variants against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tipscope.llm import alignment, spelling_variants, toxicity
from test_text_operators import awkward, corpus, empty, table

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


# alignment ----------------------------------------------------------------------------------

def token_bytes(both, by_a, ids):
    return [(both.bytes_a if by_a else both.bytes_b)[k] for k in ids]


def plain_groups(text):
    """Groups by a walk over both lists of ends; None without tokens."""
    tokenizer = Tokenizer.from_file(BYTES)
    tokenizer.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    if not text:
        return None
    both = alignment.pairing(BYTES, PIECES)
    a = tokenizer.encode(" " + text, add_special_tokens=False).ids
    b = pieces.encode(text)
    spelt = [token_bytes(both, True, a), token_bytes(both, False, b)]
    whole = (" " + text).encode()
    if b"".join(spelt[0]) != whole or b"".join(spelt[1]) != whole:
        return None
    groups, i, j, end_a, end_b = [([], [])], 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if end_a <= end_b and i < len(a) and not (end_a == end_b and j > len(b)):
            groups[-1][0].append(a[i])
            end_a += len(spelt[0][i])
            i += 1
        else:
            groups[-1][1].append(b[j])
            end_b += len(spelt[1][j])
            j += 1
        if end_a == end_b and i < len(a):
            groups.append(([], []))
    return a, b, groups


def plain_alignment(rows):
    found = [(i, plain_groups(t)) for i, t in rows]
    pairs = Counter((g[0][-1], g[1][-1]) for _, f in found if f for g in f[2])
    best = {}
    for (_, b), n in pairs.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for i, f in found:
        if f is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(g[0][-1], g[1][-1]) for g in f[2]]
        printed = ";".join("|".join(",".join(map(str, side)) for side in g) for g in f[2])
        out.append((i, len(f[0]), len(f[1]), len(f[2]), len(links),
                    sum(pairs[p] == best[p[1]] for p in links), sum(pairs[p] for p in links),
                    hashlib.sha256(printed.encode()).hexdigest()))
    return out


def sort_key(row):
    return tuple((x is None, str(x)) for x in row)


def odd_texts(seed):
    rnd = random.Random(seed)
    letters = "abc  the ing\né漢字🚀 ▁<0x41></s><s>ÄÖ\t\x00"
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(60)]


def test_alignment_equals_a_walk(spark):
    docs = awkward(spark).unionByName(table(spark, corpus(40) + odd_texts(1)).withColumn(
        "doc_id", F.col("doc_id") + 100))
    got = alignment.alignment_counts(docs, BYTES, PIECES, block=8)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                           "groups_sha256"]
    want = plain_alignment([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert sorted(map(tuple, got.collect()), key=sort_key) == sorted(want, key=sort_key)
    assert any(r[7] for r in want) and any(not r[7] for r in want)
    assert alignment.alignment_counts(empty(spark), BYTES, PIECES).count() == 0


def test_cuts_are_the_shared_ends_at_any_block_size():
    rnd = random.Random(4)
    for case in range(300):
        end = rnd.randint(1, 400)
        a, b = (np.array(sorted({end, *rnd.choices(range(1, end + 1), k=rnd.randint(0, 120))}))
                for _ in range(2))
        if case % 3 == 0:  # hardly any shared end
            b = np.array(sorted({end} | set(range(1, end)) - set(a.tolist())))
        want = np.intersect1d(a, b)
        for block in (1, 5, 1024):
            at_a, at_b = alignment.shared_cuts(a, b, block)
            assert a[at_a].tolist() == b[at_b].tolist() == want.tolist()


def test_stretches_are_encoded_as_in_the_whole_text(monkeypatch):
    both = alignment.Pairing(BYTES, PIECES)
    assert both.separable
    rnd = random.Random(8)
    letters = "ab THE's 'll 12 .,!  \n\t\u00a0\u2581é×漢🚀\x1c\x85<s>"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 40))) for _ in range(3000)]
    texts += corpus(20) + ["  a", "a  b", " a b ", "don't 'tis x's", "\ufb01 x", "é é"]
    whole = [(a, b) if both.covers(t, a, b) else None
             for t, (a, b) in zip(texts, both.whole(texts))]
    monkeypatch.setattr(alignment, "REMEMBERED", 50)
    parts = [got and (got[0].tolist(), got[1].tolist()) for k in range(0, len(texts), 100)
             for got in both.encode(texts[k:k + 100])]
    assert parts == whole and not all(whole)


def test_linkable_pairs_are_suffixes():
    both = alignment.pairing(BYTES, PIECES)
    n = len(both.bytes_b)
    rnd = random.Random(2)
    for key in rnd.sample(both.keys.tolist(), 500):
        a, b = both.bytes_a[key // n], both.bytes_b[key % n]
        assert a and b and (a.endswith(b) or b.endswith(a))
    # A bound from the vocabularies: no pair for each letter of each token twice over.
    assert len(both.keys) <= 2 * (both.size_a.sum() + both.size_b.sum())


# toxicity -----------------------------------------------------------------------------------

def insulting(n=500, seed=5):
    """Texts, labels: one half of the toxic use listed words, the other invented ones."""
    rnd = random.Random(seed)
    plain = ["".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(150)]
    own = ["vequ" + w for w in plain[:30]]
    texts, labels = [], []
    for k in range(n):
        words = [rnd.choice(plain) for _ in range(rnd.randint(20, 60))]
        bad = k % 5 == 0
        if bad:
            for _ in range(4):
                words[rnd.randrange(len(words))] = rnd.choice(
                    ["idiot", "trash", "moron", "you scum"] if k % 2 else own)
        texts.append(" ".join(words))
        labels.append(int(bad))
    return texts, labels


def test_toxicity_finds_listed_and_learned_words(spark):
    texts, labels = insulting()
    docs = table(spark, texts)
    known = spark.createDataFrame([*enumerate(labels)], "doc_id long, toxic int")
    got = toxicity.toxicity_scores(docs, known)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == len(texts)
    apart = [i for i in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(rows[i].held_out == (i in set(apart)) for i in rows)
    assert all(rows[i].predicted == (rows[i].score >= 0.3) for i in rows)
    right = [rows[i].predicted == labels[i] for i in apart]
    assert sum(right) >= 0.95 * len(right)
    assert sum(rows[i].predicted for i in apart if labels[i]) >= 0.9 * sum(labels[i] for i in apart)


def test_held_out_labels_do_not_teach(spark):
    texts, labels = insulting(200)
    docs = table(spark, texts)
    turned = [1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y for i, y in enumerate(labels)]
    got = [sorted(map(tuple, toxicity.toxicity_scores(docs, spark.createDataFrame(
        [*enumerate(y)], "doc_id long, toxic int")).collect())) for y in (labels, turned)]
    assert got[0] == got[1]


def test_toxicity_of_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.toxicity_scores(awkward(spark), none)
    assert got.count() == awkward(spark).count() and {r.score for r in got.collect()} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in range(16)] + [(3, None), (4, 7), (None, 0)],
                                "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity_scores(awkward(spark), one).collect()} == {1.0}
    assert toxicity.toxicity_scores(empty(spark), none).count() == 0


def test_features_see_through_spellings():
    def of(text):
        return dict(zip(toxicity.FEATURES, toxicity.features(text, toxicity.Weights({}))))

    assert not any(toxicity.features(None, toxicity.Weights({})))
    assert of("you absolute idiot")["insult_count"] == 1
    assert of("you absolute idiot")["near_second_person"] > 0
    assert of("you " + "word " * 9 + "idiot")["near_second_person"] == 0
    assert of("idiot " * 3)["second_person_distance"] == 0
    for hidden in ("1d10t", "i.d.i.o.t", "id*ot", "idiooot", "m0r0n", "l.o.s.e.r"):
        assert of(f"what a {hidden} that is")["obfuscated_count"] == 1, hidden
    for plain in ("b2b", "3.5.1", "a.b.c.d.e", "x*y", "cooool", "token 0x1d10"):
        assert of(f"what a {plain} that is")["obfuscated_count"] == 0, plain
    assert of("STOP that NOW!!")["caps_word_share"] == pytest.approx(2 / 3)
    assert of("STOP that NOW!!")["repeated_mark_density"] == pytest.approx(1 / 3)
    with_learned = toxicity.features("vequxa and vequyb", toxicity.Weights({"vequ*": 2.0}))
    assert dict(zip(toxicity.FEATURES, with_learned))["learned_sum"] == 4.0


def plain_isotonic(y, w):
    """The closest rising sequence: largest of smallest averages over all stretches."""
    n = len(y)
    mean = lambda a, b: np.average(y[a:b + 1], weights=w[a:b + 1])
    return [max(min(mean(a, b) for b in range(k, n)) for a in range(k + 1)) for k in range(n)]


def test_isotonic_is_the_closest_rising_sequence():
    rnd = np.random.default_rng(3)
    for _ in range(50):
        n = rnd.integers(1, 25)
        score, y, w = rnd.integers(0, 8, n).astype(float), rnd.integers(0, 2, n), rnd.random(n) + .1
        values = np.unique(score)
        rates = np.array([np.average(y[score == v], weights=w[score == v]) for v in values])
        sizes = np.array([w[score == v].sum() for v in values])
        got = np.interp(values, *toxicity.isotonic(score, y, w))
        assert got == pytest.approx(plain_isotonic(rates, sizes))


def test_a_split_is_the_best_of_all():
    rnd = np.random.default_rng(1)
    for _ in range(30):
        binned = rnd.integers(0, 6, (60, 3))
        g, h = rnd.normal(size=60), rnd.random(60)
        best = None
        for f in range(3):
            for b in range(5):
                left = binned[:, f] <= b
                if h[left].sum() < 0.5 or h[~left].sum() < 0.5:
                    continue
                gain = sum(g[s].sum() ** 2 / (h[s].sum() + 1.0) for s in (left, ~left))
                gain -= g.sum() ** 2 / (h.sum() + 1.0)
                best = max(best or -1.0, gain)
        got = toxicity._best_split(binned, g, h, np.arange(60), 6, 1.0, 0.5)
        assert got[0] == pytest.approx(best)


# spelling variants --------------------------------------------------------------------------

def plain_variants(rows, min_count=5, factor=5):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= min_count}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))

    others = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, found in others.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= factor * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n, len(others[w]), words.get(form[w]))
                  for w, n in words.items())


def variant_texts(seed=0):
    """Frequent words, edits of them in a chain of falling counts, and anagrams."""
    rnd = random.Random(seed)
    letters = "abcdeéßÀ"
    words = ["".join(rnd.choice(letters) for _ in range(rnd.randint(6, 9))) for _ in range(60)]
    often = {}
    for w in words:
        n = rnd.choice([5, 30, 700])
        for _ in range(rnd.randint(1, 4)):
            often[w] = max(often.get(w, 0), n)
            k = rnd.randrange(len(w))
            w = rnd.choice([w[:k] + w[k + 1:], w[:k] + rnd.choice(letters) + w[k:],
                            w[:k] + rnd.choice(letters) + w[k + 1:], w[::-1]])
            n = max(n // rnd.choice([1, 5, 6]), 4)
    runs = [w.title() if rnd.random() < 0.1 else w for w, n in often.items() for _ in range(n)]
    rnd.shuffle(runs)
    return [rnd.choice(" .,1×").join(runs[k:k + 40]) for k in range(0, len(runs), 40)]


def test_variants_equal_all_pairs(spark):
    docs = awkward(spark).unionByName(table(spark, variant_texts()).withColumn(
        "doc_id", F.col("doc_id") + 100))
    got = spelling_variants.spelling_variants(docs)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain_variants([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert sorted(map(tuple, got.collect()), key=sort_key) == sorted(want, key=sort_key)
    assert any(r[1] and r[2] != r[1] for r in want)  # a chain of forms
    assert spelling_variants.spelling_variants(empty(spark)).count() == 0


@pytest.mark.parametrize("chunk", [1, 3, 2048])
@pytest.mark.parametrize("classes", [2, 5])
def test_chunks_of_any_size_lose_no_pair(spark, monkeypatch, chunk, classes):
    rnd = random.Random(chunk)
    words = {"".join(rnd.choice("abc") for _ in range(rnd.randint(6, 8))) for _ in range(150)}
    words |= {"a" * 3000, "a" * 2999, "b" + "a" * 2999}
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    # The workers import the module anew, so the size is handed over with the function.
    monkeypatch.setattr(spelling_variants, "_cut", chunks_of(chunk))
    got = {(r.word, r.other) for r in spelling_variants.near_words(df, classes=classes).collect()}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))

    one_way = {(a, b) for a in words for b in words if abs(len(a) - len(b)) < 2 and near(a, b)}
    assert got == one_way | {(b, a) for a, b in one_way}


def chunks_of(size):
    def cut(batches):
        from tipscope.llm import spelling_variants as module
        kept, module.CHUNK_WORDS = module.CHUNK_WORDS, size
        try:
            yield from module._cut(batches)
        finally:
            module.CHUNK_WORDS = kept
    return cut


def test_a_form_must_be_more_frequent(spark):
    with pytest.raises(ValueError):
        spelling_variants.spelling_variants(empty(spark), factor=1)


def test_one_deletion_follows_the_hash():
    for k in range(2000):
        got = spelling_variants.misspelt("7", f"wörd{k}")
        h = zlib.crc32(f"7:wörd{k}".encode())
        assert len(got) == len(f"wörd{k}") - (h % 199 == 0)


# stages -------------------------------------------------------------------------------------

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def clashing(spark):
    """Rows with names that the stages use, a dotted name, an id of several texts, odd texts."""
    rnd = random.Random(6)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 8))) for _ in range(300)]
    text = " ".join(rnd.choice(words) for _ in range(90))
    other = " ".join(rnd.choice(words) for _ in range(90))
    rows = [(1, text, "x"), (1, text, "y"), (1, text + " end", "x"), (1, other, "x"),
            (2, text, "x"), (3, other + " end", "x"), (None, text, "x"), (None, text, "x"),
            (4, None, "x"), (4, "", "x"), (5, None, "z"), (6, text * 60, "x"),
            (7, 'token = "Zk3vQ9xW1pL7rT5yB2nM" ' + other[::-1], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, note string")
    return df.withColumns({"_text": F.lit("t"), "_clean": F.lit("c"), "a.b": F.lit(1),
                           "_row": F.lit("r"), "digest": F.lit(b"d"), "_h": F.lit(2),
                           "component_id": F.lit("k"), "n_words": F.lit(3)})


def test_keep_first_with_clashing_names_and_shared_ids(spark):
    from tipscope.llm.set_join import keep_first

    docs = clashing(spark)
    got = keep_first(docs)
    assert got.dtypes == docs.dtypes
    rows = got.collect()
    assert all((r._text, r._clean, r["a.b"], r._row, r._h, r.component_id) ==
               ("t", "c", 1, "r", 2, "k") for r in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, len(r.text or "")) for r in rows
                  if r.doc_id != 1) == sorted(
        (r.doc_id is None, r.doc_id or 0, len(r.text or "")) for r in docs.collect()
        if r.doc_id in (None, 4, 5, 7))  # the long text of id 6 has the shingles of id 1
    # Id 1 keeps one text of each of its two groups, whatever else is near them.
    assert len([r for r in rows if r.doc_id == 1]) == 2
    assert sorted(map(str, keep_first(docs.repartition(7)).collect())) == sorted(map(str, rows))
    assert keep_first(docs.limit(0)).count() == 0


def test_other_stages_with_clashing_names(spark):
    from tipscope.llm import secret_scan, subword_classifier, weak_rules

    docs = clashing(spark)
    masked = secret_scan.without_secrets(docs, RANKS, public_tokenizers.PATTERN)
    assert masked.dtypes == docs.dtypes and masked.count() == docs.count()
    rows = masked.collect()
    assert {r._clean for r in rows} == {"c"} and {r._text for r in rows} == {"t"}
    assert all("Zk3vQ9xW1pL7rT5yB2nM" not in (r.text or "") for r in rows)
    good = weak_rules.keep_good(docs)
    assert good.columns == docs.columns and {r.n_words for r in good.collect()} <= {3}
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert subword_classifier.keep_quality(docs, labels).count() == docs.count()
    for stage in (lambda d: secret_scan.without_secrets(d, RANKS, public_tokenizers.PATTERN),
                  weak_rules.keep_good, lambda d: subword_classifier.keep_quality(d, labels)):
        assert stage(docs.limit(0)).count() == 0
