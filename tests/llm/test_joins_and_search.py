"""Set join, URL cascade, packing, search and the pipeline against plain versions."""

from __future__ import annotations

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tipscope.llm import learned_partitions, retrieval_packing, set_join, url_cascade
from tipscope.llm.components import connected

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", 7) for i, t in rows],
                                 "doc_id long, text string, label string, n int")


def empty(spark):
    return docs_of(spark, [])


# set join -----------------------------------------------------------------------------------

def shingles(text, k):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1)))


def plain_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(shingles(t, k), []).append(i)
    keys = [s for s in sets if s]
    parent = {s: s for s in keys}

    def find(s):
        while parent[s] != s:
            s = parent[s]
        return s

    for a in range(len(keys)):
        for b in range(a):
            x, y = keys[a], keys[b]
            if 100 * len(x & y) >= percent * len(x | y):
                parent[find(x)] = find(y)
    small = defaultdict(lambda: 1 << 60)
    for s in keys:
        small[find(s)] = min(small[find(s)], *sets[s])
    out = []
    for i, t in rows:
        s = shingles(t, k)
        out.append((i, len(s), None if i is None else small[find(s)] if s else i))
    return sorted(out, key=str)


def families(seed, n=14):
    """Exact copies, near copies at all distances, chains, short and odd texts."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(3)) for _ in range(300)]
    rows = []

    def add(text):
        rows.append((rnd.randrange(10 ** 6) * 100 + len(rows), text))

    for _ in range(n):
        base = [rnd.choice(words) for _ in range(rnd.choice([1, 2, 3, 5, 20, 80, 200]))]
        add(" ".join(base))
        add("  ".join(base).upper())
        chain = list(base)
        for _ in range(rnd.randint(0, 12)):
            copy = list(base)
            for _ in range(rnd.randint(1, max(1, len(base) // 15))):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            add(" ".join(copy))
            chain[rnd.randrange(len(chain))] = rnd.choice(words)
            add(" ".join(chain))
            add(" ".join(base + [rnd.choice(words)] * rnd.randint(1, 8)))
    for t in (None, "", " \n", "one", "ONE", "a a a a a a a a", "a a a"):
        add(t)
    rows += [rows[0], rows[1], (None, rows[0][1]), (None, None)]
    return rows


@pytest.mark.parametrize("seed,k,percent", [(1, 3, 90), (2, 5, 80), (3, 2, 70), (4, 3, 90)])
def test_components_equal_brute_force(spark, seed, k, percent):
    rows = families(seed)
    out = set_join.jaccard_components(docs_of(spark, rows), words=k, percent=percent).collect()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str)
    assert got == plain_components(rows, k, percent)


def test_a_large_family_compares_each_member_about_once(spark):
    rnd = random.Random(8)
    base = [f"w{rnd.randrange(5000)}" for _ in range(200)]
    rows = []
    for i in range(150):
        copy = list(base)
        copy[rnd.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    compared = []
    plain = set_join._compared

    def counting(pairs, sets):
        compared.append(pairs.distinct().count())
        return plain(pairs, sets)

    set_join._compared = counting
    try:
        out = set_join.jaccard_components(docs_of(spark, rows), words=5, percent=80).collect()
    finally:
        set_join._compared = plain
    assert {r.component_id for r in out} == {0}
    assert sum(compared) < 8 * len(rows)  # all pairs would be 11,175


def test_set_join_empty_and_keep_first(spark):
    assert set_join.jaccard_components(empty(spark)).count() == 0
    rows = families(5)
    docs = docs_of(spark, rows)
    kept = set_join.keep_first(docs)
    assert kept.columns == docs.columns
    want = {c for i, _, c in plain_components(rows, 5, 80) if i is not None and i == c}
    got = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in got if i is not None) == sorted(want)
    assert got.count(None) == 2


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 200)]
    found = connected(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r.node, r.root) for r in found} == (
        {(i, 0) for i in range(41)} | {(i, 100) for i in range(100, 160)})
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


# urls ---------------------------------------------------------------------------------------

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
         ("org", "/fr/", "allow"), ("a.example.com", "/de/x", "allow"), ("bare.com", "", "block")]
URLS = [None, "", "no scheme", "http://", "http://a.net", "http://a.net/", "HTTPS://WWW.Example.NET/en/1?x",
        "https://example.net/EN/", "x://example.com/de/", "x://a.example.com/de/xy", "y://notexample.com/de/",
        "http://b.org/fr/#t", "http://b.org/fr", "http://u@h.net:80/", "http://q.net?x=/y", "http://..net/",
        "a://b://c.net/", "http://bare.com", "http://x.bare.com#f", "http://net/", "http://a.net/\nb"]


def plain_verdict(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules
           if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_url_verdicts(spark):
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(URLS + URLS[4:6])],
                                  "page_id long, url string, verdict string")
    rules = spark.createDataFrame(RULES + [(None, "/", "block")], "host string, path string, verdict string")
    for r in url_cascade.url_verdicts(pages, rules).collect():
        url = (URLS + URLS[4:6])[r.page_id]
        assert (r.host, r.path, r.rule, r.verdict) == plain_verdict(url, RULES), url
    none = url_cascade.url_verdicts(pages, rules.limit(0)).collect()
    assert {(r.rule, r.verdict) for r in none} == {(None, "allow")} and len(none) == len(URLS) + 2
    assert url_cascade.url_verdicts(pages.limit(0), rules).count() == 0


def test_cascade_is_exact_and_has_several_levels(spark):
    rnd = random.Random(6)
    keys = [f"k{rnd.randrange(10 ** 9)}" for _ in range(20_000)]
    listed = set(keys[::40])
    universe = spark.createDataFrame([(k,) for k in keys], "key string")
    levels = url_cascade.build_cascade(
        spark.createDataFrame([(k,) for k in listed], "key string"), universe)
    got = universe.where(url_cascade.is_listed(F.col("key"), levels)).distinct().collect()
    assert {r.key for r in got} == listed and len(levels) >= 3
    assert sum(level.bits for level in levels) < 40 * len(listed)


# packing ------------------------------------------------------------------------------------

def packing_rows(n=120):
    rnd = random.Random(11)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(500)]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 3, 200, 900]))))
            for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, " ".join(rnd.choice(words) for _ in range(9000))),
             (None, "no id"), (n + 3, "Don't <|endoftext|> éÉ 漢字\u00a0\u2003x\x1cy 🚀 İ Σς")]
    return rows


@pytest.mark.parametrize("shard_tokens", [5_000, 2_000_000])
def test_packing(spark, shard_tokens):
    rows = packing_rows()
    out = retrieval_packing.packed_pieces(docs_of(spark, rows), WORD_BPE,
                                          shard_tokens=shard_tokens).collect()
    tokenizer = Tokenizer.from_file(WORD_BPE)
    ids = {i: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
           for i, t in rows}
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
        by_window[r.sequence_id].append(r)
        piece = ids[r.doc_id][r.start:r.start + r.length]
        assert r.length == len(piece) > 0 and r.ids_crc32 == zlib.crc32(piece.tobytes())
        assert r.doc_tokens == len(ids[r.doc_id])
    assert set(by_doc) == set(ids)
    for doc, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(ids[doc])
    for pieces in by_window.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096 and at & (at - 1) == 0  # full, or a power of two: no padding
    assert retrieval_packing.packed_pieces(empty(spark), WORD_BPE).count() == 0


def test_neighbours_of_a_seed_come_first():
    texts = [np.array(x, np.uint16) for x in ([1, 2, 3], [7, 8, 9], [2, 3, 4], [9, 9, 9], [5, 6])]
    shard = retrieval_packing.Shard(texts, np.ones(16))
    shard.unused[0] = False
    assert shard.neighbours(0).tolist() == [2]
    assert shard.neighbours(1).tolist()[0] in (1, 3)
    order = [p[0] for p in retrieval_packing.pack(list("abcde"), texts, np.ones(16), window=6)]
    assert order[:2] == ["a", "c"]


def test_words_keep_a_tokenizers_ids():
    known, tokenizer = retrieval_packing.WordIds(WORD_BPE), Tokenizer.from_file(WORD_BPE)
    rnd = random.Random(3)
    alphabet = ["a", "B", "'s", " ", "  ", "\n", "\t", "\u00a0", "e\u0301", "\u0301", "Σ", "İ", "1", "!",
                "漢", "<|endoftext|>", "\x1c", "\u2003", "\u1100\u1161", "ﬁ"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30))) for _ in range(800)]
    texts += ["Ünïcode, WORDS!! ßtraße... (x) it's ÀÉ** a,b", "ÿ" * 30 + " | " + "Ab" * 40 + "?!"]
    for text in texts:
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert known.encode(text).tolist() == want, repr(text)


# search -------------------------------------------------------------------------------------

def vectors_of(n, width=16, seed=2):
    random_ = np.random.default_rng(seed)
    return random_.normal(size=(n, width)).astype(np.float32)


def plain_nearest(rows, k):
    ids = [i for i, _ in rows]
    v = np.array([x for _, x in rows], float)
    out = {}
    for i, x in rows:
        if i % 50 == 0:
            x = np.array(x, float)
            s = (v * x).sum(1) / (np.sqrt((x * x).sum()) * np.sqrt((v * v).sum(1)))
            out[i] = sorted(((-a, b) for a, b in zip(s, ids) if b != i))[:k]
    return out


def test_search_recall_and_exact_scores(spark):
    data = vectors_of(3000)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = learned_partitions.nearest(table, F.col("vec_id") % 50 == 0).collect()
    want = plain_nearest(rows, 5)
    got = defaultdict(dict)
    for r in out:
        got[r.query_id][r["rank"]] = (r.vec_id, r.score)
    assert set(got) == set(want) and all(sorted(g) == [1, 2, 3, 4, 5] for g in got.values())
    hits = sum(len({b for _, b in want[q]} & {x for x, _ in got[q].values()}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    for q, found in got.items():
        x = data[q].astype(float)
        for vec, score in found.values():
            y = data[vec].astype(float)
            assert score == pytest.approx(x @ y / np.linalg.norm(x) / np.linalg.norm(y), abs=1e-12)
            assert vec != q


def test_search_with_copies_and_odd_vectors(spark):
    data = vectors_of(120, 8)
    rows = [(i, [float(x) for x in (data[0] if i % 3 == 0 else data[i % 120])]) for i in range(400)]
    good = list(rows)
    rows += [(1000, None), (1050, [0.0] * 8), (1100, [None] + [1.0] * 7), (1150, [float("nan")] * 8),
             (1200, [1.0]), (1250, [float("inf")] * 8), (None, [1.0] * 8), rows[50]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn(
        "part", F.lit("clash"))
    out = learned_partitions.nearest(table, F.col("vec_id") % 50 == 0, parts=8, probes=8).collect()
    got = defaultdict(list)
    for r in sorted(out, key=lambda r: r["rank"]):
        got[r.query_id].append(r.vec_id)
    want = plain_nearest(good, 5)
    assert set(got) == set(want)
    for q in want:
        assert got[q] == [b for _, b in want[q]]


def test_search_in_small_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert learned_partitions.nearest(spark.createDataFrame([], schema), F.lit(True)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])], schema)
    out = learned_partitions.nearest(few, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r["rank"], r.vec_id) for r in out] == [(1, 1), (2, 2)]


def test_parts_are_balanced():
    graph = learned_partitions.neighbour_graph(learned_partitions._unit(vectors_of(1000)), 8)
    part = learned_partitions.balanced_parts(graph, 16)
    assert np.bincount(part, minlength=16).max() - np.bincount(part, minlength=16).min() <= 4
    random_ = np.random.default_rng(0).integers(0, 16, 1000)
    inside = (part[graph] == part[:, None]).mean()
    assert inside > 2 * (random_[graph] == random_[:, None]).mean()


# pipeline -----------------------------------------------------------------------------------

def pipeline_docs(spark, folder):
    rnd = random.Random(12)
    words = ["".join(rnd.choice("abcdefghijklm") for _ in range(rnd.randint(3, 7)))
             for _ in range(900)]

    def prose():
        return " ".join(rnd.choice(words) for _ in range(rnd.randint(80, 160)))

    good = [prose() for _ in range(90)]
    near = []
    for t in good[:20]:
        w = t.split()
        w[5] = "changed"
        near.append(" ".join(w))
    bad = [" ".join(w + "***" for w in prose().split()) for _ in range(30)]
    texts = good + near + good[:5] + bad + [None, "", "short text"]
    texts[30] += " password=abcdef123 "
    rows = [(i, t, "en", "src", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"
                          ).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 115), 0) for i in range(0, 145, 2)],
                          "doc_id long, quality int, toxic int"
                          ).write.parquet(f"{folder}/labels.parquet")
    return len(good)


def test_pipeline(spark, tmp_path):
    n = pipeline_docs(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, str(tmp_path))
        assert seen.columns == docs.columns
        kept[name] = {r.doc_id for r in seen.select("doc_id").collect()}
    assert kept["quality rules"] == set(range(n + 25))
    assert kept["near duplicates"] == set(range(n)) == kept["secret scans"]
    text = seen.where("doc_id = 30").first().text
    assert "abcdef123" not in text and "[SECRET]" in text
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in pieces.collect()} == set(range(n))


def test_pipeline_rejects_bad_documents_that_pass_the_rules(spark, tmp_path):
    rnd = random.Random(13)

    def vocabulary(letters):
        return ["".join(rnd.choice(letters) for _ in range(rnd.randint(3, 7))) for _ in range(300)]

    def prose(words, least):
        return " ".join(rnd.choice(words) for _ in range(rnd.randint(least, 2 * least)))

    good, bad = vocabulary("abcdefghijklm"), vocabulary("nopqrstuvwxyz")
    # All documents labelled 0 are too short for the rules; the long ones like them have no label.
    texts = [prose(good, 80) for _ in range(200)] + [prose(bad, 80) for _ in range(15)]
    texts += [prose(bad, 15) for _ in range(150)]
    rows = [(i, t, "en", "src", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"
                          ).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i in [*range(0, 200, 2), *range(215, 365)]],
                          "doc_id long, quality int, toxic int"
                          ).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    passed = corpus_pipeline.quality_rules(spark, docs, str(tmp_path))
    assert {r.doc_id for r in passed.select("doc_id").collect()} == {*range(215)}
    kept = corpus_pipeline.quality_classifier(spark, passed, str(tmp_path))
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == set(range(200))


def test_pipeline_of_nothing(spark, tmp_path):
    pipeline_docs(spark, tmp_path / "full")
    for name in ("documents", "labels"):
        spark.read.parquet(f"{tmp_path}/full/{name}.parquet").limit(0).write.parquet(
            f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_stars_are_left_without_another_round(spark, monkeypatch):
    from tipscope.llm import components
    rounds = []
    store = components.materialize
    monkeypatch.setattr(components, "materialize",
                        lambda df, label: rounds.append(label) or store(df, label))
    stars = [(0, k) for k in range(1, 6)] + [(10, 11), (20, 21), (20, 22)]
    found = connected(spark.createDataFrame(stars, "a long, b long")).collect()
    assert sorted(map(tuple, found)) == sorted(
        {(a, a) for a, _ in stars} | {(b, a) for a, b in stars})
    assert rounds == ["edges"]
    # A path is no star, nor is a node with two lower neighbours.
    for edges in ([(1, 2), (2, 3)], [(1, 3), (2, 3)]):
        found = connected(spark.createDataFrame(edges, "a long, b long")).collect()
        assert sorted(map(tuple, found)) == [(1, 1), (2, 1), (3, 1)]


def test_set_join_works_in_small_batches(spark, monkeypatch):
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, inside = spark.conf.get(conf), []
    store = set_join.materialize
    monkeypatch.setattr(set_join, "materialize", lambda df, label: inside.append(
        spark.conf.get(conf)) or store(df, label))
    rows = [(k, f"one two three four five six {k // 2}") for k in range(8)]
    found = set_join.jaccard_components(docs_of(spark, rows), words=3, percent=90).collect()
    assert {r.component_id for r in found} == {0, 2, 4, 6}
    assert set(inside) == {str(set_join.BATCH_ROWS)} and spark.conf.get(conf) == before
    counts = np.random.default_rng(3).integers(0, 50, 200_000)
    assert (set_join._ranks(counts) == np.unique(counts, return_inverse=True)[1]).all()
