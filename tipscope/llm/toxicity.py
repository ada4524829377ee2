"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

A text becomes a fixed row of numbers: densities of lexicon words by kind, how near they stand to a
second person, capitals, punctuation, and how many words are spelled to be read past (``1d10t``,
``i.d.i.o.t``, ``id*ot``, ``idiooot``). Beside the given lexicon one is learned: words, and beginnings of
words, that labelled toxic texts use far more often than others. Tasks compute the rows of whole texts.
Trees are grown in numpy on the rows of a bounded sample of labelled texts; isotonic regression on
scores that the trees of other folds gave turns them into probabilities. A labelled text never meets
a learned lexicon that its own fold taught.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipscope.llm.common import id_remainder
from tipscope.session import materialize

# Common words of abuse by kind, in English, German, French and Spanish.
LEXICON = {
    "insult": """idiot idiots idiotic moron morons moronic stupid dumb dumbass fool fools foolish
        imbecile imbeciles cretin dimwit halfwit nitwit clown clowns loser losers jerk jerks freak
        coward cowards liar bastard bastards bitch bitches asshole assholes dickhead wanker twat
        retard retarded lunatic creep creeps pig pigs dummkopf trottel vollidiot arschloch schlampe
        blödmann schwachkopf connard connasse abruti imbécile crétin salaud gilipollas imbécil
        cabrón estúpido pendejo tonto""",
    "contempt": """trash garbage scum vermin filth filthy pathetic worthless useless disgusting
        repulsive despicable hideous ugly vile sickening revolting laughable ridiculous shameful
        miserable abomination parasite parasites subhuman savages abschaum ekelhaft widerlich
        wertlos dégueulasse ordure minable asqueroso basura escoria patético""",
    "threat": """kill killed murder strangle stab shoot punch beat destroy suffer burn hang hurt
        perish regret umbringen verrecken crève matar""",
    "profanity": """damn hell crap shit shitty bullshit fuck fucked fucking fucker piss pissed
        bloody scheiße scheisse verdammt merde putain mierda joder""",
    "hate": """hate hates hated despise loathe detest hasse déteste odio""",
}
# The second person, and letters that stand for others.
SECOND_PERSON = frozenset("""you your yours yourself yourselves ur u youre ya du dich dir dein deine
    deiner euch euer eure vous vos votre toi tes ton tu tú te ti tus usted ustedes vosotros""".split())
LOOK_ALIKE = str.maketrans("013457@$!|", "oieastasil")
KINDS = tuple(LEXICON)
KIND_OF = {word: k for k, words in enumerate(LEXICON.values()) for word in words.split()}
#: How many words away a second person still counts as near; lengths of learned beginnings.
NEAR, BEGINNINGS = 5, (3, 4, 5, 6, 7)

FEATURES = (
    *[f"{kind}_density" for kind in KINDS], *[f"{kind}_count" for kind in KINDS],
    "kinds", "distinct_hits", "hit_density", "near_second_person", "second_person_distance",
    "second_person_density", "obfuscated_density", "obfuscated_count", "masked_density",
    "stretched_density", "upper_share", "caps_word_share", "punctuation_share",
    "exclamation_density", "question_density", "repeated_mark_density", "symbol_share",
    "digit_share", "mean_word_chars", "log_words",
    "learned_count", "learned_distinct", "learned_density", "learned_most", "learned_sum",
    "learned_near_second_person",
)

_WORDS = re.compile(r"[^\W_]+").findall
_CAPS = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{3,}\b").findall
_MARKS = re.compile(r"[!?]{2,}").findall
_STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
#: A word with a look-alike or a mask between or after letters; letters dealt out by one mark each.
_MIXED = re.compile(r"(?<![^\W_])(?=[^\W_]*[013457@$!|*])[^\W_@$!|*]*[^\W\d_@$!|*][\w@$!|*]*[^\W_@$]"
                    ).findall
_SPELLED = re.compile(r"(?<![^\W_])(?:[^\W\d_]([.\-_* ]))(?:[^\W\d_]\1){2,}[^\W\d_](?![^\W_])"
                      ).finditer
_SYMBOLS = "#*$%&|<>"


def _masked(word: str, by_shape: dict[tuple[int, str], list[str]]) -> int | None:
    """Kind of the one lexicon word that a word with ``*`` for letters may stand for."""
    for known in by_shape.get((len(word), word[:1]), ()):
        if all(a in ("*", b) for a, b in zip(word, known)):
            return KIND_OF[known]
    return None


_BY_SHAPE: dict[tuple[int, str], list[str]] = {}
for _word in KIND_OF:
    _BY_SHAPE.setdefault((len(_word), _word[0]), []).append(_word)


def word_terms(word: str) -> list[str]:
    """What of a word a lexicon may list: the word, and its beginnings, marked by ``*``."""
    return [word, *(word[:k] + "*" for k in BEGINNINGS if k < len(word))]


class Weights(dict):
    """Word -> weight of its heaviest term in a learned lexicon, 0 without one; remembered for at
    most ``limit`` words."""

    def __init__(self, terms: dict[str, float], limit: int = 300_000):
        super().__init__()
        self.terms, self.limit = terms, limit

    def __missing__(self, word: str) -> float:
        if len(self) > self.limit:
            self.clear()
        known = self.terms
        weight = self[word] = max(known.get(t, 0.0) for t in word_terms(word))
        return weight


def _gaps(places: list[int], persons: np.ndarray) -> np.ndarray:
    """Words from each place to the nearest second person."""
    at = np.array(places)
    right = np.searchsorted(persons, at)
    return np.minimum(np.abs(persons[np.minimum(right, len(persons) - 1)] - at),
                      np.abs(at - persons[np.maximum(right - 1, 0)]))


def features(text: str | None, weights: Weights) -> list[float]:
    """``FEATURES`` of a whole text; null and empty texts are all zeros."""
    text = text or ""
    low = text.lower()
    words = _WORDS(low)
    n, chars = max(len(words), 1), max(len(text), 1)
    at = [k for k, w in enumerate(words) if w in KIND_OF]
    counts = [0] * len(KINDS)
    for k in at:
        counts[KIND_OF[words[k]]] += 1
    learned = [k for k, w in enumerate(words) if weights[w]] if weights.terms else []
    heavy = [weights[words[k]] for k in learned]
    persons = np.array([k for k, w in enumerate(words) if w in SECOND_PERSON], np.int64)
    near, distance, learned_near = 0, 0.0, 0
    if at and len(persons):
        gaps = _gaps(at, persons)
        near, distance = int((gaps <= NEAR).sum()), 1.0 / (1.0 + float(gaps.min()))
    if learned and len(persons):
        learned_near = int((_gaps(learned, persons) <= NEAR).sum())
    obfuscated = masked = stretched = 0
    for word in _MIXED(low):
        if "*" in word:
            masked += _masked(word, _BY_SHAPE) is not None
        elif not word.isalpha() and word not in KIND_OF:
            obfuscated += word.translate(LOOK_ALIKE) in KIND_OF
    for found in _SPELLED(low):
        obfuscated += found[0].replace(found[1], "") in KIND_OF
    if _STRETCHED.search(low):
        for word in words:
            if word not in KIND_OF and _STRETCHED.search(word):
                stretched += any(_STRETCHED.sub(r"\1" * k, word) in KIND_OF for k in (1, 2))
    hidden = obfuscated + masked + stretched
    letters = sum(map(len, words))
    upper = sum(map(str.isupper, text)) if low != text else 0
    symbols = sum(map(text.count, _SYMBOLS))
    exclaims, questions = text.count("!"), text.count("?")
    points = sum(map(text.count, ".,;:'\"-()")) + exclaims + questions
    digits = sum(map(text.count, "0123456789"))
    hits = len(at) + hidden
    return [
        *[c / n for c in counts], *map(float, counts),
        float(sum(c > 0 for c in counts)), float(len({words[k] for k in at})), hits / n,
        near / n, distance, len(persons) / n, obfuscated / n, float(hidden), masked / n,
        stretched / n, upper / max(letters, 1), len(_CAPS(text)) / n if upper else 0.0,
        points / chars, exclaims / n, questions / n, len(_MARKS(text)) / n, symbols / chars,
        digits / chars, letters / n, float(np.log1p(len(words))),
        float(len(learned)), float(len({words[k] for k in learned})), len(learned) / n,
        max(heavy, default=0.0), sum(heavy), learned_near / n,
    ]


def feature_rows(texts: list[str | None], weights: Weights) -> np.ndarray:
    return np.array([features(t, weights) for t in texts], float).reshape(-1, len(FEATURES))


# Trees ------------------------------------------------------------------------------------------

@dataclass
class Tree:
    """Nodes as arrays: feature (-1: leaf), last bin that goes left, children, value of a leaf."""
    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self) -> int:
        for of_node, start in ((self.feature, -1), (self.bin, 0), (self.left, 0), (self.right, 0),
                               (self.value, 0.0)):
            of_node.append(start)
        return len(self.feature) - 1

    def predict(self, binned: np.ndarray) -> np.ndarray:
        feature, last = np.array(self.feature), np.array(self.bin)
        left, right, value = np.array(self.left), np.array(self.right), np.array(self.value)
        node, rows = np.zeros(len(binned), np.int64), np.arange(len(binned))
        while True:
            inner = feature[node] >= 0
            if not inner.any():
                return value[node]
            goes = binned[rows, np.maximum(feature[node], 0)] <= last[node]
            node = np.where(inner, np.where(goes, left[node], right[node]), node)


@dataclass
class Booster:
    edges: list[np.ndarray]
    start: float
    trees: list[Tree]

    def raw(self, rows: np.ndarray) -> np.ndarray:
        """Log odds before calibration."""
        binned = binned_rows(rows, self.edges)
        return self.start + sum((t.predict(binned) for t in self.trees), np.zeros(len(rows)))


def bin_edges(rows: np.ndarray, bins: int) -> list[np.ndarray]:
    """At most ``bins`` - 1 edges for each column: quantiles of its distinct values."""
    out = []
    for column in rows.T:
        values = np.unique(column)
        middles = (values[1:] + values[:-1]) / 2.0
        if len(middles) >= bins:
            middles = np.unique(np.quantile(values, np.arange(1, bins) / bins))
        out.append(middles)
    return out


def binned_rows(rows: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, c) for e, c in zip(edges, rows.T)], axis=1)


def _best_split(binned, grad, hess, rows, bins, l2, min_weight):
    """(gain, feature, last bin on the left) of the best split of the rows; None without one."""
    width = binned.shape[1]
    places = (binned[rows] + np.arange(width) * bins).ravel()
    g = np.bincount(places, np.repeat(grad[rows], width), width * bins).reshape(width, bins)
    h = np.bincount(places, np.repeat(hess[rows], width), width * bins).reshape(width, bins)
    gl, hl = g.cumsum(axis=1)[:, :-1], h.cumsum(axis=1)[:, :-1]
    gt, ht = g[0].sum(), h[0].sum()
    gr, hr = gt - gl, ht - hl
    gain = gl ** 2 / (hl + l2) + gr ** 2 / (hr + l2) - gt ** 2 / (ht + l2)
    gain[(hl < min_weight) | (hr < min_weight)] = -np.inf
    best = int(gain.argmax())
    if not gain.size or not gain.flat[best] > 1e-12:
        return None
    return float(gain.flat[best]), best // (bins - 1), best % (bins - 1)


def _grow(binned, grad, hess, bins, depth, rate, l2, min_weight) -> tuple[Tree, np.ndarray]:
    tree, out = Tree(), np.zeros(len(binned))
    todo = [(tree.add(), np.arange(len(binned)), 0)]
    while todo:
        node, rows, level = todo.pop()
        split = (_best_split(binned, grad, hess, rows, bins, l2, min_weight)
                 if level < depth else None)
        if split is None:
            tree.value[node] = -rate * grad[rows].sum() / (hess[rows].sum() + l2)
            out[rows] = tree.value[node]
            continue
        _, tree.feature[node], tree.bin[node] = split
        goes = binned[rows, tree.feature[node]] <= tree.bin[node]
        tree.left[node], tree.right[node] = tree.add(), tree.add()
        todo += [(tree.left[node], rows[goes], level + 1),
                 (tree.right[node], rows[~goes], level + 1)]
    return tree, out


def boost(rows: np.ndarray, labels: np.ndarray, weights: np.ndarray, *, rounds: int = 120,
          rate: float = 0.1, depth: int = 3, bins: int = 64, l2: float = 1.0,
          min_weight: float = 0.5) -> Booster:
    """Trees on the logistic loss: second-order gains over binned columns."""
    edges = bin_edges(rows, bins)
    binned = binned_rows(rows, edges)
    share = min(max(np.average(labels, weights=weights), 1e-6), 1 - 1e-6)
    start = float(np.log(share / (1 - share)))
    score, trees = np.full(len(rows), start), []
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-score))
        tree, step = _grow(binned, weights * (p - labels), weights * p * (1 - p), bins, depth, rate,
                           l2, min_weight)
        trees.append(tree)
        score += step
    return Booster(edges, start, trees)


def isotonic(scores: np.ndarray, labels: np.ndarray,
             weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(score, rate): the closest rates that never fall as scores rise, by pooling neighbours."""
    values, place = np.unique(scores, return_inverse=True)
    w = np.bincount(place, weights)
    y = np.bincount(place, weights * labels) / w
    blocks: list[list[float]] = []  # rate, weight, first and last place
    for k in range(len(values)):
        blocks.append([y[k], w[k], k, k])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            rate, weight, _, last = blocks.pop()
            before = blocks[-1]
            before[0] = (before[0] * before[1] + rate * weight) / (before[1] + weight)
            before[1] += weight
            before[3] = last
    ends = [(values[int(k)], rate) for rate, _, first, last in blocks
            for k in dict.fromkeys((first, last))]
    return np.array([e[0] for e in ends]), np.array([e[1] for e in ends])


# Spark ------------------------------------------------------------------------------------------

#: Labelled rows of each class to learn from, at most, and folds of the calibration.
SAMPLE_ROWS, FOLDS = 5_000, 5
#: Terms of the learned lexicon at most; toxic texts that a term needs; least cautious log odds.
LEXICON_TERMS, TERM_TEXTS, TERM_ODDS = 20_000, 4, 1.0
#: Distinct terms that a counting task remembers before it hands them on.
REMEMBERED = 500_000


@dataclass
class Model:
    """Trees, calibration (raw score -> probability) and the learned lexicon."""
    booster: Booster | None
    points: tuple[np.ndarray, np.ndarray]
    terms: dict[str, float]

    def score(self, texts: list[str | None], weights: Weights | None = None) -> np.ndarray:
        if self.booster is None:
            return np.full(len(texts), float(self.points[1][0]))
        raw = self.booster.raw(feature_rows(texts, Weights(self.terms) if weights is None else weights))
        return np.clip(np.interp(raw, *self.points), 0.0, 1.0)


def calibrated(rows: np.ndarray, labels: np.ndarray, weights: np.ndarray, folds: np.ndarray,
               **options) -> tuple[Booster | None, tuple[np.ndarray, np.ndarray]]:
    """Trees on all rows, and the calibration of the scores that trees of the other folds give.

    Without rows of both classes there are no trees: one rate for all, one half without any rows.
    """
    if len(np.unique(labels)) < 2:
        rate = float(labels[0]) if len(labels) else 0.5
        return None, (np.zeros(1), np.array([rate]))
    apart = np.full(len(rows), np.nan)
    for fold in np.unique(folds):
        here = folds == fold
        if len(np.unique(labels[~here])) == 2:
            apart[here] = boost(rows[~here], labels[~here], weights[~here], **options).raw(rows[here])
    booster = boost(rows, labels, weights, **options)
    judged = ~np.isnan(apart)
    if len(np.unique(labels[judged])) < 2:  # too few rows to set any apart
        apart, judged = booster.raw(rows), np.ones(len(rows), bool)
    return booster, isotonic(apart[judged], labels[judged], weights[judged])


def learned_lexicons(terms: list[str], counts: np.ndarray,
                     texts: np.ndarray) -> list[dict[str, float]]:
    """For each fold the lexicon that the other folds teach, and last the one of all.

    ``counts`` has texts by term, fold and class, ``texts`` all texts by fold and class. A term's
    weight is its log odds between the classes less one standard error.
    """
    out = []
    for fold in (*range(counts.shape[1]), None):
        n, of_all = counts.sum(axis=1), texts.sum(axis=0).astype(float)
        if fold is not None:
            n, of_all = n - counts[:, fold], of_all - texts[fold]
        rest = n + 0.5
        weight = (np.log(rest[:, 1] / rest[:, 0] * (of_all[0] + 1) / (of_all[1] + 1))
                  - np.sqrt((1.0 / rest).sum(axis=1)))
        good = (n[:, 1] >= TERM_TEXTS) & (weight >= TERM_ODDS)
        out.append({terms[k]: float(weight[k]) for k in np.flatnonzero(good)})
    return out


def training_rows(docs: DataFrame, labels: DataFrame, label: str, *, parts: int, apart: int,
                  rows: int) -> DataFrame:
    """(doc_id, text, label, weight, fold) of at most ``rows`` labelled texts of each class, chosen
    by a hash of the id, none with remainder ``apart``; a weight is how many rows of its class one
    stands for. Folds follow from the text, so copies share one."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"),
                          F.col(label).cast("int").alias("label"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)
                        & (id_remainder("doc_id", parts) != apart))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label")).withColumn(
        "_h", F.xxhash64("doc_id"))
    chosen = [known.where(F.col("label") == k).orderBy("_h", "doc_id").limit(rows) for k in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 x rows ids at most
    sizes = known.groupBy("label").agg(F.count("*").alias("_n")).withColumn(
        "weight", F.greatest(F.lit(1.0), F.col("_n") / F.lit(float(rows)))).drop("_n")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    fold = F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int")
    found = texts.join(ids, "doc_id").join(F.broadcast(sizes), "label")  # two rows
    # Of rows that share an id, one text teaches.
    return found.groupBy("doc_id", "label", "weight").agg(F.min("text").alias("text")).withColumn(
        "fold", fold)


def _terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many texts of each fold and class have a term."""
    def flush():
        return pd.DataFrame([(t, slot, n) for (t, slot), n in counts.items()],
                            columns=["term", "slot", "n"])

    counts: Counter = Counter()
    for batch in batches:
        for text, label, fold in zip(batch["text"], batch["label"], batch["fold"]):
            found = {t for w in set(_WORDS(text.lower())) for t in word_terms(w)}
            counts.update(zip(found, repeat(2 * int(fold) + int(label))))
            if len(counts) > REMEMBERED:
                yield flush()
                counts.clear()
    if counts:
        yield flush()


def term_counts(sample: DataFrame) -> DataFrame:
    """(term, counts) of the heaviest terms: texts by 2 x fold + class, each text once."""
    once = sample.groupBy("text", "fold").agg(F.max("label").alias("label"))
    slots = [F.sum(F.when(F.col("slot") == k, F.col("n")).otherwise(0)).alias(f"n{k}")
             for k in range(2 * FOLDS)]
    counted = once.mapInPandas(_terms, "term string, slot int, n long").groupBy("term").agg(*slots)
    toxic, other = (sum((F.col(f"n{2 * f + c}") for f in range(FOLDS)), F.lit(0.5))
                    for c in (1, 0))
    odds = F.log(toxic / other) - F.sqrt(1.0 / toxic + 1.0 / other)
    return counted.where(toxic >= TERM_TEXTS).orderBy(odds.desc(), "term").limit(
        LEXICON_TERMS).select("term", F.array(*[f"n{k}" for k in range(2 * FOLDS)]).alias("counts"))


def _vectors(lexicons):
    @F.pandas_udf("array<double>")
    def vector(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        weights = [Weights(terms) for terms in lexicons.value]
        for texts, folds in batches:
            yield pd.Series([features(t, weights[f]) for t, f in zip(texts, folds)], dtype=object)
    return vector


def train(docs: DataFrame, labels: DataFrame, label: str, *, parts: int, apart: int,
          rows: int = SAMPLE_ROWS, **options) -> Model:
    """Fit on the bounded sample. The driver gets ``FEATURES`` numbers for each of its texts and
    at most ``LEXICON_TERMS`` terms, tasks see the texts."""
    context = docs.sparkSession.sparkContext
    sample = materialize(training_rows(docs, labels, label, parts=parts, apart=apart, rows=rows),
                         "toxicity-sample")
    found = term_counts(sample).toPandas()
    counts = np.array([*map(list, found["counts"])], np.int64).reshape(-1, FOLDS, 2)
    texts = np.zeros((FOLDS, 2), np.int64)
    for r in sample.groupBy("fold", "label").agg(F.countDistinct("text").alias("n")).collect():
        texts[r["fold"], r["label"]] = r["n"]
    lexicons = learned_lexicons(found["term"].tolist(), counts, texts)
    shared = context.broadcast(lexicons[:-1])
    seen = sample.select("doc_id", "label", "weight", "fold",
                         _vectors(shared)("text", "fold").alias("features")).toPandas()
    shared.destroy()
    seen = seen.sort_values("doc_id")
    table = np.array([*map(list, seen["features"])], float).reshape(-1, len(FEATURES))
    booster, points = calibrated(table, seen["label"].to_numpy(float),
                                 seen["weight"].to_numpy(float), seen["fold"].to_numpy(), **options)
    return Model(booster, points, lexicons[-1])


def _scores(model):
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = model.value
        weights = Weights(known.terms)
        for texts in batches:
            yield pd.Series(known.score(texts.tolist(), weights), dtype=float)
    return score


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", *, parts: int = 4,
                    apart: int = 2, threshold: float = 0.3, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Probability of label 1 for each whole text of ``docs`` (doc_id, text).

    ``labels`` (doc_id, ``label`` of 0 or 1) teaches by rows whose remainder is not ``apart``; only
    the text enters a score. Runs jobs while it is built (sample and fit).
    Defined cases: a null or empty text is a row of zeros and scored as such; a null id counts as the
    empty text in the split and comes back null; repeated rows are scored each; an empty table gives
    no rows; labels other than 0 and 1 are ignored, an id with both counts as 1; without labels every
    score is one half, with one class its rate; other columns are ignored.
    """
    model = train(docs, labels, label, parts=parts, apart=apart, rows=rows)
    score = _scores(docs.sparkSession.sparkContext.broadcast(model))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (id_remainder("doc_id", parts) == apart).alias("held_out"),
        score(F.col("text").cast("string")).alias("score"),
    ).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int"))
