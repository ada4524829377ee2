"""Exact Jaccard join of shingle sets with set-relation skipping.

Texts with equal sets form a class and take part once. A set's shingles are ordered by rarity; two
sets that are similar enough share one of their first shingles (the prefix), so an inverted index
of prefixes finds all partners. Two kinds of work are skipped:

* Blocks of index lists, by position. An entry knows its shingle's place in the set's order and
  the set's size; two entries whose places leave too few shingles for the overlap can't be partners.
  Lists are cut into blocks by size and place, and pairs of blocks that can't meet are never opened.
* Answers that follow from a similar set's answers. In each list the sets are first compared with
  one pivot. Sets found similar to it share its component, so pairs among them need no comparison:
  what remains are pairs of entries whose sets are not connected yet. A large family of near copies
  costs about one comparison for each member, not one for each pair.

Before two whole sets meet, their sketches do: counts of their shingles in a fixed number of cells.
The smaller counts of each cell add up to the largest overlap there can be, so pairs that fall short
of the line are settled without moving a set.

The order of shingles comes from a table of counts of fixed size (shingles hashed to buckets). Any
one order gives exact results; rarity only makes lists short.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tipscope.llm.common import GOLDEN, WordKeys, lower_ascii_words, mix
from tipscope.llm.components import connected
from tipscope.operators.skew import skew_join
from tipscope.session import materialize, release

WORDS, PERCENT = 5, 80
#: Buckets of the table of counts, a power of two: four bytes each, whatever the corpus.
SKETCH_BITS = 20
#: Bits of the filter that keeps texts out of a reread: its size is fixed. Where very many texts are
#: wanted it lets more of the others through, which costs time and changes no result.
FILTER_BITS = 23
#: Cells of a set's sketch and the largest count one holds (two bytes).
CELLS, FULL = 256, 65535
#: Rows of an Arrow batch, and words whose hashes a task remembers.
BATCH_ROWS, KNOWN_WORDS = 1000, 1 << 17
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
# Entries of a block: size bands are steps of the similarity, place bands this share of the size.
PLACE_BANDS = 16


def shingle_set(text: str | None, words: int, known: WordKeys) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words are one shingle."""
    keys = known.array(lower_ascii_words(text))
    if not len(keys):
        return keys
    n = max(1, len(keys) - words + 1)
    out = np.full(n, len(keys[:words]), np.uint64)
    for i in range(min(words, len(keys))):
        out = mix(out * GOLDEN + keys[i:i + n])
    return np.unique(out)


def _class_id(keys: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(keys.tobytes()) if len(keys) else None


def _summaries(words: int):
    """Rows (doc_id, class, n) of documents and rows (bucket, count) of this task's shingles."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, counts = WordKeys(KNOWN_WORDS), np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            sets = [shingle_set(t, words, known) for t in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64"), "digest": batch["digest"],
                "class": [_class_id(s) for s in sets],
                "n": np.array([len(s) for s in sets], np.int64), "bucket": -1})
            if sets:
                every = np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)
                counts += np.bincount(every.astype(np.int64), minlength=len(counts))
        used = np.flatnonzero(counts)
        for part in np.array_split(used, max(1, len(used) // 50_000)):
            yield pd.DataFrame({"doc_id": pd.array([None] * len(part), "Int64"), "digest": None,
                                "class": None,
                                "n": counts[part], "bucket": part})
    return run


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All (at, n) of a task in one row of two packed arrays: the driver gets bytes, not rows."""
    parts = list(batches)
    if parts:
        whole = pd.concat(parts).sort_values("at")
        at, n = whole["at"].to_numpy().astype("<u4"), whole["n"].to_numpy().astype("<i8")
        yield pd.DataFrame({"at": [zlib.compress(np.diff(at, prepend=at[:1]).tobytes(), 1)],
                            "first": at[:1].astype(np.int64),
                            "n": [zlib.compress(n.tobytes(), 1)]})


def _gathered(rows: DataFrame, size: int) -> np.ndarray:
    """Numbers ``n`` at places ``at`` of a table of fixed ``size``; 0 elsewhere."""
    out = np.zeros(size, np.int64)
    for row in rows.mapInPandas(_packed, "at binary, first long, n binary").collect():
        steps = np.frombuffer(zlib.decompress(row["at"]), "<u4")
        out[row["first"] + steps.cumsum(dtype=np.int64)] = np.frombuffer(
            zlib.decompress(row["n"]), "<i8")
    return out


def _ranks(counts: np.ndarray) -> np.ndarray:
    """Place of each count among the different counts, without arrays of indices beside it."""
    levels, out = np.unique(counts), np.empty(len(counts), np.int32)
    for start in range(0, len(counts), 1 << 16):
        part = slice(start, start + (1 << 16))
        out[part] = np.searchsorted(levels, counts[part])
    return out


def _filter_of(ids: DataFrame, column: str):
    """Broadcast Bloom filter of a long column, by two stretches of its hash."""
    mask, h = (1 << FILTER_BITS) - 1, F.xxhash64(column)
    place = F.explode(F.array(h.bitwiseAND(F.lit(mask)),
                              F.shiftrightunsigned(h, FILTER_BITS).bitwiseAND(F.lit(mask))))
    words = ids.select(place.alias("place")).groupBy(
        F.floor(F.col("place") / 64).alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(pmod(place, 64) AS INT))")).alias("n"))
    bits = _gathered(words, 1 << (FILTER_BITS - 6)).view(np.uint64)
    return ids.sparkSession.sparkContext.broadcast(bits)


def _wanted(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    found = np.ones(len(hashes), bool)
    for shift in (0, FILTER_BITS):
        place = (hashes >> np.uint64(shift)) & np.uint64((1 << FILTER_BITS) - 1)
        found &= (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))
                  & np.uint64(1)).astype(bool)
    return found


def _prefixes(words: int, percent: int, order):
    """Index entries (class, n, place, shingle) of each set's prefix."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, seen, counts = WordKeys(KNOWN_WORDS), set(), order.value
        for batch in batches:
            entries = []
            for text in batch["text"]:
                keys = shingle_set(text, words, known)
                name = _class_id(keys)
                if name is None or name in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(name)
                n = len(keys)
                first = n - -(-percent * n // 100) + 1
                rarity = counts[(keys >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                chosen = keys[np.lexsort((keys, rarity))[:first]]
                entries.append((name, n, chosen.view(np.int64)))
            if entries:
                sizes = [len(e[2]) for e in entries]
                yield pd.DataFrame({
                    "class": np.repeat(np.array([e[0] for e in entries], object), sizes),
                    "n": np.repeat([e[1] for e in entries], sizes),
                    "place": np.concatenate([np.arange(s) for s in sizes]),
                    "shingle": np.concatenate([e[2] for e in entries])})
    return run


def _sets(words: int, bits):
    """(class, keys) of the texts whose id hash the filter lets through."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordKeys(KNOWN_WORDS)
        for batch in batches:
            chosen = batch["text"][_wanted(batch["h"].to_numpy().view(np.uint64), bits.value)]
            sets = [shingle_set(t, words, known) for t in chosen]
            if sets:
                yield pd.DataFrame({"class": [_class_id(s) for s in sets],
                                    "n": [len(s) for s in sets],
                                    "sketch": [_sketch(s) for s in sets],
                                    "keys": [s.view(np.int64) for s in sets]})
    return run


def _sketch(keys: np.ndarray) -> bytes:
    cells = np.bincount((keys & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
    return np.minimum(cells, FULL).astype("<u2").tobytes()


def _most(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs with ``most``, the largest overlap that their sketches leave room for."""
    for batch in batches:
        one, two = (np.frombuffer(b"".join(batch[c]), "<u2").reshape(-1, CELLS)
                    for c in ("sketch_a", "sketch_b"))
        smaller = np.minimum(one, two)
        room = np.minimum(batch["na"], batch["nb"]).to_numpy()
        # Cells full in both sets tell nothing.
        most = np.where((smaller == FULL).any(axis=1), room, smaller.sum(axis=1, dtype=np.int64))
        yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "total": batch["na"] + batch["nb"],
                            "most": most})


def _met(bits):
    """Index entries whose shingle's hash the filter lets through."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[_wanted(batch["h"].to_numpy().view(np.uint64), bits.value)].drop(columns="h")
    return run


def needed(na: Column, nb: Column, percent: int) -> Column:
    """Smallest overlap with 100 * overlap >= percent * union."""
    return F.ceil(F.lit(percent) * (na + nb) / F.lit(100 + percent) - 1e-9)


def may_link(na: Column, pa: Column, nb: Column, pb: Column, percent: int) -> Column:
    """Whether a first common shingle at places pa and pb leaves enough shingles behind it."""
    return F.least(na - pa, nb - pb) >= needed(na, nb, percent)


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Similarity (common, whole) of the pairs (a, b) of classes, by their whole sets."""
    one = sets.select(F.col("class").alias("a"), F.col("keys").alias("keys_a"))
    two = sets.select(F.col("class").alias("b"), F.col("keys").alias("keys_b"))
    common = F.size(F.array_intersect("keys_a", "keys_b"))
    whole = F.size("keys_a") + F.size("keys_b") - common
    return pairs.join(two, "b").join(one, "a").select(
        "a", "b", common.alias("common"), whole.alias("whole")).distinct()


def _bounded(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, total, most): sizes together and the largest possible overlap of each pair."""
    one = sets.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sketch_a"))
    two = sets.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sketch_b"))
    return pairs.join(two, "b").join(one, "a").mapInPandas(
        _most, "a binary, b binary, total long, most long").distinct()


def _distances(common: Column, whole: Column, percent: int, exact: bool) -> list[Column]:
    """Whether a pair links, and the least and the largest distance it can have."""
    least = 1.0 - common / whole
    links = common * 100 >= whole * percent
    return [links.alias("links"), least.alias("least"),
            (least if exact else F.lit(1.0)).alias("largest")]


def _cross_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs of entries of one list that may link and whose sets are not yet connected.

    ``entries``: shingle, class, n, place, label and, where the set was compared with the list's
    pivot, bounds of its distance from it (equal where it is known). Jaccard distance is a metric,
    so two sets whose distances from one pivot differ by more than the largest distance of a link
    can't link. Blocks are (shingle, size band, place band, whether the label is the list's
    smallest); pairs of blocks are checked on their extremes first.
    """
    ends = entries.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    mixed = entries.join(ends.where(F.col("low") < F.col("high")), "shingle")
    band = F.floor(F.log("n") / F.log(F.lit(100.0 / percent))).cast("int")
    reach = F.floor(F.col("place") * F.lit(PLACE_BANDS * 100.0) / (F.col("n") * (100 - percent) + 100))
    mixed = mixed.select("shingle", "class", "n", "place", "label", "least", "largest", band.alias("band"),
                         reach.cast("int").alias("reach"), (F.col("label") == F.col("low")).alias("main"))
    block = ["shingle", "band", "reach", "main"]
    blocks = mixed.groupBy(*block).agg(
        F.min("n").alias("n_min"), F.max("n").alias("n_max"), F.min("place").alias("first"),
        F.min("label").alias("low"), F.max("label").alias("high"))
    mate = blocks.select("shingle", *[F.col(c).alias(f"{c}_b") for c in blocks.columns[1:]])
    same = (F.col("low") == F.col("high")) & (F.col("low_b") == F.col("high_b")) & (
        F.col("low") == F.col("low_b"))
    in_order = F.struct("band", "reach", "main") <= F.struct("band_b", "reach_b", "main_b")
    # The largest overlap two blocks can have against the smallest that their sizes ask for.
    most = F.least(F.col("n_max") - F.col("first"), F.col("n_max_b") - F.col("first_b"))
    opened = blocks.join(mate, "shingle").where(
        in_order & ~same & (most >= needed(F.col("n_min"), F.col("n_min_b"), percent))
    ).select(*block, "band_b", "reach_b", "main_b")
    left = mixed.select(*block, F.col("class").alias("a"), F.col("n").alias("na"),
                        F.col("place").alias("pa"), F.col("label").alias("la"), F.col("least").alias("least_a"),
                        F.col("largest").alias("largest_a"))
    right = mixed.select("shingle", F.col("band").alias("band_b"), F.col("reach").alias("reach_b"),
                         F.col("main").alias("main_b"), F.col("class").alias("b"),
                         F.col("n").alias("nb"), F.col("place").alias("pb"), F.col("label").alias("lb"),
                         F.col("least").alias("least_b"), F.col("largest").alias("largest_b"))
    apart = F.greatest(F.col("least_a") - F.col("largest_b"), F.col("least_b") - F.col("largest_a")) > (
        1.0 - percent / 100.0) + 1e-9
    pairs = left.join(opened, block).join(right, ["shingle", "band_b", "reach_b", "main_b"]).where(
        (F.col("la") != F.col("lb")) & ~F.coalesce(apart, F.lit(False))
        & may_link(F.col("na"), F.col("pa"), F.col("nb"), F.col("pb"), percent))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of few texts or sets: each batch is held several times, on both sides."""
    before = spark.conf.get(_BATCH_CONF)
    spark.conf.set(_BATCH_CONF, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_CONF, before)


def jaccard_components(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT,
                       digests: bool = False) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of ``docs`` (doc_id, text).

    With ``digests`` also the digest of each text and the root of its component, which tell rows and
    components apart that share an id.

    Shingles are runs of ``words`` words with A-Z lower-cased (a text with fewer words is one
    shingle); two texts link when 100 * intersection >= ``percent`` * union. component_id is the
    smallest doc_id reachable by links. Runs jobs while it is built.
    Defined cases: a null text, or one without words, has the empty set and links with nothing;
    repeated rows and other copies of a set share a class; a row with a null id can't name a
    component: it links with nothing, comes back with its n_shingles and a null component_id; an
    empty table gives no rows; other columns are ignored.
    """
    with _small_batches(docs.sparkSession):
        return _components(docs, words, percent, digests)


def _components(docs: DataFrame, words: int, percent: int, digests: bool) -> DataFrame:
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.col("text").cast("string").alias("text"))
    digest = _digest("text") if digests else F.lit(None).cast("binary")
    summaries = materialize(texts.withColumn("digest", digest).mapInPandas(
        _summaries(words), "doc_id long, digest binary, class binary, n long, bucket long"), "sets")
    rows = summaries.where("bucket < 0").drop("bucket")
    counts = summaries.where("bucket >= 0").groupBy(F.col("bucket").alias("at")).agg(
        F.sum("n").alias("n"))
    # Ranks instead of counts: only the order matters, and 32 bits hold it at any scale.
    order = spark.sparkContext.broadcast(_ranks(_gathered(counts, 1 << SKETCH_BITS)))

    named = texts.where(F.col("doc_id").isNotNull())
    index = materialize(named.mapInPandas(
        _prefixes(words, percent, order), "class binary, n long, place int, shingle long"), "index")
    order.destroy()  # what it helped to make is stored
    # A list of two entries holds one pair: sizes and places tell whether it may link at all.
    lists = index.groupBy("shingle").agg(
        F.count("*").alias("k"), F.min("n").alias("n1"), F.max("n").alias("n2"),
        F.min(F.col("n") - F.col("place")).alias("rest"))
    alive = (F.col("k") > 2) | (
        (F.col("k") == 2) & (F.col("rest") >= needed(F.col("n1"), F.col("n2"), percent)))
    often = materialize(lists.where(alive).select("shingle"), "often")
    bits = _filter_of(often, "shingle")
    met = index.withColumn("h", F.xxhash64("shingle")).mapInPandas(_met(bits), index.schema)
    found = materialize(met.join(often, "shingle").distinct(), "entries")
    bits.destroy()
    release(index, often)
    pivots = found.groupBy("shingle").agg(F.min(F.struct("place", "n", "class")).alias("pivot"))
    entries = materialize(found.join(pivots, "shingle"), "lists")
    release(found)

    classes = rows.where(F.col("doc_id").isNotNull() & F.col("class").isNotNull()).groupBy(
        "class").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("members"))

    def compared(pairs: DataFrame, label: str) -> DataFrame:
        """(a, b, links, least, largest) of the pairs: sketches first, then sets of what is open.

        Only the texts that the pairs name are made into sets again.
        """
        pairs = materialize(pairs.distinct(), f"{label}-pairs")
        named_class = pairs.select(F.col("a").alias("class")).unionByName(
            pairs.select(F.col("b").alias("class"))).distinct()
        bits = _filter_of(classes.join(named_class, "class", "left_semi").select("first_id"),
                          "first_id")
        schema = "class binary, n long, sketch binary, keys array<long>"
        sets = materialize(
            named.select("text", F.xxhash64("doc_id").alias("h"))
            .mapInPandas(_sets(words, bits), schema), f"{label}-sets")
        bits.destroy()
        bounds = materialize(_bounded(pairs, sets), f"{label}-bounds")
        spare = F.col("total") - F.col("most")
        open_ = F.col("most") * 100 >= spare * percent
        rest = bounds.where(open_).select("a", "b")
        ends = rest.select(F.explode(F.array("a", "b")).alias("class")).distinct()
        bits = _filter_of(ends, "class")
        asked = sets.select("class", "keys", F.xxhash64("class").alias("h")).mapInPandas(
            _met(bits), "class binary, keys array<long>")
        settled = bounds.where(~open_).select(
            "a", "b", *_distances(F.col("most"), spare, percent, exact=False))
        exact = _compared(rest, asked).select(
            "a", "b", *_distances(F.col("common"), F.col("whole"), percent, exact=True))
        answers = materialize(exact.unionByName(settled), label)
        bits.destroy()
        release(pairs, sets, bounds)
        return answers

    pivot = F.col("pivot")
    near_pivot = entries.where((F.col("class") != pivot["class"]) & may_link(
        F.col("n"), F.col("place"), pivot["n"], pivot["place"], percent))
    ends = [F.least(F.col("class"), pivot["class"]).alias("a"),
            F.greatest(F.col("class"), pivot["class"]).alias("b")]
    answers = compared(near_pivot.select(*ends), "answers")
    links = answers.where("links").select("a", "b")
    stars = connected(links)
    distances = answers.select("a", "b", "least", "largest")
    labelled = (
        entries.select("*", *ends).join(distances, ["a", "b"], "left")
        .join(stars, F.col("class") == F.col("node"), "left")
        .select("shingle", "class", "n", "place", F.coalesce("root", "class").alias("label"),
                *[F.when(F.col("a") == F.col("b"), 0.0).otherwise(F.col(c)).alias(c)
                  for c in ("least", "largest")])
    )
    labelled = materialize(labelled, "labelled")
    release(entries)
    more = compared(_cross_pairs(labelled, percent), "more").where("links").select("a", "b")
    release(labelled)
    nodes = stars if more.isEmpty() else connected(links.unionByName(more))

    rooted = classes.join(nodes, F.col("class") == F.col("node"), "left").select(
        "class", "first_id", F.coalesce("root", "class").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named_class = rooted.join(smallest, "root").select("class", "component_id", "root")
    keyed = rows.withColumn("class", F.when(F.col("doc_id").isNotNull(), F.col("class")))
    joined = skew_join(keyed, named_class, "class", spread_by=["doc_id"])
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(
        F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        *(["digest", "root"] if digests else []))


def _digest(column: str) -> Column:
    return F.unhex(F.md5(column))


def keep_first(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each component, that of the smallest doc_id, with all columns of ``docs``.

    Runs jobs while it is built. Defined cases: rows with a null id stay, since nothing links with
    them; so do null texts and texts without words, but equal rows of an id and text leave one (of
    rows that differ elsewhere the one whose hash of all columns is smallest); where rows of one
    component share the smallest id, the text with the smallest digest stays; an empty table gives
    none; other columns may have any name.
    """
    found = jaccard_components(docs.select("doc_id", "text"), words=words, percent=percent,
                               digests=True)
    first = found.where(F.col("component_id") == F.col("doc_id"))
    # A component has one row; texts without words have no root and stay by themselves.
    alone = first.where(F.col("root").isNull()).select("doc_id", "digest")
    chosen = first.where(F.col("root").isNotNull()).groupBy("root").agg(
        F.min(F.struct("doc_id", "digest")).alias("_first")).select("_first.*")
    kept = alone.unionByName(chosen).select(
        "doc_id", F.coalesce("digest", F.lit(b"")).alias("digest")).distinct()
    columns = [F.col(f"`{c}`") for c in docs.columns]
    hashed = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind]  # maps have none
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                         F.coalesce(_digest("text"), F.lit(b"")).alias("digest"),
                         F.xxhash64(*hashed).alias("_h"), F.struct(*columns).alias("_row"))
    named = packed.join(kept, ["doc_id", "digest"], "left_semi")
    once = named.groupBy("doc_id", "digest").agg(F.min_by("_row", "_h").alias("_row"))
    return once.unionByName(packed.where(F.col("doc_id").isNull()).select(
        "doc_id", "digest", "_row")).select("_row.*")
