"""Approximate nearest neighbours by learned partitions.

On a bounded sample, the graph of nearest neighbours is cut into balanced parts, so that neighbours
mostly share a part. A small network learns to tell from a vector the parts its neighbours lie in.
It assigns every vector of the table to its most probable part and routes each query to several
parts, whose vectors are then compared with the query by the exact measure.

Vectors of a part are dealt into blocks, as are the queries routed to it; a task compares one block
of queries with one block of vectors. Of equal vectors only those with the smallest ids can be
among the answers, so at most ``k + 1`` copies of a vector are indexed; equal queries are asked once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tipscope.session import materialize

#: Vectors the router learns from, edges of each, parts, parts a query is routed to.
SAMPLE, EDGES, PARTS, PROBES = 6_000, 10, 32, 24
HIDDEN, EPOCHS, BATCH, RATE, SEED = 128, 30, 128, 2e-3, 11
#: Vectors and queries of a block.
BLOCK_ROWS, BLOCK_QUERIES = 20_000, 2_000


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = np.asarray(vectors, float)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def neighbour_graph(unit: np.ndarray, edges: int) -> np.ndarray:
    """Indices of each vector's nearest others (rows x edges), in blocks."""
    edges = min(edges, len(unit) - 1)
    out = np.empty((len(unit), edges), np.int64)
    for at in range(0, len(unit), 1000):
        near = unit[at:at + 1000] @ unit.T
        near[np.arange(len(near)), np.arange(at, at + len(near))] = -np.inf
        out[at:at + 1000] = np.argpartition(-near, edges - 1, axis=1)[:, :edges]
    return out


def _bisect(graph: np.ndarray, members: np.ndarray, random) -> np.ndarray:
    """Side (0 or 1) of each member: halves by the second eigenvector of their graph, found by
    power iteration, then improved by exchanging the pairs that gain most."""
    place = np.full(len(graph), -1)
    place[members] = np.arange(len(members))
    to = place[graph[members]]
    source, target = np.nonzero(to >= 0)[0], to[to >= 0]
    degree = np.bincount(source, minlength=len(members)) + np.bincount(
        target, minlength=len(members)) + 1e-9
    root = np.sqrt(degree)
    x = random.normal(size=len(members))
    for _ in range(60):
        x -= root * (x @ root) / (root @ root)
        y = x / root
        y = (np.bincount(source, y[target], len(members))
             + np.bincount(target, y[source], len(members))) / root
        x = x + y
        x /= np.linalg.norm(x) + 1e-12
    side = np.zeros(len(members), np.int64)
    side[np.argsort(x / root, kind="stable")[len(members) // 2:]] = 1
    for _ in range(10):
        sign = 2.0 * side - 1.0
        pull = (np.bincount(source, sign[target], len(members))
                + np.bincount(target, sign[source], len(members)))
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        left = left[np.argsort(-pull[left], kind="stable")]
        right = right[np.argsort(pull[right], kind="stable")]
        n = min(len(left), len(right))
        gain = pull[left[:n]] - pull[right[:n]]
        swap = int((gain > 1.0).sum()) // 2
        if not swap:
            break
        side[left[:swap]], side[right[:swap]] = 1, 0
    return side


def balanced_parts(graph: np.ndarray, parts: int, seed: int = SEED) -> np.ndarray:
    """Part of each node: sizes differ by one at most in each halving; ``parts`` a power of two."""
    random = np.random.default_rng(seed)
    part = np.zeros(len(graph), np.int64)
    width = 1
    while width < parts:
        for k in range(width):
            members = np.flatnonzero(part == k)
            if len(members) > 1:
                part[members[_bisect(graph, members, random) == 1]] += width
        width *= 2
    return part


@dataclass
class Router:
    """Network of one hidden layer from unit vectors to parts."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def hidden(self, unit: np.ndarray) -> np.ndarray:
        return np.maximum(unit @ self.w1 + self.b1, 0.0)

    def logits(self, unit: np.ndarray) -> np.ndarray:
        return self.hidden(unit) @ self.w2 + self.b2

    def ranked(self, vectors: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` most probable parts of each vector, best first."""
        return np.argsort(-self.logits(_unit(vectors)), axis=1, kind="stable")[:, :n]


def fit_router(vectors: np.ndarray, *, parts: int = PARTS, edges: int = EDGES,
               seed: int = SEED) -> Router:
    """Graph, balanced parts, and a network trained on where each vector's neighbours lie."""
    random = np.random.default_rng(seed)
    width = vectors.shape[1]
    net = [random.normal(size=(width, HIDDEN)) * np.sqrt(2.0 / width), np.zeros(HIDDEN),
           random.normal(size=(HIDDEN, parts)) * np.sqrt(1.0 / HIDDEN), np.zeros(parts)]
    if len(vectors) <= parts:
        return Router(*net)
    unit = _unit(vectors)
    graph = neighbour_graph(unit, edges)
    part = balanced_parts(graph, parts, seed)
    goal = np.zeros((len(unit), parts))
    np.add.at(goal, (np.arange(len(unit))[:, None], part[graph]), 1.0)
    np.add.at(goal, (np.arange(len(unit)), part), 1.0)
    goal /= goal.sum(axis=1, keepdims=True)
    first, second = [np.zeros_like(w) for w in net], [np.zeros_like(w) for w in net]
    step = 0
    for _ in range(EPOCHS):
        order = random.permutation(len(unit))
        for at in range(0, len(unit), BATCH):
            rows = order[at:at + BATCH]
            x, router = unit[rows], Router(*net)
            h = router.hidden(x)
            z = h @ net[2] + net[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            error = (p / p.sum(axis=1, keepdims=True) - goal[rows]) / len(rows)
            back = (error @ net[2].T) * (h > 0)
            step += 1
            for k, grad in enumerate((x.T @ back, back.sum(0), h.T @ error, error.sum(0))):
                first[k] += 0.1 * (grad - first[k])
                second[k] += 0.001 * (grad * grad - second[k])
                net[k] -= RATE * (first[k] / (1 - 0.9 ** step)) / (
                    np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return Router(*net)


def _routed(router, probes: int, keep: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                ranked = router.value.ranked(np.stack(batch["vector"].to_numpy()), probes)
                out = batch[keep].loc[batch.index.repeat(ranked.shape[1])]
                yield out.assign(part=ranked.ravel())
    return run


def cosines(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Cosine of one vector and each of many, in double precision; equal vectors give equal values
    whatever stands beside them."""
    return (many * one).sum(axis=1) / (
        np.sqrt((one * one).sum()) * np.sqrt((many * many).sum(axis=1)))


FOUND = "query long, vec_id long, score double"


def _compare(k: int):
    """Best ``k`` of a block of vectors for each query of a block."""
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows):
            ids, vectors = rows["vec_id"].to_numpy(), np.stack(rows["vector"].to_numpy()).astype(float)
            unit = _unit(vectors)
            asked = np.stack(queries["vector"].to_numpy()).astype(float)
            for at in range(0, len(asked), 200):
                rough = _unit(asked[at:at + 200]) @ unit.T
                edge = (np.partition(rough, -k, axis=1)[:, -k] if len(ids) > k
                        else np.full(len(rough), -np.inf))
                for i, query in enumerate(queries["query"].to_numpy()[at:at + 200]):
                    near = np.flatnonzero(rough[i] >= edge[i] - 1e-9)
                    score = cosines(asked[at + i], vectors[near])
                    best = np.lexsort((ids[near], -score))[:k]
                    out.append((np.full(len(best), query), ids[near][best], score[best]))
        if not out:
            return pd.DataFrame(columns=["query", "vec_id", "score"])
        return pd.DataFrame(dict(zip(("query", "vec_id", "score"), map(np.concatenate, zip(*out)))))
    return run


def _best(rows: DataFrame, by: str, k: int) -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.col("score").desc(), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                          F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
    rows = rows.where(F.coalesce(finite, F.lit(False)) & F.exists("vector", lambda x: x != 0.0))
    return rows


def _search(queries: DataFrame, index: DataFrame, router, probes: int, k: int) -> DataFrame:
    """Best ``k`` (query, vec_id, score) among the ``probes`` most probable parts."""
    asked = queries.mapInPandas(_routed(router, probes, ["query", "vector"]),
                                "query long, vector array<double>, part int")
    # How many blocks each part needs; one row for each part.
    counted = {row["part"]: row["n"] for row in index.groupBy("part").count().withColumnRenamed(
        "count", "n").collect()}
    ways = max(1, -(-max(counted.values(), default=1) // BLOCK_ROWS))
    turns = max(1, -(-queries.count() * probes // (max(1, len(counted)) * BLOCK_QUERIES)))
    row_block, query_block = F.pmod(F.xxhash64("vec_id"), F.lit(ways)), F.pmod(
        F.xxhash64("query"), F.lit(turns))
    rows = index.withColumn("row_block", row_block).withColumn("query_block", F.explode(
        F.sequence(F.lit(0).cast("long"), F.lit(turns - 1).cast("long"))))
    asked = asked.withColumn("query_block", query_block).withColumn("row_block", F.explode(
        F.sequence(F.lit(0).cast("long"), F.lit(ways - 1).cast("long"))))
    key = ["part", "row_block", "query_block"]
    found = asked.groupBy(*key).cogroup(rows.groupBy(*key)).applyInPandas(_compare(k), FOUND)
    return _best(found.distinct(), "query", k).drop("rank")


def nearest(vectors: DataFrame, is_query: Column, *, k: int = 5, parts: int = PARTS,
            probes: int = PROBES, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest by cosine that the routed parts hold.

    ``vectors`` has vec_id and embedding; ``is_query`` picks the queries among its rows. Candidates
    are all rows but those with the query's own id. The router is fitted on ``sample`` different
    vectors chosen by hash; every row is indexed. A query for which the routed parts hold fewer
    than ``k`` candidates is asked of all parts. Runs jobs while it is built.
    Defined cases: vectors that are null, zero, or hold a null or non-finite component take no
    part, nor do rows with a null vec_id, nor vectors whose length is not the table's most frequent
    one (the shorter on a tie); equal rows count once, and rows with one id and several vectors are
    candidates each but asked as one query, by the smallest vector; ties go to the smaller vec_id;
    an empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    width = rows.groupBy(F.size("vector").alias("d")).count().orderBy(
        F.col("count").desc(), "d").limit(1).collect()
    empty = "query_id long, rank int, vec_id long, score double"
    if not width:
        return spark.createDataFrame([], empty)
    rows = rows.where(F.size("vector") == width[0]["d"])
    # 128 bits name a vector; windows keep the first k + 1 of equal ones before any shuffle.
    same = Window.partitionBy(F.xxhash64("vector"), F.xxhash64("vector", F.lit(1))).orderBy("vec_id")
    copies = rows.withColumn("copy", F.dense_rank().over(same)).where(F.col("copy") <= k + 1).distinct()
    kept = materialize(copies, "vectors")
    learned = kept.where("copy = 1").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select(
        "vector").toPandas()["vector"]
    router = spark.sparkContext.broadcast(fit_router(np.stack(learned.to_numpy()), parts=parts))
    index = materialize(kept.mapInPandas(
        _routed(router, 1, ["vec_id", "vector"]), "vec_id long, vector array<double>, part int"),
        "parts")

    wanted = rows.where(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    wanted = wanted.withColumn("h1", F.xxhash64("vector")).withColumn(
        "h2", F.xxhash64("vector", F.lit(1)))
    asked = wanted.groupBy("h1", "h2").agg(
        F.min("vec_id").alias("query"), F.first("vector").alias("vector"), F.count("*").alias("n"))
    asked = materialize(asked, "queries")
    queries = asked.select("query", "vector")
    found = materialize(_search(queries, index, router, probes, k + 1), "found")
    short = queries.join(found.groupBy("query").count().where(F.col("count") > k), "query",
                         "left_anti")
    if not short.isEmpty():
        short = materialize(short, "short")
        found = found.join(short, "query", "left_anti").unionByName(
            _search(short, index, router, parts, k + 1))
    members = wanted.select("vec_id", "h1", "h2").join(
        asked.select("h1", "h2", "query"), ["h1", "h2"]).select(
        F.col("vec_id").alias("query_id"), "query")
    answers = members.join(found, "query").where(F.col("query_id") != F.col("vec_id")).select(
        "query_id", "vec_id", "score").distinct()
    return _best(answers, "query_id", k).select("query_id", "rank", "vec_id", "score")
