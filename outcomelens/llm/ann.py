"""Approximate nearest neighbours by a forest of random-projection trees.

A tree splits the vectors of a node by the hyperplane halfway between two
random members.  The forest's splits are fitted on a bounded sample
(``SAMPLE`` vectors, so its size is bounded too; the larger the table, the smaller
its leaves); then every vector is routed to its leaf in every tree.  A query walks
all trees through one shared priority queue ordered by the largest margin crossed on
the way, and opens leaves until they hold a share of the forest's places.  That share
is measured, not set: it is the least at which ``TARGET`` of the sample's own nearest
neighbours are found for ``PROBES`` of its vectors.  A margin is a lower bound of the
distance to all that lies behind it, so a query also ends, without loss, at the first
leaf behind a margin beyond its tenth distance within the sample.  Candidates of
opened leaves are ranked by exact distance in double precision on the original vectors.

Equal vectors are represented by their 11 smallest ids, which is exact: no
other copy can be among the 10 nearest of another row.  A leaf's rows are dealt
to as many blocks as the table is larger than the sample, so the rows handled
together do not grow with the table.

Defined cases: vectors that are null, of a length other than the commonest in
the sample, zero, or with a null or non-finite component take no part, neither
as queries nor as candidates; rows without vec_id take no part; a repeated vec_id with
equal vectors counts once, with different vectors its nearest counts; fewer candidates than
asked give fewer rows; an empty table gives an empty result.  Ties go to the smaller
vec_id.  Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from outcomelens.llm.common import written

TOP = 10
TREES = 10
LEAF = 160  # sample vectors in a leaf at most
SAMPLE = 20_000
LEAST_LEAF = 160  # and no less than this in a large table: smaller leaves give each query more lists to merge
TARGET = 0.95  # recall within the sample from which the share of opened places follows
PROBES = 100  # sample vectors it is measured on
BLOCK_ROWS = 4096


class Tree(NamedTuple):
    """Inner node i splits by normals[i] . x > offsets[i]; children >= 0 are nodes, else leaf -child - 1."""
    normals: np.ndarray
    offsets: np.ndarray
    children: np.ndarray  # (nodes, 2)
    sizes: np.ndarray  # of leaves, in the sample


def grow(x: np.ndarray, rng: np.random.Generator, leaf: int = LEAF) -> Tree:
    normals, offsets, children, sizes = [], [], [], []

    def place(rows: np.ndarray, depth: int) -> int:
        if len(rows) > leaf and depth < 60:
            for _ in range(5):
                a, b = x[rng.choice(rows, 2, replace=False)]
                normal = a - b
                length = np.linalg.norm(normal)
                if length == 0:
                    continue
                normal = normal / length
                offset = float(normal @ (a + b) / 2)
                side = x[rows] @ normal > offset
                if 0.02 < side.mean() < 0.98:
                    node = len(normals)
                    normals.append(normal)
                    offsets.append(offset)
                    children.append((0, 0))
                    children[node] = (place(rows[~side], depth + 1), place(rows[side], depth + 1))
                    return node
        sizes.append(len(rows))
        return -len(sizes)

    root = place(np.arange(len(x)), 0)
    d = x.shape[1]
    if root < 0:  # one leaf: a split that sends all to it
        return Tree(np.zeros((1, d)), np.zeros(1), np.array([[-1, -1]]), np.array(sizes))
    return Tree(np.array(normals), np.array(offsets), np.array(children), np.array(sizes))


def leaves(tree: Tree, x: np.ndarray) -> np.ndarray:
    """Leaf of every row."""
    at = np.zeros(len(x), np.int64)
    live = np.arange(len(x))
    while len(live):
        node = at[live]
        side = np.einsum("ij,ij->i", x[live], tree.normals[node]) > tree.offsets[node]
        at[live] = tree.children[node, side.astype(int)]
        live = live[at[live] >= 0]
    return -at - 1


def walk(forest: list[Tree], q: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(margin, tree, leaf) of all leaves in the order of the shared queue; no vector of a leaf is nearer than its margin."""
    queue = [(-np.inf, t, 0) for t in range(len(forest))]
    margins = [tree.normals @ q - tree.offsets for tree in forest]
    while queue:
        gap, t, node = heapq.heappop(queue)
        while node >= 0:
            m = margins[t][node]
            near, far = forest[t].children[node, [int(m > 0), int(m <= 0)]]
            if near != far:
                heapq.heappush(queue, (max(gap, abs(m)), t, int(far)))
            node = int(near)
        yield gap, t, -node - 1


def opened(forest: list[Tree], q: np.ndarray, want: float, reach: float = np.inf) -> list[tuple[int, int]]:
    """(tree, leaf) in the queue's order, until they hold ``want`` sample vectors or lie beyond ``reach``."""
    out, held = [], 0
    for gap, t, leaf in walk(forest, q):
        if held >= want or gap > reach:
            break
        out.append((t, leaf))
        held += int(forest[t].sizes[leaf])
    return out


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - q) ** 2).sum(1))


def share_to_open(forest: list[Tree], x: np.ndarray, seed: int = 3) -> float:
    """Least share of the forest's places that finds ``TARGET`` of the nearest neighbours among the fitted vectors."""
    rng = np.random.default_rng(seed)
    at = np.stack([leaves(tree, x) for tree in forest])
    size = sum(int(t.sizes.sum()) for t in forest)
    found = []  # the share at which each true neighbour turns up
    for i in rng.permutation(len(x))[:PROBES]:
        d = distances(x, x[i])
        d[i] = np.inf
        near = np.argsort(d, kind="stable")[:min(TOP, len(x) - 1)]
        first, held = {}, 0
        for _, t, leaf in walk(forest, x[i]):
            first[t, leaf] = held
            held += int(forest[t].sizes[leaf])
        found += [min(first[t, at[t, j]] for t in range(len(forest))) / size for j in near]
    return float(np.quantile(found, TARGET, method="higher")) + 1 / size if found else 1.0


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v of the rows that take part."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("v"))
            .filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
            .filter(fine).filter(F.exists("v", lambda c: c != 0)))


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), float).reshape(len(column), -1)


class Forest(NamedTuple):
    trees: list[Tree]
    sample: np.ndarray  # the vectors it was fitted on
    share: float  # of the places to open
    leaf: int


def fit(rows: DataFrame, n: int, seed: int = 11) -> Forest:
    """Forest over ``SAMPLE`` distinct vectors at most, the first ones in the order of a hash."""
    order = F.xxhash64("v", F.lit("ann"))
    x = matrix(rows.select("vec_id", "v", order.alias("h")).orderBy("h", "vec_id").limit(SAMPLE).toPandas().sort_values(["h", "vec_id"])["v"])
    rng = np.random.default_rng(seed)
    leaf = max(LEAST_LEAF, LEAF * SAMPLE // max(n, SAMPLE))
    trees = [grow(x, rng, leaf) for _ in range(TREES)] if len(x) else []
    return Forest(trees, x, share_to_open(trees, x) if len(x) else 1.0, leaf)


def route(rows: DataFrame, forest: list[Tree], blocks: int) -> DataFrame:
    """A row per tree: tree, leaf, block, vec_id, ids, v."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = matrix(batch["v"])
            for t, tree in enumerate(forest):
                yield batch.assign(tree=t, leaf=leaves(tree, x))
    out = rows.mapInPandas(run, "ids array<long>, v array<double>, tree int, leaf long")
    return out.withColumn("block", F.pmod(F.xxhash64(F.get("ids", 0)), F.lit(blocks)))


def ask(queries: DataFrame, forest: Forest, blocks: int) -> DataFrame:
    """A row per opened leaf and block: tree, leaf, block, query_id, q."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        want = forest.share * sum(int(t.sizes.sum()) for t in forest.trees)
        for batch in batches:
            x, rows = matrix(batch["v"]), []
            for i, q in zip(batch["vec_id"], x):
                # the query itself may be in the sample, hence one more
                reach = np.partition(distances(forest.sample, q), TOP)[TOP] * (1 + 1e-9) if len(forest.sample) > TOP else np.inf
                rows += [(t, leaf, b, i, q) for t, leaf in opened(forest.trees, q, want, reach) for b in range(blocks)]
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=["tree", "leaf", "block", "query_id", "q"])
                    rows = []
            yield pd.DataFrame(rows, columns=["tree", "leaf", "block", "query_id", "q"])
    return queries.select("vec_id", "v").mapInPandas(run, "tree int, leaf long, block long, query_id long, q array<double>")


def _rank(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """Of one leaf block, each query's nearest rows by exact distance."""
    names = ["query_id", "vec_id", "score"]
    if not len(rows) or not len(asked):
        return pd.DataFrame({"query_id": np.zeros(0, int), "vec_id": np.zeros(0, int), "score": np.zeros(0)})
    x = matrix(rows["v"])
    ids = [list(map(int, i)) for i in rows["ids"]]
    first = np.array([i[0] for i in ids])
    out = []
    for query, q in zip(asked["query_id"], matrix(asked["q"])):
        d = np.sqrt(((x - q) ** 2).sum(1))
        some = np.lexsort((first, d))[:TOP + 1]
        out += [(query, i, d[k]) for k in some for i in ids[k] if i != query]
    return pd.DataFrame(out, columns=names)


def nearest(vectors: DataFrame, is_query, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where ``is_query`` holds, its nearest found rows."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    width = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not width:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.size("v") == width[0]["d"]).distinct()
    # the smallest ids of equal vectors; the rank limit is applied before the shuffle too
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = rows.withColumn("place", place).filter(F.col("place") <= TOP + 1)
    one = written(few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select("ids", "v"), "vectors")
    n = one.count()
    forest = fit(one.select(F.get("ids", 0).alias("vec_id"), "v"), n)
    blocks = max(1, -(-n // SAMPLE) * forest.leaf // BLOCK_ROWS)
    index = route(one, forest.trees, blocks)
    asked = ask(rows.filter(is_query), forest, blocks)
    keys = ["tree", "leaf", "block"]
    found = (index.groupBy(*keys).cogroup(asked.groupBy(*keys))
             .applyInPandas(_rank, "query_id long, vec_id long, score double")
             .groupBy("query_id", "vec_id").agg(F.min("score").alias("score")))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return (found.withColumn("rank", order).filter(F.col("rank") <= top)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def digest(vectors: DataFrame) -> DataFrame:
    """Contract columns of the search query."""
    return nearest(vectors, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank")
