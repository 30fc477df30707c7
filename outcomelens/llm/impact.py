"""Exact top-k search by inner product over an impact-ordered index, a score at a time.

Components become integers, floor(256 * x).  The distinct vectors are dealt over
shards.  In a shard every dimension has a list of its rows by falling value, cut
into at most ``LEVELS`` segments of like value.  For a query a segment is worth
(its impact) at most the query's weight times the segment's best value, counted
from the dimension's worst one; for a negative weight the list is read from its
other end.  Segments are taken by falling impact, whatever their dimension, and
their impact is added to their rows' accumulators.

After each share of the postings (``ROUNDS``) every row has an upper bound: what
it collected, plus for each dimension in which it was not yet met the impact at
which the search stands (or the dimension's best, if none of it was read).  The
rows in front are scored exactly, which gives a score that the k-th best reaches
at least; the search of a shard stops only if no more than a few rows have bounds
that reach it, or when all postings are read.  The possible members left are
scored exactly, all of them.

Query blocks meet all shards, each pair of block and shard in a task of its own;
a task holds one shard and one block.  Equal vectors stand under their
``TOP + 1`` smallest ids, which is exact: no other copy can be among the first.

Defined cases: vectors that are null, empty, of a length other than the commonest
(the smaller of two), or with a null or non-finite component take no part, nor do
rows without vec_id; zero vectors do.  Ties go to the smaller vec_id; rows with
the same vec_id are one, with its best score, and so is a query with several
vectors.  256 * x beyond 2^53 counts as 2^53, a score beyond a long as the
largest long.  Fewer candidates give fewer rows, an empty table none.  Vectors may
be long: a shard's memory is its rows times their length.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from outcomelens.llm.common import written

TOP = 5
SCALE = 256
SHARD = 8192  # distinct vectors together, about
LEVELS = 64  # segments of a dimension's list
BLOCK, BLOCKS, LARGE_BLOCK = 128, 16, 4096  # queries together: 128, more once there are 16 blocks, 4096 at most
ROUNDS = (0.45, 0.6, 0.7, 0.85, 1.0)  # shares of the postings after which the bounds are looked at
FEW = 16  # the search ends once no more than a FEW-th of the rows can be members
_LARGE = float(1 << 53)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (whole numbers) of the rows that take part, equal rows once."""
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
            .filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0)).filter(fine))
    width = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    whole = F.transform("x", lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(_LARGE)), F.lit(-_LARGE))).cast("long"))
    return rows.filter(F.size("x") == F.lit(width[0]["d"] if width else 0)).select("vec_id", whole.alias("v")).distinct()


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 0), np.int64)


def _small(x: np.ndarray) -> tuple[str, bytes]:
    """An array in the shortest whole-number type that holds it."""
    kind = next(t for t in ("i1", "i2", "i4", "i8") if x.min() >= np.iinfo(t).min and x.max() <= np.iinfo(t).max)
    return kind, x.astype(kind).tobytes()


_INDEX = "shard long, dim int, kind string, vals binary, postings binary, ids array<array<long>>"


def _list_up(rows: pd.DataFrame) -> pd.DataFrame:
    """One shard's index: per dimension the values by row and the rows by falling value; first the ids by row."""
    shard = rows["shard"].iloc[0]
    x = matrix(rows["v"])
    out = [(shard, -1, None, None, None, [[int(i) for i in ids] for ids in rows["ids"]])]
    for d in range(x.shape[1]):
        kind, held = _small(x[:, d])
        out.append((shard, d, kind, held, np.argsort(-x[:, d], kind="stable").astype(np.uint32 if len(x) > 1 << 16 else np.uint16).tobytes(), None))
    return pd.DataFrame(out, columns=["shard", "dim", "kind", "vals", "postings", "ids"])


def index(rows: DataFrame) -> tuple[DataFrame, int]:
    """The index of distinct vectors (a row per shard and dimension) and the number of shards."""
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))  # the limit holds before the shuffle, too
    few = rows.withColumn("place", place).filter(F.col("place") <= TOP + 1)
    one = written(few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "vectors")
    shards = max(1, -(-one.count() // SHARD))
    dealt = one.select(F.pmod(F.xxhash64("v"), F.lit(shards)).alias("shard"), "v", "ids")
    return written(dealt.groupBy("shard").applyInPandas(_list_up, _INDEX), "impact-index"), shards


class Shard:
    """One shard's index in memory."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values("dim")
        self.ids = [[int(i) for i in ids] for ids in rows["ids"].iloc[0]]
        lists = rows.iloc[1:]
        m = len(self.ids)
        self.x = np.stack([np.frombuffer(v, k).astype(np.int64) for v, k in zip(lists["vals"], lists["kind"])], 1)
        falling_rows = np.stack([np.frombuffer(p, np.uint32 if m > 1 << 16 else np.uint16).astype(np.int64) for p in lists["postings"]])
        falling = np.take_along_axis(self.x.T, falling_rows, 1)
        self.best, self.worst = falling[:, 0], falling[:, -1]
        step = np.maximum(-(-(self.best - self.worst + 1) // LEVELS), 1)
        level = (falling - self.worst[:, None]) // step[:, None]
        # both ways to read a list: by falling value for positive weights, by rising value for negative ones
        self.ways = [self._way(falling_rows, level, falling - self.worst[:, None]),
                     self._way(falling_rows[:, ::-1], level[:, ::-1], (self.best[:, None] - falling)[:, ::-1])]
        self.alone = {ids[0]: k for k, ids in enumerate(self.ids) if len(ids) == 1}
        self.read = self.held = 0  # postings read, and those there were

    @staticmethod
    def _way(rows: np.ndarray, level: np.ndarray, worth: np.ndarray) -> tuple:
        """Postings in reading order with their segment's best worth; per dimension the segments' worths and ends."""
        m = rows.shape[1]
        starts = [np.concatenate(([0], np.flatnonzero(np.diff(v)) + 1)) for v in level]
        worths = [w[s].astype(float) for w, s in zip(worth, starts)]
        ends = [np.append(s[1:], m) for s in starts]
        spread = np.stack([np.repeat(w, np.diff(e, prepend=0)) for w, e in zip(worths, ends)])
        return np.ascontiguousarray(rows), spread, worths, ends

    def scores(self, some: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Exact inner products of some rows."""
        x = self.x[some]
        if float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * len(q) < 2.0 ** 62:
            return x @ q
        exact = x.astype(object) @ q.astype(object)
        return np.array([max(min(s, (1 << 63) - 1), -(1 << 63)) for s in exact], np.int64)

    def members(self, q: np.ndarray, own: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Rows that can be among the first ``TOP`` (and more), with their exact scores."""
        m = len(self.ids)
        use = np.flatnonzero(q)
        if not len(use):
            return np.arange(m), self.scores(np.arange(m), q)
        way = (q[use] < 0).astype(int).tolist()
        dims, weight = use.tolist(), np.abs(q[use]).astype(float)
        # all segments' impacts, one dimension after the other, and the order they are read in
        sizes = np.fromiter((len(self.ways[w][2][d]) for d, w in zip(dims, way)), np.int64, len(dims))
        flat = np.concatenate([self.ways[w][2][d] for d, w in zip(dims, way)]) * np.repeat(weight, sizes)
        ends = np.concatenate([self.ways[w][3][d] for d, w in zip(dims, way)])
        of = np.repeat(np.arange(len(dims)), sizes)
        offset = np.cumsum(sizes) - sizes
        first = flat[offset]
        order = np.argsort(-flat, kind="stable")
        lengths = np.diff(ends, prepend=0)
        lengths[offset] = ends[offset]
        filled = np.cumsum(lengths[order])
        base = float(sum(float(q[d]) * float(self.worst[d] if q[d] > 0 else self.best[d]) for d in dims))
        most = first.sum()
        slack = 1e-9 * (abs(base) + most) if max(abs(base), most) * 4 > _LARGE else 0.0
        # how often a row was met is counted in the same sum as its impacts, above them, where there is room
        unit = 2.0 ** np.ceil(np.log2(most + 2)) if most < 2.0 ** 30 and len(dims) < 1 << 20 else 0.0
        total, met = np.zeros(m), np.zeros(m)
        segments, at = np.zeros(len(dims), np.int64), np.zeros(len(dims), np.int64)
        bound, done = None, 0
        self.held += m * len(dims)
        for share in ROUNDS:
            last = min(int(np.searchsorted(filled, share * filled[-1])), len(flat) - 1)
            if last < done:
                continue
            stand = flat[order[last + 1]] if last + 1 < len(flat) else 0.0  # the impact of the best segment that is not read
            segments += np.bincount(of[order[done:last + 1]], minlength=len(dims))
            done = last + 1
            until = np.where(segments > 0, ends[offset + np.maximum(segments, 1) - 1], 0)
            cut = list(zip(way, dims, at.tolist(), until.tolist()))
            some = np.concatenate([self.ways[w][0][d, a:b] for w, d, a, b in cut])
            gain = np.concatenate([self.ways[w][1][d, a:b] for w, d, a, b in cut])
            gain *= np.repeat(weight, until - at)
            if unit:
                total += np.bincount(some, gain + unit, m)
                met = np.floor(total / unit)
                got = total - met * unit
            else:
                total += np.bincount(some, gain, m)
                met += np.bincount(some, minlength=m)
                got = total
            at = until
            self.read += len(some)
            touched = segments > 0
            upper = got + stand * (touched.sum() - met)
            upper += base + first[~touched].sum() + slack
            if own is not None:
                upper[own] = -np.inf
            if bound is None and m > 4 * TOP:
                front = np.argpartition(-upper, 4 * TOP)[:4 * TOP]
                bound = float(np.sort(self.scores(front[np.isfinite(upper[front])], q))[-TOP:][0]) - slack
            if bound is not None:
                possible = np.flatnonzero(upper >= bound)
                if len(possible) <= max(4 * TOP, m // FEW):
                    break
        else:
            possible = np.flatnonzero(upper >= bound) if bound is not None else np.arange(m)
        return possible, self.scores(possible, q)


def _search(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """Of one shard, each query's best rows."""
    out = []
    if len(rows) and len(asked):
        shard = Shard(rows)
        for query, q in zip(asked["vec_id"], asked["v"]):
            own = shard.alone.get(query)
            possible, score = shard.members(np.asarray(q, np.int64), own)
            first = np.array([shard.ids[k][0] for k in possible], np.int64)
            for k in np.lexsort((first, -score.astype(object) if len(score) and score.min() == -(1 << 63) else -score))[:TOP + 1]:
                if possible[k] != own:
                    out += [(query, i, score[k]) for i in shard.ids[possible[k]] if i != query]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"], dtype="int64")


def top(vectors: DataFrame, is_query: Column) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where ``is_query`` holds, its best rows."""
    rows = usable(vectors)
    table, shards = index(rows)
    queries = written(rows.filter(is_query), "queries")
    n = queries.count()
    blocks = max(1, min(-(-n // BLOCK), max(BLOCKS, -(-n // LARGE_BLOCK))))
    parts = min(2 * shards * blocks, 20_000)
    asked = (queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
             .withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))).repartition(parts, "shard", "block"))
    index_ = (table.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
              .repartition(parts, "shard", "block"))
    found = (index_.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block"))
             .applyInPandas(_search, "query_id long, vec_id long, score long")
             .groupBy("query_id", "vec_id").agg(F.max("score").alias("score")))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (found.withColumn("rank", order).filter(F.col("rank") <= TOP)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def digest(vectors: DataFrame) -> DataFrame:
    """Contract columns of the search query."""
    return top(vectors, F.col("vec_id") % 50 == 0)
