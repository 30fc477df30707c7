"""Near-duplicates by DartMinHash signatures, banded joins and an exact check.

Each shingle owns a region of the plane (weight, rank), cut into layers by
weight.  In a layer darts fall as a Poisson process along the rank, drawn from
hashes of the shingle alone, so equal shingles throw equal darts everywhere.  A
dart counts if it lies under the shingle's weight; it carries a coordinate, and
of each coordinate the earliest dart is kept.  Two documents then agree on a
coordinate with the probability of their weighted Jaccard similarity.  About
k ln k + 2k darts fill k coordinates, however many shingles there are.

Documents are linked if the Jaccard similarity of their sets of five-word
shingles is at least 0.8; classes are the connected components of all links.
Copies are represented by one document.  In each band bucket all members are
compared with its hub, the one that shares most buckets with others; members of buckets that are then still in several
classes are compared across classes, so no link is left out for a hub's sake: a
prefix join on their rare shingles finds all pairs of them that can be similar.
The darts take weights; here every shingle weighs 1, as the similarity is that of sets.

Defined cases: a text of one to four words is one shingle; null texts and texts
without a word link to nothing but their exact copies; rows with the same
doc_id and text are one document, those with the same doc_id and other texts
documents of their own (under numbers from 2^62 on); rows without doc_id take part
under a number derived from their text, which is negative.  An empty table gives an
empty result.  Ties don't arise: similarity is compared exactly.  Texts are hashed
whole, some hundred thousand characters at a time (a single text at once).  Other columns are ignored, and kept by
``keep_one`` whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outcomelens.llm.common import WORD, small_batches, spread, written

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 38, 5  # a pair at 0.8 shares no band with probability 3e-7, at 0.85 with 2e-10; one at 0.3 shares one in 9 cases of 100
_CHARS = 200_000  # characters hashed at a time
_SALTS = 64
CELLS = 1 << 19  # of the table that tells rare shingles from frequent ones
SIZE_STEP = 0.9  # ratio of neighbouring size classes
_BASE = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1)."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts and the number of its text, from one pass over the bytes."""
    joined = "\n".join(texts).encode("utf-8", "surrogatepass")
    raw = np.frombuffer(joined, np.uint8)
    space = np.zeros(256, bool)
    space[[0x20, *range(9, 14)]] = True
    gap = np.concatenate(([True], space[raw], [True]))
    starts = np.flatnonzero(gap[:-1] & ~gap[1:])
    ends = np.flatnonzero(~gap[:-1] & gap[1:])
    inverse = np.uint64(pow(_BASE, -1, 1 << 64))
    # a word's hash is the sum of byte * BASE^(-place in the word), from one running sum
    up, down = np.full(len(raw), _BASE, np.uint64), np.full(len(raw), inverse, np.uint64)
    up[:1] = down[:1] = 1
    up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    running = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * down)))
    h = _mix((running[ends] - running[starts]) * up[starts] + (ends - starts).astype(np.uint64))
    sizes = np.fromiter((len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts), np.int64, len(texts))
    return h, np.searchsorted(np.cumsum(sizes), starts, side="right")


def shingle_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles: (text number, 48-bit hash, times it occurs), by text number."""
    h, doc = word_hashes(texts)
    factors = [np.uint64((_BASE * (2 * i + 3) ** 5 | 1) & (1 << 64) - 1) for i in range(SHINGLE)]
    n = max(len(h) - SHINGLE + 1, 0)
    code = np.zeros(n, np.uint64)
    for i, f in enumerate(factors):
        code += h[i:i + n] * f
    whole = doc[:n] == doc[SHINGLE - 1:] if n else np.zeros(0, bool)
    code, owner = _mix(code[whole]), doc[:n][whole]
    words = np.bincount(doc, minlength=len(texts))
    short = np.flatnonzero((words > 0) & (words < SHINGLE))
    if len(short):
        first = np.searchsorted(doc, short)
        add = np.zeros(len(short), np.uint64)
        for i, f in enumerate(factors[:-1]):
            has = words[short] > i
            add[has] += h[first[has] + i] * f
        code, owner = np.concatenate((code, _mix(add + words[short].astype(np.uint64)))), np.concatenate((owner, short))
    if len(texts) > 1 << 16:
        raise ValueError("too many texts at a time")
    key, times = np.unique(owner.astype(np.uint64) << np.uint64(48) | code >> np.uint64(16), return_counts=True)
    return (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 48) - 1), times


def darts(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """Signatures (n, k) of n weighted sets: the earliest dart of each coordinate; 0 for empty sets."""
    out = np.zeros((n, k), np.uint64)
    total = np.bincount(owner, weight, n)
    limit = np.where(total > 0, (k * math.log(k) + 2 * k) / np.maximum(total, 1e-300), 0.0)
    todo = total > 0
    while todo.any():
        best, name = np.full(n * k, np.inf), np.zeros(n * k, np.uint64)
        layers = math.ceil(math.log2(max(weight[todo[owner]].max(), 1.0))) + 1
        for layer in range(layers):
            low, wide = (0.0, 1.0) if layer == 0 else (2.0 ** (layer - 1), 2.0 ** (layer - 1))
            at = np.flatnonzero(todo[owner] & (weight > low))
            seed = _mix(element[at] + np.uint64((layer + 1) * _BASE & (1 << 64) - 1))
            rank, step = np.zeros(len(at)), 0
            while len(at):
                step += 1
                z = _mix(seed + np.uint64(step * 0xD1B54A32D192ED03 & (1 << 64) - 1))
                rank = rank - np.log(_unit(z)) / wide
                live = rank < limit[owner[at]]
                at, seed, rank, z = at[live], seed[live], rank[live], z[live]
                dart = _mix(z + np.uint64(0x632BE59BD9B4E019))
                height = low + wide * _unit(_mix(dart + np.uint64(1)))
                hit = height < weight[at]
                cell = owner[at][hit] * k + (dart[hit] % np.uint64(k)).astype(np.int64)
                r = rank[hit]
                np.minimum.at(best, cell, r)
                won = best[cell] == r
                name[cell[won]] = dart[hit][won]
        full = todo & np.isfinite(best.reshape(n, k)).all(1)
        out[full] = name.reshape(n, k)[full]
        todo &= ~full
        limit = limit * 2  # some coordinate stayed empty: throw further, the same darts first
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """Signed 64-bit bucket names (n, BANDS) of signatures."""
    n = len(signature)
    rows = signature.reshape(n, BANDS, ROWS)
    code = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (n, BANDS)).copy()
    for i in range(ROWS):
        code = _mix(code * np.uint64(_BASE) + rows[:, :, i])
    return code.view(np.int64)


def _sign(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        texts_, n_out, bands_out, part, size = list(batch), [], [], [], 0
        for i, t in enumerate(texts_):
            part.append(t or "")
            size += len(part[-1])
            if size >= _CHARS or len(part) >= 1 << 15 or i == len(texts_) - 1:
                owner, element, _ = shingle_hashes(part)
                n = np.bincount(owner, minlength=len(part))
                codes = bands(darts(owner, element, np.ones(len(owner)), len(part), BANDS * ROWS))
                n_out.append(n)
                bands_out += [c if m else c[:0] for c, m in zip(codes, n)]
                part, size = [], 0
        yield pd.DataFrame({"n": np.concatenate(n_out) if n_out else np.zeros(0, np.int64),
                            "bands": pd.Series(bands_out, dtype=object)})


def shingles(text: str) -> set:
    words = re.findall(WORD, text or "")
    if len(words) < SHINGLE:
        return {tuple(words)} if words else set()
    return set(zip(*[words[i:] for i in range(SHINGLE)]))


def _check(pairs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Keep pairs whose exact similarity reaches the bound."""
    hub, of_hub = None, set()
    for batch in pairs:
        kept = []
        for a, b, ta, tb in zip(batch.a, batch.b, batch.ta, batch.tb):
            if b != hub:
                hub, of_hub = b, shingles(tb)
            mine = shingles(ta)
            both = len(mine & of_hub)
            if both and both >= SIMILARITY * (len(mine) + len(of_hub) - both) - 1e-9:
                kept.append((a, b))
        yield pd.DataFrame(kept, columns=["a", "b"], dtype="int64")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) that are similar; texts (node, text) has every node once.

    A node in very many pairs is spread: its text is copied once per 256 of them.
    """
    often = pairs.groupBy("b").agg(F.ceil(F.count("*") / 256).alias("parts"))
    salted = spread(pairs, often, key="b", by="a").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts"))).drop("parts")
    left = salted.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    right = (texts.join(often, texts.node == often.b).select(
        "b", F.col("text").alias("tb"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")))
    return left.join(right, ["b", "part"]).select("a", "b", "ta", "tb").mapInPandas(_check, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, class) of all nodes with an edge; class is the smallest node reachable.

    Alternates pointing larger neighbours and smaller neighbours of a node at
    its smallest one until the edges no longer change; they end as stars.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    stamp = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == stamp:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("class"))
        stamp = now
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("x"), "m").filter("x > m").select(F.col("x").alias("a"), F.col("m").alias("b"))
        edges = written(small.unionAll(low.select("a", F.col("m").alias("b"))).distinct(), "edges")


def identity(docs: DataFrame) -> DataFrame:
    """``docs`` with ``t`` (hash of the text) and ``own``: the doc_id, or a negative number from t."""
    docs = docs.withColumn("t", F.md5(F.coalesce("text", F.lit(""))))
    stand_in = -F.shiftrightunsigned(F.xxhash64("t"), 1) - 1
    return docs.withColumn("own", F.coalesce(F.col("doc_id").cast("long"), stand_in))


def numbered(rows: DataFrame) -> DataFrame:
    """t, own, node: each distinct text's smallest document, and a number for the text.

    That is the document's, but where an id has several texts only for the first of them (by hash);
    the others get numbers from their hashes, from 2^62 on.
    """
    part = rows.groupBy("t", F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS)).alias("salt")).agg(F.min("own").alias("m"))
    texts = part.groupBy("t").agg(F.min("m").alias("own"))
    several = texts.groupBy("own").agg(F.min("t").alias("first"), F.count("*").alias("k")).filter("k > 1").select("own", "first")
    other = F.shiftrightunsigned(F.xxhash64("t"), 2) + (1 << 62)
    return (spread(texts, several, key="own", by="t", how="left")
            .select("t", "own", F.when(F.col("first") != F.col("t"), other).otherwise(F.col("own")).alias("node")))


def first_bucket_pairs(members: DataFrame, similar_size: Column) -> DataFrame:
    """Each member of a bucket with the bucket's hub, once."""
    return (members.filter("node <> hub.node")
            .select(F.greatest("node", "hub.node").alias("a"), F.least("node", "hub.node").alias("b"), "n", F.col("hub.n").alias("n2"))
            .filter(similar_size).select("a", "b").distinct())


def _cells(texts: DataFrame) -> np.ndarray:
    """How many of the texts' shingles fall into each cell, 2^32 - 1 at most; of a bounded size, so it can go to every task."""
    most = (1 << 32) - 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros(CELLS, np.int64)
        for batch in batches:
            for part in _parts(list(batch["text"])):
                out += np.bincount((shingle_hashes(part)[1] % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
        yield pd.DataFrame({"c": [np.minimum(out, most).astype(np.uint32).tobytes()]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros(CELLS, np.int64)
        for batch in batches:
            for c in batch["c"]:
                out += np.frombuffer(c, np.uint32)
        yield pd.DataFrame({"c": [np.minimum(out, most).astype(np.uint32).tobytes()]})

    rows = texts.select("text").mapInPandas(run, "c binary")
    return np.frombuffer(rows.repartition(16).mapInPandas(add, "c binary").repartition(1).mapInPandas(add, "c binary").first().c, np.uint32)


def _parts(texts: list) -> Iterator[list[str]]:
    """Runs of texts of bounded length."""
    part, size = [], 0
    for i, t in enumerate(texts):
        part.append(t or "")
        size += len(part[-1])
        if size >= _CHARS or len(part) >= 1 << 15 or i == len(texts) - 1:
            yield part
            part, size = [], 0


def size_class(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(n) / math.log(1 / SIZE_STEP) + 1e-9).astype(np.int64)


def prefix_rows(element: np.ndarray, n: int, cells: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, bool]]:
    """Of one set its first shingles in an order from rare to frequent: (size class, shingles, their places, is the larger set).

    Similar sets share s / (1 + s) of both sizes' sum, so one of what they share lies among the first
    n - that + 1 of either; the more the smaller the other set, hence a number for each size class.
    """
    order = element[np.lexsort((element, cells[(element % np.uint64(CELLS)).astype(np.int64)]))].astype(np.int64)
    share = SIMILARITY / (1 + SIMILARITY)

    def first(other: float) -> int:
        return min(n, n - math.ceil(share * (n + other) - 1e-9) + 1)

    mine, low = int(size_class(np.array([n]))[0]), SIMILARITY * n
    least = int(size_class(np.array([max(low * (1 - 1e-9), 1)]))[0])
    out = [(mine, order[:first(n)], np.arange(first(n)), False)]
    for k in range(least, mine + 1):
        m = first(max(low, SIZE_STEP ** -k))
        out.append((k, order[:m], np.arange(m), True))
    return out


def cross_class_pairs(members: DataFrame, found: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs still in different classes that can be similar, of all members of buckets with several classes.

    A prefix join: pairs meet in a shingle that is among the rare ones of both, so a passage that many
    documents share brings none together.  In a shingle of several classes the members of the largest
    class meet those of the others only.
    """
    placed = members.select("bucket", "node", "n").join(found.select("node", F.col("class").alias("c")), "node", "left").withColumn("c", F.coalesce("c", "node"))
    several = placed.groupBy("bucket").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).filter("c1 <> c2").select("bucket")
    nodes = placed.join(several, "bucket", "left_semi").select("node", "c").distinct()
    asked = written(texts.join(nodes, "node"), "prefix-texts")
    cells = _cells(asked)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            start, node, c = 0, batch["node"].to_numpy(), batch["c"].to_numpy()
            for part in _parts(list(batch["text"])):
                owner, element, _ = shingle_hashes(part)
                sizes = np.bincount(owner, minlength=len(part))
                sets = np.split(element, np.cumsum(sizes)[:-1])
                found = [(start + i, *row) for i, x in enumerate(sets) if len(x) for row in prefix_rows(x, len(x), cells)]
                if found:
                    at, k, x, place, larger = zip(*found)
                    doc = np.repeat(at, [len(p) for p in x])
                    yield pd.DataFrame({"k": np.repeat(k, [len(p) for p in x]), "x": np.concatenate(x), "at": np.concatenate(place),
                                        "larger": np.repeat(larger, [len(p) for p in x]), "node": node[doc], "n": sizes[doc - start], "c": c[doc]})
                start += len(part)

    rows = asked.select("node", "c", "text").mapInPandas(run, "k long, x long, at long, larger boolean, node long, n long, c long")
    shared = (rows.groupBy("k", "x", "c").agg(F.count("*").alias("m")).groupBy("k", "x")
              .agg(F.max_by("c", F.struct("m", "c")).alias("big"), F.count("*").alias("classes")).filter("classes > 1").select("k", "x", "big"))
    rows = written(rows.join(shared, ["k", "x"]), "shared-prefixes")

    def side(larger: bool, few: bool | None, letter: str) -> DataFrame:
        keep = F.col("larger") == larger
        if few is not None:
            keep = keep & ((F.col("c") != F.col("big")) == few)
        return rows.filter(keep).select("k", "x", *[F.col(c).alias(c + letter) for c in ("node", "n", "c", "at")])

    def meet(small: DataFrame, large: DataFrame) -> DataFrame:
        rest = F.least(F.col("n1") - F.col("at1"), F.col("n2") - F.col("at2"))  # shared at most, from the first shared shingle on
        can = (rest >= SIMILARITY / (1 + SIMILARITY) * (F.col("n1") + F.col("n2")) - 1e-6) & (F.col("n1") >= SIMILARITY * F.col("n2") - 1e-6)
        in_order = F.struct("n1", "node1") < F.struct("n2", "node2")
        same = (F.col("l.k") == F.col("s.k")) & (F.col("l.x") == F.col("s.x")) & (F.col("c1") != F.col("c2"))
        return (small.alias("s").join(large.alias("l"), same & in_order & can)
                .select(F.greatest("node1", "node2").alias("a"), F.least("node1", "node2").alias("b")))

    return meet(side(False, True, "1"), side(True, None, "2")).unionAll(meet(side(False, False, "1"), side(True, True, "2"))).distinct()


def classes(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, t, own, node (the document standing for its copies), class_id (the
    smallest node of the class) and n_links (checked links of the node to other texts)."""
    with small_batches(docs.sparkSession):  # all Python runs before this returns
        return _classes(docs)


def _classes(docs: DataFrame) -> DataFrame:
    rows = identity(docs.select("doc_id", "text")).select("doc_id", "own", "t", F.pandas_udf(_sign, "n long, bands array<long>")("text").alias("s"))
    rows = written(rows.select("doc_id", "own", "t", "s.*"), "signatures")
    nodes = written(numbered(rows), "nodes")
    one = (rows.filter("n > 0").select("t", "own", "n", "bands").join(nodes, ["t", "own"])
           .groupBy("node").agg(F.min(F.struct("t", "own", "n", "bands")).alias("s")).select("node", "s.*"))
    one = written(one, "represented")
    members = one.select("node", "n", F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    members = written(members.join(sizes, "bucket"), "members")
    # a bucket's hub is the member that meets most others in all its buckets: the original of a group rather than one of its copies
    company = members.groupBy("node").agg(F.sum("size").alias("company"))
    hubs = (members.join(company, "node").groupBy("bucket")
            .agg(F.max_by(F.struct("node", "n"), F.struct("company", -F.col("node"))).alias("hub")))
    members = written(members.join(hubs, "bucket").select("bucket", "node", "n", "hub"), "with-hubs")
    similar_size = F.least("n", "n2") >= SIMILARITY * F.greatest("n", "n2") - 1e-9
    pairs = written(first_bucket_pairs(members, similar_size), "pairs")
    asked = members.select("node").distinct().join(one.select("node", "t", "own"), "node")
    texts = identity(docs.select("doc_id", "text")).join(asked, ["own", "t"]).dropDuplicates(["node"]).select("node", "text")
    texts = written(texts, "asked-texts")
    links = written(verified(pairs, texts), "links")
    across = cross_class_pairs(members, components(links), texts)
    across = written(across.join(pairs, ["a", "b"], "left_anti"), "across")
    links = written(links.unionAll(verified(across, texts)), "links")
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    table = nodes.select("t", "node").join(components(links), "node", "left").join(degree, "node", "left").select(
        "t", "node", F.coalesce("class", "node").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return spread(rows.select("doc_id", "own", "t"), table)


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each class one document stays, that with the smallest doc_id; columns unchanged."""
    stay = classes(docs).filter("node = class_id").groupBy("t").agg(F.min("own").alias("own")).select(F.col("own").alias("__own"), F.col("t").alias("__t"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = identity(docs.select(row, "doc_id", "text")).select("row", F.col("own").alias("__own"), F.col("t").alias("__t"))
    return rows.join(stay, ["__own", "__t"]).dropDuplicates(["__own", "__t"]).select("row.*")


def digest(docs: DataFrame) -> DataFrame:
    """Per document its class, the node standing for its copies, and the node's links."""
    return classes(docs).select("doc_id", "class_id", F.col("node").alias("copy_of"), "n_links")
