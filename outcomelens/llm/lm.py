"""Language-model scores from a hashed maximum-entropy model.

P(token | context) = P(class | context) * P(token | class, context).  The class
part is a softmax over hashed features of the context: the last token, the last
two, the last frequent one and the last two frequent ones (which skip what lies
between).  Classes are made of the ``TOP`` most frequent tokens, by the words
they follow and by frequency; one class holds all other tokens, known or not.
Below a class stands a tree of up to ``LEVELS`` choices among ``FAN`` branches,
as many as its tokens ask for; each choice is a softmax over the same features
hashed with the place in the tree, starting from the branches' shares.  A frequent
token's path is its rank in its class and ends at itself; any other token's
comes from its hash and ends after ``OTHER_LEVELS`` choices at a leaf, within which
it has its smoothed share.  In the features every token stands for itself (the last
ones by hash).  A choice that is told well enough already is not learned from.

Training passes over all training texts in ``ROUNDS`` rounds.  In a round every
task updates a copy of the weights by gradient steps on its share, and the
copies are averaged row by row, weighted by how often a row was used.  Weights
have as many rows as V asks for, from ``ROWS`` to ``MOST_ROWS``; they, the tree's
shares and the list of frequent tokens go to every task.  The counts of all
other tokens stay in Spark and meet the texts by blocks of documents, once: what
they tell and the tokens' names are stored, and training and scoring read these.

Defined cases: a null text has the end token only; repeated rows are counted
and scored each; rows without doc_id are scored like others (bucket of the
empty text); an empty table gives an empty result; without training texts
every token has the same share and no class is told apart.  Texts are learned from
and scored whole; those over ``LONG`` characters are dealt over 63 further blocks.
Of equally frequent tokens the first by code point counts as the more frequent.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from outcomelens.llm.common import bucket, small_batches, written

END = "\n"  # no word contains it
TOP = 8192  # frequent tokens
NEAR = 32  # most frequent tokens that tell what a token follows
GROUPS, TIERS = 8, 4
CLASSES = GROUPS * TIERS + 2  # and the end token, and all others
FAN, LEVELS = 32, 3  # of the tree below a class
OTHER_LEVELS = 1
TREE_FEATURES = 4
ROWS, MOST_ROWS = 1 << 13, 1 << 15  # hashed feature rows
NAMES = 1 << 16  # from here on names of tokens that aren't frequent; the one before is the unknown token's
RARE = NAMES - 2  # stands for a name from NAMES on where names are stored in two bytes
ROUNDS = 2
BATCH = 8192
SHARE = 1 << 22  # training tokens per task, at least on average: copies that saw less lose much when they are averaged
RATE = 0.3
SURE = 0.15  # a choice whose probability lacks less than this is not learned from
BLOCK = 4096  # documents whose distinct tokens are looked up together
HELD = 24 << 20  # bytes of texts whose tokens a task counts together
LONG = 1 << 16  # characters from which a document is dealt over the parts of its block


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of texts one after the other, A-Z lowered, without the end tokens, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))  # splits at \x20 and \x09-\x0D
    words, text = lists.flatten(), pc.list_parent_indices(lists)
    real = pc.not_equal(words, "")  # outer white space leaves empty strings
    return words.filter(real), np.bincount(text.filter(real).to_numpy(), minlength=len(texts))


def _parts(texts: pa.Array, most: int = 1 << 21) -> Iterator[pa.Array]:
    """Texts in runs of bounded length."""
    ends = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)))
    first = 0
    while first < len(texts):
        last = max(int(np.searchsorted(ends, ends[first] + most, "right")) - 1, first + 1)
        yield texts.slice(first, last - first)
        first = last


def with_block(docs: DataFrame) -> DataFrame:
    """doc_id, text, train, block: neighbouring ids share a block, long texts are spread over its parts."""
    part = F.when(F.length("text") > LONG, 1 + F.pmod(F.xxhash64("doc_id", "text"), F.lit(63))).otherwise(0)
    block = F.coalesce(F.floor(F.col("doc_id") / BLOCK), -1 - F.pmod(F.xxhash64("text"), F.lit(1 << 20))) * 64 + F.coalesce(part, F.lit(0))
    return docs.select("doc_id", "text", (bucket(F.col("doc_id"), 5) != 1).alias("train"), block.cast("long").alias("block"))


def _block_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, word, n): the tokens of each block, with their number in training texts."""
    def rows() -> Iterator[pa.RecordBatch]:
        docs = pa.Table.from_batches(held)
        texts, train, blocks = docs["text"].combine_chunks(), docs["train"].to_numpy(), docs["block"].to_numpy()
        order = np.argsort(blocks, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(blocks[order])) + 1):
            found = [split(part) for part in _parts(texts.take(pa.array(own)))]
            coded = pa.chunked_array([words for words, _ in found]).dictionary_encode().combine_chunks()
            sizes = np.concatenate([x for _, x in found])
            n = np.bincount(coded.indices.to_numpy()[np.repeat(train[own], sizes)], minlength=len(coded.dictionary))
            n = np.append(n, train[own].sum()).astype(np.int64)
            word = pa.concat_arrays([coded.dictionary, pa.array([END], coded.dictionary.type)])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), blocks[own[0]])), word, pa.array(n)], names=["block", "word", "n"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) > HELD:
            yield from rows()
            held = []
            pa.default_memory_pool().release_unused()
    if sum(map(len, held)):
        yield from rows()


def count_table(docs: DataFrame) -> DataFrame:
    """block, word, n, c (the word's count over all training texts), place (1 on one row of each word)."""
    rows = docs.select("text", "train", "block").mapInArrow(_block_counts, "block long, word string, n long")
    w = Window.partitionBy("word").orderBy("block")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    with small_batches(docs.sparkSession):
        return written(rows.select("block", "word", "n", F.sum("n").over(whole).alias("c"), F.row_number().over(w).alias("place")), "counts")


class Frequent(NamedTuple):
    """The most frequent tokens and their counts, the number of training tokens and that of distinct ones."""
    words: list[str]
    counts: np.ndarray
    total: int  # N
    distinct: int  # V


class Frame(NamedTuple):
    """Frequent tokens, their classes, and each class's share of the training tokens."""
    words: list[str]
    classes: np.ndarray  # per frequent token, then for all others
    share: np.ndarray  # log10, per class
    total: int  # N
    distinct: int  # V
    leaf: np.ndarray  # per frequent token its leaf in the tree of its class
    shares: list[np.ndarray]  # per level (places, FAN): natural log of each branch's share of its place
    rows: int  # hashed feature rows
    splits: list[np.ndarray]  # per level: which places have more than one branch


class Names(dict):
    """Numbers of frequent tokens, and hashes as the names of all others."""
    def __missing__(self, word: str) -> int:
        name = NAMES + zlib.crc32(word.encode("utf-8", "surrogatepass"))
        if len(self) < 1_000_000:
            self[word] = name
        return name


def _targets(names: np.ndarray, f: Frame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each name the token id (len(f.words): not frequent), the class and the leaf."""
    ids = np.minimum(names, len(f.words))
    other = np.where(names >= NAMES, (names - NAMES) % FAN ** OTHER_LEVELS, 0)
    return ids, f.classes[ids], np.where(ids < len(f.words), np.append(f.leaf, 0)[ids], other)


def _tree(mass: np.ndarray) -> list[np.ndarray]:
    """Log shares of all branches, level by level, from the mass (classes, leaves); a leaf's lowest digit is its first branch."""
    out, leaves, places = [], mass.shape[1], 1
    while places < leaves:
        m = mass.reshape(len(mass), -1, FAN, places).sum(1).transpose(0, 2, 1).reshape(-1, FAN)
        out.append(np.log(np.maximum(m, 1e-30) / np.maximum(m.sum(1, keepdims=True), 1e-30)).astype(np.float32))
        places *= FAN
    return out


def choices(classes: np.ndarray, leaf: np.ndarray, code: np.ndarray, f: Frame) -> Iterator[tuple]:
    """Per level: which tokens have a choice there, their feature rows, the log shares of the branches and the branch taken."""
    for level, (shares, splits) in enumerate(zip(f.shares, f.splits)):
        places = FAN ** level
        place = classes * places + leaf % places
        at = np.flatnonzero(splits[place])
        if len(at):
            place = place[at]
            mark = (place * LEVELS + level + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            yield at, feature_rows(np.take(code, at, axis=0) ^ mark[:, None], f.rows), np.take(shares, place, axis=0), leaf[at] // places % FAN


def frequent(table: DataFrame) -> Frequent:
    """The ``TOP`` most frequent tokens."""
    totals = table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.expr("int(place = 1 AND c > 0)")), F.lit(0))).first()
    top = table.filter("place = 1 AND c > 0").select("word", "c").orderBy(F.desc("c"), "word").limit(TOP).collect()
    return Frequent([r.word for r in top], np.array([r.c for r in top], float), int(totals[0]), int(totals[1]))


def numbered(docs: DataFrame, table: DataFrame, words: list[str], total: int, distinct: int) -> DataFrame:
    """doc_id, train, n_tokens, n_known, base_score and the names of all tokens: texts meet the counts of their block's tokens.

    ``names`` holds two bytes a token (``RARE``: the next four bytes of ``rest``, less ``NAMES``).
    """
    z = np.log10(total + 0.5 * (distinct + 1))
    columns = ["doc_id", "train", "n_tokens", "n_known", "base_score", "names", "rest"]
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.binary()]

    def run(texts: pa.Table, counts: pa.Table) -> pa.Table:
        # one lookup per token: its place in the block's table, from which follow count and name
        word = pa.concat_arrays([pa.array([], pa.string()), *(x.cast(pa.string()) for x in counts["word"].chunks)])
        missing, c = len(word), np.append(counts["c"].to_numpy(), 0)  # the last place is that of tokens without a count
        end = pc.index(word, END).as_py() % (missing + 1)  # -1: missing
        top = pc.fill_null(pc.index_in(word, pa.array(words, pa.string())), -1).to_numpy()
        crc = np.fromiter(map(zlib.crc32, word.cast(pa.binary()).to_pylist()), np.int64, len(word))
        name = np.append(np.where(top < 0, crc + NAMES, top), NAMES - 1)
        one, known = np.log10(c + 0.5) - z, (c > 0).astype(np.int64)
        short, rare = np.where(name < NAMES, name, RARE).astype(np.uint16), name >= NAMES
        rest = np.where(rare, name - NAMES, 0).astype(np.uint32)
        parts = [[pa.array([], x)] for x in types[2:]]
        for part in (p for chunk in texts["text"].chunks for p in _parts(chunk)):
            found, sizes = split(part)
            at = pc.fill_null(pc.index_in(found, word), missing).to_numpy()
            at = np.insert(at, np.cumsum(sizes), end)
            ends = np.cumsum(sizes + 1)
            starts = ends - sizes - 1
            others = rare[at]
            before = np.append(0, np.cumsum(others))
            names, more = short[at], rest[at[others]]
            new = [sizes + 1, np.add.reduceat(known[at], starts), np.add.reduceat(one[at], starts),
                   [names[a:b].tobytes() for a, b in zip(starts, ends)],
                   [more[a:b].tobytes() for a, b in zip(before[starts], before[ends])]]
            for done, x, kind in zip(parts, new, types[2:]):
                done.append(pa.array(x, kind))
        pa.default_memory_pool().release_unused()
        return pa.Table.from_arrays([texts["doc_id"], texts["train"], *map(pa.chunked_array, parts)], names=columns).combine_chunks()

    counts = table.filter("c > 0").select("block", "word", "c")
    rows = (docs.groupBy("block").cogroup(counts.groupBy("block"))
            .applyInArrow(run, "doc_id long, train boolean, n_tokens long, n_known long, base_score double, names binary, rest binary"))
    return written(rows, "names")


def _stored(batches: Iterator[pd.DataFrame], most: int = 1 << 18) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Runs of numbered documents of bounded length: the rows, the names of all tokens, and where each text starts."""
    for batch in batches:
        ends = np.cumsum(batch["n_tokens"].to_numpy(np.int64))
        first, done = 0, 0
        while first < len(batch):
            last = max(int(np.searchsorted(ends, done + most, "right")), first + 1)
            rows = batch.iloc[first:last]
            names = np.frombuffer(b"".join(rows["names"]), np.uint16).astype(np.int64)
            names[names == RARE] = np.frombuffer(b"".join(rows["rest"]), np.uint32).astype(np.int64) + NAMES
            yield rows, names, np.append(0, ends[first:last - 1] - done)
            first, done = last, int(ends[last - 1])


def summed(rows: DataFrame, widths: list[int]) -> list[np.ndarray]:
    """Sum of the tasks' arrays: rows of binaries, added up in a few tasks before the driver."""
    names = [f"x{i}" for i in range(len(widths))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = [np.zeros(w) for w in widths]
        for batch in batches:
            for name, t in zip(names, total):
                for x in batch[name]:
                    t += np.frombuffer(x, np.float32)
        yield pd.DataFrame([[t.astype(np.float32).tobytes() for t in total]], columns=names)

    schema = ", ".join(f"{n} binary" for n in names)
    out = [np.zeros(w) for w in widths]
    for row in rows.repartition(4).mapInPandas(run, schema).collect():
        for t, x in zip(out, row):
            t += np.frombuffer(x, np.float32)
    return out


def frame(table: DataFrame, docs: DataFrame, top: Frequent | None = None) -> Frame:
    """Frequent tokens and classes: k-means over what a token follows, cut by frequency."""
    words, c, n, v = top = top or frequent(table)
    if "names" not in docs.columns:
        docs = numbered(docs, table, words, n, v)
    number = {w: i for i, w in enumerate(words)}
    width = len(words) * NEAR

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros(max(width, 1))
        for _, names, starts in _stored(batches):
            before, now = names[:-1], names[1:]
            ok = (before < NEAR) & (now < len(words))
            ok[starts[1:] - 1] = False
            out += np.bincount(now[ok] * NEAR + before[ok], minlength=max(width, 1))
        yield pd.DataFrame({"x0": [out.astype(np.float32).tobytes()]})

    classes = np.full(len(words) + 1, CLASSES - 1)
    if words:
        seen = summed(docs.filter("train").select("n_tokens", "names", "rest").mapInPandas(follow, "x0 binary"), [width])[0].reshape(-1, NEAR)
        group = _cluster(np.sqrt(seen), c)
        for g in range(GROUPS):
            own = np.flatnonzero(group == g)
            mass = np.cumsum(c[own]) - c[own] / 2
            classes[own] = g * TIERS + (np.minimum(mass / max(c[own].sum(), 1) * TIERS, TIERS - 1)).astype(int)
        if END in number:
            classes[number[END]] = CLASSES - 2
    z = n + 0.5 * (v + 1)
    mass = np.bincount(classes[:-1], c + 0.5, CLASSES) if words else np.zeros(CLASSES)
    mass[CLASSES - 1] = z - mass.sum()
    largest = int(np.bincount(classes[:-1], minlength=1).max()) if words else 1
    levels = max(OTHER_LEVELS, next((k for k in range(1, LEVELS) if largest <= FAN ** k), LEVELS))
    leaves = FAN ** levels
    rank, tree = np.zeros(len(words), np.int64), np.zeros((CLASSES, leaves))
    for k in range(CLASSES - 1):
        own = np.flatnonzero(classes[:-1] == k)
        rank[own] = np.arange(len(own))
        tree[k, :len(own)] = c[own] + 0.5
    # all other tokens by hash: what all tokens have, less the frequent ones
    name = F.crc32(F.col("word").cast("binary")) % FAN ** OTHER_LEVELS
    for r in table.filter("place = 1 AND c > 0").groupBy(name.alias("leaf")).agg(F.sum(F.col("c") + 0.5).alias("m")).collect():
        tree[-1, r.leaf] = r.m
    np.subtract.at(tree[-1], np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) % FAN ** OTHER_LEVELS for w in words], np.int64), c + 0.5)
    tree[-1] = np.maximum(np.round(tree[-1], 1), 0)
    tree[-1, 0] += 0.5  # the unknown token
    rows = min(max(ROWS, 1 << v.bit_length()), MOST_ROWS)
    shares = _tree(tree)
    return Frame(words, classes, np.log10(np.maximum(mass, 1e-300) / z), n, v, rank, shares, rows, [(x > -60).sum(1) > 1 for x in shares])


def _cluster(x: np.ndarray, weight: np.ndarray, seed: int = 1) -> np.ndarray:
    """Spherical k-means into ``GROUPS`` groups."""
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = x / np.maximum(norm, 1e-9)
    centre = x[:1]
    while len(centre) < min(GROUPS, len(x)):  # the heaviest of what lies far from all centres
        far = (1 - (x @ centre.T).max(1)) * np.sqrt(weight) * (norm[:, 0] > 0)
        centre = np.vstack((centre, x[far.argmax()]))
    group = np.zeros(len(x), int)
    for _ in range(20):
        group = (x @ centre.T).argmax(1)
        for g in range(len(centre)):
            m = (x[group == g] * np.sqrt(weight[group == g])[:, None]).sum(0)
            if np.linalg.norm(m):
                centre[g] = m / np.linalg.norm(m)
    return group


def context(ids: np.ndarray, starts: np.ndarray, rare: int, names: np.ndarray | None = None) -> np.ndarray:
    """Feature hashes (tokens, 4) of each token's context; ``names`` tell apart tokens that aren't frequent."""
    n = len(ids)
    names = ids if names is None else names
    first = np.zeros(n, np.int64)
    first[starts[starts < n]] = 1
    text = np.cumsum(first) - 1
    begin = starts[text]
    at = np.arange(n)
    outside = rare + 1

    def back(place: np.ndarray) -> np.ndarray:
        return np.where(place >= begin, names[np.maximum(place, 0)], outside)

    frequent = ids != rare
    known = np.flatnonzero(frequent)
    before = np.cumsum(frequent) - frequent  # how many frequent tokens stand before
    padded = np.concatenate(([-1, -1], known))
    p1, p2, k1, k2 = back(at - 1), back(at - 2), back(padded[before + 1]), back(padded[before])
    p1, p2, k1, k2 = (x.astype(np.uint64) for x in (p1, p2, k1, k2))
    wide, four = np.uint64(0x9FB21C651E98DF25), np.uint64(4)
    code = np.stack((p1 * four + np.uint64(1), (p1 * wide + p2) * four + np.uint64(2), k1 * four + np.uint64(3), (k1 * wide + k2) * four), 1)
    code *= np.uint64(0x9E3779B97F4A7C15)
    code ^= code >> np.uint64(29)
    code *= np.uint64(0xBF58476D1CE4E5B9)
    return code ^ (code >> np.uint64(32))


def feature_rows(code: np.ndarray, rows: int) -> np.ndarray:
    """Rows of the weights for feature hashes."""
    return (code * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - rows.bit_length() + 1)).astype(np.int64)


def logits(weights: np.ndarray, rows: np.ndarray, bias: np.ndarray | None = None) -> np.ndarray:
    """Sums of each token's rows of the weights; without ``bias`` the last row of the weights is it."""
    z = weights.take(rows[:, 0], 0)
    for i in range(1, rows.shape[1]):
        z += weights.take(rows[:, i], 0)
    z += weights[-1] if bias is None else bias
    return z


def class_log(weights: np.ndarray, rows: np.ndarray, bias: np.ndarray | None = None) -> np.ndarray:
    """Natural log of P(class | context)."""
    z = logits(weights, rows, bias)
    z -= z.max(1, keepdims=True)
    z -= np.log(np.exp(z).sum(1, keepdims=True))
    return z


def softmax(weights: np.ndarray, rows: np.ndarray, truth: np.ndarray, bias: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exponentials of the logits up to a factor per token, their sums, and the natural log of P(truth | context).

    The largest logit of each token is only taken off where the exponentials would leave the middle of the range.
    """
    one, all_ones = np.arange(len(rows)), np.ones(weights.shape[1], np.float32)
    for scale in (False, True):
        z = logits(weights, rows, bias)
        if scale:
            z -= z.max(1, keepdims=True)
        elif z.max(initial=0) > 60:
            continue
        own = z[one, truth]
        np.exp(z, out=z)
        total = z @ all_ones
        if scale or total.min(initial=1) > 1e-20:
            return z, total, own - np.log(total)


def train(docs: DataFrame, f: Frame) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the classes (rows + 1, CLASSES) and of the trees (rows + 1, FAN) after all rounds."""
    if "names" not in docs.columns:
        docs = numbered(docs, count_table(docs), f.words, f.total, f.distinct)
    shapes = [(f.rows + 1, CLASSES), (f.rows + 1, FAN)]
    weights = [np.zeros(x, np.float32) for x in shapes]
    weights[0][-1] = f.share * np.log(10)
    for r in range(ROUNDS):
        start = weights

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            w, w2 = (x.copy() for x in start)
            used, used2 = np.zeros(f.rows + 1, np.float32), np.zeros(f.rows + 1, np.float32)
            square, square2 = np.full(f.rows + 1, 1e-6, np.float32), np.full(f.rows + 1, 1e-6, np.float32)
            for _, names, starts in _stored(batches):
                ids, truth, leaf = _targets(names, f)
                code = context(ids, starts, len(f.words), names)
                for k in range(0, len(ids), BATCH):
                    now = slice(k, k + BATCH)
                    _step(w, used, square, feature_rows(code[now], f.rows), truth[now])
                    for _, rows, bias, branch in choices(truth[now], leaf[now], code[now], f):
                        _step(w2, used2, square2, rows, branch, bias)
            yield pd.DataFrame([[w.astype(np.float16).tobytes(), used.tobytes(), w2.astype(np.float16).tobytes(), used2.tobytes()]],
                               columns=["x0", "x1", "x2", "x3"])

        share = docs.filter("train").filter(F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)) == r).select("n_tokens", "names", "rest")
        share = share.coalesce(max(1, f.total // SHARE))
        with small_batches(docs.sparkSession):
            weights = averaged(share.mapInPandas(run, "x0 binary, x1 binary, x2 binary, x3 binary"), start)
    return weights[0], weights[1]


def averaged(rows: DataFrame, start: list[np.ndarray]) -> list[np.ndarray]:
    """Mean of the tasks' weights, row by row, weighted by how often each used it; rows no task used stay as they were.

    Tasks send their weights in half precision; they are added up in a few tasks before the driver.
    """
    shapes = [w.shape for w in start]
    names = ["x0", "x1", "x2", "x3"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = [np.zeros(n, np.float32) for x in shapes for n in (x, x[0])]
        for batch in batches:
            for row in batch[names].itertuples(index=False):
                for k, x in enumerate(shapes):
                    used = np.frombuffer(row[2 * k + 1], np.float32)
                    total[2 * k] += np.frombuffer(row[2 * k], np.float16).reshape(x) * used[:, None]
                    total[2 * k + 1] += used
        yield pd.DataFrame([[t.tobytes() for t in total]], columns=names)

    sums = [np.zeros(n) for x in shapes for n in (x, x[0])]
    for row in rows.repartition(4).mapInPandas(run, ", ".join(f"{n} binary" for n in names)).collect():
        for t, b in zip(sums, row):
            t += np.frombuffer(b, np.float32).reshape(t.shape)
    return [np.where(used[:, None] > 0, total / np.maximum(used, 1e-9)[:, None], old).astype(np.float32)
            for total, used, old in zip(sums[::2], sums[1::2], start)]


def _step(w: np.ndarray, used: np.ndarray, square: np.ndarray, rows: np.ndarray, truth: np.ndarray,
          bias: np.ndarray | None = None) -> None:
    """One gradient step on a batch of tokens, scaled per feature row."""
    e, total, _ = softmax(w, rows, truth, bias)
    off = np.flatnonzero(e[np.arange(len(rows)), truth] < (1 - SURE) * total)  # those that are told well already teach next to nothing
    if not len(off):
        return
    n = len(off)
    g = e.take(off, 0)
    g *= (1 / total[off])[:, None]
    g[np.arange(n), truth[off]] -= 1
    flat = rows.take(off, 0).astype(np.int16).T.reshape(-1)
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    at = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    times = np.diff(np.append(at, len(order)))
    by, sums = run_sums(g, np.tile(np.arange(n), rows.shape[1])[order], at, times)
    hit = flat[at[by]].astype(np.int64)
    size = square[hit] + np.einsum("ij,ij->i", sums, sums)
    square[hit] = size
    sums *= (RATE / np.sqrt(size))[:, None]
    new = w.take(hit, 0)
    new -= sums
    whole = np.dtype((np.void, w.shape[1] * w.itemsize))  # each row as one item, which is stored much faster
    w.view(whole)[hit, 0] = new.view(whole)[:, 0]
    used[hit] += times[by].astype(np.float32)
    if bias is None:
        sums = np.ones(n, np.float32) @ g
        square[-1] += (sums * sums).sum()
        w[-1] -= RATE / np.sqrt(square[-1]) * sums
        used[-1] += n


def run_sums(g: np.ndarray, take: np.ndarray, at: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the runs from long to short (alike from 33 rows on), and in it the sums of g's rows take[at:at + times].

    The first rows of all runs are added, then all second ones, and so on; the few long runs have the rest added each on its own.
    """
    size = np.minimum(times, 33).astype(np.int8)
    by = np.argsort(-size, kind="stable")
    at, times = at[by], times[by]
    live = len(at) - np.cumsum(np.bincount(size, minlength=34))  # at k: runs of more than k rows
    out, ones = g.take(take[at], 0), np.ones(max(times.max() - 32, 0), np.float32)
    for k in range(1, 32):
        if not live[k]:
            break
        out[:live[k]] += g.take(take[at[:live[k]] + k], 0)
    for i in range(live[32]):
        out[i] += ones[:times[i] - 32] @ g.take(take[at[i] + 32:at[i] + times[i]], 0)
    return by, out


def token_gain(classes: np.ndarray, leaf: np.ndarray, code: np.ndarray, f: Frame, weights: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """log10 of P(token | context) over the token's share of all tokens."""
    gain = softmax(weights[0], feature_rows(code, f.rows), classes)[2] / np.log(10) - f.share[classes]
    for at, rows, bias, branch in choices(classes, leaf, code, f):
        gain[at] += (softmax(weights[1], rows, branch, bias)[2] - bias[np.arange(len(at)), branch]) / np.log(10)
    return gain


def score(docs: DataFrame, table: DataFrame, f: Frame, weights: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Contract columns."""
    if "names" not in docs.columns:
        docs = numbered(docs, table, f.words, f.total, f.distinct)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, names, starts in _stored(batches):
            ids, truth, leaf = _targets(names, f)
            gain = np.empty(len(ids))
            code = context(ids, starts, len(f.words), names)
            for k in range(0, len(ids), BATCH):
                now = slice(k, k + BATCH)
                gain[now] = token_gain(truth[now], leaf[now], code[now], f, weights)
            yield pd.DataFrame({"doc_id": rows["doc_id"].astype("Int64").to_numpy(), "held_out": ~rows["train"].to_numpy(bool),
                                "n_tokens": rows["n_tokens"].to_numpy(), "n_known": rows["n_known"].to_numpy(),
                                "base_score": rows["base_score"].to_numpy(), "score": rows["base_score"].to_numpy() + np.add.reduceat(gain, starts)})

    found = docs.mapInPandas(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(f.total).cast("long").alias("train_tokens"), "base_score", "score")


def digest(docs: DataFrame) -> DataFrame:
    """Contract columns of the scoring query."""
    docs = with_block(docs.select("doc_id", "text"))
    table = count_table(docs)
    top = frequent(table)
    docs = numbered(docs, table, top.words, top.total, top.distinct)
    f = frame(table, docs, top)
    return score(docs, table, f, train(docs, f))
