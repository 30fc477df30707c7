"""Alignment of two tokenizers' tokens, with corpus-wide counts of linked id pairs.

Every text is encoded by a byte-level BPE file (A, of a space and the text) and by
a sentencepiece model (B, which adds the space).  Both give the same bytes, so the
offsets where tokens of both end cut the text into groups, and the two tokens that
end there are linked.  A text whose tokens' bytes differ from its own has no tokens.

Counts go through minimal perfect hashing.  A first pass over the token ids, which
are kept, gives each task's linked pairs with their number.  The distinct pairs are
dealt over segments of about ``SEGMENT`` pairs; of each segment a task builds a
minimal perfect hash: a row of bits per level, in which pairs that are alone in
their place stay and all others go on to the next level; a pair's index is the
number of set bits up to its own.  A segment's counts are a dense vector indexed by
that hash; the tasks' numbers are added up into leaf vectors, the leaves along a tree.
A second pass aligns the documents again and looks their links up: hash, key found at
the index compared with the pair (a pair that isn't there is an error), count.

A task of the second pass holds ``SHELF`` segments at most, read from the shared
folder; with more, the ids are passed over once per shelf and the documents' sums
added, so memory doesn't grow with the number of pairs.  What the driver sees is
bounded by the vocabularies.

Defined cases: null and empty texts have no tokens: zeros and ''; repeated rows and
rows without doc_id are counted and returned each; an empty table gives an empty
result; other columns are ignored.  Texts are encoded whole, whatever their length.
Of a B id's pairs with equal counts all are its best.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outcomelens.llm.common import open_store, shared_path, written

SEGMENT = 1 << 18  # pairs of a segment, about
SHELF = 16  # segments that a task holds
LEAF = 1 << 20  # rows of pair numbers added up together
FAN = 16  # vectors added together
ROOM = 2  # places per pair in a level
_PIECE = 2_000_000  # characters handled together
#: The split of a byte-level BPE into words, as public tokenizer files name it.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes are themselves, others follow from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """Tokenizer A, from the content of its file."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        letter = byte_letters()
        self.content = content
        size = 1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
        self.bytes = [b""] * size
        special = {t["content"] for t in spec["added_tokens"]}
        for token, i in spec["model"]["vocab"].items():
            self.bytes[i] = token.encode() if token in special else bytes(letter[c] for c in token)
        ranks = {b: i for i, b in enumerate(self.bytes) if b and i not in {t["id"] for t in spec["added_tokens"]}}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        made = [ranks.get(bytes(letter[c] for c in a + b), -1) for a, b in merges]
        # merges in the order of their ids, and the usual split: the faster library gives the same ids
        usual = (made == list(range(256, 256 + len(made))) and spec["normalizer"] is None and spec["pre_tokenizer"].get("type") == "ByteLevel"
                 and not spec["pre_tokenizer"].get("add_prefix_space") and spec["pre_tokenizer"].get("use_regex", True)
                 and not spec["model"].get("ignore_merges"))
        self.ranks = ranks if usual else None

    def encoder(self):
        if self.ranks is not None:
            import tiktoken
            whole = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=self.ranks, special_tokens={})
            return lambda texts: [whole.encode_ordinary(t) for t in texts]
        from tokenizers import Tokenizer
        whole = Tokenizer.from_str(self.content.decode())
        whole.encode_special_tokens = True
        whole.no_truncation()
        whole.no_padding()
        return lambda texts: [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


class Pieces:
    """Tokenizer B, from the content of its file."""

    def __init__(self, content: bytes):
        self.content = content
        model = self.model()
        self.bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()
                      for i, p in enumerate(model.id_to_piece(list(range(model.get_piece_size()))))]

    def model(self):
        from sentencepiece import SentencePieceProcessor
        return SentencePieceProcessor(model_proto=self.content)

    def encoder(self):
        model = self.model()
        return lambda texts: model.encode(texts, num_threads=1)


def _id_type(table: list[bytes]) -> str:
    return "<u2" if len(table) <= 1 << 16 else "<u4"


def _pieces(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of rows that hold ``most`` together, or a single larger row."""
    start = size = 0
    for i, n in enumerate(sizes):
        if size and size + n > most:
            yield slice(start, i)
            start, size = i, 0
        size += int(n)
    if start < len(sizes):
        yield slice(start, len(sizes))


def encode(docs: DataFrame, a: ByteLevel, b: Pieces) -> DataFrame:
    """row (a number of its own), doc_id, a, b (token ids as little-endian numbers, none where there are no tokens)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of_a, of_b = a.encoder(), b.encoder()
        types = _id_type(a.bytes), _id_type(b.bytes)
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            ids: tuple[list, list] = ([], [])
            for now in _pieces(np.fromiter(map(len, texts), np.int64, len(texts)), _PIECE):
                part = texts[now]
                for t, x, y in zip(part, of_a([f" {t}" for t in part]), of_b(part)):
                    whole = b" " + t.encode()
                    fine = t and b"".join(map(a.bytes.__getitem__, x)) == whole == b"".join(map(b.bytes.__getitem__, y))
                    for out, found, kind in zip(ids, (x, y), types):
                        out.append(np.array(found, kind).tobytes() if fine else b"")
            yield pd.DataFrame({"row": batch["row"], "doc_id": batch["doc_id"].astype("Int64"), "a": ids[0], "b": ids[1]})

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(rows.mapInPandas(run, "row long, doc_id long, a binary, b binary"), "token-ids")


class Aligned:
    """The alignment of some documents' tokens, one document after the other."""

    def __init__(self, a: pd.Series, b: pd.Series, tables: tuple[np.ndarray, np.ndarray], types: tuple[str, str]):
        self.ids, self.count = [], []  # per tokenizer all ids, and how many each document has
        for column, kind in zip((a, b), types):
            self.ids.append(np.frombuffer(b"".join(column), kind).astype(np.int64))
            self.count.append(np.fromiter(map(len, column), np.int64, len(column)) // np.dtype(kind).itemsize)
        ends = [np.cumsum(t[i]) for t, i in zip(tables, self.ids)]
        mark = np.zeros(int(ends[0][-1]) + 1 if len(ends[0]) else 1, np.int8)
        mark[ends[0]] = 1
        mark[ends[1]] += 2
        self.last = [mark[e] == 3 for e in ends]  # tokens that end where one of the other side ends
        self.pairs = self.ids[0][self.last[0]] << 32 | self.ids[1][self.last[1]]
        start = np.concatenate(([0], np.cumsum(self.count[0])))
        upto = np.concatenate(([0], np.cumsum(self.last[0])))
        self.groups = np.diff(upto[start])  # per document
        self.ends = ends

    def texts(self, names: list[bytes], second: int) -> list[bytes]:
        """Per document its groups in words; ``names`` has of each id one form within a group and one at its end, B's from ``second`` on."""
        at = [np.flatnonzero(x) + 1 for x in self.last]
        group = [np.cumsum(x) - x for x in self.last]
        code = np.empty(len(self.ids[0]) + len(self.ids[1]), np.int64)
        code[np.arange(len(self.ids[0])) + np.concatenate(([0], at[1]))[group[0]]] = 2 * self.ids[0] + self.last[0]
        code[np.arange(len(self.ids[1])) + at[0][group[1]]] = second + 2 * self.ids[1] + self.last[1]
        words = list(map(names.__getitem__, code.tolist()))
        ends = np.cumsum(self.count[0] + self.count[1]).tolist()
        return [b"".join(words[s:e])[:-1] for s, e in zip([0, *ends], ends)]


class Reader:
    """What tasks need to align kept token ids."""

    def __init__(self, a: ByteLevel, b: Pieces):
        self.types = _id_type(a.bytes), _id_type(b.bytes)
        self.tables = tuple(np.fromiter(map(len, t), np.int64, len(t)) for t in (a.bytes, b.bytes))
        self.second = 2 * len(a.bytes)

    def names(self) -> list[bytes]:
        """Per id its decimal number with the mark that follows it within a group and at the end of its side."""
        sides = [(len(t), end) for t, end in zip(self.tables, (b"|", b";"))]
        return list(chain.from_iterable((b"%d," % i, b"%d" % i + end) for n, end in sides for i in range(n)))

    def aligned(self, batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, Aligned]]:
        for batch in batches:
            for now in _pieces(np.fromiter(map(len, batch["a"]), np.int64, len(batch)), _PIECE):
                part = batch.iloc[now]
                yield part, Aligned(part["a"], part["b"], self.tables, self.types)


def groups(ids: DataFrame, reader: Reader) -> DataFrame:
    """row, doc_id, group (from 1), start, stop (bytes, of a space and the text), a_ids, b_ids: a row per group."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, x in reader.aligned(batches):
            at = [np.flatnonzero(last) + 1 for last in x.last]
            doc = np.repeat(np.arange(len(part)), x.groups)
            first = np.concatenate(([0], np.cumsum(x.groups)))[:-1]
            stop = x.ends[0][x.last[0]]
            base = np.concatenate(([0], stop))[first][doc]
            start = np.concatenate(([0], stop))[:len(stop)]
            yield pd.DataFrame({"row": part["row"].to_numpy()[doc], "doc_id": part["doc_id"].astype("Int64").array[doc],
                                "group": np.arange(len(doc)) - first[doc] + 1, "start": start - base, "stop": stop - base,
                                "a_ids": np.split(x.ids[0], at[0])[:-1] if len(doc) else [], "b_ids": np.split(x.ids[1], at[1])[:-1] if len(doc) else []})

    return ids.select("row", "doc_id", "a", "b").mapInPandas(
        run, "row long, doc_id long, group long, start long, stop long, a_ids array<long>, b_ids array<long>")


def pair_numbers(ids: DataFrame, reader: Reader) -> DataFrame:
    """pair, n: the links of each task's documents, by pair of ids."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, number = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for _, x in reader.aligned(batches):
            pair, n = np.unique(x.pairs, return_counts=True)
            held, place = np.unique(np.concatenate((held, pair)), return_inverse=True)
            number = np.bincount(place, np.concatenate((number, n)), len(held)).astype(np.int64)
            if len(held) > 1 << 21:
                yield pd.DataFrame({"pair": held, "n": number})
                held, number = held[:0], number[:0]
        yield pd.DataFrame({"pair": held, "n": number})

    return written(ids.select("a", "b").mapInPandas(run, "pair long, n long"), "pair-numbers")


def _hash(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    return (_hash(keys, -1) % np.uint64(segments)).astype(np.int64)


class Perfect:
    """A minimal perfect hash of distinct keys: their numbers are 0 to n - 1."""

    def __init__(self, bits: np.ndarray, sizes: list[int], keys: np.ndarray | None = None):
        self.bits, self.sizes, self.keys = bits, [int(s) for s in sizes], keys
        self.upto = np.cumsum(bits, dtype=np.int64)

    @staticmethod
    def of(keys: np.ndarray) -> Perfect:
        left, rows = keys, []
        while len(left):
            size = max(ROOM * len(left), 8)
            place = (_hash(left, len(rows)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            rows.append(alone)
            left = left[~alone[place]]
        out = Perfect(np.concatenate(rows) if rows else np.zeros(0, bool), [len(r) for r in rows])
        out.keys = np.empty(len(keys), np.int64)
        out.keys[out.index(keys)] = keys
        return out

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; of a foreign key any number, or -1."""
        out = np.full(len(keys), -1, np.int64)
        left, start = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            place = start + (_hash(keys[left], level) % np.uint64(size)).astype(np.int64)
            hit = self.bits[place]
            out[left[hit]] = self.upto[place[hit]] - 1
            left, start = left[~hit], start + size
        return out

    def verified(self, keys: np.ndarray) -> np.ndarray:
        """As ``index``, but every key must be one that was hashed."""
        at = self.index(keys)
        if (at < 0).any() or (self.keys[at] != keys).any():
            raise KeyError("a pair that was not hashed")
        return at


_TABLE = "seg long, sizes array<long>, bits binary, keys binary"


def _perfect(row) -> Perfect:
    n = int(sum(row.sizes))
    return Perfect(np.unpackbits(np.frombuffer(row.bits, np.uint8), count=n).astype(bool), row.sizes, np.frombuffer(row.keys, np.int64))


def _with_segment(rows: DataFrame, segments: int, schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(seg=segment_of(batch["pair"].to_numpy(np.int64), segments))
    return rows.mapInPandas(run, schema)


def hashed(numbers: DataFrame) -> tuple[DataFrame, int]:
    """A minimal perfect hash of each segment of the distinct pairs, and how many segments there are."""
    keys = written(numbers.select("pair").distinct(), "pairs")
    segments = -(-keys.count() // SEGMENT)

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        p = Perfect.of(np.sort(rows["pair"].to_numpy(np.int64)))
        return pd.DataFrame([(rows["seg"].iloc[0], p.sizes, np.packbits(p.bits).tobytes(), p.keys.tobytes())], columns=["seg", "sizes", "bits", "keys"])

    rows = _with_segment(keys, max(segments, 1), "pair long, seg long")
    return written(rows.groupBy("seg").applyInPandas(build, _TABLE), "perfect-hashes"), segments


def counted(numbers: DataFrame, table: DataFrame, segments: int) -> DataFrame:
    """seg, counts: of each segment the dense vector of its pairs' counts, by their hash."""
    leaves = max(1, -(-numbers.count() // (max(segments, 1) * LEAF)))

    def leaf(rows: pd.DataFrame, hashes: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"seg": [], "part": [], "counts": []})
        p = _perfect(next(hashes.itertuples(index=False)))
        at = p.verified(rows["pair"].to_numpy(np.int64))
        vector = np.zeros(len(p.keys), np.int64)
        np.add.at(vector, at, rows["n"].to_numpy(np.int64))
        return pd.DataFrame({"seg": [rows["seg"].iloc[0]], "part": [rows["part"].iloc[0]], "counts": [vector.tobytes()]})

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        total = reduce(np.add, (np.frombuffer(c, np.int64) for c in rows["counts"]))
        return pd.DataFrame({"seg": [rows["seg"].iloc[0]], "part": [rows["part"].iloc[0]], "counts": [total.tobytes()]})

    schema = "seg long, part long, counts binary"
    rows = (_with_segment(numbers, max(segments, 1), "pair long, n long, seg long")
            .withColumn("part", F.pmod(F.xxhash64("pair", "n"), F.lit(leaves))))
    hashes = table.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(leaves - 1).cast("long"))))
    out = rows.groupBy("seg", "part").cogroup(hashes.groupBy("seg", "part")).applyInPandas(leaf, schema)
    while leaves > 1:
        leaves = -(-leaves // FAN)
        out = out.withColumn("part", F.floor(F.col("part") / FAN).cast("long")).groupBy("seg", "part").applyInPandas(added, schema)
    return out.select("seg", "counts")


def pair_counts(table: DataFrame) -> DataFrame:
    """a_id, b_id, count of every linked pair, from the kept table of ``counts``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for keys, counts in zip(batch["keys"], batch["counts"]):
                key = np.frombuffer(keys, np.int64)
                yield pd.DataFrame({"a_id": key >> 32, "b_id": key & 0xFFFFFFFF, "count": np.frombuffer(counts, np.int64)})

    return table.select("keys", "counts").mapInPandas(run, "a_id long, b_id long, count long")


def counts(ids: DataFrame, reader: Reader) -> tuple[DataFrame, str, int]:
    """The table of hashes and counts, the shared folder it is kept in by shelf, and the number of segments."""
    numbers = pair_numbers(ids, reader)
    hashes, segments = hashed(numbers)
    path = shared_path(ids.sparkSession, "pair-counts")
    (hashes.join(counted(numbers, hashes, segments), "seg").withColumn("shelf", F.floor(F.col("seg") / SHELF).cast("long"))
     .write.partitionBy("shelf").parquet(path))
    table = ids.sparkSession.read.schema(f"{_TABLE}, counts binary, shelf long").parquet(path)
    return table, path, segments


class Shelf:
    """Some segments' hashes and counts, in a task's memory."""

    def __init__(self, path: str, shelf: int, segments: int):
        from pyarrow import dataset
        store, place = open_store(f"{path}/shelf={shelf}")
        rows = dataset.dataset(place, filesystem=store, format="parquet").to_table().to_pandas()
        self.segments = segments
        self.held = {int(r.seg): (_perfect(r), np.frombuffer(r.counts, np.int64)) for r in rows.itertuples(index=False)}

    def look_up(self, pairs: np.ndarray) -> np.ndarray:
        """Counts of the pairs; 0 of those on other shelves."""
        out = np.zeros(len(pairs), np.int64)
        seg = segment_of(pairs, self.segments)
        for k, (hashes, numbers) in self.held.items():
            own = np.flatnonzero(seg == k)
            out[own] = numbers[hashes.verified(pairs[own])]
        return out


_SUMS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def looked_up(ids: DataFrame, reader: Reader, path: str, shelf: int, segments: int, best: np.ndarray) -> DataFrame:
    """Per document its numbers, with the counts of one shelf's pairs; the first shelf has what needs no counts."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = Shelf(path, shelf, segments) if segments else None
        names = reader.names() if shelf == 0 else []
        for part, x in reader.aligned(batches):
            unique, place = np.unique(x.pairs, return_inverse=True)
            count = held.look_up(unique) if held else np.zeros(0, np.int64)
            top = (count > 0) & (count == best[unique & 0xFFFFFFFF])
            upto = np.concatenate(([0], np.cumsum(x.groups)))
            sums = [np.diff(np.concatenate(([0], np.cumsum(v[place])))[upto]) for v in (top.astype(np.int64), count)]
            texts = x.texts(names, reader.second) if shelf == 0 else [b""] * len(part)
            first = int(shelf == 0)
            yield pd.DataFrame({"row": part["row"], "doc_id": part["doc_id"].astype("Int64"), "n_a": x.count[0] * first, "n_b": x.count[1] * first,
                                "n_groups": x.groups * first, "n_links": x.groups * first, "n_best": sums[0], "count_sum": sums[1],
                                "groups_sha256": [hashlib.sha256(t).hexdigest() if t else "" for t in texts]})

    return ids.mapInPandas(run, _SUMS)


def digest(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Contract columns, a row per document; the two files are read by the driver and sent along with the tasks."""
    with open(a_path, "rb") as f, open(b_path, "rb") as g:
        a, b = ByteLevel(f.read()), Pieces(g.read())
    ids = encode(docs, a, b)
    reader = Reader(a, b)
    table, path, segments = counts(ids, reader)
    best = np.zeros(len(b.bytes), np.int64)
    for r in pair_counts(table).groupBy("b_id").agg(F.max("count").alias("c")).collect():  # one per B id
        best[r.b_id] = r.c
    parts = [looked_up(ids, reader, path, k, segments, best) for k in range(max(-(-segments // SHELF), 1))]
    sums = [F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return (reduce(DataFrame.unionAll, parts).groupBy("row", "doc_id").agg(*sums, F.max("groups_sha256").alias("groups_sha256"))
            .drop("row"))
