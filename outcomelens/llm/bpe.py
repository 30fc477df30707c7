"""BPE encoding and decoding with bounded lookahead.

Encoding is a streaming transducer: symbols enter one piece at a time, a token
leaves as soon as no continuation can change it.  ``lookahead`` derives from
the merge list how many symbols past a token's start can matter, so a piece of
any length needs a buffer of constant size.  Decoding is a state machine over
bytes that emits text whenever a character is complete.

Defined cases: a null text counts as empty (no tokens, empty decoded text);
strings of special tokens in the text become those tokens, as the library does
by default.  Repeated rows are encoded each; an empty table gives an empty result;
texts of any length pass through in slices, pieces of any length in runs of symbols.
Merges of equal rank go from left to right.  Only the named text column is read, so
other columns may have any name; ``digest`` reads doc_id and text.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import islice

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"
_SLICE = 1 << 16  # characters normalised at a time, cut at white space
_RUN = 1 << 12  # symbols of a long piece taken, and ids of it given out, at a time
_CACHE = 1 << 18  # pieces remembered by a task


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else 256 onwards in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def lookahead(merges: list[tuple[str, str]], length) -> int:
    """Symbols counted from a token's start that can decide whether it stays.

    ``reach[t]`` bounds this for token t under the merges seen so far.  Merge
    (u, v) looks at u and, past it, at all that decides v; whether it happens
    then bears on u, on v and on the new token.  One pass in rank order.
    """
    reach: dict[str, int] = {}
    for u, v in merges:
        r = max(reach.get(u, length(u)), length(u) + reach.get(v, length(v)))
        reach[u] = max(reach.get(u, 0), r)
        reach[v] = max(reach.get(v, length(v)), r - length(u))
        reach[u + v] = max(reach.get(u + v, 0), r)
    return max(reach.values(), default=1)


class Transducer:
    """Vocabulary, merge ranks and the stable-prefix encoder of one tokenizer file."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.symbols = byte_symbols()
        end = self.suffix
        self.lookahead = lookahead(merges, lambda t: len(t) - (len(end) if end and t.endswith(end) else 0))
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        split = "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))
        self.special_at = regex.compile(f"({split})") if split else None
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.decoder = (spec.get("decoder") or {}).get("type")
        self.lower = False
        self.forms: list[str] = []
        normal = spec.get("normalizer") or {}
        for step in normal.get("normalizers", [normal] if normal else []):
            if step["type"] == "Lowercase":
                self.lower = True
            elif step["type"] in ("NFC", "NFKC", "NFD", "NFKD"):
                self.forms.append(step["type"])
        pre = spec.get("pre_tokenizer") or {}
        pattern = next((x["pattern"]["Regex"] for x in pre.get("pretokenizers", []) if x["type"] == "Split"), None)
        if pattern is None or spec["pre_tokenizer"]["pretokenizers"][0].get("behavior") != "Removed":
            raise ValueError("the tokenizer file must split text by a pattern whose matches are the pieces")
        self.piece = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))

    def merge(self, parts: list[str]) -> list[str]:
        """Apply the merges to a bounded run of symbols, lowest rank first, leftmost first."""
        rank, never = self.rank.get, 1 << 60
        ranks = [rank(pair, never) for pair in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == never:
                break
            i = ranks.index(low)
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), never)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), never)
        return parts

    def stream(self, symbols: Iterable[str]) -> Iterator[str]:
        """Tokens of one piece, each as soon as it is stable; the last symbol carries the suffix."""
        held: list[str] = []
        room = 4 * self.lookahead
        for s in symbols:
            held.append(s)
            if len(held) >= room:
                at = 0
                for token in self.merge(held[:]):
                    if at + self.lookahead + 1 >= len(held):  # the last symbol may still take the suffix
                        break
                    yield token
                    at += len(token)
                held = held[at:]
        if held:
            held[-1] += self.suffix
            yield from self.merge(held)

    def piece_ids(self, piece: str) -> tuple[int, ...]:
        """Ids of a short piece, which ends before anything could leave early."""
        symbols = [self.symbols[b] for b in piece.encode()]
        symbols[-1] += self.suffix
        return tuple(map(self.vocab.__getitem__, self.merge(symbols)))

    def long_piece_ids(self, piece: str) -> Iterator[tuple[int, ...]]:
        """Ids of a piece of any length as they become stable, ``_RUN`` at a time."""
        letters = (piece[k:k + _RUN] for k in range(0, len(piece), _RUN))
        stable = self.stream(self.symbols[b] for part in letters for b in part.encode())
        while run := tuple(map(self.vocab.__getitem__, islice(stable, _RUN))):
            yield run

    def normal(self, text: str) -> str:
        for form in self.forms:
            text = unicodedata.normalize(form, text)
        if self.lower:  # character by character: no final-sigma rule
            text = text.lower() if "Σ" not in text else "".join(map(str.lower, text))
        return text

    def ids(self, text: str, cache: dict[str, tuple[int, ...]]) -> Iterator[tuple[int, ...]]:
        """Token ids of a text, slice by slice."""
        parts = self.special_at.split(text) if self.special_at else [text]
        for part in parts:
            if part in self.special:
                yield (self.special[part],)
                continue
            for piece_text in _slices(part):
                out: list[int] = []
                for match in self.piece.finditer(self.normal(piece_text)):
                    piece = match[0]
                    got = cache.get(piece)
                    if got is None:
                        if len(piece) >= self.lookahead:
                            if out:
                                yield tuple(out)
                                out = []
                            yield from self.long_piece_ids(piece)
                            continue
                        got = self.piece_ids(piece)
                        if len(piece) <= 64:
                            if len(cache) >= _CACHE:
                                cache.clear()
                            cache[piece] = got
                    out.extend(got)
                if out:
                    yield tuple(out)


def _slices(text: str) -> Iterator[str]:
    """Cut after white space into slices of about ``_SLICE`` characters."""
    at = 0
    space = regex.compile(r"\p{White_Space}")
    while len(text) - at > _SLICE:
        cut = space.search(text, at + _SLICE)
        if cut is None:
            break
        yield text[at:cut.end()]
        at = cut.end()
    yield text[at:]


class Decoder:
    """Incremental decoding: tokens in, text out as soon as its bytes are whole."""

    def __init__(self, transducer: Transducer):
        self.plain = transducer.decoder is None  # no decoder in the file: tokens joined by one space
        self.begun = False
        self.tokens = transducer.tokens
        self.byte = {} if self.plain else {s: bytes([b]) for b, s in enumerate(transducer.symbols)}
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        if self.plain:
            text = " ".join(map(self.tokens.__getitem__, ids))
            text = f" {text}" if self.begun and text else text
            self.begun = self.begun or bool(text)
            return text
        byte = self.byte
        return self.state.decode(b"".join(byte.get(c) or c.encode() for i in ids for c in self.tokens[i]))

    def close(self) -> str:
        return "" if self.plain else self.state.decode(b"", True)


def content(path: str) -> str:
    """The tokenizer file, read by the driver: it goes to the tasks with their function, so only the driver needs the path."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def load(path: str) -> Transducer:
    return Transducer(json.loads(content(path)))


def encode(text: Column, path: str) -> Column:
    """Token ids of a text column (null: no tokens)."""
    spec = content(path)

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t, cache = Transducer(json.loads(spec)), {}
        for batch in texts:
            yield pd.Series([[i for part in t.ids(x or "", cache) for i in part] for x in batch], dtype=object)
    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<int>")(text)


def decode(ids: Column, path: str) -> Column:
    """Text of a column of token ids (null: empty)."""
    spec = content(path)

    def run(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = Transducer(json.loads(spec))
        for batch in rows:
            out = []
            for row in batch:
                d = Decoder(t)
                out.append(d.feed(() if row is None else map(int, row)) + d.close())
            yield pd.Series(out, dtype=object)
    run.__annotations__ = {"rows": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "string")(ids)


def round_trip(text: Column, path: str) -> Column:
    """Encode, decode, and hash both streams while they pass: a struct of the digest columns."""
    spec = content(path)

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        t, cache = Transducer(json.loads(spec)), {}
        numeral = {i: str(i) for i in t.tokens}
        for batch in texts:
            rows = []
            for x in batch:
                n, ids_hash, text_hash, decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder(t)
                for ids in t.ids(x or "", cache):
                    ids_hash.update((" " * bool(n) + " ".join(map(numeral.__getitem__, ids))).encode())
                    text_hash.update(decoder.feed(ids).encode())
                    n += len(ids)
                text_hash.update(decoder.close().encode())
                rows.append((n, ids_hash.hexdigest(), text_hash.hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, DIGEST)(text)


def digest(docs: DataFrame, path: str) -> DataFrame:
    """Contract columns of the encoding query."""
    return docs.select("doc_id", round_trip(F.col("text"), path).alias("__t")).select("doc_id", "__t.*")
