import hashlib
import random

import pytest

from outcomelens.llm import bpe
from outcomelens.llm.queries import vocabulary

ODD = ["Σ", "ΑΣ ", "İ", "é", "\x1c", "\x85", "​", "<|endoftext|>", "<|startoftext|>", "'s", "'LL", "12", "日本", "😀",
       "̀", "<|end", "ﬁ", "\xa0", "\x00", "the", "tion", "ab", "  ", "zq", "\n"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def ours():
    return bpe.load(vocabulary())


def test_equals_library(ours, library):
    rng = random.Random(3)
    for _ in range(800):
        s = "".join(rng.choice(ODD) for _ in range(rng.randint(0, 25)))
        want = library.encode(s, add_special_tokens=False).ids
        got = [i for part in ours.ids(s, {}) for i in part]
        assert got == want, s
        d = bpe.Decoder(ours)
        assert "".join([d.feed([i]) for i in got]) + d.close() == library.decode(want, skip_special_tokens=False)


def test_unbroken_text_streams_in_bounded_memory(ours, library):
    rng = random.Random(4)
    s = "".join(rng.choice(["a", "e", "in", "th", "zz", "er", "é"]) for _ in range(4000))
    assert [i for p in ours.ids(s, {}) for i in p] == library.encode(s, add_special_tokens=False).ids
    assert ours.lookahead < 1000
    held = []

    def feed():
        for i, b in enumerate("ab" * 5000):
            held.append(i)
            yield b
    out = 0
    for token in ours.stream(feed()):
        out += len(token.removesuffix(ours.suffix))
        assert len(held) - out <= 4 * ours.lookahead + 64


def test_lookahead_grows_along_a_chain():
    one = bpe.lookahead([("a", "b")], len)
    chain = bpe.lookahead([("a", "b"), ("b", "c"), ("c", "d")], len)
    assert one == 2 and chain >= one
    # right-to-left chain: whether a joins b hangs on all that follows
    assert bpe.lookahead([("c", "d"), ("b", "c"), ("a", "b")], len) == 4


def test_byte_decoder_state_machine():
    class File:
        decoder = "ByteLevel"
        symbols = bpe.byte_symbols()
        tokens = {b: s for b, s in enumerate(symbols)}
    d = bpe.Decoder(File)
    raw = "é😀x".encode() + b"\xff" + "ü".encode()[:1]
    text = "".join(d.feed([b]) for b in raw) + d.close()
    assert text == raw.decode("utf-8", "replace")


def test_digest(make, library):
    texts = [None, "", "Plain Words, twice.", "x" * 3000, "é" * 70_000 + " end"]
    got = {r.doc_id: r for r in bpe.digest(make(list(enumerate(texts)), extra=["n_tokens"]), vocabulary()).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digest(make([]), vocabulary()).count() == 0
