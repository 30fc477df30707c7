import hashlib
import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from outcomelens.llm import alignment as al
from outcomelens.llm.queries import vocabulary

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


def direct(rows):
    """All columns by the libraries themselves, offset by offset."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letter = al.byte_letters()
    seen, total = [], Counter()
    for doc, text in rows:
        found = []
        if text:
            x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            bx = [bytes(letter[c] for c in a.id_to_token(i)) for i in x]
            by = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
            if b"".join(bx) == b"".join(by) == (" " + text).encode():
                ends = [np.cumsum([len(t) for t in s]).tolist() for s in (bx, by)]
                i = j = 0
                for cut in sorted(set(ends[0]) & set(ends[1])):
                    k, m = ends[0].index(cut, i) + 1, ends[1].index(cut, j) + 1
                    found.append((x[i:k], y[j:m]))
                    i, j = k, m
        seen.append((doc, found))
        total.update((g[-1], h[-1]) for g, h in found)
    best = {}
    for (_, h), n in total.items():
        best[h] = max(best.get(h, 0), n)
    out = []
    for doc, found in seen:
        n = [total[g[-1], h[-1]] for g, h in found]
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in found)
        out.append((doc, sum(len(g) for g, _ in found), sum(len(h) for _, h in found), len(found), len(found),
                    sum(c == best[h[-1]] for c, (_, h) in zip(n, found)), sum(n), hashlib.sha256(text.encode()).hexdigest() if found else ""))
    return sorted(out, key=str)


def texts():
    rng = random.Random(5)
    words = "the The tokenizer naïve Ærø 東京 don't x1 3.14 <|endoftext|> <s> … 🙂🙂 a\tb   c foo_bar\n\n é́ ﬁ".split(" ")
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 40)))) for i in range(60)]
    rows += [(100, ""), (101, None), (102, " "), (103, "▁literal"), (104, "  lead"), (105, "trail  "), (3, rows[3][1]), (None, "the the"), (106, " 　x"), (107, "a\x00b")]
    return rows


@pytest.mark.parametrize("segment,shelf,leaf", [(1 << 18, 16, 1 << 20), (40, 2, 10)])
def test_equals_the_libraries(spark, make, monkeypatch, segment, shelf, leaf):
    for name, value in (("SEGMENT", segment), ("SHELF", shelf), ("LEAF", leaf), ("FAN", 2), ("_PIECE", 500)):
        monkeypatch.setattr(al, name, value)
    rows = texts()
    docs = make(rows, extra=("row", "a", "b", "n_a", "seg")).repartition(5)
    got = [tuple(r) for r in al.digest(docs, A, B).collect()]
    assert sorted(got, key=str) == direct(rows)


def test_groups_and_counts_as_tables(spark, make):
    rows = texts()
    with open(A, "rb") as f, open(B, "rb") as g:
        a, b = al.ByteLevel(f.read()), al.Pieces(g.read())
    assert a.ranks is not None
    ids, reader = al.encode(make(rows), a, b), al.Reader(a, b)
    found = al.groups(ids, reader).orderBy("row", "group").collect()
    by = {}
    for r in found:
        by.setdefault(r.row, []).append(r)
    docs = {r.row: (r.doc_id, r.a) for r in ids.collect()}
    text = dict(rows)
    for row, parts in by.items():
        whole = (" " + text[docs[row][0]]).encode()
        assert [p.group for p in parts] == list(range(1, len(parts) + 1))
        assert parts[0].start == 0 and parts[-1].stop == len(whole)
        for p in parts:
            assert b"".join(a.bytes[i] for i in p.a_ids) == b"".join(b.bytes[i] for i in p.b_ids) == whole[p.start:p.stop]
    table, _, _ = al.counts(ids, reader)
    links = Counter((r.a_ids[-1], r.b_ids[-1]) for r in found)
    assert {(r.a_id, r.b_id): r["count"] for r in al.pair_counts(table).collect()} == links


def test_empty_tables(spark, make):
    assert al.digest(make([]), A, B).count() == 0
    got = al.digest(make([(1, None), (1, "")]), A, B).collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 0, 0, 0, 0, "")] * 2


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 100, 5000):
        keys = np.unique(rng.integers(0, 1 << 48, n))
        p = al.Perfect.of(keys)
        assert sorted(p.index(keys)) == list(range(len(keys)))
        assert len(p.bits) <= 5 * len(keys) + 200
        foreign = np.setdiff1d(rng.integers(0, 1 << 48, 50), keys)
        if len(foreign):
            with pytest.raises(KeyError):
                p.verified(foreign)


def test_files_of_another_make_take_the_slower_library():
    with open(A, "rb") as f:
        spec = json.load(f)
    spec["pre_tokenizer"]["add_prefix_space"] = True
    other = al.ByteLevel(json.dumps(spec).encode())
    assert other.ranks is None
    spec["pre_tokenizer"]["add_prefix_space"] = False
    rows = [f" {t}" for _, t in texts() if t]
    fast = al.ByteLevel(json.dumps(spec).encode())
    slow = al.ByteLevel(json.dumps(spec).encode())
    slow.ranks = None
    assert fast.encoder()(rows) == slow.encoder()(rows)
