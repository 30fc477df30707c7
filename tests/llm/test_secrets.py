import random
import re

from outcomelens.llm import secret_scan as S

ASSIGN = re.compile(S.BASE[0].pattern, re.I | re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")


def brute(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found))


def test_spans_match_brute_force(make):
    rng = random.Random(6)
    parts = ["password", "Passwd", "SECRET", "token", "api_key", "ApiKey", " ", "=", ":", '"', "'", "abcdef", "x" * 7, "😀", "é",
             "AKIA", "AKIA" + "A1" * 8, "0123456789abcdef" * 2, "f" * 23, "\n", "secret: token : abcdefgh", "K", "ſecret=abcdefgh"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "token=abcdefg" + " x" * 3000 + "token=abcdefg"), (902, "token=abcdefg"), (None, "secret=abcdefg")]
    got = S.digest(make(rows, extra=["key", "row", "spans"])).collect()
    assert len(got) == len(rows)
    import hashlib
    have = sorted((r.doc_id is None, r.doc_id or 0, r.base_sha256) for r in got)
    want = sorted((i is None, i or 0, hashlib.sha256(brute(t or "").encode()).hexdigest()) for i, t in rows)
    assert have == want


def test_trigram_queries():
    assert S.trigram_query(r"[0-9a-f]{24,}") == []
    assert S.trigram_query(r"abc+d") == []  # what repeats closes the run "ab"
    assert S.trigram_query(r"abcd+e") == [[frozenset({"abc"})]]
    assert S.trigram_query(r"AKIA[A-Z0-9]+") == [[frozenset({"aki", "kia"})]]
    some = S.trigram_query(S.BASE[0].pattern)
    assert len(some) == 1 and frozenset({"tok", "oke", "ken"}) in some[0]
    assert S.trigram_query(r"x?y*") == []


def test_index_loses_no_match(make):
    """Every rule's own matches are candidates."""
    from pyspark.sql import functions as F
    samples = {"private_key": "-----BEGIN RSA PRIVATE KEY-----", "code_host": "ghp_" + "a1" * 20, "chat": "xoxb-1234567890-ab",
               "web_token": "eyJabcdefghijk.abcdefghijkl.abcdefghijkl", "map_key": "AIza" + "b" * 35, "payment": "sk_live_" + "c" * 20,
               "access": "AKIA" + "Z" * 16, "assign": "API_KEY: abcdefgh"}
    rows = [(i, f"some text {x} more") for i, x in enumerate(samples.values())]
    got = {r.doc_id: r.spans for r in S.digest(make(rows)).collect()}
    for i, kind in enumerate(samples):
        assert kind in got[i], (kind, got[i])


def test_redact(make):
    rows = [(1, "a password=abcdef0123456789abcdef0123456789 b"), (2, None), (3, "clean"), (4, "😀 token: 'abcdefg' x token=abcdefg")]
    got = {r.doc_id: r for r in S.redact(make(rows)).collect()}
    assert got[1].text == "a [SECRET] b" and got[1].n_chars == len(got[1].text)
    assert got[2].text is None and got[3].text == "clean"
    assert got[4].text == "😀 [SECRET]' x [SECRET]"
    assert S.redact(make([])).columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_no_python_in_the_plan(make):
    plan = S.digest(make([(1, "x")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_very_many_matches_in_a_text(make):
    import time
    one = "password=abcdef1 "
    text = one * 100_000
    start = time.time()
    row = S.redact(make([(1, text), (2, "clean")])).filter("doc_id = 1").first()
    assert row.text == "[SECRET] " * 100_000 and row.n_chars == len(row.text)
    got = S.digest(make([(1, text)])).first()
    assert got.n_assign == 100_000 and got.spans.endswith(f"assign:{len(text) - len(one)}:{len(text) - 1}")
    assert time.time() - start < 60


def test_overlapping_spans_are_one(make, spark):
    from pyspark.sql import functions as F
    rng = random.Random(2)
    rows = []
    for i in range(40):
        n = rng.randrange(0, 400)
        spans = sorted((s, rng.randrange(3), s + rng.randrange(1, 9)) for s in rng.sample(range(3000), n))
        rows.append((i, [{"s": s, "k": k, "e": e} for s, k, e in spans]))
    df = spark.createDataFrame(rows, "i int, spans array<struct<s:int,k:int,e:int>>")
    got = {r.i: [(x.s, x.e) for x in r.m] for r in df.select("i", S.merged(F.col("spans")).alias("m")).collect()}
    for i, spans in rows:
        want = []
        for x in spans:
            if want and x["s"] < want[-1][1]:
                want[-1][1] = max(want[-1][1], x["e"])
            else:
                want.append([x["s"], x["e"]])
        assert got[i] == [tuple(w) for w in want]


def test_clashing_names(make):
    names = ["key", "row", "c", "__spans", "salt", "trigram", "low"]
    got = S.redact(make([(1, "a password=abcdefg")], extra=names)).first()
    assert got.text == "a [SECRET]" and [got[n] for n in names] == [1] * len(names)
