import hashlib

import corpus_pipeline as P
from outcomelens.llm import secret_scan
from .test_minhash import brute as near
from .test_quality import brute as rules

from outcomelens.llm.common import read

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_brute_force(spark):
    docs = read(spark, SF, "documents")
    start = {r.doc_id: r for r in docs.collect()}
    good = P.quality_rules(spark, docs, SF)
    assert good.columns == COLUMNS
    kept = {r.doc_id: r.text for r in good.collect()}
    assert all(not rules(t)[5] for t in kept.values()) and len(kept) > 0.5 * len(start)
    one = P.near_duplicates(spark, good, SF)
    left = {r.doc_id for r in one.collect()}
    assert one.columns == COLUMNS and left == set(near(sorted(kept.items())).values())
    clean = P.secrets(spark, one, SF)
    rows = {r.doc_id: r for r in clean.collect()}
    assert clean.columns == COLUMNS and set(rows) == left
    assert all(r.n_chars == len(r.text) for r in rows.values())
    again = secret_scan.digest(clean).filter("spans <> ''").count()
    assert again == 0
    mixed = P.source_mix(spark, clean, SF)
    assert mixed.columns == COLUMNS
    times = {}
    for r in mixed.collect():
        assert r.text == rows[r.doc_id].text
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert max(times.values()) <= 3
    ids = {r.doc_id: r for r in P.tokens(spark, mixed, SF).collect()}
    from tokenizers import Tokenizer
    from outcomelens.llm.queries import vocabulary
    t = Tokenizer.from_file(vocabulary())
    for i, r in list(ids.items())[:40]:
        want = t.encode(rows[i].text, add_special_tokens=False).ids
        assert list(r.token_ids) == want and r.n_tokens == len(want)
        assert r.decoded_sha256 == hashlib.sha256(t.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows_pass_all_stages(spark, make):
    docs = make([(1, None), (2, ""), (None, "word " * 30), (3, "plain different words make this text long enough to stay here now"),
                 (3, "plain different words make this text long enough to stay here now")], extra=["row", "key", "t", "own"])
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    assert docs.count() >= 1
    empty = make([])
    for _, stage in P.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0
