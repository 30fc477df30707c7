import random
import re
from collections import Counter, defaultdict

import numpy as np

from outcomelens.llm import minhash as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """Smallest id of each document's connected component, all pairs compared through shared shingles."""
    sets = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        sets[i] = set(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where, both = defaultdict(list), Counter()
    for i, s in sets.items():
        for x in s:
            for j in where[x]:
                both[j, i] += 1
            where[x].append(i)
    by_text = {}
    for i, t in rows:
        j = by_text.setdefault(t or "", i)
        a, b = sorted((find(i), find(j)))
        root[b] = a
    for (i, j), n in both.items():
        if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n) - 1e-9:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i: find(i) for i in sets}


def documents():
    rng = random.Random(8)
    vocabulary = ["w%d" % i for i in range(3000)]
    rows, i = [], 0
    for _ in range(25):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 8, 40, 200, 400]))]
        for copy in range(rng.choice([1, 1, 2, 4, 12])):
            new = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 8])):
                new[rng.randrange(len(new))] = rng.choice(vocabulary)
            rows.append((i, " ".join(new)))
            i += 1
    # a chain: neighbours are linked, the ends are not
    chain = [rng.choice(vocabulary) for _ in range(300)]
    for k in range(6):
        rows.append((i, " ".join(chain[k * 25:] + ["c%d_%d" % (k, j) for j in range(k * 25)])))
        i += 1
    return rows + [(i, ""), (i + 1, None), (i + 2, " \n"), (i + 3, "solo"), (i + 4, "solo"), (i + 5, "solo\n")]


def test_classes_match_brute_force(make):
    rows = documents()
    random.Random(9).shuffle(rows)
    got = {r.doc_id: r.class_id for r in M.digest(make(rows, extra=["t", "own", "node", "salt"])).collect()}
    assert got == brute(rows)


def test_keep_one(make):
    rows = documents()
    want = sorted(set(brute(rows).values()))
    kept = M.keep_one(make(rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id for r in kept.collect()) == want


def test_missing_ids_and_repeated_rows(make):
    text = "one two three four five six seven"
    rows = [(None, text), (None, text), (7, text), (7, text), (None, "other words that stand alone here"), (9, None)]
    out = M.digest(make(rows)).collect()
    assert len(out) == len(rows)
    assert len({r.class_id for r in out if r.doc_id == 7}) == 1
    assert M.keep_one(make(rows)).count() == 3
    assert M.digest(make([])).count() == 0


def test_weighted_signatures_estimate_weighted_similarity():
    a, b = np.array([1.0, 2.5, 7.0, 0.3]), np.array([2.0, 2.5, 3.0, 0.6])
    ids = np.arange(4).astype(np.uint64)
    s = M.darts(np.repeat([0, 1], 4), np.concatenate((ids, ids)), np.concatenate((a, b)), 2, 4096)
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


def test_signature_does_not_depend_on_the_batch():
    texts = [t or "" for _, t in documents()][:40]
    def sign(part):
        o, e, _ = M.shingle_hashes(part)
        return M.darts(o, e, np.ones(len(o)), len(part), M.BANDS * M.ROWS)
    whole = sign(texts)
    for i in (0, 5, 17, 33):
        assert (sign([texts[i]])[0] == whole[i]).all()


def test_a_common_passage_brings_no_pairs_together(spark, make):
    rng = random.Random(3)
    passage = " ".join("p%d" % i for i in range(300))
    rows = [(i, passage + " " + " ".join("w%d" % rng.randrange(10 ** 6) for _ in range(75))) for i in range(120)]
    docs = make(rows)
    nodes = [(i, t, 371, b) for i, t in rows for b in (1, 2)]
    members = spark.createDataFrame([(b, i, n) for i, _, n, b in nodes], "bucket long, node long, n long")
    none = spark.createDataFrame([], "node long, class long")
    texts = docs.select(docs.doc_id.alias("node"), "text")
    assert M.cross_class_pairs(members, none, texts).count() == 0
    assert len({r.class_id for r in M.digest(docs).collect()}) == 120


def test_prefix_join_finds_every_similar_pair(spark, make):
    rows = [(i, t) for i, t in documents() if len((t or "").split()) >= 1]
    rows = [(i, t) for k, (i, t) in enumerate(rows) if t not in {x for _, x in rows[:k]}]
    sets = {i: M.shingles(t) for i, t in rows}
    members = spark.createDataFrame([(1, i, len(sets[i])) for i, _ in rows], "bucket long, node long, n long")
    none = spark.createDataFrame([], "node long, class long")
    texts = make(rows).selectExpr("doc_id AS node", "text")
    got = {(r.a, r.b) for r in M.cross_class_pairs(members, none, texts).collect()}
    want = {(a, b) for a in sets for b in sets if a > b
            and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9}
    assert want <= got and len(got) < 3 * len(want) + 50


def test_an_id_with_several_texts(make):
    one, two = ("a%d " % k * 1 for k in (1, 2))
    one, two = (" ".join(x.strip() + str(i) for i in range(60)) for x in (one, two))
    rows = [(7, one), (7, two), (8, two + " more"), (9, one + " more"), (3, "alone stands this text among others")]
    got = {}
    for r in M.classes(make(rows)).collect():
        got.setdefault(r.doc_id, set()).add(r.class_id)
    assert got[9] <= got[7] and got[8] <= got[7] and len(got[7]) == 2 and got[3] == {3}
    assert sorted(M.keep_one(make(rows)).select("text").toPandas()["text"].str[:2]) == ["a1", "a2", "al"]


def test_very_long_texts(make):
    words = ["w%d" % (i * 7919 % 100_003) for i in range(300_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:290_000])), (3, " ".join(words[150_000:] + ["x%d" % i for i in range(150_000)]))]
    got = {r.doc_id: r.class_id for r in M.digest(make(rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
