import random
import re
from collections import Counter

from outcomelens.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    times = Counter(grams)
    covered = {j for i, g in enumerate(grams) if times[g] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered),
            n < 10 or 100 * len(covered) > 20 * n)


def test_matches_brute_force(make):
    rng = random.Random(1)
    texts = [None, "", " \t\n", "a", "x y z w v " * 4, "line one\nline one\r\nline\x0btwo\n\n", "é ü ß 日本 " * 5]
    texts += [" ".join(rng.choice("abcd#|") * rng.randint(1, 3) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    got = {r.doc_id: r for r in quality.digest(make(list(enumerate(texts)), extra=["__other", "n_words", "kept"])).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t)
        assert not (r.base_failed and r.kept)


def test_long_text_numbers_windows_exactly():
    rng = random.Random(2)
    words = [rng.choice("abcdefghijk") for _ in range(quality._LONG + 50)]
    assert quality.repeat_words(words) == brute(" ".join(words))[4]


def test_policies_and_ablation(make):
    good = "This is an ordinary line of plain words that nobody would ever reject."
    rows = [(1, good), (2, "too short"), (3, " ".join("w%d###" % i for i in range(30))), (4, None)]
    led = quality.ledger(make(rows))
    kept = [r.doc_id for r in quality.keep_good(make(rows)).collect()]
    assert kept == [1]
    table = {r["rule"]: (r.n_fail, r.n_only) for r in quality.ablation(led).collect()}
    assert table["few_words"] == (2, 2)
    assert table["symbols"] == (1, 1)
    assert table["shouting"] == (0, 0)


def test_empty_table(make):
    assert quality.digest(make([])).count() == 0
    assert quality.keep_good(make([])).columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_every_internal_name_may_be_a_column(make):
    from outcomelens.llm import quality as Q
    good = "these are plain words of a text that is long enough to stay in it"
    kept = Q.keep_good(make([(1, good), (2, "short")], extra=["__q", "__bits", "row", "bits"]))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "__q", "__bits", "row", "bits"]
    assert [tuple(r) for r in kept.collect()] == [(1, good, "en", "s", len(good), 1, 1, 1, 1)]
