"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger keeps the measurements
and one bit per failed rule; a policy is a named, versioned mask over these
bits, so applying or comparing policies never reads the text again.

Defined cases: a null text counts as empty (no words, every count 0); repeated
rows each get their own ledger row; an empty table gives an empty ledger.  Only
the named text column is read, so extra columns pass through untouched; ``ledger``
replaces columns named ``__q`` or ``__bits``, ``keep_good`` and ``digest`` don't touch
them.  Texts are measured whole; from ``_LONG`` words on windows are told apart by
numbers instead of tuples, with the same result.  There are no ties.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outcomelens.llm.common import WORD

MEASURES = ("n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, "
            "n_repeat_words long, n_letters long, n_upper long, n_plain_words long")

#: name -> SQL condition over the measurements; the position is the rule's bit.
RULES = (
    ("few_words", "n_words < 10"),
    ("repeat_words", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("dup_lines", "n_lines >= 4 AND 2 * n_dup_lines > n_lines"),
    ("shouting", "n_letters >= 20 AND 10 * n_upper > 4 * n_letters"),
    ("long_words", "word_chars > 40 * n_words"),
    ("no_letters", "2 * n_plain_words < n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
#: Versioned policies: masks of the rules whose failure rejects a document.
BASE_POLICY = BIT["few_words"] | BIT["repeat_words"]
POLICIES = {"base": BASE_POLICY, "v1": (1 << len(RULES)) - 1}

_LONG = 20_000  # words from which windows are numbered in numpy instead of tuples


def repeat_words(words: list[str]) -> int:
    """Words that lie in some 5-word window occurring twice or more in ``words``."""
    n = len(words)
    if n < 6:
        return 0
    if n < _LONG:
        grams = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
        if len(set(grams)) == len(grams):
            return 0
        seen = Counter(grams)
        hit = np.fromiter((seen[g] > 1 for g in grams), bool, len(grams))
    else:  # exact ids of ever longer windows: 1, 2, 4, then 5 words
        number: dict[str, int] = {}
        one = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        two = np.unique(one[:-1] * n + one[1:], return_inverse=True)[1]
        four = np.unique(two[:-2] * n + two[2:], return_inverse=True)[1]
        _, five, times = np.unique(four[:-1] * n + one[4:], return_inverse=True, return_counts=True)
        hit = times[five] > 1
    cover = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + 5, -1)
    return int((np.cumsum(cover) > 0).sum())


def _measure(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    word, letter = re.compile(WORD), re.compile(r"[^\W\d_]")
    symbols = re.compile(r"[#*$%&|<>]")
    for batch in texts:
        rows = []
        for text in batch:
            text = text or ""
            words = word.findall(text)
            lines = [x for x in text.split("\n") if word.search(x)]
            upper = sum(map(str.isupper, text))
            letters = sum(map(str.isalpha, text))
            rows.append((len(words), sum(map(len, words)), len(symbols.findall(text)), len(lines),
                         len(lines) - len(set(lines)), repeat_words(words), letters, upper,
                         sum(1 for w in words if letter.search(w))))
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in MEASURES.split(", ")], dtype="int64")


def fail_bits(measures: str) -> Column:
    """One bit per rule that fails, from a struct column of measurements."""
    out = F.lit(0)
    for name, condition in RULES:
        sql = re.sub(r"\b([a-z]\w+)\b", lambda m: f"{measures}.{m[1]}", condition.replace(" AND ", " && "))
        out = out.bitwiseOR(F.when(F.expr(sql.replace(" && ", " AND ")), BIT[name]).otherwise(0))
    return out


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct ``__q`` of measurements and the failure bits ``__bits``."""
    return docs.withColumn("__q", F.pandas_udf(_measure, MEASURES)(F.col(text))).withColumn("__bits", fail_bits("__q"))


def passes(policy: str = "v1") -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("__bits").bitwiseAND(F.lit(POLICIES[policy])) == 0


def keep_good(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The documents that a policy accepts, columns unchanged, whatever their names."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return ledger(docs.select(row, F.col("text").alias("text"))).filter(passes(policy)).select("row.*")


def ablation(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of a policy: documents failing it, and those that only this rule rejects.

    Works on counts per bit pattern (at most 2^rules rows), not on documents.
    """
    mask = POLICIES[policy]
    patterns = rows.groupBy(F.col("__bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).alias("bit")) for n, b in BIT.items() if b & mask])
    return (patterns.select("bits", "n", F.inline(rules))
            .groupBy("rule").agg(
                F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n"))), F.lit(0)).alias("n_fail"),
                F.coalesce(F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n"))), F.lit(0)).alias("n_only"),
                F.sum("n").alias("n_docs")))


def digest(docs: DataFrame) -> DataFrame:
    """Contract columns of the quality query."""
    return ledger(docs.select("doc_id", "text")).select(
        "doc_id", "__q.n_words", "__q.word_chars", "__q.n_symbols", "__q.n_dup_lines", "__q.n_repeat_words",
        (~passes("base")).alias("base_failed"), (passes("base") & passes("v1")).alias("kept"),
        F.col("__bits").alias("fail_bits"))
