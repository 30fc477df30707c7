"""Secret scanning through a trigram inverted index, in DataFrame functions only.

From each rule's regular expression a Boolean trigram query is derived.  The
index holds postings (trigram, row key) for the trigrams of these queries; per
row key the postings are intersected, and only candidate rules are verified on
the row's text.  A rule without mandatory trigrams is verified on every text.

Defined cases: a null text counts as empty (no spans), and stays null when
secrets are replaced; repeated rows share a row key and each keep their own result
row (adaptive execution splits a key that many rows share); the index may only
add candidates, never lose one, so a key collision changes nothing.  An empty
table gives an empty result.  Very long texts and texts with very many matches
take time in proportion to their length.  Spans that start together are listed in
the order of the rules.  Only doc_id and text are read; other columns may have any
name.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re._constants as op
import re._parser as parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    kind: str
    pattern: str
    fold: bool = False  # letters in either case
    group: int = 0  # the group whose length is checked
    least: int = 1


#: Kinds of the contract first; their order breaks ties between spans.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", False, 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", False, 0, 24),  # same spans as runs of any length, then checked for 24
)
RULES = BASE + (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,255}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,250}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"(sk|rk)_live_[A-Za-z0-9]{16,}"),
)
_CHUNK = 128  # items that a growing array is copied with
_MOST = 64  # literal alternatives followed before a run is closed


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """Mandatory trigrams of a pattern, lower-cased: all clauses, in each some set, in it all trigrams.

    Walks the parsed pattern, extending the set of literal runs that must occur
    where it stands; whatever isn't a short set of literals closes the run.
    An empty list means that no trigram is mandatory.
    """
    clauses: list[list[frozenset[str]]] = []

    def close(runs: set[str]) -> set[str]:
        sets = {frozenset(r[i:i + 3] for i in range(len(r) - 2)) for r in runs}
        if frozenset() not in sets:
            clauses.append(sorted((s for s in sets if not any(o < s for o in sets)), key=sorted))
        return {""}

    def literals(node) -> set[str] | None:
        """All strings of a small finite node, else None."""
        kind, arg = node
        if kind is op.LITERAL:
            return {chr(arg).lower()}
        if kind is op.IN:
            found: set[str] = set()
            for k, a in arg:
                if k is op.LITERAL:
                    found.add(chr(a).lower())
                elif k is op.RANGE and a[1] - a[0] < 4:
                    found |= {chr(c).lower() for c in range(a[0], a[1] + 1)}
                else:
                    return None
            return found if len(found) <= 8 else None
        if kind is op.SUBPATTERN:
            return product(arg[3])
        if kind is op.BRANCH:
            parts = [product(x) for x in arg[1]]
            return None if None in parts else set().union(*parts)
        if kind is op.MAX_REPEAT and arg[1] <= 3:
            one = product(arg[2])
            if one is None:
                return None
            out, power = set(), {""}
            for n in range(arg[1] + 1):
                if n >= arg[0]:
                    out |= power
                power = {a + b for a in power for b in one}
            return out if len(out) <= _MOST else None
        return None

    def product(nodes) -> set[str] | None:
        out = {""}
        for node in nodes:
            one = literals(node)
            if one is None or len(out) * len(one) > _MOST:
                return None
            out = {a + b for a in out for b in one}
        return out

    def walk(nodes, runs: set[str]) -> set[str]:
        for node in nodes:
            one = literals(node)
            if one is not None and len(runs) * len(one) <= _MOST:
                runs = {a + b for a in runs for b in one}
                continue
            runs = close(runs)
            if node[0] is op.SUBPATTERN:
                runs = walk(node[1][3], runs)
            elif node[0] is op.MAX_REPEAT and node[1][0] >= 1:
                runs = close(walk(node[1][2], runs))
        return runs

    close(walk(parser.parse(pattern), {""}))
    return clauses


def row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram number, row key) of the given trigrams over lower-cased texts."""
    low = docs.select(row_key().alias("key"), F.lower("text").alias("low"))
    present = F.array(*[F.when(F.contains("low", F.lit(t)), i) for i, t in enumerate(trigrams)])
    return low.select(F.explode(F.array_compact(present)).alias("trigram"), "key")


def candidates(postings: DataFrame, trigrams: list[str], queries: dict[str, list]) -> DataFrame:
    """Intersect postings: per row key, a flag per rule whose trigram query holds; keys with none are left out."""
    at = {t: i for i, t in enumerate(trigrams)}
    rows = postings.groupBy("key").agg(F.collect_set("trigram").alias("has"))
    flags = []
    for kind, clauses in queries.items():
        holds = F.lit(True)
        for clause in clauses:
            some = F.lit(False)
            for group in clause:
                every = F.lit(True)
                for t in sorted(group):
                    every = every & F.array_contains("has", at[t])
                some = some | every
            holds = holds & some
        flags.append(holds.alias(kind))
    rows = rows.select("key", *flags)
    return rows.filter(" OR ".join(f"`{k}`" for k in queries)) if queries else rows


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), 0)


def running(items: Column, value, fold) -> Column:
    """Per item the fold (from 0) of the values of all items before it.

    Items are taken ``_CHUNK`` at a time: an array that grows by one item is copied
    with each, so only a chunk's worth is ever copied.
    """
    def grow(part: Column, start: Column, of) -> Column:
        first = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, first, lambda acc, x: F.struct(
            fold(acc["at"], of(x)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]

    def cut(all_: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor(F.size(all_) / _CHUNK).cast("int")), lambda i: F.slice(all_, i * _CHUNK + 1, _CHUNK))

    def within(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda acc, x: fold(acc, value(x))))
        return F.flatten(F.zip_with(chunks, grow(totals, F.lit(0), lambda t: t), lambda c, start: grow(c, start, value)))

    return let(items, lambda all_: let(cut(all_), within))


def _spans(rule: Rule, number: int) -> Column:
    """Array of (start, kind number, end) of a rule's matches in ``text``: the pieces
    between matches and the matches, both from left to right, give the offsets."""
    pattern = ("(?i)" if rule.fold else "") + rule.pattern
    gaps = F.split("text", pattern, -1)
    hits = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    checked = F.regexp_extract_all("text", F.lit(pattern), F.lit(rule.group)) if rule.group else hits
    parts = F.zip_with(F.zip_with(hits, checked, lambda h, c: F.struct(F.length(h).alias("n"), (F.length(c) >= rule.least).alias("ok"))),
                       gaps, lambda h, g: F.struct(F.length(g).alias("gap"), h["n"].alias("n"), h["ok"].alias("ok")))
    parts = F.filter(parts, lambda p: p["n"].isNotNull())  # the piece after the last match

    def placed(p: Column) -> Column:
        before = running(p, lambda x: x["gap"] + x["n"], lambda a, b: a + b)
        each = F.zip_with(p, before, lambda x, at: F.struct(
            (at + x["gap"]).alias("s"), F.lit(number).alias("k"), (at + x["gap"] + x["n"]).alias("e"), x["ok"].alias("ok")))
        return F.transform(F.filter(each, lambda x: x["ok"]), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))

    return let(parts, placed)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` (every column) with ``__spans``: sorted array of (s, k, e) over all rules.

    A null text gives an empty array.
    """
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    trigrams = sorted({t for q in queries.values() for clause in q for g in clause for t in g})
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = candidates(index(plain, trigrams), trigrams, queries)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.xxhash64(F.col("row")["doc_id"], F.col("text")))
    both = rows.join(found.alias("c"), "key", "left")
    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    spans = [F.when(F.col(f"c.{r.kind}"), _spans(r, i)).otherwise(none) if r.kind in queries else _spans(r, i)
             for i, r in enumerate(rules)]
    return both.select("row", F.array_sort(F.concat(*spans)).alias("__spans"))


def listing(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of spans, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"], x["e"])), ",")


def merged(spans: Column) -> Column:
    """Sorted (s, e) of sorted spans, overlapping ones as one."""
    def join(all_: Column) -> Column:
        reach = running(all_, lambda x: x["e"], lambda a, b: F.greatest(a, b))
        marks = F.zip_with(all_, reach, lambda x, r: F.struct(
            x["s"].alias("s"), F.greatest(x["e"], r).alias("e"), (x["s"] >= r).alias("new")))
        return let(marks, ends)

    def ends(marks: Column) -> Column:
        after = F.concat(F.transform(F.slice(marks, 2, F.greatest(F.size(marks) - 1, F.lit(0))), lambda x: x["new"]), F.array(F.lit(True)))
        last = F.filter(F.zip_with(marks, after, lambda x, new: F.struct(x["e"].alias("e"), new.alias("end"))), lambda x: x["end"])
        return F.zip_with(F.filter(marks, lambda x: x["new"]), last, lambda x, y: F.struct(x["s"].alias("s"), y["e"].alias("e")))

    return F.when(F.size(spans) == 0, F.array().cast("array<struct<s:int,e:int>>")).otherwise(let(spans, join))


def replaced(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with ``mark`` in the place of every span: its characters are taken apart once, and joined between the spans."""
    def join(chars: Column) -> Column:
        def pieces(m: Column) -> Column:
            before = F.concat(F.array(F.lit(0)), F.transform(m, lambda x: x["e"]))
            until = F.concat(F.transform(m, lambda x: x["s"]), F.array(F.size(chars)))
            return F.array_join(F.zip_with(before, until, lambda a, b: F.array_join(F.slice(chars, a + 1, F.greatest(b - a, F.lit(0))), "")), mark)
        return let(merged(spans), pieces)
    return let(F.split(text, ""), join)


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced in text (overlapping spans as one) and n_chars brought in line."""
    found = scan(docs).withColumn("text", F.col("row")["text"])
    clean = replaced(F.col("text"), F.col("__spans"), mark)
    found = found.select("row", F.when(F.size("__spans") > 0, clean).otherwise(F.col("text")).alias("clean"))
    out = []
    for c in docs.columns:
        value = F.col("row")[c]
        if c == "text":
            value = F.col("clean")
        elif c == "n_chars":
            value = F.when(F.col("clean").isNull(), value).otherwise(F.length("clean").cast(docs.schema[c].dataType))
        out.append(value.alias(c))
    return found.select(*out)


def digest(docs: DataFrame) -> DataFrame:
    """Contract columns of the secrets query."""
    found = scan(docs.select("doc_id", "text")).select(F.col("row")["doc_id"].alias("doc_id"), "__spans")
    base = F.filter("__spans", lambda x: x["k"] < len(BASE))

    def count(number: int) -> Column:
        return F.size(F.filter("__spans", lambda x: x["k"] == number)).cast("long")

    counts = [count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(listing(base), 256).alias("base_sha256"), listing(F.col("__spans")).alias("spans"))
