"""Selection operators: cases worked by hand and properties."""

import random

import pytest
from pyspark.sql import functions as F

from outcomelens.operators import configs as C
from outcomelens.operators import search as Q
from outcomelens.spec import FIXTURE_SPEC


def _pick(spark, builds, k):
    df = spark.createDataFrame(builds)
    got = Q.diverse_top_k(df, ["item", "opt", "extra"], ["item", "opt", "extra"], "opt", k)
    return [r.ordinal for r in got.orderBy("pick_rank").collect()]


def _build(ordinal, opt, p, item="a", extra=0):
    return {"item": item, "opt": opt, "extra": extra, "probability": p, "ordinal": ordinal}


def test_diverse_top_k_by_hand(spark):
    # x leads by far: its best, its second (two a group at most), the best of y and z, then x's third to fill up
    builds = [_build(0, "x", 0.9), _build(1, "x", 0.8, extra=1), _build(2, "x", 0.7, extra=2), _build(3, "y", 0.2),
              _build(4, "z", 0.1), _build(5, "y", 0.15, extra=1)]
    assert _pick(spark, builds, 3) == [0, 3, 4]
    assert _pick(spark, builds, 4) == [0, 1, 3, 4]
    assert _pick(spark, builds, 5) == [0, 1, 2, 3, 4]  # y's second is under the floor, so x's third comes first
    assert _pick(spark, builds, 9) == [0, 1, 2, 3, 5, 4]
    # the same configuration twice counts once, with its better score; ties go to the earlier
    assert _pick(spark, [_build(0, "x", 0.4), _build(1, "x", 0.6), _build(2, "y", 0.6), _build(3, "y", 0.6)], 3) == [1, 2]


def test_diverse_top_k_properties(spark):
    rnd = random.Random(7)
    for _ in range(4):
        builds = [_build(i, rnd.choice("xyz"), round(rnd.random(), 3), rnd.choice("ab"), rnd.randint(0, 2)) for i in range(rnd.randint(5, 40))]
        k = rnd.choice([3, 5, 7])
        picked = [builds[i] for i in _pick(spark, builds, k)]
        name = lambda b: (b["item"], b["opt"], b["extra"])
        value = lambda b: (b["probability"], -b["ordinal"])
        distinct = {}
        for b in builds:
            distinct[name(b)] = max(distinct.get(name(b), b), b, key=value)
        assert len({name(b) for b in picked}) == len(picked) == min(k, len(distinct))
        assert picked == sorted(picked, key=value, reverse=True)
        assert all(distinct[name(b)] is b for b in picked)
        groups = {o: sorted((b for b in distinct.values() if b["opt"] == o), key=value, reverse=True) for o in "xyz"}
        heads = sorted((g[0] for g in groups.values() if g), key=value, reverse=True)
        assert all(h in picked for h in heads[:k])  # the best of each group, as far as there is room
        # a group takes its members from the top, and one beyond its share only when no admissible one is left out
        share = max(2, k // 3)
        for g in groups.values():
            taken = [b in picked for b in g]
            assert taken == sorted(taken, reverse=True)
            if sum(taken) > share:
                assert all(b in picked for h in groups.values() for b in h[:share] if b["probability"] >= 0.35)


def test_improvement_of_both_signs(spark):
    df = spark.createDataFrame([(1, 40.0, 60.0), (2, 60.0, 40.0), (3, 5.0, 5.0), (4, None, 7.0)], "i int, current_chance double, best_chance double")
    got = {r.i: (r.best_chance, r.improvement) for r in Q.improvement(df).collect()}
    assert got == {1: (60.0, 20.0), 2: (60.0, 0.0), 3: (5.0, 0.0), 4: (7.0, None)}


def test_over_limit_configs_are_quarantined_with_a_reason(spark):
    space = FIXTURE_SPEC.search
    rows = [("1-URGENT", 3, "Yes", "No", "No", "No"), ("None", 0, "No", "No", "No", "No")]
    df = spark.createDataFrame(rows, "opt string, extra int, flag_a string, flag_b string, flag_c string, flag_d string")
    assert [r.reason for r in C.quarantine_configs(df, space).collect()] == ["slots used: 5"]
    assert C.valid_configs(df, space).count() == 1


def test_ordinals_follow_the_number_of_sites(spark):
    sites = spark.createDataFrame([("F", i, i, "g", f"s{i}") for i in range(5)], "site_type string, area int, site_ord long, site_group string, site string")
    grid = C.candidate_grid(sites, FIXTURE_SPEC.search, "A")
    n, distinct, top = grid.agg(F.count("*"), F.countDistinct("ordinal"), F.max("ordinal")).first()
    s = FIXTURE_SPEC.search
    assert n == distinct == 7 * 5 * 6 * 71 * 9
    assert top < len(s.items) * 5 * len(s.levels) * C.loadout_radix(s) * 9


def test_first_over_threshold_matches_loop(spark):
    rnd = random.Random(3)
    for _ in range(5):
        rows = [{"f": i, "probability": rnd.choice([0.2, 0.5, 0.96, 0.97, 0.5]), "ordinal": i} for i in range(30)]
        df = spark.createDataFrame(rows)
        got = Q.first_over_threshold(df, ["f"], 0.95).first()
        best, chosen = -1.0, None
        for r in rows:                        # running strict maximum with early stop
            if r["probability"] > best:
                best, chosen = r["probability"], r["f"]
            if best >= 0.95:
                break
        assert got.f == chosen


def test_loadouts_count(spark):
    lo = C.loadouts(spark, FIXTURE_SPEC.search)
    counts = {r.opt: r.n for r in lo.groupBy("opt").agg(F.count("*").alias("n")).collect()}
    assert lo.count() == 71
    assert sorted(counts.values()) == [11, 15, 15, 15, 15]


def test_running_records(spark):
    rnd = random.Random(5)
    scores = [rnd.randint(0, 400) / 10 for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(scores)), "ordinal long, score double")
    for chunk in (7, 64, 10_000):
        got = sorted((r.ordinal, r.score) for r in Q.running_records(df, chunk=chunk).collect())
        want, best = [], None
        for i, s in enumerate(scores):
            if best is None or s > best:
                want.append((i, s))
                best = s
        assert got == want


def test_picks_of_every_count_equal_picks_of_one(spark):
    rnd = random.Random(11)
    for _ in range(3):
        builds = [_build(i, rnd.choice("wxyz"), round(rnd.random(), 3), rnd.choice("abc"), rnd.randint(0, 3)) for i in range(120)]
        df = spark.createDataFrame(builds)
        key = ["item", "opt", "extra"]
        many = {}
        for r in Q.picks_by_count(df, key, key, "opt", [1, 2, 5, 12, 40]).collect():
            many.setdefault(r.k, []).append((r.pick_rank, r.ordinal))
        for k, found in many.items():
            assert [o for _, o in sorted(found)] == _pick(spark, builds, k)
        assert set(many) == {1, 2, 5, 12, 40}


def test_own_fields_are_searched_over_every_level(spark, monkeypatch):
    from conftest import SF_SMALL
    from outcomelens.plans import q_search
    from outcomelens.plans.catalog import ORACLE

    class Seen(Exception):
        pass

    def optimize(base, sites, scorer, key):
        raise Seen(C.candidate_grid(sites, scorer.spec.search, scorer.variant))

    monkeypatch.setattr(q_search.Q, "optimize_configs", optimize)
    with pytest.raises(Seen) as seen:
        q_search.q_optimize_own_fields(spark, SF_SMALL)
    levels = FIXTURE_SPEC.search.levels
    assert sorted(r.level for r in seen.value.args[0].select("level").distinct().collect()) == sorted(levels)
    assert all(f"({v!r}::DOUBLE, {i})" in ORACLE["optimize_own_fields"] for i, v in enumerate(levels))
