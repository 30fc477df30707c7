import random

from outcomelens.llm import mixing


def brute_targets(sizes):
    """Reshare the excess by weight until no source is above its limit."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: float(i % 3 + 1) for i, s in enumerate(names)}
    total, fixed = float(sum(sizes.values())), {}
    while len(fixed) < len(names):
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > 3 * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in above}
    return fixed


def test_targets_and_takings(make):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), "en", rng.choice(["a", "b", "c", "ä", None, "z", "z", "z", "z", "z"])) for i in range(900)]
    rows += [(1000, "one two", "en", "tiny"), (1000, "one two", "en", "tiny"), (None, "x y", "en", "b"), (1001, None, "en", "none")]
    got = mixing.digest(make(rows, extra=["size", "copies"])).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = brute_targets(sizes)
    source_of = {r[0]: r[3] for r in rows}
    taken = {}
    for r in got:
        s = source_of[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6
        assert r.taken <= 3 * r["size"]
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 30 for s in want)


def test_rerun_agrees_and_mix_repeats_rows(make):
    rows = [(i, "w " * (i % 7 + 1), "en", "abc"[i % 3]) for i in range(200)]
    docs = make(rows)
    a = mixing.digest(docs.repartition(7)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, mixing.digest(docs).collect()))
    mixed = mixing.mix(docs).collect()
    times = {}
    for r in mixed:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert {r.doc_id: r.taken // r["size"] for r in a if r.taken} == times


def test_positions_invert_the_schedules(spark):
    from pyspark.sql import functions as F
    df = spark.range(101).select((F.col("id") / 100).alias("y"))
    for place, (a, b, c) in enumerate(mixing.SCHEDULES):
        total = (a + b) / 4 + (b + c) / 4
        for r in df.select("y", mixing.position(F.col("y"), F.lit(place)).alias("t")).collect():
            t = r.t
            first = min(t, 0.5)
            area = a * first + (b - a) * first * first
            if t > 0.5:
                area += b * (t - 0.5) + (c - b) * (t - 0.5) ** 2
            assert abs(area - r.y * total) < 1e-9


def test_empty(make):
    assert mixing.digest(make([])).count() == 0
    assert mixing.mix(make([])).columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert mixing.digest(make([(1, None), (2, "")])).count() == 2


def test_whole_rows_are_not_stored(spark, monkeypatch):
    from outcomelens.llm import mixing as M
    stored, written = [], M.written
    monkeypatch.setattr(M, "written", lambda df, name: stored.append(df.columns) or written(df, name))
    docs = spark.createDataFrame([(i, f"w{i} x", "ab"[i % 2]) for i in range(40)], "doc_id long, text string, source string")
    assert M.mix(docs).columns == docs.columns and stored == [["doc_id", "source", "size", "h"]]
    assert M.mix(docs).select("doc_id").distinct().count() <= 40
