import math

import numpy as np
import pandas as pd
import pytest

from outcomelens.llm import impact

VEC = "vec_id long, embedding array<float>, label int, rank int, shard int, block int, v int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 0, 0, 0, 0) for i, v in rows], VEC)


def direct(rows):
    """query -> its five best (score, id), by all pairs."""
    x = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows]
    out = {}
    for q, a in x:
        if q % 50 == 0:
            best = out.setdefault(q, {})
            for i, b in x:
                if i != q:
                    s = sum(p * r for p, r in zip(a, b))
                    best[i] = max(best.get(i, s), s)
    return {q: sorted((-s, i) for i, s in best.items())[:5] for q, best in out.items() if best}


def got(spark, rows):
    out = {}
    for r in impact.digest(frame(spark, rows)).collect():
        out.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
    return {q: [x[1:] for x in sorted(v)] for q, v in out.items()}, out


@pytest.mark.parametrize("shard,block", [(8192, 128), (100, 3)])
def test_equals_all_pairs(spark, monkeypatch, shard, block):
    monkeypatch.setattr(impact, "SHARD", shard)
    monkeypatch.setattr(impact, "BLOCK", block)
    rng = np.random.default_rng(6)
    rows = [(i, v) for i, v in enumerate((rng.normal(size=(700, 12)) / 4).tolist())]
    rows += [(1000 + i, rows[50][1]) for i in range(60)]  # copies of a query
    rows += [(2000 + i, [0.0] * 12) for i in range(3)] + [(7, rows[8][1]), (50, rows[3][1])]
    mine, ranks = got(spark, rows)
    assert mine == direct(rows)
    assert all(sorted(x[0] for x in v) == list(range(1, len(v) + 1)) for v in ranks.values())


def test_ties_go_to_smaller_ids(spark):
    rows = [(i, [1.0, (i % 3) - 1.0]) for i in range(200)]
    assert got(spark, rows)[0] == direct(rows)


def test_defined_cases(spark):
    bad = [(150, None), (200, []), (250, [1, 2, 3]), (300, [None, 1]), (350, [float("nan"), 1]), (400, [1, float("-inf")]), (None, [1, 1])]
    good = [(0, [1, 0]), (0, [1, 0]), (3, [-1, 5]), (50, [0, 0])]
    mine, _ = got(spark, bad + good)
    assert mine == direct(good) and set(mine) == {0, 50}
    assert got(spark, [])[0] == {} and got(spark, [(0, [1, 1])])[0] == {}
    large = [(0, [1e30, 0]), (1, [1e30, 1]), (2, [1.0, 0]), (3, [-1e30, 0])]
    assert got(spark, large)[0][0] == [(-(2 ** 63 - 1), 1), (-(2 ** 61), 2), (2 ** 63, 3)]


def test_stops_on_proof_before_all_postings_are_read():
    rng = np.random.default_rng(7)
    x = np.floor(rng.normal(size=(8192, 64)) * 32).astype(np.int64)
    rows = impact._list_up(pd.DataFrame({"shard": 0, "v": list(x), "ids": [[i] for i in range(len(x))]}))
    shard = impact.Shard(rows)
    for q in range(0, 8192, 400):
        possible, score = shard.members(x[q], q)
        want = x @ x[q]
        want[q] = want.min()
        best = np.argsort(-want, kind="stable")[:5]
        assert set(best) <= set(possible) and (score == x[possible] @ x[q]).all()
    assert shard.read < 0.75 * shard.held
