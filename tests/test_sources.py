"""Sources and sinks: text scan keeps literal markers (A1), fingerprint change test (A2)."""

import tempfile

from outcomelens.sources.fingerprint import changed_since, fingerprint
from outcomelens.sources.records import read_records
from outcomelens.spec import GAME_SPEC


def test_read_records_keeps_literal_none(spark):
    d = tempfile.mkdtemp(prefix="ol-csv-")
    with open(f"{d}/r.csv", "w") as fh:
        fh.write("Item,Exhaustion Perk,Result\nNone,,Escape\nNA,Lithe,Dead\n")
    df = read_records(spark, f"{d}/r.csv", spec=GAME_SPEC)
    rows = [tuple(r) for r in df.collect()]
    assert df.columns == ["item", "opt", "label"]
    assert rows == [("None", "", "Escape"), ("NA", "Lithe", "Dead")]


def test_fingerprint_detects_change(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "y"), (1, "x")], "k int, v string")
    c = spark.createDataFrame([(1, "x"), (2, "z")], "k int, v string")
    fa = fingerprint(a, ["k", "v"])
    assert not changed_since(fingerprint(b, ["k", "v"]), fa).first().changed   # order-insensitive
    assert changed_since(fingerprint(c, ["k", "v"]), fa).first().changed


def test_rate_stream_is_time_zone_independent(spark):
    import __spark_entry__ as E
    q = E.queries()["rate_stream"]
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        a = sorted(tuple(r) for r in q(spark, "/root/testdata/sf0.001").collect())
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        b = sorted(tuple(r) for r in q(spark, "/root/testdata/sf0.001").collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert a == b and len(a) > 0


def test_score_stream_splits_valid_and_quarantined(spark):
    import uuid

    from pyspark.sql import functions as F

    from outcomelens.operators.configs import valid_configs
    from outcomelens.plans.fixture_model import fixture_scorer
    from outcomelens.session import ensure_checkpoint_dir
    from outcomelens.sources.fixtures import fact_from_lineitem, fact_records, table
    from outcomelens.spec import FIXTURE_SPEC
    from outcomelens.streaming.score_stream import start_score_stream

    sf = "/root/testdata/sf0.001"
    sc = fixture_scorer(spark, sf, "B")
    src = (spark.readStream.schema(table(spark, sf, "lineitem").schema)
                .option("pathGlobFilter", "lineitem.parquet").parquet(sf))
    base = f"{ensure_checkpoint_dir(spark)}/test-stream-{uuid.uuid4().hex}"
    keep = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "own_amt"]
    q = start_score_stream(spark, src, lambda li: fact_from_lineitem(spark, sf, li), sc, keep,
                           f"{base}/out", f"{base}/bad", f"{base}/ck")
    q.awaitTermination()
    out, bad = spark.read.parquet(f"{base}/out"), spark.read.parquet(f"{base}/bad")
    total = fact_records(spark, sf).count()
    assert out.count() == valid_configs(fact_records(spark, sf), FIXTURE_SPEC.search).count()
    assert out.count() + bad.count() == total
    assert bad.where(F.col("error").isNull()).count() == 0


def test_fingerprint_sees_doubled_rows_and_moved_nulls(spark):
    schema = "k string, v string, w string"
    base = spark.createDataFrame([("a", None, "b"), ("c", "d", "e")], schema)
    mark = fingerprint(base, ["k", "v", "w"])
    twice = base.unionAll(base.limit(1)).unionAll(base.limit(1))
    moved = spark.createDataFrame([("a", "b", None), ("c", "d", "e")], schema)
    shifted = spark.createDataFrame([("a", None, "b"), ("c|1:d", None, "e")], schema)
    for other in (twice, moved, shifted):
        assert changed_since(fingerprint(other, ["k", "v", "w"]), mark).first().changed
    assert not changed_since(fingerprint(base.repartition(3), ["k", "v", "w"]), mark).first().changed
    assert changed_since(fingerprint(base.limit(0), ["k", "v", "w"]), mark).first().changed


def test_replayed_epoch_replaces_its_rows(spark):
    import uuid

    from outcomelens.session import ensure_checkpoint_dir
    from outcomelens.streaming.score_stream import epoch_sink
    base = f"{ensure_checkpoint_dir(spark)}/test-epochs-{uuid.uuid4().hex}"
    sink = epoch_sink(f"{base}/out", f"{base}/bad")
    batch = spark.createDataFrame([(1, None), (2, "x")], "i int, error string")
    sink(batch, 0)
    sink(batch, 0)
    sink(batch, 1)
    assert spark.read.parquet(f"{base}/out").count() == 2 and spark.read.parquet(f"{base}/bad").count() == 2


def test_report_is_written_as_json(spark):
    import uuid

    from outcomelens.session import ensure_checkpoint_dir
    from outcomelens.sources.publish import nest, write_report
    df = spark.createDataFrame([("f", "x", 2), ("f", "y", 1)], "feature string, value string, n long")
    path = f"{ensure_checkpoint_dir(spark)}/test-report-{uuid.uuid4().hex}"
    write_report(nest(df, ["feature"], "value", "n"), path)
    assert spark.read.json(path).first().payload == '{"x":2,"y":1}'


def _shared(spark, name):
    import uuid

    from outcomelens.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark)}/test-{name}-{uuid.uuid4().hex}"


def test_published_lines_are_one_document(spark):
    import json
    import re

    from outcomelens.sources import publish as P
    rows = [("a", "f", 'x"y', 1), ("a", "f", "\\z\n", 2), ("a", "g", "[k]", 3), ("b", "", "é", 4), ("c", "h", "1", 5)]
    df = spark.createDataFrame(rows, "report string, feature string, key string, n int")
    parts = [P.entries(r, df.where(f"report = '{r}'"), "key", ["n"], "feature") for r in ("a", "b", "c")]
    path = _shared(spark, "document")
    P.publish(parts[0].unionByName(parts[1]).unionByName(parts[2]).repartition(5), path)
    folder = re.sub("^file:/*", "/", path)
    import glob
    text = "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(folder + "/part-*")))
    want = {}
    for r, f, k, n in rows:
        want.setdefault(r, {}).setdefault(f, {})[k] = {"n": n}
    assert json.loads(text) == want


def test_manifest_of_single_files(spark):
    from outcomelens.sources.fingerprint import file_manifest
    path = _shared(spark, "manifest")
    df = spark.range(100).selectExpr("id", "id % 7 AS v")
    df.repartition(3).write.parquet(path)
    first = file_manifest(spark, path, ["id", "v"])
    rows = first.collect()
    assert len(rows) == 3 and {r.state for r in rows} == {"added"} and sum(r.n for r in rows) == 100
    kept = spark.createDataFrame(rows, first.schema)
    again = file_manifest(spark, path, ["id", "v"], kept).collect()
    assert {(r.state, r.rehashed) for r in again} == {("unchanged", False)}
    assert sorted((r.unit, r.n, r.sum_hash) for r in again) == sorted((r.unit, r.n, r.sum_hash) for r in rows)
    df.where("id < 5").coalesce(1).write.mode("append").parquet(path)
    more = file_manifest(spark, path, ["id", "v"], kept).collect()
    assert sorted((r.state, r.rehashed) for r in more) == [("added", True)] + [("unchanged", False)] * 3
    assert sum(r.n for r in more) == 105


def test_damaged_lines_get_reasons(spark):
    import tempfile

    from outcomelens.sources.records import read_checked
    d = tempfile.mkdtemp(prefix="ol-lines-")
    with open(f"{d}/r.csv", "w") as fh:
        fh.write('a,b,c\n1,"x,y",3\n1,2\n1,2,3,4\n1,"2,3\n,,\n"q",NA,None\n1,2,"3\n\n')
    got = sorted(((r._reason or "", r._line or "", r.a, r.b, r.c) for r in read_checked(spark, d, ["a", "b", "c"]).collect()), key=str)
    assert got == sorted([("", "", "1", "x,y", "3"), ("short line", "1,2", None, None, None), ("long line", "1,2,3,4", None, None, None),
                          ("unbalanced quote", '1,"2,3', None, None, None), ("", "", "", "", ""), ("", "", "q", "NA", "None"),
                          ("unbalanced quote", '1,2,"3', None, None, None)], key=str)


def test_wide_vocabulary_equals_the_narrow_form(spark):
    from pyspark.sql import functions as F

    from outcomelens.functions import encode as E
    from outcomelens.operators.reports import vocabulary_list
    df = spark.createDataFrame([(i, f"v{i % 5}" if i % 4 else None, "ab"[i % 2]) for i in range(40)], "id int, p string, q string")
    narrow = [e.alias(n) for c in ("p", "q") for n, e in E.one_hot_discovered(c, vocabulary_list(df, c))]
    wide = df.select("id", F.array(*[F.coalesce(c, F.lit(0)) for c in narrow]).alias("hot"))
    table = E.vocabulary_table(df, ["p", "q"])
    sparse = E.sparse_features(df, ["p", "q"], table, weights=F.col("position") + 1)
    both = sparse.join(wide, "id").collect()
    assert len(both) == 40
    for r in both:
        assert [i for i, x in enumerate(r.hot) if x] == list(r.features) and r.weight == sum(i + 1 for i in r.features)
