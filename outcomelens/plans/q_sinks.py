"""Queries of the file manifest (A2), checked reading (A1), the published document (A4), the
request stream (I1) and vocabularies of any size (B10)."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import encode as E
from ..functions.scalars import sigmoid
from ..operators import batches as B
from ..operators import reports as R
from ..operators.ordering import written
from ..session import ensure_checkpoint_dir
from ..sources import publish as P
from ..sources.fingerprint import file_manifest
from ..sources.fixtures import fact_records
from ..sources.records import read_checked
from ..spec import FIXTURE_SPEC as S
from ..streaming.score_stream import PACKED, start_request_stream
from .catalog import register
from .fixture_model import fixture_scorer, stored_facts, sql_cost, sql_logit, sql_scaler_cte
from .oracle import BATCH, FACT, lenient_num, union_long
from .q_batches import _B, _comp
from .q_io import FP_COLS, _fp_records, _CENTS


def _folder(spark, name):
    return f"{ensure_checkpoint_dir(spark)}/{name}/{uuid.uuid4().hex}"


# ------------------------------------------------------------------ A2, unit by unit
_UNIT_COLS = [c for c in FP_COLS if c != "l_linenumber"]
_CELLS = ", ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in _UNIT_COLS)
_UNIT_ROWS = ", ".join(f"CAST(round({c} * 100) AS BIGINT) AS {c}" if c in _CENTS else c for c in FP_COLS)


@register("file_manifest", f"""WITH {FACT},
v1 AS (SELECT {_UNIT_ROWS} FROM fact),
v2 AS (SELECT * REPLACE (CASE WHEN l_linenumber = 5 THEN 9 ELSE l_linenumber END AS l_linenumber,
                         CASE WHEN l_linenumber = 2 AND l_orderkey < 100 THEN 1 - label ELSE label END AS label) FROM v1),
h AS (SELECT which, l_linenumber, count(*) AS n, CAST(sum(CAST('0x' || substr(md5(concat_ws('|', {_CELLS})), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS sum_hash
  FROM (SELECT 1 AS which, * FROM v1 UNION ALL SELECT 2, * FROM v2) GROUP BY 1, 2)
SELECT 'again' AS run, 'l_linenumber=' || l_linenumber AS unit, 'unchanged' AS state, false AS rehashed, n, sum_hash FROM h WHERE which = 1
UNION ALL SELECT 'edited', 'l_linenumber=' || l_linenumber, CASE l_linenumber WHEN 2 THEN 'changed' WHEN 9 THEN 'added' ELSE 'touched' END, true, n, sum_hash
  FROM h WHERE which = 2
UNION ALL SELECT 'edited', 'l_linenumber=5', 'gone', false, n, sum_hash FROM h WHERE which = 1 AND l_linenumber = 5""")
def q_file_manifest(spark, sf):
    """A folder of partitions against its own manifest, and an edited copy of it: rows changed in one partition,
    one gone, one added, the rest written again with the same rows."""
    rec = _fp_records(spark, sf)
    one, two = _folder(spark, "files"), _folder(spark, "files")
    rec.write.partitionBy("l_linenumber").parquet(one)
    rec = spark.read.schema(rec.schema).parquet(one)  # the copy is edited from the files, not joined again
    label = F.when((F.col("l_linenumber") == 2) & (F.col("l_orderkey") < 100), 1 - F.col("label")).otherwise(F.col("label"))
    (rec.withColumns({"label": label, "l_linenumber": F.when(F.col("l_linenumber") == 5, 9).otherwise(F.col("l_linenumber"))})
     .write.partitionBy("l_linenumber").parquet(two))
    first = written(file_manifest(spark, one, _UNIT_COLS, by="folder"), "file-manifest")
    runs = [file_manifest(spark, path, _UNIT_COLS, first, by="folder").select(F.lit(run).alias("run"), "unit", "state", "rehashed", "n", "sum_hash")
            for run, path in (("again", one), ("edited", two))]
    return runs[0].unionByName(runs[1])


# ------------------------------------------------------------------ A1 with damaged lines
_LINE_COLS = ["l_orderkey", "l_linenumber", "item", "opt", "level", "own_amt", "label"]


@register("read_checked", f"""WITH {FACT},
d AS (SELECT *, CASE WHEN l_orderkey % 50 = 1 THEN 'short line' WHEN l_orderkey % 50 = 2 THEN 'long line'
  WHEN l_orderkey % 50 = 3 THEN 'unbalanced quote' END AS reason FROM fact)
SELECT reason, CASE WHEN reason IS NULL THEN item END AS item, CASE WHEN reason IS NULL THEN CASE WHEN opt = '2-HIGH' THEN '' ELSE opt END END AS opt, count(*) AS n,
  CAST(coalesce(sum(CASE WHEN reason IS NULL THEN label END), 0) AS BIGINT) AS positives FROM d GROUP BY 1, 2, 3""")
def q_read_checked(spark, sf):
    """Records as CSV lines, some cut short, some with a cell too many, some with a quote that is never closed."""
    quoted = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    cells = [F.col("l_orderkey"), F.col("l_linenumber"), F.when(F.col("l_orderkey") % 2 == 0, quoted("item")).otherwise(F.col("item")),
             F.when(F.col("opt") == "2-HIGH", "").otherwise(F.col("opt")), F.col("level"), F.round(F.col("own_amt") * 100).cast("long")]
    line = F.concat_ws(",", *[c.cast("string") for c in cells])
    k = F.col("l_orderkey") % 50
    whole = F.concat(line, F.lit(","), F.col("label").cast("string"))
    line = (F.when(k == 1, line).when(k == 2, F.concat(whole, F.lit(",x"))).when(k == 3, F.concat(line, F.lit(',"'), F.col("label").cast("string")))
            .otherwise(whole))
    path = _folder(spark, "lines")
    head = spark.range(1).select(F.lit(",".join(_LINE_COLS)).alias("value"))
    fact_records(spark, sf).select(line.alias("value")).unionByName(head).write.text(path)
    read = read_checked(spark, path, _LINE_COLS)
    return read.groupBy(F.col("_reason").alias("reason"), "item", "opt").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("label").cast("int")), F.lit(0)).cast("long").alias("positives"))


# ------------------------------------------------------------------ A4: every report in one document
_RATE = "round(100.0::DOUBLE * positives / n, 2)"
_ENTRIES = f"""long AS ({union_long('fact', S.report_categoricals)}),
by_value AS (SELECT feature, value, count(*) AS n, CAST(sum(_label) AS BIGINT) AS positives FROM long GROUP BY 1, 2),
level AS (SELECT CAST(level AS DOUBLE) AS x, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives FROM fact GROUP BY 1),
hist_long AS (SELECT 'own_amt' AS c, own_amt AS x FROM fact UNION ALL SELECT 'other_amt', other_amt FROM fact),
st AS (SELECT c, CAST(floor(min(x) / 5000.0) * 5000 AS BIGINT) AS lo, greatest(CAST(ceil(max(x) / 5000.0) * 5000 AS BIGINT) - 5000,
  CAST(floor(min(x) / 5000.0) * 5000 AS BIGINT)) AS last FROM hist_long GROUP BY 1),
spine AS (SELECT c, unnest(range(lo, last + 1, 5000)) AS bin FROM st),
bins AS (SELECT c, least(CAST(floor(x / 5000.0) * 5000 AS BIGINT), last) AS bin, count(*) AS n FROM hist_long JOIN st USING (c) GROUP BY 1, 2),
ranges AS (SELECT unnest(['0-3', '4-6', '7-9', '10-12']) AS bucket),
x AS (SELECT 'item_a' AS what, outcome, CAST(least(item_a_n, 4) AS VARCHAR) AS bucket FROM lab
  UNION ALL SELECT 'item_b', outcome, CAST(least(item_b_n, 4) AS VARCHAR) FROM lab UNION ALL SELECT 'any_flag', outcome, CAST(least(any_flag_n, 4) AS VARCHAR) FROM lab
  UNION ALL SELECT 'range', outcome, CASE WHEN extra_sum <= 3 THEN '0-3' WHEN extra_sum <= 6 THEN '4-6' WHEN extra_sum <= 9 THEN '7-9' ELSE '10-12' END FROM lab),
xs AS (SELECT what, outcome, bucket FROM outcomes, (SELECT w AS what, bucket FROM (SELECT unnest(['item_a', 'item_b', 'any_flag']) AS w), counts5
  UNION ALL SELECT 'range', bucket FROM ranges)),
entries AS (
SELECT 'value_counts' AS report, feature, value AS key, '{{"n":' || n || '}}' AS value FROM by_value
UNION ALL SELECT 'rate_by_value', feature, value, '{{"n":' || n || ',"positives":' || positives || ',"rate":' || {_RATE} || '}}' FROM by_value
UNION ALL SELECT 'numeric_distribution', 'level', CAST(x AS VARCHAR), '{{"n":' || n || ',"positives":' || positives || '}}' FROM level
UNION ALL SELECT 'rate_curve', 'level', CAST(x AS VARCHAR), '{{"rate":' || {_RATE} || ',"n":' || n || '}}' FROM level
UNION ALL SELECT 'overall', '', 'all', '{{"n":' || count(*) || ',"positives":' || sum(label) || '}}' FROM fact
UNION ALL SELECT 'histogram', c, CAST(bin AS VARCHAR), '{{"n":' || coalesce(n, 0) || '}}' FROM spine LEFT JOIN bins USING (c, bin)
UNION ALL SELECT 'numeric_summary', c, 'summary', '{{"min":' || min(x) || ',"max":' || max(x) || ',"median":' || round(median(x), 2) || ',"n":' || count(*) || '}}'
  FROM hist_long GROUP BY c
UNION ALL SELECT 'matches', 'site_type', o.outcome, '{{"type_a_n":' || count(*) FILTER (WHERE site_type = 'click') || ',"type_b_n":' || count(*) FILTER (WHERE site_type = 'view') || '}}'
  FROM outcomes o LEFT JOIN lab ON lab.outcome = o.outcome GROUP BY 3
UNION ALL SELECT 'matches', xs.what, xs.outcome || ' ' || xs.bucket, '{{"n":' || count(x.what) || '}}'
  FROM xs LEFT JOIN x ON x.what = xs.what AND x.outcome = xs.outcome AND x.bucket = xs.bucket GROUP BY xs.what, xs.outcome, xs.bucket)"""


@register("publish_document", f"""{_B}, {FACT}, {_ENTRIES},
o AS (SELECT *, row_number() OVER (PARTITION BY report, feature ORDER BY key) = 1 AS f1, row_number() OVER (PARTITION BY report, feature ORDER BY key DESC) = 1 AS f2,
  row_number() OVER (PARTITION BY report ORDER BY feature, key) = 1 AS r1, row_number() OVER (PARTITION BY report ORDER BY feature DESC, key DESC) = 1 AS r2,
  row_number() OVER (ORDER BY report, feature, key) = 1 AS d1, row_number() OVER (ORDER BY report DESC, feature DESC, key DESC) = 1 AS d2 FROM entries)
SELECT CASE WHEN d1 THEN '{{' WHEN r1 THEN ',' ELSE '' END || CASE WHEN r1 THEN '"' || report || '":{{' ELSE '' END
  || CASE WHEN f1 AND NOT r1 THEN ',' ELSE '' END || CASE WHEN f1 THEN '"' || feature || '":{{' ELSE ',' END || '"' || key || '":' || value
  || CASE WHEN f2 THEN '}}' ELSE '' END || CASE WHEN r2 THEN '}}' ELSE '' END || CASE WHEN d2 THEN '}}' ELSE '' END AS line FROM o""")
def q_publish_document(spark, sf):
    """All reports as one nested JSON document, read back line by line."""
    hist = S.histogram_columns
    f = written(fact_records(spark, sf).select("label", "level", *S.report_categoricals, *hist), "facts")  # eight reports read it
    comp = written(_comp(spark, sf), "compositions")
    rate = F.round("rate", 2).alias("rate")
    parts = [
        P.entries("value_counts", R.value_counts(f, S.report_categoricals), "value", ["n"], "feature"),
        P.entries("rate_by_value", R.rate_by_value(f, S.report_categoricals), "value", ["n", "positives", rate], "feature"),
        P.entries("numeric_distribution", R.numeric_distribution(f, "level"), "value", ["n", "positives"], F.lit("level")),
        P.entries("rate_curve", R.rate_curve(f, "level"), "x", [rate, "n"], F.lit("level")),
        P.entries("overall", R.overall_rate(f).withColumn("key", F.lit("all")), "key", ["n", "positives"]),
        P.entries("histogram", R.histogram(f, hist), "bin_start", ["n"], "column"),
        P.entries("numeric_summary", R.numeric_summary(f, hist).withColumn("key", F.lit("summary")), "key",
                  ["min", "max", F.round("median", 2).alias("median"), "n"], "column"),
        P.entries("matches", B.outcome_by_site_type(comp, "click", "view"), "outcome", ["type_a_n", "type_b_n"], F.lit("site_type"))]
    for name, tab in (("item_a", B.outcome_by_item_a), ("item_b", B.outcome_by_item_b), ("any_flag", B.outcome_by_any_flag), ("range", B.outcome_by_range)):
        parts.append(P.entries("matches", tab(comp).withColumn("key", F.concat_ws(" ", "outcome", "bucket")), "key", ["n"], F.lit(name)))
    path = _folder(spark, "document")
    P.publish(reduce(DataFrame.unionByName, parts), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


# ------------------------------------------------------------------ I1 for request documents
_BROKEN = "l_orderkey % 97 = 0"
_BATCH_BYTES = 1 << 30  # of packed files read by a micro-batch: what it moves and stages on disk is bounded by it


@register("request_stream", f"""WITH {FACT}, sta AS (SELECT * FROM (WITH {sql_scaler_cte('A')} SELECT * FROM st)), stb AS (SELECT * FROM (WITH {sql_scaler_cte('B')} SELECT * FROM st)),
pa AS (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + exp(-({sql_logit('A')}))) AS p FROM fact, sta st WHERE l_linenumber % 2 = 0),
pb AS (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + exp(-({sql_logit('B')}))) AS p FROM fact, stb st WHERE l_linenumber % 2 = 1),
both_ AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, own_amt, opt, extra, flag_a, flag_b, flag_c, flag_d, p FROM pa
  UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, own_amt, opt, extra, flag_a, flag_b, flag_c, flag_d, p FROM pb)
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(own_amt * 100) AS BIGINT)) AS request_id,
  {_BROKEN} OR {sql_cost()} > 4 AS quarantined,
  CASE WHEN NOT ({_BROKEN}) AND {sql_cost()} <= 4 THEN round(p, 6) END AS probability,
  CASE WHEN {_BROKEN} THEN 'unreadable request' WHEN {sql_cost()} > 4 THEN 'invalid configuration: ' || CAST({sql_cost()} AS VARCHAR) || ' slots used, limit 4' END AS error
FROM both_""")
def q_request_stream(spark, sf):
    """Request documents arrive in two files, the first of which is sent again; some bodies are broken off."""
    f = stored_facts(spark, sf)
    fields = [F.col(c) for c in ("item", "opt", "site_type", "flag_a", "flag_b", "flag_c", "flag_d", "extra")]
    fields += [F.col(c).cast("double").alias(c) for c in ("level", "area", "own_amt", "other_amt")]
    model = F.when(F.col("l_linenumber") % 2 == 0, "with_bp").otherwise("no_bp").alias("model_type")
    body = F.to_json(F.struct(model, *fields))
    name = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("own_amt") * 100).cast("long"))
    sent = f.select(name.alias("request_id"), F.when(F.expr(_BROKEN), F.substring(body, 1, 40)).otherwise(body).alias("body"),
                    (F.col("l_orderkey") % 2).alias("half"))
    base = _folder(spark, "requests")
    for minute, half in enumerate((0, 1, 0)):  # made from the stored records: the documents have no copy beside those sent
        arrived = F.to_timestamp(F.lit(f"2024-01-01 00:0{minute}:00"))
        (sent.where(F.col("half") == half).select("request_id", arrived.alias("arrived"), "body")
         .write.mode("append").option("compression", PACKED).parquet(f"{base}/in"))
    source = spark.readStream.schema("request_id string, arrived timestamp, body string").option("maxBytesPerTrigger", _BATCH_BYTES).parquet(f"{base}/in")
    q = start_request_stream(source, fixture_scorer(spark, sf, "A", f), fixture_scorer(spark, sf, "B", f), f"{base}/out", f"{base}/bad", f"{base}/_checkpoint")
    q.awaitTermination()
    sinks = [spark.read.parquet(f"{base}/{sink}").select("request_id", F.lit(bad).alias("quarantined"), F.round("probability", 6).alias("probability"), "error")
             for sink, bad in (("out", False), ("bad", True))]
    return sinks[0].unionByName(sinks[1])


# ------------------------------------------------------------------ B10 for any number of values
@register("wide_vocabulary", f"""WITH {FACT},
v AS (SELECT 1 AS c, CAST(l_orderkey AS VARCHAR) AS value FROM fact UNION SELECT 2, CAST(l_partkey AS VARCHAR) FROM fact),
t AS (SELECT c, value, row_number() OVER (ORDER BY c, value) - 1 AS position FROM v),
w AS (SELECT *, ((7 * position) % 11 - 5) / 10.0::DOUBLE AS weight FROM t)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(own_amt * 100) AS BIGINT) AS cents, [a.position, b.position] AS features,
  round(1.0::DOUBLE / (1.0::DOUBLE + exp(-(a.weight + b.weight - 0.3::DOUBLE))), 6) AS probability
FROM fact JOIN w a ON a.c = 1 AND a.value = CAST(l_orderkey AS VARCHAR) JOIN w b ON b.c = 2 AND b.value = CAST(l_partkey AS VARCHAR)""")
def q_wide_vocabulary(spark, sf):
    """Two fields with a value per order and per part, discovered, encoded as sparse vectors and scored by joins."""
    f = fact_records(spark, sf).withColumn("cents", F.round(F.col("own_amt") * 100).cast("long"))
    columns = ["l_orderkey", "l_partkey"]
    table = E.vocabulary_table(f, columns)
    weights = ((F.col("position") * 7) % 11 - 5) / F.lit(10.0)
    out = E.sparse_features(f, columns, table, weights=weights)
    p = sigmoid(F.col("weight") - F.lit(0.3))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cents", "features", F.round(p, 6).alias("probability"))
