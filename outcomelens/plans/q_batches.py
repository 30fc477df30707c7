"""Batch queries (E1-E3, C13-C15, B20-B22) over ordered event records."""

from __future__ import annotations

from ..functions.scalars import outcome_label, range_bucket
from ..operators import batches as B
from ..sources.fixtures import batch_records
from .catalog import register
from .oracle import BATCH, lenient_num, truthy

ORDER = ["ts", "event_id"]
ITEM_A, ITEM_B = "click", "view"
FLAGS = ["flag_a", "flag_b", "flag_c", "flag_d"]
ALLOWED, DEFAULT = ("click", "view"), "view"


def _comp(spark, sf):
    needed = [*ORDER, "label", "item", "site_type", "extra", *FLAGS]
    b = B.assign_batches(batch_records(spark, sf).select(*needed), ORDER)
    return B.batch_composition(b, ITEM_A, ITEM_B, FLAGS, ALLOWED, DEFAULT)


_B = f"""WITH {BATCH},
b AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos,
             CAST(floor((row_number() OVER (ORDER BY ts, event_id) - 1) / 4) AS BIGINT) AS batch FROM brec),
g AS (SELECT batch, count(*) AS n, count(*) FILTER (WHERE label = 1) AS positives,
        count(*) FILTER (WHERE item = '{ITEM_A}') AS item_a_n,
        count(*) FILTER (WHERE item = '{ITEM_B}') AS item_b_n,
        count(*) FILTER (WHERE {' OR '.join(truthy(f) for f in FLAGS)}) AS any_flag_n,
        CAST(sum(coalesce(TRY_CAST(trunc({lenient_num('extra')}) AS INTEGER), 0)) AS BIGINT) AS extra_sum,
        arg_min(site_type, pos) FILTER (WHERE site_type IS NOT NULL) AS first_type
      FROM b GROUP BY batch HAVING count(*) = 4),
comp AS (SELECT batch, n, positives, n - positives AS negatives, item_a_n, item_b_n, any_flag_n, extra_sum,
        CASE WHEN first_type IN ('click', 'view') THEN first_type ELSE '{DEFAULT}' END AS site_type FROM g),
lab AS (SELECT CAST(4 - positives AS VARCHAR) || 'k' AS outcome, * FROM comp),
outcomes AS (SELECT unnest(['0k', '1k', '2k', '3k', '4k']) AS outcome),
counts5 AS (SELECT unnest(['0', '1', '2', '3', '4']) AS bucket)"""


@register("assign_batches", f"""{_B}
SELECT event_id, batch FROM b""")
def q_assign_batches(spark, sf):
    return B.assign_batches(batch_records(spark, sf).select(*ORDER), ORDER).select("event_id", "batch")


@register("complete_batches", f"""{_B}
SELECT batch, n FROM g""")
def q_complete_batches(spark, sf):
    return _comp(spark, sf).select("batch", "n")


@register("batch_first", f"""{_B}
SELECT batch, site_type FROM comp""")
def q_batch_first(spark, sf):
    return _comp(spark, sf).select("batch", "site_type")


@register("batch_composition", f"""{_B}
SELECT * FROM comp""")
def q_batch_composition(spark, sf):
    return _comp(spark, sf)


@register("outcome_label", f"""{_B}
SELECT batch, outcome FROM lab""")
def q_outcome_label(spark, sf):
    return _comp(spark, sf).select("batch", outcome_label("positives", 4).alias("outcome"))


@register("range_bucket", f"""{_B}
SELECT batch, extra_sum, CASE WHEN extra_sum <= 3 THEN '0-3' WHEN extra_sum <= 6 THEN '4-6'
  WHEN extra_sum <= 9 THEN '7-9' ELSE '10-12' END AS bucket FROM comp""")
def q_range_bucket(spark, sf):
    return _comp(spark, sf).select("batch", "extra_sum", range_bucket("extra_sum").alias("bucket"))


@register("outcome_by_site_type", f"""{_B},
t AS (SELECT outcome, count(*) FILTER (WHERE site_type = 'click') AS type_a_n,
        count(*) FILTER (WHERE site_type = 'view') AS type_b_n FROM lab GROUP BY 1),
o AS (SELECT outcomes.outcome, coalesce(type_a_n, 0) AS type_a_n, coalesce(type_b_n, 0) AS type_b_n,
        coalesce(type_a_n, 0) + coalesce(type_b_n, 0) AS total FROM outcomes LEFT JOIN t USING (outcome))
SELECT outcome, CAST(type_a_n AS BIGINT) AS type_a_n, CAST(type_b_n AS BIGINT) AS type_b_n,
  CAST(total AS BIGINT) AS total,
  coalesce(total * 100.0::DOUBLE / nullif((SELECT sum(total) FROM o), 0), 0.0) AS pct FROM o""")
def q_outcome_by_site_type(spark, sf):
    return B.outcome_by_site_type(_comp(spark, sf), "click", "view")


def _xtab_sql(bucket_expr: str, spine: str) -> str:
    return f"""{_B},
ranges AS (SELECT unnest(['0-3', '4-6', '7-9', '10-12']) AS bucket),
x AS (SELECT outcome, {bucket_expr} AS bucket, count(*) AS n FROM lab GROUP BY 1, 2)
SELECT o.outcome, s.bucket, CAST(coalesce(x.n, 0) AS BIGINT) AS n
FROM outcomes o CROSS JOIN {spine} s LEFT JOIN x ON x.outcome = o.outcome AND x.bucket = s.bucket"""


@register("outcome_by_item_a", _xtab_sql("CAST(least(item_a_n, 4) AS VARCHAR)", "counts5"))
def q_outcome_by_item_a(spark, sf):
    return B.outcome_by_item_a(_comp(spark, sf))


@register("outcome_by_item_b", _xtab_sql("CAST(least(item_b_n, 4) AS VARCHAR)", "counts5"))
def q_outcome_by_item_b(spark, sf):
    return B.outcome_by_item_b(_comp(spark, sf))


@register("outcome_by_any_flag", _xtab_sql("CAST(least(any_flag_n, 4) AS VARCHAR)", "counts5"))
def q_outcome_by_any_flag(spark, sf):
    return B.outcome_by_any_flag(_comp(spark, sf))


@register("outcome_by_range", _xtab_sql(
    "CASE WHEN extra_sum <= 3 THEN '0-3' WHEN extra_sum <= 6 THEN '4-6' "
    "WHEN extra_sum <= 9 THEN '7-9' ELSE '10-12' END", "ranges"))
def q_outcome_by_range(spark, sf):
    return B.outcome_by_range(_comp(spark, sf))
