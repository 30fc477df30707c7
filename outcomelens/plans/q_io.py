"""Source/sink queries: fingerprint (A2) and nested report publishing (A4)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import reports as R
from ..operators.ordering import ROWS_PER_TASK, written
from ..session import ensure_checkpoint_dir, shuffle_partitions
from ..sources.fingerprint import changed_since, fingerprint, write_manifest
from ..sources.fixtures import fact_records
from ..sources.publish import nest
from ..spec import FIXTURE_SPEC as S
from .catalog import register
from .oracle import FACT, union_long

# every column of the record view; amounts in cents, so both engines spell them alike
FP_COLS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "label", "item", "opt", "site_type",
           "level", "area", "extra", "flag_a", "flag_b", "flag_c", "flag_d", "own_amt", "other_amt"]
_CENTS = ("own_amt", "other_amt")


def _fp_records(spark, sf):
    f = fact_records(spark, sf)
    return f.select(*[F.round(F.col(c) * 100).cast("long").alias(c) if c in _CENTS else F.col(c) for c in FP_COLS])


def _fp_sql(extra=""):
    cells = ", ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in FP_COLS)
    cols = ", ".join(f"CAST(round({c} * 100) AS BIGINT) AS {c}" if c in _CENTS else c for c in FP_COLS)
    return f"""SELECT count(*) AS n, min(d) AS min_md5, max(d) AS max_md5, bit_xor(h) AS xor_hash, CAST(sum(h) AS DECIMAL(38,0)) AS sum_hash
  FROM (SELECT md5(concat_ws('|', {cells})) AS d, CAST('0x' || substr(md5(concat_ws('|', {cells})), 1, 15) AS BIGINT) AS h
        FROM (SELECT {cols} FROM fact {extra}))"""


@register("fingerprint", f"""WITH {FACT}
SELECT 'same' AS state, *, false AS changed FROM ({_fp_sql()})
UNION ALL SELECT 'label flipped in orders 1 to 9', *, true FROM ({_fp_sql().replace('label,', 'CASE WHEN l_orderkey < 10 THEN 1 - label ELSE label END AS label,')})""")
def q_fingerprint(spark, sf):
    """The records' fingerprint against a stored manifest: unchanged rows (in another order), and edited ones."""
    rec = written(_fp_records(spark, sf), "records")
    path = f"{ensure_checkpoint_dir(spark)}/manifests/{uuid.uuid4().hex}"
    write_manifest(fingerprint(rec, FP_COLS), path)
    manifest = spark.read.parquet(path)
    # another order by the records' own keys, which no value gathers in one task
    tasks = max(shuffle_partitions(spark), -(-manifest.first()["n"] // ROWS_PER_TASK))
    moved = rec.repartition(tasks, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    edited = rec.withColumn("label", F.when(F.col("l_orderkey") < 10, 1 - F.col("label")).otherwise(F.col("label")))
    out = [changed_since(fingerprint(x, FP_COLS), manifest).select(F.lit(state).alias("state"), "*")
           for state, x in (("same", moved), ("label flipped in orders 1 to 9", edited))]
    return out[0].unionByName(out[1])


@register("publish_report", f"""WITH {FACT}, long AS ({union_long('fact', S.report_categoricals)}),
g AS (SELECT feature, value, count(*) AS n FROM long GROUP BY 1, 2)
SELECT feature, '{{' || string_agg('"' || value || '":' || CAST(n AS VARCHAR), ',' ORDER BY value) || '}}' AS payload
FROM g GROUP BY feature""")
def q_publish_report(spark, sf):
    """C1 report nested to one JSON object per feature (the report is already aggregated)."""
    c1 = R.value_counts(fact_records(spark, sf), S.report_categoricals)
    return nest(c1, ["feature"], "value", "n")
