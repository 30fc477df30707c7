"""DuckDB SQL twins of the registered queries (the correctness oracle).

Input views are rebuilt in SQL exactly as ``sources.fixtures`` builds them in
Spark.  Conventions shared with the Spark side: counts BIGINT, rates DOUBLE as
100*positives/n, averages / medians / exp results rounded to 6 places, and
``trunc`` before integer casts (DuckDB rounds, Spark truncates).
"""

from __future__ import annotations

FACT = """fact AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
    p_type AS item, o_orderpriority AS opt, l_linestatus AS site_type,
    p_size AS level, CAST(trunc(l_quantity) AS INTEGER) AS area,
    l_linenumber % 4 AS extra,
    CASE WHEN l_discount > 0.05 THEN 'Yes' ELSE 'No' END AS flag_a,
    CASE WHEN l_tax > 0.04 THEN 'Yes' ELSE 'No' END AS flag_b,
    CASE WHEN o_orderstatus = 'F' THEN 'Yes' ELSE 'No' END AS flag_c,
    CASE WHEN c_mktsegment = 'BUILDING' THEN 'Yes' ELSE 'No' END AS flag_d,
    l_extendedprice AS own_amt, o_totalprice AS other_amt
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey)"""

RAW = FACT + """,
raw AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    CASE WHEN area = 50 THEN 'Draw' WHEN label = 1 THEN 'Escape' ELSE 'Dead' END AS label,
    CASE WHEN level % 7 = 0 THEN '' ELSE item END AS item,
    CASE WHEN l_linenumber = 7 AND l_orderkey % 2 = 1 THEN 'x'
         WHEN l_linenumber = 7 THEN '' ELSE CAST(level AS VARCHAR) END AS level,
    CAST(area AS VARCHAR) AS area, CAST(extra AS VARCHAR) AS extra,
    CASE WHEN l_linenumber = 2 AND flag_a = 'Yes' THEN 'yes'
         WHEN l_linenumber = 3 AND flag_a = 'Yes' THEN '1'
         WHEN l_linenumber = 4 AND flag_a = 'Yes' THEN 'true' ELSE flag_a END AS flag_a,
    CASE WHEN l_linenumber = 2 AND flag_b = 'Yes' THEN 'yes'
         WHEN l_linenumber = 3 AND flag_b = 'Yes' THEN '1'
         WHEN l_linenumber = 4 AND flag_b = 'Yes' THEN 'true' ELSE flag_b END AS flag_b,
    flag_c, flag_d, opt, site_type,
    CASE WHEN l_orderkey % 11 = 0 THEN (CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE 'nan' END)
         ELSE CAST(own_amt AS VARCHAR) END AS own_amt,
    CAST(other_amt AS VARCHAR) AS other_amt,
    own_amt AS own_key
  FROM fact)"""

BATCH = """brec AS (
  SELECT ts, event_id, user_id,
    CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS label,
    event_type AS item,
    CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS site_type,
    CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 AS extra,
    CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 = 0 THEN 'Yes' ELSE 'No' END AS flag_a,
    CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 7 = 0 THEN 'true' ELSE 'No' END AS flag_b,
    CASE WHEN value > 100 THEN '1' ELSE '0' END AS flag_c,
    CASE WHEN user_id % 9 = 0 THEN 'YES' ELSE 'no' END AS flag_d
  FROM events)"""

SPLIT = """srec AS (
  SELECT l.doc_id, l.quality AS label, d.lang, d.source, CAST(d.n_chars AS DOUBLE) AS n_chars
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""

SITES = """sites AS (
  SELECT n_name AS site, r_name AS site_group,
    CASE WHEN n_nationkey % 5 = 0 THEN 'F' ELSE 'O' END AS site_type,
    CAST(1 + (n_nationkey * 3) % 20 AS INTEGER) AS area
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""

METRICS = """daily AS (
  SELECT CAST(ts AS DATE) AS day, avg(value) AS val_loss FROM events GROUP BY 1),
metrics AS (
  SELECT CAST(datediff('day', (SELECT min(day) FROM daily), day) + 1 AS INTEGER) AS epoch, val_loss
  FROM daily)"""


def split_alloc() -> str:
    """CTEs from ``counts`` (label, n_c) to ``alloc`` (label, n_test, n_val)."""
    return """a1 AS (SELECT label, n_c, sum(n_c) OVER () AS tot, CAST(ceil(sum(n_c) OVER () * 0.2) AS BIGINT) AS draws FROM counts),
b1 AS (SELECT *, CAST(floor(n_c * draws / tot) AS BIGINT) AS base, (n_c * draws) % tot AS rem FROM a1),
c1 AS (SELECT *, draws - sum(base) OVER () AS lft, row_number() OVER (ORDER BY rem DESC, label) AS rk FROM b1),
t AS (SELECT label, n_c, base + CASE WHEN rk <= lft THEN 1 ELSE 0 END AS n_test FROM c1),
a2 AS (SELECT label, n_c, n_test, n_c - n_test AS n_rest, sum(n_c - n_test) OVER () AS tot,
        CAST(ceil(sum(n_c - n_test) OVER () * 0.2) AS BIGINT) AS draws FROM t),
b2 AS (SELECT *, CAST(floor(n_rest * draws / tot) AS BIGINT) AS base, (n_rest * draws) % tot AS rem FROM a2),
c2 AS (SELECT *, draws - sum(base) OVER () AS lft, row_number() OVER (ORDER BY rem DESC, label) AS rk FROM b2),
alloc AS (SELECT label, n_test, base + CASE WHEN rk <= lft THEN 1 ELSE 0 END AS n_val FROM c2)"""


def truthy(col: str) -> str:
    return f"coalesce(lower(trim(CAST({col} AS VARCHAR))) IN ('yes','1','true','1.0'), false)"


def norm_flag(col: str) -> str:
    return f"CASE WHEN {truthy(col)} THEN 'Yes' ELSE 'No' END"


def lenient_num(col: str) -> str:
    v = f"TRY_CAST(CAST({col} AS VARCHAR) AS DOUBLE)"
    return f"(CASE WHEN isnan({v}) THEN NULL ELSE {v} END)"


def union_long(source: str, columns, label: str = "label", blank: str = "None") -> str:
    parts = []
    for c in columns:
        v = f"CAST({c} AS VARCHAR)"
        v = f"coalesce(nullif({v}, ''), 'None')" if blank == "None" else f"coalesce({v}, '')"
        parts.append(f"SELECT {label} AS _label, '{c}' AS feature, {v} AS value FROM {source}")
    return "\nUNION ALL\n".join(parts)
