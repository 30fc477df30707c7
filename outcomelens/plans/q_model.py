"""Encoding, split, scoring and evaluation queries with fixed weights (B9-B12, B23-B25,
C16-C18, E7-E9, H1, H2, H6-H8)."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import encode as E
from ..functions.scalars import decision, round_display, round_fast, sigmoid
from ..operators import learn as L
from ..operators import reports as R
from ..operators import scoring as SC
from ..operators.ordering import written
from ..sources.fixtures import fact_records, metrics_series, split_records
from ..spec import FIXTURE_SPEC as S
from .catalog import register
from .fixture_model import fixture_scorer, stored_facts, sql_cost, sql_logit, sql_scaler_cte, sql_terms, sql_weights
from .oracle import FACT, METRICS, SPLIT, split_alloc, union_long

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "own_key"]
KEY_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey, own_amt AS own_key"
KEY_COLS = "l_orderkey, l_linenumber, l_partkey, l_suppkey, own_key"


def _fact(spark, sf):
    return fact_records(spark, sf).withColumn("own_key", F.col("own_amt"))


def _stored(spark, sf):
    """The records, joined once: a fit and the rows after it read them."""
    return stored_facts(spark, sf).withColumn("own_key", F.col("own_amt"))


# ---------------------------------------------------------------- encoding
@register("one_hot_fixed", f"""WITH {FACT}
SELECT {KEY_SQL}, {", ".join(f"CAST(item = '{v}' AS INTEGER) AS item__{E.safe_name(v)}" for v in S.get("item").vocab)}
FROM fact""")
def q_one_hot_fixed(spark, sf):
    f = _fact(spark, sf)
    return f.select(*KEY, *[e.alias(n) for n, e in E.one_hot_fixed("item", S.get("item").vocab)])


@register("one_hot_discovered", f"""WITH {FACT}
SELECT {KEY_SQL}, CAST(site_type = 'F' AS INTEGER) AS site_type__f, CAST(site_type = 'O' AS INTEGER) AS site_type__o
FROM fact""")
def q_one_hot_discovered(spark, sf):
    f = _stored(spark, sf)
    vocab = R.vocabulary_list(f, "site_type")
    return f.select(*KEY, *[e.alias(n) for n, e in E.one_hot_discovered("site_type", vocab)])


@register("assemble_features", f"""WITH {FACT}
SELECT {KEY_SQL}, [{", ".join(e for _, e in sql_terms("A"))}] AS features FROM fact""")
def q_assemble_features(spark, sf):
    f = _stored(spark, sf)
    c = E.fit_contract(f, S, "A")
    return E.assemble_features(f, c, S, keep=KEY)


@register("check_width", f"""WITH {FACT}
SELECT {KEY_SQL}, {len(sql_terms("B"))} AS width, CAST(NULL AS VARCHAR) AS error FROM fact""")
def q_check_width(spark, sf):
    f = _stored(spark, sf)
    c = E.fit_contract(f, S, "B")
    a = E.assemble_features(f, c, S, keep=KEY)
    return E.check_width(a, c).select(*KEY, F.size("features").alias("width"), "error")


def _scaler_sql(variant):
    terms = sql_terms(variant)
    rows = " UNION ALL ".join(
        f"SELECT '{n}' AS feature, round(m{i}, 6) AS mean, round(s{i}, 6) AS std FROM st"
        for i, (n, _) in enumerate(terms))
    return f"WITH {FACT}, {sql_scaler_cte(variant)}\n{rows}"


@register("scaler_stats", _scaler_sql("A"))
def q_scaler_stats(spark, sf):
    f = _stored(spark, sf)
    c = E.fit_contract(f, S, "A")
    wide = E.expand_features(f, c, S)
    long = E.scaler_long(E.scaler_stats(wide, c.names), c.names)
    return long.select("feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def _standardize_sql(variant):
    terms = sql_terms(variant)
    cols = ", ".join(
        f"round((({e}) - st.m{i}) / (CASE WHEN st.s{i} = 0 THEN 1.0::DOUBLE ELSE st.s{i} END), 6) AS {n}"
        for i, (n, e) in enumerate(terms))
    return f"WITH {FACT}, {sql_scaler_cte(variant)}\nSELECT {KEY_SQL}, {cols} FROM fact, st"


@register("standardize", _standardize_sql("B"))
def q_standardize(spark, sf):
    f = _stored(spark, sf)
    c = E.fit_contract(f, S, "B")
    wide = E.expand_features(f, c, S, keep=KEY)
    z = E.standardize(wide, c.names, keep=KEY)
    return z.select(*KEY, *[F.round(n, 6).alias(n) for n in c.names])


# ---------------------------------------------------------------- split
def _split_sql():
    return f"""WITH {SPLIT}, counts AS (SELECT label, count(*) AS n_c FROM srec GROUP BY 1),
{split_alloc()},
r AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label
        ORDER BY md5(CAST(doc_id AS VARCHAR) || '-42'), doc_id) - 1 AS rn FROM srec)
SELECT doc_id, r.label, CASE WHEN rn < n_test THEN 'test' WHEN rn < n_test + n_val THEN 'val' ELSE 'train' END AS part
FROM r JOIN alloc ON r.label = alloc.label"""


@register("stratified_split", _split_sql())
def q_stratified_split(spark, sf):
    return L.stratified_split(split_records(spark, sf), "doc_id")


def _record_split_sql():
    key = "concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(own_amt * 100) AS BIGINT))"
    return (_split_sql().replace(f"WITH {SPLIT}", f"WITH {FACT}, srec AS (SELECT {key} AS doc_id, label FROM fact)")
            .replace("SELECT doc_id, r.label,", "SELECT doc_id AS record, r.label,"))


@register("split_records", _record_split_sql())
def q_split_records(spark, sf):
    """H1 on the record view."""
    f = fact_records(spark, sf).withColumn("cents", F.round(F.col("own_amt") * 100).cast("long"))
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cents"]
    parts = L.stratified_parts(written(f.select(*keys, "label"), "split-records"), keys)  # read three times
    return parts.select(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("record"), "label", "part")


# ---------------------------------------------------------------- scoring
def _scored_sql(variant):
    cost = sql_cost()
    return f"""WITH {FACT}, {sql_scaler_cte(variant)},
scored AS (SELECT {KEY_SQL}, label,
  CASE WHEN {cost} > 4 THEN NULL ELSE 1.0::DOUBLE / (1.0::DOUBLE + exp(-({sql_logit(variant)}))) END AS p,
  CASE WHEN {cost} > 4 THEN 'invalid configuration: ' || CAST({cost} AS VARCHAR) || ' slots used, limit 4' END AS error
  FROM fact, st)"""


@register("score_batch", _scored_sql("A") + f"""
SELECT {KEY_COLS}, 'A' AS variant, round(p, 6) AS probability, round(p * 100, 4) AS chance,
  p >= 0.5 AS positive, error FROM scored""")
def q_score_batch(spark, sf):
    f = _stored(spark, sf)
    out = SC.score_batch(f, fixture_scorer(spark, sf, "A", f), KEY)
    return out.select(*KEY, "variant", F.round("probability", 6).alias("probability"),
                      F.round(F.col("probability") * 100, 4).alias("chance"), "positive", "error")


@register("sigmoid", f"""WITH {FACT}
SELECT {KEY_SQL}, round(100.0::DOUBLE / (1.0::DOUBLE + exp(-((level - 25.0::DOUBLE) / 10.0::DOUBLE))), 6) AS chance
FROM fact""")
def q_sigmoid(spark, sf):
    f = _fact(spark, sf)
    return f.select(*KEY, F.round(sigmoid((F.col("level") - 25.0) / 10.0) * 100.0, 6).alias("chance"))


@register("decision", f"""WITH {FACT}
SELECT {KEY_SQL}, 1.0::DOUBLE / (1.0::DOUBLE + exp(-((level - 25.0::DOUBLE) / 10.0::DOUBLE))) >= 0.5 AS positive
FROM fact""")
def q_decision(spark, sf):
    f = _fact(spark, sf)
    return f.select(*KEY, decision(sigmoid((F.col("level") - 25.0) / 10.0), 0.5).alias("positive"))


@register("round_display", f"""WITH {FACT}
SELECT {KEY_SQL}, round(own_amt / 3.0::DOUBLE, 2) AS own_2, round(other_amt / 7.0::DOUBLE, 4) AS other_4 FROM fact""")
def q_round_display(spark, sf):
    f = _fact(spark, sf)
    return f.select(*KEY, round_display(F.col("own_amt") / 3.0, 2).alias("own_2"),
                    round_display(F.col("other_amt") / 7.0, 4).alias("other_4"))


def _explain_sql(variant):
    terms = sql_terms(variant)
    w, _ = sql_weights(variant)
    cells = " UNION ALL ".join(
        f"SELECT {KEY_COLS}, '{n}' AS feature, {i} AS i, {w[i]!r}::DOUBLE * pp AS g FROM pp"
        for i, (n, _) in enumerate(terms))
    tot = " + ".join(f"abs({w[i]!r}::DOUBLE * pp)" for i in range(len(terms)))
    return f"""WITH {FACT}, {sql_scaler_cte(variant)},
g0 AS (SELECT {KEY_SQL}, 1.0::DOUBLE / (1.0::DOUBLE + exp(-({sql_logit(variant)}))) AS p FROM fact, st),
pp AS (SELECT {KEY_COLS}, p * (1.0::DOUBLE - p) AS pp FROM g0),
tot AS (SELECT {KEY_COLS}, 0.0::DOUBLE + {tot} AS tot FROM pp),
cells AS ({cells}),
ranked AS (SELECT c.*, tot.tot, row_number() OVER (PARTITION BY c.l_orderkey, c.l_linenumber, c.l_partkey,
             c.l_suppkey, c.own_key ORDER BY abs(g) DESC, i) AS rank
           FROM cells c JOIN tot USING ({KEY_COLS}))
SELECT {KEY_COLS}, feature, rank,
  floor((CASE WHEN tot > 0 THEN abs(g) / tot * 100.0::DOUBLE ELSE abs(g) END) * 1e6::DOUBLE + 0.5::DOUBLE)
    / 1e6::DOUBLE AS magnitude,
  CASE WHEN g > 0 THEN 'positive' WHEN g < 0 THEN 'negative' ELSE 'neutral' END AS direction,
  floor(g * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS raw_gradient FROM ranked"""


def _round6(c):
    """6-place rounding by IEEE arithmetic (exactly rounded steps, same in DuckDB);
    avoids the per-value BigDecimal of ``round`` on millions of rows."""
    return F.floor(F.col(c) * 1e6 + 0.5) / 1e6


def _explained(spark, sf, variant):
    f = _stored(spark, sf)
    ex = SC.explain_gradient(f, fixture_scorer(spark, sf, variant, f), KEY)
    return ex.select(*KEY, "feature", "rank", _round6("magnitude").alias("magnitude"), "direction",
                     _round6("raw_gradient").alias("raw_gradient"))


@register("explain_gradient", _explain_sql("B"))
def q_explain_gradient(spark, sf):
    return _explained(spark, sf, "B")


@register("rank_contributions", _explain_sql("A"))
def q_rank_contributions(spark, sf):
    return _explained(spark, sf, "A")


@register("share_of_total", f"""WITH {FACT}, long AS ({union_long('fact', S.report_categoricals)}),
g AS (SELECT feature, value, count(*) AS n FROM long GROUP BY 1, 2)
SELECT feature, value, n, coalesce(100.0::DOUBLE * n / nullif(sum(n) OVER (PARTITION BY feature), 0), 0.0) AS share
FROM g""")
def q_share_of_total(spark, sf):
    g = R.value_counts(_fact(spark, sf), S.report_categoricals).select("feature", "value", "n")
    # per-feature frame is (features x values) rows: partitioning by feature is bounded
    w = Window.partitionBy("feature")
    return g.withColumn("share", F.coalesce(F.try_divide(F.lit(100.0) * F.col("n"), F.sum("n").over(w)),
                                            F.lit(0.0)))


# ---------------------------------------------------------------- evaluation
_CONF_SQL = f"""WITH {FACT}, {sql_scaler_cte('A')},
pr AS (SELECT label, 1.0::DOUBLE / (1.0::DOUBLE + exp(-({sql_logit('A')}))) AS p FROM fact, st)""" + """,
ok AS (SELECT label, p, p >= 0.5 AS pos FROM pr),
c AS (SELECT count(*) FILTER (WHERE label = 1 AND pos) AS tp, count(*) FILTER (WHERE label <> 1 AND pos) AS fp,
        count(*) FILTER (WHERE label <> 1 AND NOT pos) AS tn, count(*) FILTER (WHERE label = 1 AND NOT pos) AS fn,
        avg(-(label * ln(least(greatest(p, 1e-7), 1 - 1e-7))
            + (1 - label) * ln(1 - least(greatest(p, 1e-7), 1 - 1e-7)))) AS log_loss FROM ok),
m AS (SELECT *, coalesce(100.0::DOUBLE * (tp + tn) / nullif(tp + fp + tn + fn, 0), 0.0) AS accuracy,
        coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0.0) AS precision,
        coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0.0) AS recall FROM c)"""


def _confusion(spark, sf):
    f = _stored(spark, sf)
    return L.confusion(SC.score_batch(f, fixture_scorer(spark, sf, "A", f), ["label"], check_cost=False))


@register("confusion", _CONF_SQL + """
SELECT tp, fp, tn, fn, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(coalesce(2.0::DOUBLE * precision * recall / nullif(precision + recall, 0), 0.0), 6) AS f1,
  round(log_loss, 6) AS log_loss FROM m""")
def q_confusion(spark, sf):
    c = _confusion(spark, sf)
    return c.select("tp", "fp", "tn", "fn", *[F.round(x, 6).alias(x) for x in
                                            ("accuracy", "precision", "recall", "f1", "log_loss")])


@register("log_loss", _CONF_SQL + """
SELECT round(log_loss, 6) AS log_loss FROM m""")
def q_log_loss(spark, sf):
    f = _stored(spark, sf)
    return L.log_loss(SC.score_batch(f, fixture_scorer(spark, sf, "A", f), ["label"], check_cost=False)).select(F.round("log_loss", 6).alias("log_loss"))


@register("quality_gate", _CONF_SQL + """
SELECT round(accuracy, 6) AS accuracy, CASE WHEN accuracy < 50 THEN 'worse than chance' WHEN accuracy < 55 THEN 'weak'
  WHEN accuracy > 95 THEN 'suspicious' ELSE 'fine' END AS verdict FROM m""")
def q_quality_gate(spark, sf):
    g = L.quality_gate(_confusion(spark, sf))
    return g.select(F.round("accuracy", 6).alias("accuracy"), "verdict")


@register("early_stop", f"""WITH {METRICS},
m AS (SELECT epoch, val_loss, min(val_loss) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
      FROM metrics),
m2 AS (SELECT *, prev IS NULL OR val_loss < prev AS improved,
        min(val_loss) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_loss FROM m),
m3 AS (SELECT *, max(CASE WHEN improved THEN epoch END) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_step FROM m2),
m4 AS (SELECT *, CAST(epoch - best_step AS INTEGER) AS since_best FROM m3)
SELECT epoch, round(val_loss, 6) AS val_loss, round(best_loss, 6) AS best_loss, improved, best_step, since_best,
  coalesce(epoch = min(CASE WHEN since_best >= 5 THEN epoch END) OVER (), false) AS stop FROM m4""")
def q_early_stop(spark, sf):
    e = L.early_stop(metrics_series(spark, sf), patience=5)
    return e.withColumn("val_loss", F.round("val_loss", 6)).withColumn("best_loss", F.round("best_loss", 6))


_REQ_ID = ("CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR)"
           " || '-' || CAST(l_suppkey AS VARCHAR) || '-' || CAST(own_amt AS VARCHAR)")


def _request_sql():
    """Record n of each order: 1 sends no JSON, 2 a text as level, 3 leaves out site type and level;
    5 asks for the second model, 6 for importance."""
    names, w = [n for n, _ in sql_terms("A")], sql_weights("A")[0]
    top = names[max(range(len(w)), key=lambda i: (abs(w[i]), -i))]
    logit_b = sql_logit("B").replace("st.m", "sb.m").replace("st.s", "sb.s")
    return f"""WITH {FACT}, {sql_scaler_cte('A')}, {sql_scaler_cte('B').replace('st AS', 'sb AS', 1)},
req AS (SELECT * REPLACE (CASE WHEN l_linenumber = 3 THEN 'O' ELSE site_type END AS site_type,
          CASE WHEN l_linenumber = 3 THEN NULL ELSE level END AS level) FROM fact),
pr AS (SELECT {_REQ_ID} AS request_id, l_linenumber, {sql_cost()} AS cost,
  1.0::DOUBLE / (1.0::DOUBLE + exp(-({sql_logit('A')}))) AS pa,
  1.0::DOUBLE / (1.0::DOUBLE + exp(-({logit_b}))) AS pb FROM req, st, sb),
e AS (SELECT *, CASE WHEN l_linenumber <= 2 THEN 'unreadable request'
    WHEN cost > 4 THEN 'invalid configuration: ' || CAST(cost AS VARCHAR) || ' slots used, limit 4' END AS error FROM pr)
SELECT request_id, CASE WHEN l_linenumber = 5 THEN 'no_bp' ELSE 'with_bp' END AS model_type,
  CASE WHEN error IS NULL THEN round(CASE WHEN l_linenumber = 5 THEN pb ELSE pa END, 6) END AS probability, error,
  CASE WHEN error IS NULL AND l_linenumber = 6 THEN {len(names)} ELSE 0 END AS n_importance,
  CASE WHEN error IS NULL AND l_linenumber = 6 THEN CASE WHEN pa * (1 - pa) > 0 THEN '{top}' ELSE '{names[0]}' END END AS top_feature
FROM e"""


def _bodies(f):
    """Request documents: record 1 of an order sends no JSON, record 2 a text as its level, record 3
    leaves out site type and level, record 4 the model type; 5 asks for the second model, 6 for importance."""
    line = F.col("l_linenumber")
    fields = [x.name for x in S.fields if x.name not in ("label", "site_type", "level")]
    whole = line != 3  # to_json leaves null fields out
    body = F.to_json(F.struct(
        F.col("request_id").alias("config_id"),
        F.when(line == 5, "no_bp").when(line != 4, "with_bp").alias("model_type"),
        F.when(line == 6, True).alias("include_importance"),
        F.when(whole, F.col("site_type")).alias("site_type"),
        F.when(line == 2, F.lit("high")).when(whole, F.col("level").cast("string")).alias("level"), *fields))
    # levels are numbers in a request: unquote the digits
    body = F.regexp_replace(body, r'"level":"(\d+)"', r'"level":$1')
    return F.when(line == 1, F.lit("not json")).otherwise(body)


@register("score_requests", _request_sql())
def q_score_requests(spark, sf):
    """H7 from JSON request documents, damaged ones and both models mixed; with the top feature where asked."""
    f = _stored(spark, sf)
    cid = F.concat_ws("-", *[F.col(k).cast("string") for k in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
                      F.col("own_key").cast("string"))
    sent = f.withColumn("request_id", cid).select("request_id", "l_linenumber", *[x.name for x in S.fields if x.name != "label"])
    out = SC.score_requests(sent.select("request_id", _bodies(sent).alias("body")), fixture_scorer(spark, sf, "A", f),
                            fixture_scorer(spark, sf, "B", f), keep=["request_id"])
    return out.select("request_id", "model_type", F.round("probability", 6).alias("probability"), "error",
                      F.size(F.coalesce("importance", F.array())).alias("n_importance"), F.get("importance", 0)["feature"].alias("top_feature"))


# ---------------------------------------------------------------- explanations of a network
_HIDDEN_OUT = (0.8123, 0.5377, -0.3719)


def _net_weight(j: int, i: int) -> float:
    return ((37 * i + 11 * j + 5) % 211 - 70) / 200.0


def _network(scorer):
    """A network with weights by a rule: three relu units, so its gradient can be said in SQL."""
    d = scorer.contract.width
    first = np.array([[_net_weight(j, i) for i in range(d)] for j in range(3)])
    out = np.vstack((np.zeros(3), np.array(_HIDDEN_OUT)))
    model = SC.MlpModel(((first, np.array([0.1, -0.2, 0.3])), (out, np.array([0.0, -0.1]))), "relu")
    return replace(scorer, model=model)


def _explain_network_sql():
    terms = sql_terms("B")
    z = [f"(({e}) - st.m{i}) / (CASE WHEN st.s{i} = 0 THEN 1.0::DOUBLE ELSE st.s{i} END)" for i, (_, e) in enumerate(terms)]
    pre = [" + ".join([f"{b!r}::DOUBLE", *(f"{_net_weight(j, i)!r}::DOUBLE * z[{i + 1}]" for i in range(len(terms)))])
           for j, b in enumerate((0.1, -0.2, 0.3))]
    logit = " + ".join(["-0.1::DOUBLE", *(f"{v!r}::DOUBLE * greatest(h{j}, 0.0::DOUBLE)" for j, v in enumerate(_HIDDEN_OUT))])
    grads = ", ".join("pp * (" + " + ".join(f"CASE WHEN h{j} > 0 THEN {v!r}::DOUBLE * {_net_weight(j, i)!r}::DOUBLE ELSE 0.0::DOUBLE END"
                                            for j, v in enumerate(_HIDDEN_OUT)) + ")" for i in range(len(terms)))
    names = ", ".join(f"'{n}'" for n, _ in terms)
    return f"""WITH {FACT}, {sql_scaler_cte('B')},
zs AS (SELECT {KEY_SQL}, [{', '.join(z)}] AS z FROM fact, st),
hs AS (SELECT {KEY_COLS}, {', '.join(f'{e} AS h{j}' for j, e in enumerate(pre))} FROM zs),
ps AS (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + exp(-({logit}))) AS p FROM hs),
gs AS (SELECT {KEY_COLS}, unnest([{grads}]) AS g, unnest(range({len(terms)})) AS i FROM (SELECT *, p * (1.0::DOUBLE - p) AS pp FROM ps)),
rs AS (SELECT *, row_number() OVER (PARTITION BY {KEY_COLS} ORDER BY abs(g) DESC, i) AS rank, sum(abs(g)) OVER (PARTITION BY {KEY_COLS}) AS total FROM gs)
SELECT {KEY_COLS}, [{names}][i + 1] AS feature, CAST(rank AS INTEGER) AS rank,
  round(CASE WHEN total > 0 THEN abs(g) / total * 100.0::DOUBLE ELSE abs(g) END, 5) AS magnitude,
  CASE WHEN g > 0 THEN 'positive' WHEN g < 0 THEN 'negative' ELSE 'neutral' END AS direction, round(g, 8) AS raw_gradient FROM rs"""


@register("explain_network", _explain_network_sql())
def q_explain_network(spark, sf):
    """H8 + E8 + E9 for a network: back-propagated gradients of every record, ranked."""
    f = _stored(spark, sf)
    ex = SC.explain_gradient(f, _network(fixture_scorer(spark, sf, "B", f)), KEY)
    return ex.withColumn("magnitude", round_fast("magnitude", 5)).withColumn("raw_gradient", round_fast("raw_gradient", 8))
