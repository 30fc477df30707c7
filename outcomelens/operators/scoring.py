"""Scoring and explanation of configurations.

A ``Scorer`` bundles the feature contract, the scaler and a model.  A logistic
model is evaluated as a plain Column expression (JVM-side, codegen); a
multilayer network is evaluated per Arrow batch in ``mapInPandas`` with its
(small) weight matrices shipped in the closure.  Explanations are gradients of
the probability with respect to standardised inputs, ranked inside each row,
so no shuffle is needed.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.encode import FeatureContract, Scaler, contract_terms
from ..functions.scalars import sigmoid, slot_cost
from ..sources.records import parse_configs
from ..spec import TableSpec


@dataclass(frozen=True)
class LogisticModel:
    weights: tuple[float, ...]
    bias: float


@dataclass(frozen=True)
class MlpModel:
    """Dense network: hidden layers, sigmoid (MLlib) or relu, and a 2-way softmax output (MLlib layout)."""
    layers: tuple[tuple[np.ndarray, np.ndarray], ...]   # (W [out x in], b [out])
    activation: str = "sigmoid"

    def _hidden(self, a: np.ndarray) -> np.ndarray:
        return np.maximum(a, 0.0) if self.activation == "relu" else 1.0 / (1.0 + np.exp(-a))

    def forward(self, z: np.ndarray) -> np.ndarray:
        a = z
        for W, b in self.layers[:-1]:
            a = self._hidden(a @ W.T + b)
        W, b = self.layers[-1]
        out = a @ W.T + b
        return 1.0 / (1.0 + np.exp(-(out[:, 1] - out[:, 0])))

    def gradient(self, z: np.ndarray) -> np.ndarray:
        """d p / d z by back-propagation (rows x features)."""
        acts = [z]
        a = z
        for W, b in self.layers[:-1]:
            a = self._hidden(a @ W.T + b)
            acts.append(a)
        W, b = self.layers[-1]
        out = a @ W.T + b
        p = 1.0 / (1.0 + np.exp(-(out[:, 1] - out[:, 0])))
        d = (p * (1 - p))[:, None] * (W[1] - W[0])[None, :]          # d p / d last hidden
        for (Wl, _), act in zip(reversed(self.layers[:-1]), reversed(acts[1:])):
            d = (d * ((act > 0) if self.activation == "relu" else act * (1 - act))) @ Wl
        return d


@dataclass(frozen=True)
class Scorer:
    spec: TableSpec
    contract: FeatureContract
    scaler: Scaler
    model: LogisticModel | MlpModel

    @property
    def variant(self) -> str:
        return self.contract.variant

    def standardized_terms(self, types: dict | None = None) -> list[tuple[str, Column]]:
        return self.scaler.columns(contract_terms(self.contract, self.spec, types))


def _cost_error(spec: TableSpec, types: dict | None = None) -> Column | None:
    s = spec.search
    if s is None:
        return None
    cost = slot_cost(s, types)
    return F.when(cost > s.slot_limit, F.concat(
        F.lit("invalid configuration: "), cost.cast("string"),
        F.lit(f" slots used, limit {s.slot_limit}")))


def fixed_logistic(names: Sequence[str], bias: float = -0.3) -> LogisticModel:
    """Deterministic small weights (rule: ((7 i) mod 11 - 5) / 10) for oracle-able scoring."""
    return LogisticModel(tuple(((7 * i) % 11 - 5) / 10.0 for i in range(len(names))), bias)


def logit_expr(scorer: Scorer, types: dict | None = None) -> Column:
    m = scorer.model
    assert isinstance(m, LogisticModel)
    acc = F.lit(m.bias)
    for (_, z), w in zip(scorer.standardized_terms(types), m.weights):
        acc = acc + F.lit(w) * z
    return acc


def partial_logit(scorer: Scorer, types: dict | None, grid_fields: Sequence[str]) -> tuple[Column, Column]:
    """A logistic model's logit in two parts: the terms of ``grid_fields``, and all others with the bias.

    Both are rounded to nine digits, so sums that only differ by the order of adding count as equal.
    """
    m = scorer.model
    if not isinstance(m, LogisticModel):
        raise ValueError("only a logistic score falls into parts")
    inside, outside = F.lit(0.0), F.lit(m.bias)
    for (name, z), w in zip(scorer.standardized_terms(types), m.weights):
        if name.split("__")[0] in grid_fields:
            inside = inside + F.lit(w) * z
        else:
            outside = outside + F.lit(w) * z
    return F.round(inside, 9), F.round(outside, 9)


def score_batch(configs: DataFrame, scorer: Scorer, keep: Sequence[str],
                check_cost: bool = True, threshold: float = 0.5) -> DataFrame:
    """H7: probability, chance (x100), positive, error for typed configurations.

    Rows that break the slot limit get an error and no probability (B17).
    """
    err = _cost_error(scorer.spec, dict(configs.dtypes)) if check_cost else None
    if isinstance(scorer.model, LogisticModel):
        p = sigmoid(logit_expr(scorer, dict(configs.dtypes)))
        out = configs.select(*keep, p.alias("probability"),
                             (err if err is not None else F.lit(None).cast("string")).alias("error"))
    else:
        out = _mlp_probability(configs, scorer, keep, err)
    out = out.withColumn("probability", F.when(F.col("error").isNull(), F.col("probability")))
    return out.select(*keep, F.lit(scorer.variant).alias("variant"), "probability",
                      (F.col("probability") * 100.0).alias("chance"),
                      (F.col("probability") >= F.lit(threshold)).alias("positive"), "error")


def _mlp_probability(configs: DataFrame, scorer: Scorer, keep: Sequence[str],
                     err: Column | None) -> DataFrame:
    terms = scorer.standardized_terms(dict(configs.dtypes))
    z = F.array(*[e for _, e in terms]).alias("_z")
    pre = configs.select(*keep, z, (err if err is not None else F.lit(None).cast("string")).alias("error"))
    model = scorer.model
    width = len(terms)   # capture plain values only: Columns are not serialisable
    schema = T.StructType([f for f in pre.schema.fields if f.name != "_z"]
                          + [T.StructField("probability", T.DoubleType(), True)])

    def run(batches):
        for pdf in batches:
            m = np.stack(pdf["_z"].to_numpy()) if len(pdf) else np.zeros((0, width))
            pdf = pdf.drop(columns=["_z"])
            pdf["probability"] = model.forward(m) if len(m) else pd.Series(dtype="float64")
            yield pdf

    return pre.mapInPandas(run, schema)


def gradients(configs: DataFrame, scorer: Scorer, keep: Sequence[str]) -> DataFrame:
    """Per row: probability and ``grad`` = array of d p / d standardised input."""
    names = list(scorer.contract.names)
    m = scorer.model
    if isinstance(m, LogisticModel):
        p = sigmoid(logit_expr(scorer, dict(configs.dtypes)))
        withp = configs.select(*keep, p.alias("probability"))
        pp = F.col("probability") * (F.lit(1.0) - F.col("probability"))
        return withp.select(*keep, "probability", F.array(*[F.lit(w) * pp for w in m.weights]).alias("grad"))
    terms = scorer.standardized_terms(dict(configs.dtypes))
    pre = configs.select(*keep, F.array(*[e for _, e in terms]).alias("_z"))
    schema = T.StructType([f for f in pre.schema.fields if f.name != "_z"] + [
        T.StructField("probability", T.DoubleType()),
        T.StructField("grad", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for pdf in batches:
            zz = np.stack(pdf["_z"].to_numpy()) if len(pdf) else np.zeros((0, len(names)))
            pdf = pdf.drop(columns=["_z"])
            pdf["probability"] = m.forward(zz) if len(zz) else []
            pdf["grad"] = list(m.gradient(zz)) if len(zz) else []
            yield pdf

    return pre.mapInPandas(run, schema)


def _ranked(names: Sequence[str], grad: Column) -> Column:
    """E8 + E9 inside the row: (feature, magnitude in % of the sum, direction, raw) by falling magnitude."""
    total = F.aggregate(grad, F.lit(0.0), lambda acc, x: acc + F.abs(x))
    cells = F.sort_array(F.array(*[
        F.struct((-F.abs(grad[i])).alias("k"), F.lit(i).alias("i"), F.lit(n).alias("feature"), grad[i].alias("g"))
        for i, n in enumerate(names)]))
    return F.transform(cells, lambda c: F.struct(
        c["feature"].alias("feature"),
        F.when(total > 0, F.abs(c["g"]) / total * 100.0).otherwise(F.abs(c["g"])).alias("magnitude"),
        F.when(c["g"] > 0, F.lit("positive")).when(c["g"] < 0, F.lit("negative")).otherwise(F.lit("neutral")).alias("direction"),
        c["g"].alias("raw_gradient")))


def _with_gradient(configs: DataFrame, scorer: Scorer, probability: str, grad: str) -> tuple[DataFrame, Column]:
    """The rows with a model's probability, and its gradient: for a logistic model an expression over the
    probability, so no row has an array that nobody asks for."""
    m = scorer.model
    if not isinstance(m, LogisticModel):
        found = gradients(configs, scorer, configs.columns)
        return found.withColumnsRenamed({"probability": probability, "grad": grad}), F.col(grad)
    p = F.col(probability)
    rows = configs.withColumn(probability, sigmoid(logit_expr(scorer, dict(configs.dtypes))))
    return rows, F.array(*[F.lit(w) * (p * (F.lit(1.0) - p)) for w in m.weights])


def score_requests(requests: DataFrame, with_posthoc: Scorer, without: Scorer, column: str = "body",
                   keep: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    """H7 for request documents: parse, route by ``model_type``, score, explain where asked.

    ``model_type`` is 'with_bp' by default; any other text takes the model without
    the post-hoc group.  Both models score every row in one pass, the row's
    ``model_type`` chooses.  A body that doesn't parse, or a configuration over the
    slot limit, gets an error and no probability.  ``importance`` is filled where
    ``include_importance`` is true.
    """
    cfg = parse_configs(requests, with_posthoc.spec, column, keep)
    cost = _cost_error(with_posthoc.spec, dict(cfg.dtypes))
    error = F.when(F.col("parse_error"), F.lit("unreadable request"))
    if cost is not None:
        error = F.coalesce(error, cost)
    cfg = cfg.withColumn("_error", error)
    both, grad_a = _with_gradient(cfg, with_posthoc, "_pa", "_ga")
    both, grad_b = _with_gradient(both, without, "_pb", "_gb")
    use_a = F.coalesce("model_type", F.lit("with_bp")) == "with_bp"
    fine = F.col("_error").isNull()
    p = F.when(fine, F.when(use_a, F.col("_pa")).otherwise(F.col("_pb")))
    asked = fine & F.coalesce("include_importance", F.lit(False))
    why = F.when(asked & use_a, _ranked(with_posthoc.contract.names, grad_a)).when(asked, _ranked(without.contract.names, grad_b))
    out = both.select(*keep, "config_id", F.when(use_a, F.lit("with_bp")).otherwise(F.lit("no_bp")).alias("model_type"),
                      p.alias("probability"), why.alias("importance"), F.col("_error").alias("error"))
    return out.withColumns({"chance": F.col("probability") * 100.0, "positive": F.col("probability") >= F.lit(threshold)})


def _explain_linear(configs: DataFrame, scorer: Scorer, keep: Sequence[str]) -> DataFrame:
    """Closed form for a logistic model: g_i = w_i * p (1 - p).

    p (1 - p) is one non-negative factor per row, so whenever it is positive the
    order by |g| is the order by |w| (ties by feature index); when it is zero all
    gradients are zero and the order is the feature index.  p (1 - p) and the sum
    of |g| are computed once per row, then one row per feature is generated.
    """
    m = scorer.model
    names = list(scorer.contract.names)
    order = sorted(range(len(names)), key=lambda i: (-abs(m.weights[i]), i))
    static_rank = {i: r + 1 for r, i in enumerate(order)}
    p = sigmoid(logit_expr(scorer, dict(configs.dtypes)))
    withp = configs.select(*keep, p.alias("probability"))
    pp = withp.select(*keep, (F.col("probability") * (F.lit(1.0) - F.col("probability"))).alias("_pp"))
    tot = F.lit(0.0)
    for w in m.weights:
        tot = tot + F.abs(F.lit(w) * F.col("_pp"))
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("feature"), F.lit(float(m.weights[i])).alias("w"),
                               F.lit(static_rank[i]).alias("r")) for i, n in enumerate(names)])
    ex = pp.select(*keep, "_pp", tot.alias("_tot"), F.inline(cells))
    g = F.col("w") * F.col("_pp")
    mag = F.when(F.col("_tot") > 0, F.abs(g) / F.col("_tot") * 100.0).otherwise(F.abs(g))
    direction = F.when(g > 0, F.lit("positive")).when(g < 0, F.lit("negative")).otherwise(F.lit("neutral"))
    rank = F.when(F.col("_pp") > 0, F.col("r")).otherwise(F.col("i") + 1)
    return ex.select(*keep, "feature", rank.alias("rank"), mag.alias("magnitude"), direction.alias("direction"),
                     g.alias("raw_gradient"))


def explain_gradient(configs: DataFrame, scorer: Scorer, keep: Sequence[str]) -> DataFrame:
    """H8 + E8 + E9: one row per (configuration, feature) with rank by magnitude.

    magnitude = |g| / sum |g| * 100 (E8, 0-safe), direction by sign, rank by
    magnitude desc then feature order (E9).  Logistic models use the closed form;
    a network's gradients are ranked in the Arrow batches that give them - no shuffle.
    """
    if isinstance(scorer.model, LogisticModel):
        return _explain_linear(configs, scorer, keep)
    return _explain_ranked(configs, scorer, keep)


def _explain_ranked(configs: DataFrame, scorer: Scorer, keep: Sequence[str]) -> DataFrame:
    """A network's gradients per Arrow batch, ranked there by numpy; one row per feature is generated from
    two plain arrays, the features' places and gradients by falling magnitude."""
    names = list(scorer.contract.names)
    model = scorer.model   # plain values only: Columns are not serialisable
    terms = scorer.standardized_terms(dict(configs.dtypes))
    pre = configs.select(*keep, *[e.alias(f"_z{i}") for i, (_, e) in enumerate(terms)])
    kept = len(keep)
    schema = T.StructType(pre.schema.fields[:kept] + [T.StructField("_at", T.ArrayType(T.IntegerType())), T.StructField("_g", T.ArrayType(T.DoubleType())),
                                                      T.StructField("_tot", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(names)
        for batch in batches:
            n = batch.num_rows
            z = np.empty((n, width))
            for i in range(width):
                z[:, i] = batch.column(kept + i).to_numpy(zero_copy_only=False)
            g = model.gradient(z)
            size = np.abs(g)
            total = np.zeros(n)
            for i in range(width):   # in the features' order, so sums don't depend on the batch
                total += size[:, i]
            at = np.argsort(-size, axis=1, kind="stable")
            ends = pa.array(np.arange(n + 1, dtype=np.int32) * np.int32(width))
            ranked = np.take_along_axis(g, at, 1)
            cells = [pa.ListArray.from_arrays(ends, pa.array(x.ravel())) for x in (at.astype(np.int32), ranked)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], *cells, pa.array(total)], names=[*batch.schema.names[:kept], "_at", "_g", "_tot"])

    ex = pre.mapInArrow(run, schema).select(*keep, "_at", "_tot", F.posexplode("_g").alias("_r", "_x"))
    g = F.col("_x")
    mag = F.when(F.col("_tot") > 0, F.abs(g) / F.col("_tot") * 100.0).otherwise(F.abs(g))
    direction = F.when(g > 0, F.lit("positive")).when(g < 0, F.lit("negative")).otherwise(F.lit("neutral"))
    feature = F.get(F.lit(names), F.get("_at", F.col("_r")))
    return ex.select(*keep, feature.alias("feature"), (F.col("_r") + 1).alias("rank"), mag.alias("magnitude"),
                     direction.alias("direction"), g.alias("raw_gradient"))
