"""Feature encoding shared by fitting and scoring.

A ``FeatureContract`` (ordered feature names, discovered vocabularies, width) is
fitted once and then drives one projection for both training rows and scored
configurations, so the two can never disagree on column order.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..spec import CODE, COUNT, FIXED_CAT, FLAG, FOUND_CAT, LEVEL, MEDIAN, TableSpec
from .scalars import blank_to_sentinel, lenient_numeric


def safe_name(s: str) -> str:
    return re.sub(r"[^0-9a-zA-Z]+", "_", s).strip("_").lower() or "blank"


def one_hot_fixed(col: str, vocab: Sequence[str]) -> list[tuple[str, Column]]:
    """0/1 column per vocabulary value; unseen values give all zeros."""
    return [(f"{col}__{safe_name(v)}", (F.col(col) == F.lit(v)).cast("int")) for v in vocab]


def one_hot_discovered(col: str, vocab: Sequence[str]) -> list[tuple[str, Column]]:
    """As B9 with the vocabulary discovered at fit time (sorted)."""
    return one_hot_fixed(col, sorted(vocab))


@dataclass(frozen=True)
class FeatureContract:
    variant: str
    names: tuple[str, ...]
    vocabularies: dict = field(default_factory=dict)   # FOUND_CAT field -> sorted values

    @property
    def width(self) -> int:
        return len(self.names)

    def to_json(self) -> str:
        return json.dumps({"variant": self.variant, "names": list(self.names),
                           "vocabularies": self.vocabularies})

    @staticmethod
    def from_json(s: str) -> "FeatureContract":
        d = json.loads(s)
        return FeatureContract(d["variant"], tuple(d["names"]), d["vocabularies"])


def _yes(col: str, positive: str) -> Column:
    """1.0 for the positive text or an already-typed 1, else 0.0 (null -> 0)."""
    t = F.col(col).cast("string")
    return F.when(t.isin(positive, "1"), F.lit(1.0)).otherwise(F.lit(0.0))


_NUMERIC = ("int", "bigint", "smallint", "tinyint", "double", "float")


def _number(name: str, default: float, types: dict | None) -> Column:
    """Typed numerics are cast directly; text goes through the lenient parse."""
    if types is not None and types.get(name, "string").startswith(_NUMERIC):
        return F.coalesce(F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double")), F.lit(default))
    return F.coalesce(lenient_numeric(name), F.lit(default))


def feature_terms(spec: TableSpec, variant: str, vocabularies: dict,
                  present: Sequence[str] | None = None,
                  types: dict | None = None, training: bool = False) -> list[tuple[str, Column]]:
    """Ordered (name, expression) pairs.

    Works on typed training records (flags/codes as 0/1) and on configuration
    rows in form spelling (flags Yes/No, codes as text); missing numerics and
    missing discovered categories take the field's serving default (in ``training``
    a missing discovered category stays all zeros).
    """
    out: list[tuple[str, Column]] = []
    for f in spec.features(variant):
        if present is not None and f.name not in present and f.optional:
            continue  # absent optional feature is skipped, as when it was never in the data
        if f.role == FLAG:
            out.append((f.name, _yes(f.name, "Yes")))
        elif f.role == CODE:
            out.append((f.name, _yes(f.name, f.positive)))
        elif f.role in (LEVEL, MEDIAN, COUNT):
            out.append((f.name, _number(f.name, float(f.default or 0.0), types)))
        elif f.role == FIXED_CAT:
            v = blank_to_sentinel(F.col(f.name).cast("string"))
            out += [(f"{f.name}__{safe_name(x)}", F.when(v == F.lit(x), F.lit(1.0)).otherwise(F.lit(0.0)))
                    for x in f.vocab]
        elif f.role == FOUND_CAT:
            v = F.col(f.name).cast("string")
            if f.default is not None and not training:
                v = F.coalesce(v, F.lit(str(f.default)))
            out += [(f"{f.name}__{safe_name(x)}", F.when(v == F.lit(x), F.lit(1.0)).otherwise(F.lit(0.0)))
                    for x in sorted(vocabularies.get(f.name, []))]
    return out


def fit_contract(typed: DataFrame, spec: TableSpec, variant: str = "A") -> FeatureContract:
    """Discover FOUND_CAT vocabularies (bounded category lists) and fix the order."""
    from ..operators.reports import vocabulary_list
    vocabs = {f.name: vocabulary_list(typed, f.name, spec.max_vocabulary)
              for f in spec.features(variant) if f.role == FOUND_CAT and f.name in typed.columns}
    names = tuple(n for n, _ in feature_terms(spec, variant, vocabs, typed.columns))
    return FeatureContract(variant, names, vocabs)


def vocabulary_table(typed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, position): every value of the columns with its place among all, by column (as given) and value.

    The places come from a distributed order, so a vocabulary may be of any size.
    """
    from ..operators.ordering import global_index
    from ..operators.reports import vocabulary
    place = F.array_position(F.lit(list(columns)), F.col("column"))
    values = vocabulary(typed, columns).withColumn("_c", place)
    return global_index(values, ["_c", "value"], "position").select("column", "value", "position")


def sparse_features(typed: DataFrame, columns: Sequence[str], table: DataFrame, name: str = "features",
                    weights: Column | None = None, weight: str = "weight") -> DataFrame:
    """B10 for vocabularies of any size: every row with the sorted positions of its values, by a join per column.

    A value that the table doesn't have, or a missing one, gives no position, as it gives
    all zeros in the wide form.  With ``weights`` (an expression over the table's columns)
    the sum of the found values' weights is added as ``weight``: the fields' part of a linear score.
    """
    table = table.withColumn("_w", weights.cast("double") if weights is not None else F.lit(0.0))
    out, places, parts = typed, [], []
    for i, c in enumerate(columns):
        own = table.where(F.col("column") == c).select(F.col("value").alias(f"_v{i}"), F.col("position").alias(f"_p{i}"), F.col("_w").alias(f"_w{i}"))
        out = out.join(own, F.col(c).cast("string") == F.col(f"_v{i}"), "left")
        places.append(F.col(f"_p{i}"))
        parts.append(F.coalesce(F.col(f"_w{i}"), F.lit(0.0)))
    total = F.lit(0.0)
    for part in parts:
        total = total + part
    cells = [F.array_sort(F.array_compact(F.array(*places))).alias(name)] + ([total.alias(weight)] if weights is not None else [])
    return out.select(*[F.col(f"`{c}`") for c in typed.columns], *cells)


def variant_columns(typed: DataFrame, spec: TableSpec) -> DataFrame:
    """(variant, position, feature) of both variants, from the vocabulary frame.

    Fixed names are few rows from the spec; a discovered category adds a row per value.
    """
    from ..operators.reports import vocabulary
    spark = typed.sparkSession
    found = [f.name for f in spec.fields if f.role == FOUND_CAT and f.name in typed.columns]
    fixed, slots = [], []
    for v in ("A", "B"):
        for i, f in enumerate(spec.features(v)):
            if f.role == FIXED_CAT:
                fixed += [(v, i, k, f"{f.name}__{safe_name(x)}") for k, x in enumerate(f.vocab)]
            elif f.role == FOUND_CAT:
                slots.append((v, i, f.name))
            elif not f.optional or f.name in typed.columns:
                fixed.append((v, i, 0, f.name))
    names = spark.createDataFrame(fixed, "variant string, field int, k int, feature string")
    clean = F.lower(F.trim(F.regexp_replace("value", "[^0-9a-zA-Z]+", "_"), F.lit("_")))
    order = Window.partitionBy("variant", "column").orderBy("value")
    words = (vocabulary(typed, found).join(F.broadcast(spark.createDataFrame(slots, "variant string, field int, column string")), "column")
             .select("variant", "field", F.row_number().over(order).alias("k"),
                     F.concat("column", F.lit("__"), F.when(clean == "", "blank").otherwise(clean)).alias("feature")))
    place = Window.partitionBy("variant").orderBy("field", "k")
    return names.unionByName(words).select("variant", (F.row_number().over(place) - 1).cast("int").alias("position"), "feature")


def contract_terms(contract: FeatureContract, spec: TableSpec,
                   types: dict | None = None, training: bool = False) -> list[tuple[str, Column]]:
    terms = dict(feature_terms(spec, contract.variant, contract.vocabularies, types=types, training=training))
    return [(n, terms[n]) for n in contract.names]


def expand_features(typed: DataFrame, contract: FeatureContract, spec: TableSpec,
                    keep: Sequence[str] = ()) -> DataFrame:
    """One column per feature (wide form), in contract order, of training records."""
    types = dict(typed.dtypes)
    return typed.select(*keep, *[e.alias(n) for n, e in contract_terms(contract, spec, types, training=True)])


def assemble_features(typed: DataFrame, contract: FeatureContract, spec: TableSpec,
                      keep: Sequence[str] = (), name: str = "features") -> DataFrame:
    """Ordered ``array<double>`` feature vector."""
    types = dict(typed.dtypes)
    return typed.select(*keep, F.array(*[e for _, e in contract_terms(contract, spec, types)]).alias(name))


def check_width(df: DataFrame, contract: FeatureContract, col: str = "features") -> DataFrame:
    """Error column when the vector width differs from the model's."""
    n = contract.width
    return df.withColumn("error", F.when(F.size(col) != n, F.concat(
        F.lit(f"feature mismatch: expected {n}, got "), F.size(col).cast("string"))))


def scaler_stats(wide: DataFrame, names: Sequence[str]) -> DataFrame:
    """Per-feature mean and population std, one row (columns mean_i, std_i)."""
    aggs = []
    for i, n in enumerate(names):
        aggs += [F.avg(F.col(n)).alias(f"mean_{i}"), F.stddev_pop(F.col(n)).alias(f"std_{i}")]
    return wide.agg(*aggs)


def scaler_long(stats_row: DataFrame, names: Sequence[str]) -> DataFrame:
    """C18 as (feature, mean, std) rows."""
    cells = [F.struct(F.lit(n).alias("feature"), F.col(f"mean_{i}").alias("mean"),
                      F.col(f"std_{i}").alias("std")) for i, n in enumerate(names)]
    return stats_row.select(F.inline(F.array(*cells)))


@dataclass(frozen=True)
class Scaler:
    """H2 parameters: train-only mean and population std; std 0 divides by 1."""
    means: tuple[float, ...]
    stds: tuple[float, ...]

    @staticmethod
    def fit(wide: DataFrame, names: Sequence[str]) -> "Scaler":
        row = scaler_stats(wide, names).first()  # one row of model parameters
        means = tuple(float(row[f"mean_{i}"] or 0.0) for i in range(len(names)))
        stds = tuple(float(row[f"std_{i}"] or 0.0) for i in range(len(names)))
        return Scaler(means, stds)

    def scale_of(self, i: int) -> float:
        return self.stds[i] if self.stds[i] != 0.0 else 1.0

    def columns(self, terms: list[tuple[str, Column]]) -> list[tuple[str, Column]]:
        return [(n, (e - F.lit(self.means[i])) / F.lit(self.scale_of(i)))
                for i, (n, e) in enumerate(terms)]


def standardize(wide: DataFrame, names: Sequence[str], keep: Sequence[str] = (),
                stats: DataFrame | None = None) -> DataFrame:
    """H2 as a pure DataFrame transform: the stats row enters as one scalar subquery."""
    stats = stats if stats is not None else scaler_stats(wide, names)
    fields = []
    for i in range(len(names)):
        fields += [F.col(f"mean_{i}").alias(f"m{i}"),
                   F.when(F.col(f"std_{i}") == 0, F.lit(1.0)).otherwise(F.col(f"std_{i}")).alias(f"s{i}")]
    st = stats.select(F.struct(*fields).alias("st")).scalar()
    cols = [((F.col(n) - st.getField(f"m{i}")) / st.getField(f"s{i}")).alias(n) for i, n in enumerate(names)]
    return wide.select(*keep, *cols)


def to_form(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Configuration rows in form spelling: typed 0/1 flags -> Yes/No, typed codes -> texts.

    Text columns are kept as they are, so the function is idempotent.
    """
    types = dict(df.dtypes)
    cols = {}
    for f in spec.fields:
        if f.name not in types or not types[f.name].startswith(_NUMERIC):
            continue
        if f.role == FLAG:
            cols[f.name] = F.when(F.col(f.name) == 1, F.lit("Yes")).otherwise(F.lit("No"))
        elif f.role == CODE:
            cols[f.name] = (F.when(F.col(f.name) == 1, F.lit(f.positive))
                             .when(F.col(f.name) == 0, F.lit(f.negative)))
    return df.withColumns(cols) if cols else df
