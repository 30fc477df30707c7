"""Field-level queries: variant feature lists (B15) and raw/engine renaming."""

from __future__ import annotations

from ..functions.encode import safe_name, variant_columns
from ..sources.fixtures import fact_records
from ..sources.records import rename_fields
from ..spec import FIXED_CAT, FOUND_CAT, GAME_SPEC, FIXTURE_SPEC as S
from .catalog import register
from .oracle import FACT


def _variant_sql():
    """Fixed names come from the spec; those of discovered categories from the records."""
    parts = []
    for v in ("A", "B"):
        for i, f in enumerate(S.features(v)):
            if f.role == FIXED_CAT:
                parts += [f"SELECT '{v}' AS variant, {i} AS field, {k} AS k, '{f.name}__{safe_name(x)}' AS feature" for k, x in enumerate(f.vocab)]
            elif f.role == FOUND_CAT:
                parts.append(f"SELECT '{v}', {i}, row_number() OVER (ORDER BY x), '{f.name}__' || lower(x) FROM (SELECT DISTINCT {f.name} AS x FROM fact)")
            else:
                parts.append(f"SELECT '{v}', {i}, 0, '{f.name}'")
    return f"""WITH {FACT}, n(variant, field, k, feature) AS ({" UNION ALL ".join(parts)})
SELECT variant, CAST(row_number() OVER (PARTITION BY variant ORDER BY field, k) - 1 AS INTEGER) AS position, feature FROM n"""


@register("variant_columns", _variant_sql())
def q_variant_columns(spark, sf):
    """Ordered feature names of each variant (B drops the post-hoc group)."""
    return variant_columns(fact_records(spark, sf), S)


_RAW_NAMES = {f.name: f.source for f in GAME_SPEC.fields if f.source}
_COLS = ["label", "item", "opt", "site_type", "level", "area", "extra", "flag_a", "flag_b", "flag_c", "flag_d",
         "own_amt", "other_amt"]


@register("rename_fields", f"""WITH {FACT}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  {', '.join(f'{c} AS "{_RAW_NAMES[c]}"' for c in _COLS)} FROM fact""")
def q_rename_fields(spark, sf):
    """Engine names -> the original record layout's column names."""
    f = fact_records(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *_COLS)
    return rename_fields(f, GAME_SPEC, to_engine=False)
