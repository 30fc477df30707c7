"""Table specs: which column plays which role, with vocabularies and fill policies.

A spec drives cleaning (``functions.scalars``), encoding (``functions.encode``),
configuration search (``operators.configs``) and reports, so fit and score share
one projection.  Two specs ship: ``FIXTURE_SPEC`` for the record view built from
the driver tables and ``GAME_SPEC`` for headered CSV files in the original
record layout.
"""

from __future__ import annotations

from dataclasses import dataclass, field as dc_field

# Roles
LABEL = "label"          # two-valued outcome text -> 0/1, unmapped -> null (quarantined)
CODE = "code"            # two-valued text -> 0/1 by lookup, unmapped -> null (row dropped)
LEVEL = "level"          # lenient numeric, missing -> row dropped
MEDIAN = "median"        # lenient numeric, missing -> exact median, all missing -> default
COUNT = "count"          # lenient numeric int, missing -> 0
FLAG = "flag"            # Yes -> 1, anything else -> 0
FIXED_CAT = "fixed_cat"  # categorical, vocabulary declared here, blank -> sentinel
FOUND_CAT = "found_cat"  # categorical, vocabulary discovered at fit (sorted)

NONE_VALUE = "None"


@dataclass(frozen=True)
class Field:
    name: str                       # engine column name
    role: str
    source: str | None = None       # column name in a raw headered file
    vocab: tuple[str, ...] = ()
    positive: str | None = None     # CODE/LABEL: text that means 1
    negative: str | None = None     # CODE/LABEL: text that means 0
    default: object = None          # serving default / fill default
    optional: bool = True
    posthoc: bool = False           # belongs to the post-hoc group (variant A only)


@dataclass(frozen=True)
class SearchSpace:
    """Constrained configuration space used by the grid search operators."""
    item_field: str
    items: tuple[str, ...]                 # search order of item values
    option_field: str
    options: tuple[str, ...]               # search order of option values
    double_cost_option: str                # option that takes two slots
    popular_options: tuple[str, ...]       # preferred first when ordering loadouts
    count_field: str                       # slot-taking count column (0..3)
    slot_flags: tuple[str, ...]            # Yes/No options costing one slot each
    slot_limit: int = 4
    levels: tuple[float, ...] = ()
    level_field: str = "level"
    free_flags: tuple[str, ...] = ()       # Yes/No fields searched at no slot cost
    free_codes: tuple[str, ...] = ()       # CODE fields searched over both values
    posthoc_own: tuple[float, ...] = ()
    posthoc_other: tuple[float, ...] = ()
    top_level: float = 100.0
    top_posthoc: tuple[float, float] = (0.0, 0.0)


@dataclass(frozen=True)
class TableSpec:
    fields: tuple[Field, ...]
    key: tuple[str, ...]
    label: str = "label"
    site_type: str | None = None           # FOUND_CAT column used as site type
    site_area: str | None = None           # MEDIAN column used as site area
    search: SearchSpace | None = None
    report_categoricals: tuple[str, ...] = dc_field(default_factory=tuple)
    report_numeric: str | None = None
    histogram_columns: tuple[str, ...] = ()
    max_vocabulary: int | None = None      # refuse wider discovered vocabularies (off: no limit)

    def get(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise KeyError(name)

    def has(self, name: str) -> bool:
        return any(f.name == name for f in self.fields)

    def features(self, variant: str = "A") -> tuple[Field, ...]:
        """Feature fields in vector order; variant B drops the post-hoc group."""
        return tuple(f for f in self.fields
                     if f.role != LABEL and (variant == "A" or not f.posthoc))

    def present(self, columns) -> "TableSpec":
        """Spec restricted to the optional fields present in ``columns``."""
        cols = set(columns)
        kept = tuple(f for f in self.fields if (not f.optional) or f.name in cols)
        return TableSpec(kept, self.key, self.label, self.site_type, self.site_area,
                         self.search, self.report_categoricals, self.report_numeric,
                         self.histogram_columns)


# ---------------------------------------------------------------------------
# Record view over the driver tables (see sources.fixtures.fact_records).
# Fixed values for this view: p_type values, order priorities, their order.
FIXTURE_ITEMS = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD", "None")
FIXTURE_OPTIONS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "None")

FIXTURE_SPEC = TableSpec(
    fields=(
        Field("label", LABEL, positive="1", negative="0", optional=False),
        Field("level", LEVEL, default=0.0, optional=False),
        Field("area", MEDIAN, default=9728.0),
        Field("item", FIXED_CAT, vocab=FIXTURE_ITEMS, default=NONE_VALUE, optional=False),
        Field("flag_a", FLAG, default="No"),
        Field("flag_b", FLAG, default="No"),
        Field("flag_c", FLAG, default="No"),
        Field("flag_d", FLAG, default="No"),
        Field("extra", COUNT, default=0),
        Field("opt", FIXED_CAT, vocab=FIXTURE_OPTIONS, default=NONE_VALUE),
        Field("site_type", FOUND_CAT, default="O"),
        Field("own_amt", MEDIAN, default=0.0, posthoc=True),
        Field("other_amt", MEDIAN, default=0.0, posthoc=True),
    ),
    key=("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "own_amt"),
    site_type="site_type",
    site_area="area",
    search=SearchSpace(
        item_field="item",
        items=("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD", "None"),
        option_field="opt",
        options=("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "None"),
        double_cost_option="4-NOT SPECIFIED",
        popular_options=("1-URGENT", "2-HIGH", "3-MEDIUM"),
        count_field="extra",
        slot_flags=("flag_a", "flag_b", "flag_c", "flag_d"),
        levels=(50.0, 40.0, 30.0, 20.0, 10.0, 1.0),
        posthoc_own=(90000.0, 60000.0, 30000.0),
        posthoc_other=(100000.0, 200000.0, 300000.0),
        top_level=50.0,
        top_posthoc=(60000.0, 200000.0),
    ),
    report_categoricals=("item", "opt", "site_type", "flag_a", "flag_b", "flag_c", "flag_d"),
    report_numeric="level",
    histogram_columns=("own_amt", "other_amt"),
)


# ---------------------------------------------------------------------------
# Headered record files in the original layout (one row per player per match).
# Fixed values that must equal the original application's: column names,
# vocabularies, code texts, defaults and search grids, in their original order.
GAME_ITEMS_TRAIN = ("Firecracker", "Flashlight", "Key", "Map", "Medkit", "Toolbox", "None")
GAME_EXHAUSTION = ("None", "Sprint Burst", "Dead Hard", "Lithe", "Overcome", "DHBL",
                   "Balanced Landing", "Background Player", "Head On")
GAME_SEARCH_ITEMS = ("Medkit", "Toolbox", "Flashlight", "Key", "Map", "Firecracker", "Fog Vial", "None")
GAME_SEARCH_EXHAUSTION = ("Sprint Burst", "Dead Hard", "Lithe", "DHBL", "None")
GAME_SEARCH_LEVELS = (100.0, 50.0, 30.0, 20.0, 10.0, 0.0)
GAME_SEARCH_SURVIVOR_BP = (30000.0, 25000.0, 20000.0, 15000.0)
GAME_SEARCH_KILLER_BP = (10000.0, 15000.0, 20000.0, 25000.0)
GAME_DEFAULT_AREA = 9728.0
GAME_RESULT_POSITIVE = "Escape"
GAME_RESULT_NEGATIVE = "Dead"

GAME_SPEC = TableSpec(
    fields=(
        Field("label", LABEL, source="Result", positive=GAME_RESULT_POSITIVE,
              negative=GAME_RESULT_NEGATIVE, optional=False),
        Field("gender", CODE, source="Survivor Gender", positive="F", negative="M",
              default="M", optional=False),
        Field("steam", CODE, source="Steam Player", positive="Yes", negative="No",
              default="No", optional=False),
        Field("anonymous", CODE, source="Anonymous Mode", positive="Yes", negative="No",
              default="No", optional=False),
        Field("level", LEVEL, source="Prestige", default=0.0, optional=False),
        Field("area", MEDIAN, source="Map Area", default=GAME_DEFAULT_AREA),
        Field("item", FIXED_CAT, source="Item", vocab=GAME_ITEMS_TRAIN, default=NONE_VALUE,
              optional=False),
        Field("addon", FLAG, source="Powerful Add-ons", default="No"),
        Field("flag_a", FLAG, source="Decisive Strike", default="No"),
        Field("flag_b", FLAG, source="Unbreakable", default="No"),
        Field("flag_c", FLAG, source="Off the Record", default="No"),
        Field("flag_d", FLAG, source="Adrenaline", default="No"),
        Field("extra", COUNT, source="Chase Perks", default=0),
        Field("opt", FIXED_CAT, source="Exhaustion Perk", vocab=GAME_EXHAUSTION,
              default=NONE_VALUE),
        Field("site_type", FOUND_CAT, source="Map Type", default="Outdoor"),
        Field("own_amt", MEDIAN, source="Survivor BP", default=0.0, posthoc=True),
        Field("other_amt", MEDIAN, source="Killer BP", default=0.0, posthoc=True),
    ),
    key=("seq",),
    site_type="site_type",
    site_area="area",
    search=SearchSpace(
        item_field="item",
        items=GAME_SEARCH_ITEMS,
        option_field="opt",
        options=GAME_SEARCH_EXHAUSTION,
        double_cost_option="DHBL",
        popular_options=("Sprint Burst", "Dead Hard", "Lithe"),
        count_field="extra",
        slot_flags=("flag_a", "flag_b", "flag_c", "flag_d"),
        levels=GAME_SEARCH_LEVELS,
        free_flags=("addon",),
        free_codes=("gender", "steam", "anonymous"),
        posthoc_own=GAME_SEARCH_SURVIVOR_BP,
        posthoc_other=GAME_SEARCH_KILLER_BP,
        top_level=100.0,
        top_posthoc=(25000.0, 15000.0),
    ),
    report_categoricals=("item", "opt", "site_type", "gender", "steam", "anonymous",
                         "addon", "flag_a", "flag_b", "flag_c", "flag_d"),
    report_numeric="level",
    histogram_columns=("own_amt", "other_amt"),
)
