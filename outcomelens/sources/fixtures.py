"""Record-shaped inputs derived from the driver tables.

These functions only give rows in the schema the operators expect; they do none
of the operators' work.  Each one has an SQL twin in ``plans.oracle`` so the
DuckDB oracle sees the same input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _yes_no(cond):
    return F.when(cond, F.lit("Yes")).otherwise(F.lit("No"))


def fact_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per line item: outcome = returned, configuration from order/part/customer.

    Plain equi-joins; Catalyst prunes the columns each query needs and AQE picks
    sort-merge or (size-checked) broadcast per join.  Customers are joined to orders
    and parts to line items first, each side cut to the record's own values, so a line
    item is moved twice and customers' keys don't move it at all.
    """
    return fact_from_lineitem(spark, sf_dir, table(spark, sf_dir, "lineitem"))


def fact_from_lineitem(spark: SparkSession, sf_dir: str, li: DataFrame) -> DataFrame:
    """The record view for any line-item frame (static or streaming) against static dimensions."""
    o = table(spark, sf_dir, "orders")
    p = table(spark, sf_dir, "part")
    c = table(spark, sf_dir, "customer")
    orders = o.join(c, o.o_custkey == c.c_custkey).select(
        "o_orderkey", F.col("o_orderpriority").alias("opt"), (F.col("o_orderstatus") == "F").alias("_c"),
        (F.col("c_mktsegment") == "BUILDING").alias("_d"), F.col("o_totalprice").alias("other_amt"))
    items = li.join(p, li.l_partkey == p.p_partkey).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
        F.col("p_type").alias("item"),
        F.col("l_linestatus").alias("site_type"),
        F.col("p_size").alias("level"),
        F.col("l_quantity").cast("int").alias("area"),
        (F.col("l_discount") > 0.05).alias("_a"),
        (F.col("l_tax") > 0.04).alias("_b"),
        F.col("l_extendedprice").alias("own_amt"))
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "label", "item", "opt", "site_type", "level", "area",
        (F.col("l_linenumber") % 4).alias("extra"),
        *[_yes_no(F.col(f"_{x}")).alias(f"flag_{x}") for x in "abcd"],
        "own_amt", "other_amt")


def signal_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record view with an outcome that its columns can tell: positive where level / 10 plus 2 for
    each of the first two flags plus a noise of 0 to 2 (from the record's hash) reaches 5."""
    f = fact_records(spark, sf_dir).withColumn("cents", F.round(F.col("own_amt") * 100).cast("long"))
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in RECORD_KEY])
    noise = F.conv(F.substring(F.md5(F.concat(F.lit("noise-"), text)), 1, 4), 16, 10).cast("double") / 32768.0
    told = (F.col("level") / 10.0 + F.when(F.col("flag_a") == "Yes", 2.0).otherwise(0.0)
            + F.when(F.col("flag_b") == "Yes", 2.0).otherwise(0.0) + noise)
    return f.withColumn("label", F.when(told >= 5.0, 1).otherwise(0))


#: Unique key of the record view (amounts in cents).
RECORD_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cents"]


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record view as untyped text with deterministic damage (blank, junk, variants).

    Rules: item blank where level % 7 = 0; level 'x' (line 7, odd order) or blank
    (line 7, even order); flags spelled yes/1/true by line number; own_amt blank or
    'nan' every 11th order; label text 'Draw' where area = 50.
    """
    f = fact_records(spark, sf_dir)
    s = lambda c: F.col(c).cast("string")
    flag_variant = lambda c: (F.when((F.col("l_linenumber") == 2) & (F.col(c) == "Yes"), F.lit("yes"))
                              .when((F.col("l_linenumber") == 3) & (F.col(c) == "Yes"), F.lit("1"))
                              .when((F.col("l_linenumber") == 4) & (F.col(c) == "Yes"), F.lit("true"))
                              .otherwise(F.col(c)))
    return f.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.when(F.col("area") == 50, F.lit("Draw"))
         .when(F.col("label") == 1, F.lit("Escape")).otherwise(F.lit("Dead")).alias("label"),
        F.when(F.col("level") % 7 == 0, F.lit("")).otherwise(F.col("item")).alias("item"),
        F.when((F.col("l_linenumber") == 7) & (F.col("l_orderkey") % 2 == 1), F.lit("x"))
         .when(F.col("l_linenumber") == 7, F.lit("")).otherwise(s("level")).alias("level"),
        s("area").alias("area"),
        s("extra").alias("extra"),
        flag_variant("flag_a").alias("flag_a"),
        flag_variant("flag_b").alias("flag_b"),
        F.col("flag_c"), F.col("flag_d"),
        F.col("opt"), F.col("site_type"),
        F.when(F.col("l_orderkey") % 11 == 0,
               F.when(F.col("l_linenumber") % 2 == 0, F.lit("")).otherwise(F.lit("nan")))
         .otherwise(s("own_amt")).alias("own_amt"),
        s("other_amt").alias("other_amt"),
        F.col("own_amt").alias("own_key"),
    )


def batch_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as ordered records: order key (ts, event_id).

    positive = purchase; item = event type; site type = event type, missing on
    errors; count = props.k % 4; flags written in mixed spellings.
    """
    return events_as_records(table(spark, sf_dir, "events"))


def events_as_records(events: DataFrame) -> DataFrame:
    """Projection of an events frame (static or streaming) to ordered records."""
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        "ts", "event_id", "user_id",
        F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("label"),
        F.col("event_type").alias("item"),
        F.when(F.col("event_type") == "error", F.lit(None).cast("string"))
         .otherwise(F.col("event_type")).alias("site_type"),
        (k % 4).alias("extra"),
        F.when(k % 5 == 0, F.lit("Yes")).otherwise(F.lit("No")).alias("flag_a"),
        F.when(k % 7 == 0, F.lit("true")).otherwise(F.lit("No")).alias("flag_b"),
        F.when(F.col("value") > 100, F.lit("1")).otherwise(F.lit("0")).alias("flag_c"),
        F.when(F.col("user_id") % 9 == 0, F.lit("YES")).otherwise(F.lit("no")).alias("flag_d"),
    )


def split_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: key doc_id, label quality, categoricals lang/source."""
    lab = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return (lab.join(docs, "doc_id")
               .select("doc_id", F.col("quality").alias("label"), "lang", "source",
                       F.col("n_chars").cast("double").alias("n_chars")))


def site_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites (nations) in site groups (regions) with a type and an area."""
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    return (n.join(r, n.n_regionkey == r.r_regionkey)
             .select(F.col("n_name").alias("site"), F.col("r_name").alias("site_group"),
                     F.when(F.col("n_nationkey") % 5 == 0, F.lit("F")).otherwise(F.lit("O"))
                      .alias("site_type"),
                     (F.lit(1) + (F.col("n_nationkey") * 3) % 20).cast("int").alias("area")))


def metrics_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A per-step loss-like series: daily mean event value as validation loss."""
    e = table(spark, sf_dir, "events")
    day = F.to_date("ts")
    daily = e.groupBy(day.alias("day")).agg(F.avg("value").alias("val_loss"))
    # one row per day: the unpartitioned window sees a calendar-bounded frame
    first = F.min("day").over(Window.partitionBy())
    return daily.select((F.datediff("day", first) + 1).alias("epoch"), "val_loss")
