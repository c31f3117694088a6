"""Adapters from the shared parquet tables to the event/item/user schema.

The parquet tables carry no session id and no cart event, so a fixed mapping
gives them the shape of an e-commerce event log (see FIXTURES.md section 4):

* ``events``: session = 3-day window since 2024-01-01, item = ``props.k``,
  click -> add_to_cart, signup -> begin_checkout, device and country derived
  from the event id, and copies of some events (new source order): every tenth
  repeated as it is (de-duplication), every fiftieth with an item and every
  seventieth with a user above the largest key (unknown items and users).
* ``part`` -> items (every thirteenth id repeated with another name; some prices
  and categories blanked), ``customer`` -> users (some ids repeated with a later
  or a missing date), so that the first-item and latest-user rules have work.
* ``orders`` x ``lineitem`` -> a second, multi-year event log for monthly
  periods.
* Deterministic segments ``user_id % 5 - 1`` (values -1..3) stand in for
  k-means labels where a query must not depend on clustering.

Everything is derived by Spark from the full tables; nothing is sampled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Category map for the part-table item categories.  STANDARD is
# left out on purpose so that it falls back to "Other".
PART_CATEGORY_MAP = {
    "economy": "ECONOMY",
    "large": "LARGE",
    "medium": "MEDIUM",
    "promo": "PROMO",
    "small": "SMALL",
}

DUPLICATE_OFFSET = 1_000_000_000

#: Events of a partition where the tables are joined, de-duplicated and rolled up: sorts and hash tables of a task hold so many.
EVENTS_A_PARTITION = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _copies(when: dict) -> F.Column:
    """Array of 0 and every copy number whose condition holds."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(n).cast("bigint")) for n, cond in {0: F.lit(True), **when}.items()]))


def _beyond(copy: int) -> F.Column:
    """Added to a key: above every key for that copy, else nothing."""
    return F.when(F.col("_copy") == copy, F.lit(DUPLICATE_OFFSET)).otherwise(F.lit(0)).cast("bigint")


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed raw events (before cleaning), with injected key duplicates and unknown references.

    All made in the same scan by exploding a list of copies: 0 the event, 1 a
    duplicate, 2 with an unknown item, 3 with an unknown user.
    """
    ev = table(spark, sf_dir, "events")
    copies = _copies({1: F.col("event_id") % 10 == 0, 2: F.col("event_id") % 50 == 7, 3: F.col("event_id") % 70 == 11})
    ev = ev.select("*", F.explode(copies).alias("_copy"))
    return ev.select(
        (F.col("event_id") + F.col("_copy") * F.lit(DUPLICATE_OFFSET)).alias("src_order"),
        (F.col("user_id") + _beyond(3)).alias("user_id"),
        F.expr("datediff(to_date(ts), date'2024-01-01') div 3").cast("bigint").alias("ga_session_id"),
        (F.get_json_object("props", "$.k").cast("bigint") + _beyond(2)).alias("item_id"),
        F.col("ts").alias("date"),
        F.when(F.col("event_type") == "click", "add_to_cart")
        .when(F.col("event_type") == "signup", "begin_checkout")
        .otherwise(F.col("event_type"))
        .alias("type"),
        F.when(F.col("event_id") % 3 == 0, "desktop").when(F.col("event_id") % 3 == 1, "mobile").alias("device"),
        F.when(F.col("event_id") % 7 == 1, "US")
        .when(F.col("event_id") % 7 == 2, "DE")
        .when(F.col("event_id") % 7 == 3, "IN")
        .when(F.col("event_id") % 7 != 0, "CA")
        .alias("country"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    p = p.select("*", F.explode(_copies({1: F.col("p_partkey") % 13 == 0})).alias("_copy"))
    return p.select(
        F.col("p_partkey").alias("id"),
        F.concat("p_name", F.when(F.col("_copy") == 1, " (again)").otherwise("")).alias("name"),
        F.col("p_brand").alias("brand"),
        F.col("p_size").cast("string").alias("variant"),
        F.when(F.col("p_partkey") % 29 != 7, F.col("p_type")).alias("category"),
        F.when(F.col("p_partkey") % 19 != 4, ((F.col("p_partkey") * 7) % 131).cast("double") + F.col("_copy")).alias("price_in_usd"),
        (F.col("p_partkey") + F.col("_copy") * F.lit(DUPLICATE_OFFSET)).alias("src_order"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    c = c.select("*", F.explode(_copies({1: F.col("c_custkey") % 7 == 0, 2: F.col("c_custkey") % 11 == 0})).alias("_copy"))
    date = F.when(F.col("_copy") == 0, "2024-01-01 00:00:00").when(F.col("_copy") == 1, "2024-02-01 00:00:00")
    return c.select(
        F.col("c_custkey").alias("id"),
        (F.col("c_acctbal") + F.col("_copy")).alias("ltv"),
        date.cast("timestamp_ntz").alias("date"),
        (F.col("c_custkey") + F.col("_copy") * F.lit(DUPLICATE_OFFSET)).alias("src_order"),
    )


def deterministic_assignments(events: DataFrame) -> DataFrame:
    """user_id, segment_id = user_id % 5 - 1 for every user seen in ``events``."""
    return (
        events.select("user_id")
        .distinct()
        .select("user_id", (F.col("user_id") % 5 - 1).cast("int").alias("segment_id"))
    )


def partitions_for(rows: int, parallelism: int) -> int | None:
    """Partitions of about ``EVENTS_A_PARTITION`` rows; None where one wave of tasks is enough (Spark then merges small ones)."""
    n = -(-rows // EVENTS_A_PARTITION)
    return n if n > parallelism else None


def monthly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders x lineitem as a typed event log spanning 1995-2001.

    The partitions of the join, which de-duplication and the session roll-up keep, go by
    the rows of lineitem (a count from the files' footers), so that the memory of
    a task does not grow with the tables.
    """
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem")
    li = lines.select("l_orderkey", "l_partkey", "l_shipdate", "l_returnflag", "l_linenumber")
    n = partitions_for(lines.count(), spark.sparkContext.defaultParallelism)
    if n:
        # rows without an order find no partner and would all meet in one partition
        o, li = o.where("o_orderkey is not null").repartition(n, "o_orderkey"), li.where("l_orderkey is not null").repartition(n, "l_orderkey")
    j = o.join(li, o.o_orderkey == li.l_orderkey, "inner")
    return j.select(
        F.col("l_linenumber").cast("bigint").alias("src_order"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderkey").alias("ga_session_id"),
        F.col("l_partkey").alias("item_id"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("date"),
        F.when(F.col("l_returnflag") == "R", "add_to_cart")
        .when(F.col("l_returnflag") == "A", "purchase")
        .otherwise("view")
        .alias("type"),
        F.lit(None).cast("string").alias("device"),
        F.lit(None).cast("string").alias("country"),
    )
