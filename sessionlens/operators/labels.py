"""Content and price labels for items, joined onto events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from sessionlens.functions import nan_to_null, strip_ws
from sessionlens.schema import assert_unique

# Default category key (trimmed, lower-cased) -> content type.
DEFAULT_CATEGORY_MAP = {
    "apparel": "Apparel",
    "drinkware": "Drinkware",
    "bags": "Bags",
    "electronics accessories": "Electronics_Accessories",
    "lifestyle": "Lifestyle",
    "small goods": "Small_Goods",
    "campus collection": "Campus_Collection",
    "new": "New_Arrivals",
    "clearance": "Clearance",
    "shop by brand": "Shop_By_Brand",
    "black lives matter": "Cause_Collection",
    "uncategorized items": "Uncategorized",
}

# Fallback labels.
OTHER = "Other"
UNKNOWN_ITEM = "Unknown_Item"
UNKNOWN_PRICE = "Unknown_Price"

# Right-closed price bins (lower edge exclusive, upper inclusive).
PRICE_BINS = [(-0.01, 10.0, "<=10"), (10.0, 25.0, "10-25"), (25.0, 50.0, "25-50"),
              (50.0, 100.0, "50-100"), (100.0, float("inf"), "100+")]


@dataclass(frozen=True)
class ClassifiedEvents:
    events: DataFrame
    items: DataFrame


def resolve_map(category_map: dict | None) -> dict:
    """An empty or missing map falls back to the default one."""
    return dict(category_map) if category_map else dict(DEFAULT_CATEGORY_MAP)


def content_vocabulary(category_map: dict | None = None) -> list[str]:
    """Every content type the labeller can produce, sorted."""
    return sorted(set(resolve_map(category_map).values()) | {OTHER, UNKNOWN_ITEM})


def content_type_expr(category: F.Column, category_map: dict | None = None) -> F.Column:
    m = resolve_map(category_map)
    lookup = F.create_map(*[F.lit(x) for k in sorted(m) for x in (k, m[k])])
    key = F.lower(strip_ws(category))
    return F.coalesce(F.try_element_at(lookup, key), F.lit(OTHER))


def price_bucket_expr(price: F.Column) -> F.Column:
    p = nan_to_null(price.cast("double"))
    expr = None
    for lo, hi, label in PRICE_BINS:
        cond = (p > F.lit(lo)) & (p <= F.lit(hi))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def label_items(items: DataFrame, category_map: dict | None = None) -> DataFrame:
    return items.withColumn("category_key", F.lower(strip_ws(F.col("category")))).select(
        "*",
        content_type_expr(F.col("category"), category_map).alias("content_type"),
        price_bucket_expr(F.col("price_in_usd")).alias("price_bucket"),
    )


def add_labels(
    events: DataFrame,
    items: DataFrame,
    category_map: dict | None = None,
    validate: bool = True,
) -> ClassifiedEvents:
    """events LEFT JOIN labelled items on item_id = id (many-to-one).

    The item table is a dimension: Spark broadcasts it only when its estimated
    size is under ``spark.sql.autoBroadcastJoinThreshold`` (and AQE re-checks
    the real size); beyond that it is a shuffle join with skew splitting.
    ``validate`` makes the plan fail if an item id repeats.
    """
    it = label_items(items, category_map)
    if validate:
        it = assert_unique(it, ["id"], "items")
    dim = it.select(
        F.col("id").alias("_item_id"), "content_type", "price_in_usd", "price_bucket", "brand", "variant", "category"
    )
    ev = events.join(dim, events["item_id"] == dim["_item_id"], "left").drop("_item_id")
    ev = ev.withColumn("content_type", F.coalesce(F.col("content_type"), F.lit(UNKNOWN_ITEM))).withColumn(
        "price_bucket", F.coalesce(F.col("price_bucket"), F.lit(UNKNOWN_PRICE))
    )
    return ClassifiedEvents(events=ev, items=it)


def content_type_counts(events: DataFrame, top_n: int = 30) -> DataFrame:
    """Events per content type (null kept as a group), largest first, top ``top_n``."""
    return (
        events.groupBy("content_type")
        .agg(F.count(F.lit(1)).alias("n_events"))
        .orderBy(F.col("n_events").desc(), F.col("content_type").asc_nulls_first())
        .limit(top_n)
    )


def price_bucket_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("price_bucket").agg(F.count(F.lit(1)).alias("n_events"))
