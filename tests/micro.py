"""Golden micro-fixture M1 (hand-checkable), shared by several test modules."""

from datetime import datetime, timedelta

T0 = datetime(2024, 1, 1)
T1 = datetime(2024, 1, 8)

# (user, session, item, +minutes, type); session 11 starts at T1
EVENTS = [
    (1, 10, 100, 0, "add_to_cart"), (1, 10, 100, 1, "add_to_cart"), (1, 10, 101, 2, "purchase"),
    (1, 11, 102, 0, "add_to_cart"),
    (2, 20, 101, 0, "purchase"), (2, 20, 100, 5, "add_to_cart"),
    (3, 30, 999, 0, "add_to_cart"), (3, 30, 103, 3, "begin_checkout"), (3, 30, 103, 4, "purchase"),
    (3, 30, 103, 4, "purchase"),
]
ITEMS = [(100, "Apparel", 10.0), (101, " DRINKWARE ", 10.01), (102, None, None), (103, "Mystery", 150.0)]
USERS = [1, 2]
ASSIGN = [(1, 0), (2, 1), (3, -1), (4, 2)]

EVENT_SCHEMA = ("src_order long, user_id long, ga_session_id long, item_id long, date timestamp_ntz, "
                "type string, device string, country string")


def events(spark):
    rows = []
    for i, (u, s, it, m, t) in enumerate(EVENTS):
        base = T1 if s == 11 else T0
        rows.append((i, u, s, it, base + timedelta(minutes=m), t, "mobile", "DE"))
    return spark.createDataFrame(rows, EVENT_SCHEMA)


def items(spark):
    return spark.createDataFrame(
        [(i, f"n{i}", "b", "v", c, p, i) for i, c, p in ITEMS],
        "id long, name string, brand string, variant string, category string, price_in_usd double, src_order long",
    )


def users(spark):
    return spark.createDataFrame([(u, 10.0 * u, T0, u) for u in USERS], "id long, ltv double, date timestamp_ntz, src_order long")


def assignments(spark):
    return spark.createDataFrame(ASSIGN, "user_id long, segment_id int")


CATEGORY_MAP = {"apparel": "Apparel", "drinkware": "Drinkware"}
