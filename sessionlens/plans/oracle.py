"""DuckDB SQL oracles for the registered queries.

Each oracle starts from the shared parquet tables (views ``events``, ``part``,
``customer``, ``orders``, ``lineitem``) and rebuilds the same adapter and
operator chain in plain SQL, written independently of the Spark code.  Common
steps are named CTEs; ``build(final, ...)`` prepends the CTEs a query needs.
Every DOUBLE output column is rounded to 6 places (and -0.0 cleared) on both
sides so float summation order cannot change a value hash.
"""

from __future__ import annotations


# Fixed values of the fixture, written out here so that a mistake in the engine's own lists shows.
PART_CATEGORY_MAP = {"economy": "ECONOMY", "large": "LARGE", "medium": "MEDIUM", "promo": "PROMO", "small": "SMALL"}
VOCAB = ["ECONOMY", "LARGE", "MEDIUM", "Other", "PROMO", "SMALL", "Unknown_Item"]

_CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, deps: list[str], body: str) -> None:
    _CTES[name] = (deps, body)


def _resolve(names, out, seen):
    for n in names:
        if n in seen:
            continue
        deps, _ = _CTES[n]
        _resolve(deps, out, seen)
        seen.add(n)
        out.append(n)


def build(final: str, *needs: str, doubles: tuple[str, ...] = ()) -> str:
    order: list[str] = []
    _resolve(needs, order, set())
    parts = [f"{n} AS (\n{_CTES[n][1]}\n)" for n in order]
    head = ("WITH " + ",\n".join(parts) + "\n") if parts else ""
    body = f"{head}{final}"
    if any(n.endswith("_lloyd") for n in order):
        body = body.replace("WITH ", "WITH RECURSIVE ", 1)
    if doubles:
        repl = ", ".join(
            f"CASE WHEN isnan({c}) OR abs({c}) >= 1e9 THEN {c} ELSE floor({c} * 1e6 + 0.5) / 1e6 END + 0.0 AS {c}"
            for c in doubles)
        return f"SELECT * REPLACE ({repl}) FROM (\n{body}\n) q"
    return body


def _dedup(src: str) -> str:
    return f"""SELECT src_order, user_id, ga_session_id, item_id, date, type, device, country FROM (
  SELECT src_order, user_id, ga_session_id, item_id, date, type, device, COALESCE(country, 'Unknown') AS country,
         row_number() OVER (PARTITION BY user_id, ga_session_id, item_id, date, type ORDER BY src_order) AS rn
  FROM {src}
  WHERE user_id IS NOT NULL AND ga_session_id IS NOT NULL AND type IS NOT NULL AND date IS NOT NULL AND item_id IS NOT NULL
) t WHERE rn = 1"""


# ---------------------------------------------------------------- adapters
cte("raw_e", [], """SELECT event_id AS src_order, user_id,
  CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 3 AS BIGINT) AS ga_session_id,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id,
  ts AS date,
  CASE WHEN event_type = 'click' THEN 'add_to_cart' WHEN event_type = 'signup' THEN 'begin_checkout' ELSE event_type END AS type,
  CASE WHEN event_id % 3 = 0 THEN 'desktop' WHEN event_id % 3 = 1 THEN 'mobile' END AS device,
  CASE WHEN event_id % 7 = 1 THEN 'US' WHEN event_id % 7 = 2 THEN 'DE' WHEN event_id % 7 = 3 THEN 'IN'
       WHEN event_id % 7 <> 0 THEN 'CA' END AS country
FROM events""")
cte("raw_events", ["raw_e"], """SELECT * FROM raw_e
UNION ALL
SELECT src_order + 1000000000 AS src_order, user_id, ga_session_id, item_id, date, type, device, country
FROM raw_e WHERE src_order % 10 = 0
UNION ALL
SELECT src_order + 2000000000 AS src_order, user_id, ga_session_id, item_id + 1000000000 AS item_id, date, type, device, country
FROM raw_e WHERE src_order % 50 = 7
UNION ALL
SELECT src_order + 3000000000 AS src_order, user_id + 1000000000 AS user_id, ga_session_id, item_id, date, type, device, country
FROM raw_e WHERE src_order % 70 = 11""")
cte("events_clean", ["raw_events"], _dedup("raw_events"))
cte("items_a", [], """SELECT p_partkey AS id, CASE WHEN c = 1 THEN p_name || ' (again)' ELSE p_name END AS name, p_brand AS brand, CAST(p_size AS VARCHAR) AS variant,
  CASE WHEN p_partkey % 29 <> 7 THEN p_type END AS category,
  CASE WHEN p_partkey % 19 <> 4 THEN CAST((p_partkey * 7) % 131 AS DOUBLE) + c END AS price_in_usd,
  p_partkey + c * 1000000000 AS src_order
FROM part, (VALUES (0), (1)) v(c) WHERE c = 0 OR p_partkey % 13 = 0""")
cte("items_first", ["items_a"], """SELECT id, name, brand, variant, category, price_in_usd, src_order FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY src_order) AS rn FROM items_a) t WHERE rn = 1""")
_ct_case = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in sorted(PART_CATEGORY_MAP.items()))
cte("items_lab", ["items_first"], f"""SELECT *, lower(trim(category)) AS category_key,
  COALESCE(CASE lower(trim(category)) {_ct_case} END, 'Other') AS content_type,
  CASE WHEN price_in_usd > -0.01 AND price_in_usd <= 10 THEN '<=10'
       WHEN price_in_usd > 10 AND price_in_usd <= 25 THEN '10-25'
       WHEN price_in_usd > 25 AND price_in_usd <= 50 THEN '25-50'
       WHEN price_in_usd > 50 AND price_in_usd <= 100 THEN '50-100'
       WHEN price_in_usd > 100 THEN '100+' END AS price_bucket
FROM items_first""")
cte("users_a", [], """SELECT c_custkey AS id, c_acctbal + c AS ltv,
  CASE c WHEN 0 THEN TIMESTAMP '2024-01-01 00:00:00' WHEN 1 THEN TIMESTAMP '2024-02-01 00:00:00' END AS date,
  c_custkey + c * 1000000000 AS src_order
FROM customer, (VALUES (0), (1), (2)) v(c) WHERE c = 0 OR (c = 1 AND c_custkey % 7 = 0) OR (c = 2 AND c_custkey % 11 = 0)""")
cte("users_latest", ["users_a"], """SELECT id, ltv, date, src_order FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY date DESC NULLS FIRST, src_order DESC) AS rn FROM users_a) t
WHERE rn = 1""")


def _labeled(src: str) -> str:
    return f"""SELECT e.*, COALESCE(i.content_type, 'Unknown_Item') AS content_type, i.price_in_usd,
  COALESCE(i.price_bucket, 'Unknown_Price') AS price_bucket, i.brand, i.variant, i.category
FROM {src} e LEFT JOIN items_lab i ON e.item_id = i.id"""


def _sessions(src: str) -> str:
    return f"""SELECT user_id, ga_session_id, CAST(user_id AS VARCHAR) || '_' || CAST(ga_session_id AS VARCHAR) AS session_key,
  min(date) AS session_start, max(date) AS session_end, count(*) AS n_events,
  count(DISTINCT item_id) AS n_unique_items,
  count(*) FILTER (WHERE type = 'purchase') AS n_purchases,
  count(*) FILTER (WHERE type = 'add_to_cart') AS n_add_to_cart,
  arg_min(country, (date, item_id, src_order)) FILTER (WHERE country IS NOT NULL) AS country,
  arg_min(device, (date, item_id, src_order)) FILTER (WHERE device IS NOT NULL) AS device,
  greatest(date_diff('microsecond', min(date), max(date)) / 1e6, 0.0) AS session_duration_sec,
  count(*) FILTER (WHERE type = 'purchase') > 0 AS has_purchase,
  count(*) FILTER (WHERE type = 'add_to_cart') > 0 AS has_add_to_cart
FROM {src} GROUP BY user_id, ga_session_id"""


cte("events_labeled", ["events_clean", "items_lab"], _labeled("events_clean"))
cte("sessions", ["events_labeled"], _sessions("events_labeled"))
cte("assignments", ["events_clean"], """SELECT DISTINCT user_id, CAST(user_id % 5 - 1 AS INTEGER) AS segment_id FROM events_clean""")

# monthly adapter: orders x lineitem
cte("m_raw", [], """SELECT CAST(l_linenumber AS BIGINT) AS src_order, o_custkey AS user_id, o_orderkey AS ga_session_id,
  l_partkey AS item_id, l_shipdate AS date,
  CASE WHEN l_returnflag = 'R' THEN 'add_to_cart' WHEN l_returnflag = 'A' THEN 'purchase' ELSE 'view' END AS type,
  CAST(NULL AS VARCHAR) AS device, CAST(NULL AS VARCHAR) AS country
FROM orders JOIN lineitem ON o_orderkey = l_orderkey""")
cte("m_clean", ["m_raw"], _dedup("m_raw"))
cte("m_labeled", ["m_clean", "items_lab"], _labeled("m_clean"))
cte("m_sessions", ["m_labeled"], _sessions("m_labeled"))
cte("m_assign", ["m_clean"], """SELECT DISTINCT user_id, CAST(user_id % 5 - 1 AS INTEGER) AS segment_id FROM m_clean""")

# ---------------------------------------------------------------- features
SHARE_COLS = [f"share_content_{v.lower()}" for v in VOCAB]
_share_sql = ",\n  ".join(
    f"CASE WHEN count(content_type) > 0 THEN (count(*) FILTER (WHERE content_type = '{v}')) / count(content_type) ELSE 0.0 END AS {c}"
    for v, c in zip(VOCAB, SHARE_COLS)
)
_entropy_sql = " + ".join(f"CASE WHEN {c} > 0 THEN {c} * ln({c}) ELSE 0.0 END" for c in SHARE_COLS)


def _user_features(ev: str, ses: str, prefix: str) -> None:
    cte(f"{prefix}user_sess", [ses], f"""SELECT user_id, count(session_key) AS n_sessions,
  avg(CAST(round(session_duration_sec * 1e6) AS BIGINT)) / 1e6 AS mean_session_duration,
  avg(CAST(has_purchase AS DOUBLE)) AS purchase_rate_sessions,
  avg(CAST(has_add_to_cart AS DOUBLE)) AS add_to_cart_rate_sessions,
  avg(n_events) AS mean_events_per_session,
  avg(n_unique_items) AS mean_unique_items_per_session
FROM {ses} GROUP BY user_id""")
    cte(f"{prefix}user_ev0", [ev], f"""SELECT user_id, count(type) AS n_events,
  avg(CAST(type = 'purchase' AS DOUBLE)) AS purchase_rate_events,
  count(DISTINCT CAST(date AS DATE)) AS active_days, min(date) AS first_seen, max(date) AS last_seen,
  {_share_sql}
FROM {ev} GROUP BY user_id""")
    cte(f"{prefix}user_ev", [f"{prefix}user_ev0"], f"""SELECT *, -({_entropy_sql}) + 0.0 AS content_entropy FROM {prefix}user_ev0""")
    cte(f"{prefix}user_features", [f"{prefix}user_sess", f"{prefix}user_ev", "users_latest"], f"""SELECT s.*, e.* EXCLUDE (user_id), COALESCE(u.ltv, 0.0) AS ltv
FROM {prefix}user_sess s JOIN {prefix}user_ev e ON s.user_id = e.user_id LEFT JOIN users_latest u ON s.user_id = u.id""")


_user_features("events_labeled", "sessions", "")
_user_features("m_labeled", "m_sessions", "m_")

# Feature columns used for segmentation (base set, then shares).
SEGMENT_BASE = [
    "n_sessions", "n_events", "active_days", "purchase_rate_sessions", "add_to_cart_rate_sessions",
    "mean_session_duration", "mean_events_per_session", "mean_unique_items_per_session", "content_entropy",
]
FEATURES = SEGMENT_BASE + SHARE_COLS
_z = ",\n  ".join(
    f"(CAST({c} AS DOUBLE) - avg({c}) OVER ()) / COALESCE(NULLIF(stddev_pop({c}) OVER (), 0), 1) AS {c}" for c in FEATURES
)
cte("zfeat", ["user_features"], f"""SELECT user_id, {_z} FROM user_features""")
cte("zlab", ["zfeat", "assignments"], """SELECT z.*, a.segment_id FROM zfeat z JOIN assignments a USING (user_id)""")
_cent = ", ".join(f"avg({c}) AS c_{c}" for c in FEATURES)
cte("centroids", ["zlab"], f"""SELECT segment_id + 1 AS cid, {_cent} FROM zlab GROUP BY segment_id""")
_dist = " + ".join(f"({c} - c_{c}) * ({c} - c_{c})" for c in FEATURES)
cte("zdist", ["zlab", "centroids"], f"""SELECT z.user_id, z.segment_id, c.cid, {_dist} AS d2 FROM zlab z, centroids c""")
cte("nearest", ["zdist"], """SELECT user_id, segment_id AS true_segment, CAST(cid AS INTEGER) AS segment_id, d2 AS distance_sq FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY d2, cid) AS rk FROM zdist) t WHERE rk = 1""")

# ---------------------------------------------------------------- journeys


def _journey_ctes(prefix: str, src: str, mode: str, max_steps: int, min_events: int, drop_repeats: bool) -> str:
    if mode == "event_type":
        step = "type"
    elif mode == "content_type":
        step = "COALESCE(content_type, 'unknown_content')"
    else:
        step = "type || '::' || COALESCE(content_type, 'unknown_content')"
    start = "(prev IS NULL OR prev <> step)" if drop_repeats else "TRUE"
    order = "ORDER BY date, item_id, src_order"
    cte(f"{prefix}jpos", [src], f"""SELECT *, sum(CAST(is_start AS INTEGER)) OVER (PARTITION BY user_id, ga_session_id {order}
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pos
FROM (SELECT *, {start} AS is_start FROM (
  SELECT *, lag(step) OVER (PARTITION BY user_id, ga_session_id {order}) AS prev
  FROM (SELECT *, {step} AS step FROM {src} WHERE date IS NOT NULL) a) b) c""")
    cte(f"{prefix}journeys", [f"{prefix}jpos"], f"""SELECT user_id, ga_session_id,
  CAST(user_id AS VARCHAR) || '_' || CAST(ga_session_id AS VARCHAR) AS session_key,
  min(date) AS session_start, max(date) AS session_end, count(*) AS n_events,
  CAST(least(count(*) FILTER (WHERE is_start), {max_steps}) AS BIGINT) AS n_steps,
  string_agg(step, ' > ' ORDER BY pos) FILTER (WHERE is_start AND pos <= {max_steps}) AS path,
  COALESCE(bool_or(type = 'add_to_cart'), FALSE) AS has_add_to_cart,
  COALESCE(bool_or(type = 'purchase'), FALSE) AS has_purchase
FROM {prefix}jpos GROUP BY user_id, ga_session_id
HAVING count(*) FILTER (WHERE is_start) >= {min_events}""")
    cte(f"{prefix}kept", [f"{prefix}jpos", f"{prefix}journeys"], f"""SELECT k.user_id, k.ga_session_id, k.pos, k.step
FROM {prefix}jpos k JOIN {prefix}journeys j ON k.user_id = j.user_id AND k.ga_session_id = j.ga_session_id
WHERE k.is_start AND k.pos <= {max_steps}""")
    cte(f"{prefix}transitions", [f"{prefix}kept"], f"""SELECT "from", "to", count(*) AS count,
  count(*) / sum(count(*)) OVER (PARTITION BY "from") AS p
FROM (SELECT a.step AS "from", b.step AS "to" FROM {prefix}kept a JOIN {prefix}kept b
  ON a.user_id = b.user_id AND a.ga_session_id = b.ga_session_id AND b.pos = a.pos + 1) t
GROUP BY "from", "to\"""")
    return f"{prefix}journeys"


J_EVENT = _journey_ctes("j_", "events_labeled", "event_type", 30, 2, True)
J_CONTENT = _journey_ctes("jc_", "events_labeled", "content_type", 30, 2, True)
J_HYBRID = _journey_ctes("jh_", "events_labeled", "hybrid", 30, 2, True)
J_REPEATS = _journey_ctes("jr_", "events_labeled", "event_type", 30, 2, False)
J_TRUNC = _journey_ctes("jt_", "events_labeled", "event_type", 3, 2, True)
J_MONTH = _journey_ctes("jm_", "m_labeled", "event_type", 30, 2, True)

_JCOLS = "user_id, ga_session_id, session_key, session_start, session_end, n_events, n_steps, path, has_add_to_cart, has_purchase"


def _shares(events: str, assign: str, unit: str, name: str) -> None:
    cte(name, [events, assign], f"""SELECT period, segment_id, n_users_active,
  CAST(sum(n_users_active) OVER (PARTITION BY period) AS BIGINT) AS n_users_active_total,
  n_users_active / sum(n_users_active) OVER (PARTITION BY period) AS share
FROM (SELECT a.period, s.segment_id, count(*) AS n_users_active
  FROM (SELECT DISTINCT CAST(date_trunc('{unit}', date) AS TIMESTAMP) AS period, user_id FROM {events} WHERE date IS NOT NULL) a
  JOIN {assign} s ON a.user_id = s.user_id GROUP BY a.period, s.segment_id) t""")


def _drift(shares: str, name: str) -> None:
    cte(f"{name}_links", [shares], f"""SELECT period, prev_period FROM (
  SELECT period, lag(period) OVER (ORDER BY period) AS prev_period FROM (SELECT DISTINCT period FROM {shares}) p) t
WHERE prev_period IS NOT NULL""")
    cte(name, [shares, f"{name}_links"], f"""SELECT b.period, l.prev_period, sum(abs(a - b)) AS l1_drift,
  sum((a - b) * ln((a + 1e-8) / (b + 1e-8))) AS psi_drift
FROM (SELECT COALESCE(c.period, p.period) AS period, COALESCE(c.share, 0.0) AS a, COALESCE(p.share, 0.0) AS b
  FROM (SELECT s.period, s.segment_id, s.share FROM {shares} s JOIN {name}_links l ON s.period = l.period) c
  FULL OUTER JOIN (SELECT l.period, s.segment_id, s.share FROM {shares} s JOIN {name}_links l ON s.period = l.prev_period) p
  ON c.period = p.period AND c.segment_id = p.segment_id) b
JOIN {name}_links l ON b.period = l.period
GROUP BY b.period, l.prev_period""")


_shares("events_clean", "assignments", "week", "shares_w")
_shares("m_clean", "m_assign", "month", "shares_m")
_shares("m_clean", "m_assign", "week", "shares_mw")
_shares("m_clean", "m_assign", "day", "shares_md")
_drift("shares_w", "drift_w")
_drift("shares_m", "drift_m")


def _uniform(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE"


def _draw_ctes(users: str, name: str) -> None:
    """``name`` (run, user_id, draws): exactly floor(0.8 N) draws in each of twenty runs."""
    cte(f"{name}_n", [users], f"SELECT count(*) AS n, CAST(floor(0.8 * count(*)) AS BIGINT) AS size FROM {users}")
    cte(f"{name}_rows", [users], f"SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS place FROM {users}")
    cte(name, [f"{name}_n", f"{name}_rows"], f"""SELECT run, user_id, CAST(count(*) AS INTEGER) AS draws FROM (
  SELECT run, least(CAST(floor({_uniform('run', 'j', '42')} * n) AS BIGINT), n - 1) AS place
  FROM (SELECT CAST(unnest(range(1, 21)) AS INTEGER) AS run), (SELECT n, unnest(range(size)) AS j FROM {name}_n)) d
JOIN {name}_rows USING (place) GROUP BY run, user_id""")


cte("all_users", ["users_latest"], "SELECT id AS user_id FROM users_latest")
_draw_ctes("all_users", "user_draws")
_draw_ctes("zlab", "zlab_draws")


def _kmeans_ctes(p: str, points: str, models: str, needs: list[str], per_cluster: int) -> None:
    """K-means of many models: ``p``_best (model, cluster, centre), ``p``_labels, ``p``_silhouette.

    ``points`` gives (run, id, w, the features), ``models`` gives (run, k, seed); seeds draw k-means++ starts, Lloyd
    steps run until the squared moves of a model add up to 1e-4 or less, and each (run, k) keeps its cheapest seed.
    """
    z, c = FEATURES, [f"c_{f}" for f in FEATURES]
    dist = lambda a, b: " + ".join(f"({a}.{f} - {b}.c_{f}) * ({a}.{f} - {b}.c_{f})" for f in z)
    cols = ", ".join(c)
    as_centre = ", ".join(f"p.{f} AS c_{f}" for f in z)
    cte(f"{p}_points", needs, points)
    cte(f"{p}_models", needs, models)
    cte(f"{p}_chains", [f"{p}_models"], f"SELECT DISTINCT run, seed FROM {p}_models")
    starts = []
    for step in range(7):
        far = f"SELECT ch.run, ch.seed, p.id, p.w, CAST(1 AS DOUBLE) AS d2 FROM {p}_chains ch JOIN {p}_points p USING (run)"
        if step:
            near = f"CASE WHEN {dist('p', 's')} < 1e-12 THEN 0 ELSE {dist('p', 's')} END"
            least = near if step == 1 else f"least(f.d2, {near})"
            far = f"""SELECT f.run, f.seed, f.id, f.w, {least} AS d2 FROM {p}_far{step - 1} f JOIN {p}_points p USING (run, id)
JOIN {p}_start{step - 1} s ON s.run = f.run AND s.seed = f.seed"""
        cte(f"{p}_far{step}", [f"{p}_chains", f"{p}_points"] + ([f"{p}_far{step - 1}", f"{p}_start{step - 1}"] if step else []), far)
        race = f"CASE WHEN d2 > 0 THEN -ln(greatest({_uniform('id', 'seed', str(step))}, 2.220446049250313e-16)) / (w * d2) ELSE 1e300 END"
        cte(f"{p}_start{step}", [f"{p}_far{step}"], f"""SELECT r.run, r.seed, {step} AS cluster, {as_centre} FROM (
  SELECT run, seed, id, row_number() OVER (PARTITION BY run, seed ORDER BY {race}, id) AS place FROM {p}_far{step}) r
JOIN {p}_points p USING (run, id) WHERE r.place = 1""")
        starts.append(f"SELECT * FROM {p}_start{step}")
    cte(f"{p}_starts", [f"{p}_start{j}" for j in range(7)], " UNION ALL ".join(starts))
    means = ", ".join(f"sum(p.w * p.{f}) / sum(p.w) AS m_{f}" for f in z)
    moves = " + ".join(f"(coalesce(m_{f}, c_{f}) - c_{f}) * (coalesce(m_{f}, c_{f}) - c_{f})" for f in z)
    moved = ", ".join(f"coalesce(m_{f}, c_{f}) AS c_{f}" for f in z)
    near = lambda src, where: f"""SELECT run, k, seed, id, cluster, d2 FROM (
    SELECT *, row_number() OVER (PARTITION BY run, k, seed, id ORDER BY d2 > least_d2 + 1e-9, cluster) AS place FROM (
      SELECT *, min(d2) OVER (PARTITION BY run, k, seed, id) AS least_d2 FROM (
        SELECT l.run, l.k, l.seed, p.id, l.cluster, {dist('p', 'l')} AS d2
        FROM {src} l JOIN {p}_points p ON p.run = l.run {where}) d) e) q WHERE place = 1"""  # noqa: E731
    cte(f"{p}_lloyd", [f"{p}_starts", f"{p}_models", f"{p}_points"], f"""SELECT 0 AS it, m.run, m.k, m.seed, s.cluster, {cols}, TRUE AS moving
FROM {p}_models m JOIN {p}_starts s ON s.run = m.run AND s.seed = m.seed AND s.cluster < m.k
UNION ALL
SELECT it + 1 AS it, run, k, seed, cluster, {moved}, sum({moves}) OVER (PARTITION BY run, k, seed) > 1e-4 AS moving
FROM {p}_lloyd LEFT JOIN (
  SELECT n.run, n.k, n.seed, n.cluster, {means} FROM ({near(p + '_lloyd', 'WHERE l.moving')}) n
  JOIN {p}_points p ON p.run = n.run AND p.id = n.id GROUP BY n.run, n.k, n.seed, n.cluster) USING (run, k, seed, cluster)
WHERE moving AND it < 300""")
    cte(f"{p}_final", [f"{p}_lloyd"], f"""SELECT run, k, seed, cluster, {cols} FROM {p}_lloyd
QUALIFY it = max(it) OVER (PARTITION BY run, k, seed)""")
    cte(f"{p}_near", [f"{p}_final", f"{p}_points"], near(p + "_final", ""))
    cte(f"{p}_cost", [f"{p}_near", f"{p}_points"], f"""SELECT run, k, seed, inertia FROM (
  SELECT n.run, n.k, n.seed, sum(w * d2) AS inertia FROM {p}_near n JOIN {p}_points p ON p.run = n.run AND p.id = n.id
  GROUP BY n.run, n.k, n.seed) t
QUALIFY row_number() OVER (PARTITION BY run, k ORDER BY CAST(format('{{:.8e}}', inertia) AS DOUBLE), seed) = 1""")
    cte(f"{p}_labels", [f"{p}_near", f"{p}_cost", f"{p}_points"], f"""SELECT n.run, n.k, n.id, n.cluster, p.w, {', '.join(f'p.{f}' for f in z)}
FROM {p}_near n JOIN {p}_cost USING (run, k, seed) JOIN {p}_points p ON p.run = n.run AND p.id = n.id""")
    away = "sqrt(" + " + ".join(f"(a.{f} - b.{f}) * (a.{f} - b.{f})" for f in z) + ")"
    cte(f"{p}_silhouette", [f"{p}_labels"], f"""SELECT run, k, CASE WHEN count(*) > 1 THEN sum(share * own) ELSE 'nan'::DOUBLE END AS silhouette,
  CASE WHEN count(*) > 1 THEN sqrt(sum(CASE WHEN m > 1 AND sampled < 1 THEN share * share * spread / m * (1 - sampled) ELSE 0 END)) ELSE 'nan'::DOUBLE END AS silhouette_error
FROM (SELECT run, k, cluster, any_value(size) / any_value(total) AS share, sum(w) / any_value(size) AS sampled, count(*) AS m, any_value(own) AS own,
        sum(w * w * (s - own) * (s - own)) / (avg(w) * avg(w) * nullif(count(*) - 1, 0)) AS spread
      FROM (SELECT *, sum(s * w) OVER (PARTITION BY run, k, cluster) / sum(w) OVER (PARTITION BY run, k, cluster) AS own FROM (
        SELECT x.run, x.k, x.id, x.cluster, x.w, x.size, x.total,
          CASE WHEN x.size <= 1 THEN 0 WHEN greatest(x.a, x.b) = 0 THEN 0 ELSE (x.b - x.a) / greatest(x.a, x.b) END AS s
        FROM (SELECT run, k, id, cluster, w, max(CASE WHEN other = cluster THEN n END) AS size, sum(n) AS total,
                max(CASE WHEN other = cluster THEN far / nullif(n - 1, 0) END) AS a, min(CASE WHEN other <> cluster THEN far / n END) AS b
              FROM (SELECT a.run, a.k, a.id, a.cluster, a.w, b.cluster AS other, sum(b.w) AS n, sum(b.w * {away}) AS far
                    FROM (SELECT * FROM {p}_labels QUALIFY row_number() OVER (PARTITION BY run, k, cluster ORDER BY {_uniform('id', '42', "'anchor'")}, id) <= {per_cluster}) a
                    JOIN {p}_labels b ON a.run = b.run AND a.k = b.k GROUP BY a.run, a.k, a.id, a.cluster, a.w, b.cluster) d
              GROUP BY run, k, id, cluster, w) x) y) v
      GROUP BY run, k, cluster) c GROUP BY run, k""")


_kmeans_ctes("seg", f"SELECT 0 AS run, user_id AS id, CAST(1 AS DOUBLE) AS w, {', '.join(FEATURES)} FROM zfeat",
             "SELECT 0 AS run, k, seed FROM (SELECT unnest(range(3, 8)) AS k), (SELECT unnest(range(42, 62)) AS seed)", ["zfeat"], 128)
cte("seg_chosen", ["seg_silhouette"], "SELECT k FROM seg_silhouette ORDER BY silhouette DESC, k LIMIT 1")
cte("seg_assign", ["seg_labels", "seg_chosen"], """SELECT id AS user_id, CAST(dense_rank() OVER (ORDER BY cluster) - 1 AS INTEGER) AS segment_id
FROM seg_labels JOIN seg_chosen USING (k)""")
_draw_ctes("zfeat", "boot_draws")
_kmeans_ctes("boot", f"SELECT run, user_id AS id, CAST(draws AS DOUBLE) AS w, {', '.join(FEATURES)} FROM boot_draws JOIN zfeat USING (user_id)",
             """SELECT run, k, 42 + run + i AS seed FROM (SELECT CAST(unnest(range(1, 21)) AS INTEGER) AS run), (SELECT unnest(range(20)) AS i), seg_chosen""",
             ["boot_draws", "zfeat", "seg_chosen"], 64)


def _ari_by_run(src: str) -> str:
    return f"""CASE WHEN fn = 0 AND fp = 0 THEN 1.0
  ELSE 2.0 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)) END AS ari
FROM (SELECT run, sq - n AS tp, sb - sq AS fp, sa - sq AS fn, n * n - (sb - sq) - (sa - sq) - sq AS tn FROM
  (SELECT run, sum(n_ij) AS n, sum(n_ij * n_ij) AS sq FROM {src} GROUP BY run)
  JOIN (SELECT run, sum(x * x) AS sa FROM (SELECT run, sum(n_ij) AS x FROM {src} GROUP BY run, t) GROUP BY run) USING (run)
  JOIN (SELECT run, sum(x * x) AS sb FROM (SELECT run, sum(n_ij) AS x FROM {src} GROUP BY run, p) GROUP BY run) USING (run)) r"""


def _ari(src: str) -> str:
    return f"""SELECT CASE WHEN fn = 0 AND fp = 0 THEN 1.0
  ELSE 2.0 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)) END AS ari
FROM (SELECT sq - n AS tp, sb - sq AS fp, sa - sq AS fn, n * n - (sb - sq) - (sa - sq) - sq AS tn FROM (
  SELECT (SELECT sum(n_ij) FROM {src}) AS n, (SELECT sum(n_ij * n_ij) FROM {src}) AS sq,
         (SELECT sum(x * x) FROM (SELECT sum(n_ij) AS x FROM {src} GROUP BY t) q) AS sa,
         (SELECT sum(x * x) FROM (SELECT sum(n_ij) AS x FROM {src} GROUP BY p) q) AS sb) s) r"""


def _profile_sql(src_features: str, src_assign: str) -> tuple[str, list[str]]:
    core = ["n_sessions", "n_events", "purchase_rate_sessions", "add_to_cart_rate_sessions",
            "mean_session_duration", "active_days", "content_entropy"]
    cols = core + SHARE_COLS
    aggs = ",\n  ".join(f"avg({c}) AS {c}_mean, median({c}) AS {c}_median" for c in cols)
    sql = f"""SELECT a.segment_id, count(*) AS n_users,
  {aggs}
FROM {src_features} f JOIN {src_assign} a ON f.user_id = a.user_id WHERE a.segment_id >= 0 GROUP BY a.segment_id"""
    doubles = [f"{c}_{s}" for c in cols for s in ("mean", "median")]
    return sql, doubles


def _conversion(ses: str, assign: str, name: str) -> None:
    cte(name, [ses, assign], f"""SELECT u.segment_id, u.n_users, s.n_sessions, s.atc_rate, s.purchase_rate,
  least(greatest(COALESCE(s.purchase_rate / NULLIF(s.atc_rate, 0), 0.0), 0.0), 1.0) AS conversion_efficiency,
  least(greatest(1.0 - least(greatest(COALESCE(s.purchase_rate / NULLIF(s.atc_rate, 0), 0.0), 0.0), 1.0), 0.0), 1.0)
    AS conversion_leakage
FROM (SELECT segment_id, count(DISTINCT user_id) AS n_users FROM {assign} WHERE segment_id >= 0 GROUP BY segment_id) u
LEFT JOIN (SELECT a.segment_id, CAST(count(*) AS BIGINT) AS n_sessions,
             avg(CAST(has_add_to_cart AS DOUBLE)) AS atc_rate, avg(CAST(has_purchase AS DOUBLE)) AS purchase_rate
           FROM {ses} x JOIN {assign} a ON x.user_id = a.user_id WHERE a.segment_id >= 0 GROUP BY a.segment_id) s
ON u.segment_id = s.segment_id""")


_conversion("sessions", "assignments", "conversion")
_conversion("m_sessions", "m_assign", "m_conversion")
cte("assign_idle", ["assignments", "users_latest"], """SELECT user_id, segment_id FROM assignments
UNION ALL SELECT id + 5000000000 AS user_id, CAST(9 AS INTEGER) AS segment_id FROM users_latest WHERE id % 4 = 0""")
_conversion("sessions", "assign_idle", "conversion_idle")

_CONV = ("atc_rate", "purchase_rate", "conversion_efficiency", "conversion_leakage")
_SESS_D = ("session_duration_sec",)
_UF_D = tuple(["mean_session_duration", "purchase_rate_sessions", "add_to_cart_rate_sessions",
               "mean_events_per_session", "mean_unique_items_per_session", "purchase_rate_events"]
              + SHARE_COLS + ["content_entropy", "ltv"])
_LAB_COLS = "src_order, user_id, ga_session_id, item_id, date, type, device, country, content_type, price_in_usd, price_bucket, brand, variant, category"


def _dq_summary(src: str) -> str:
    cols = ["src_order", "user_id", "ga_session_id", "item_id", "date", "type", "device", "country"]
    data_cols = [c for c in cols if c != "src_order"]
    null_cols = " + ".join(f"CAST(count(*) FILTER (WHERE {c} IS NULL) > 0 AS INTEGER)" for c in data_cols)
    ts = lambda e: f"CASE WHEN strftime({e}, '%f') = '000000' THEN strftime({e}, '%Y-%m-%d %H:%M:%S') ELSE strftime({e}, '%Y-%m-%d %H:%M:%S.%f') END"
    dc = ", ".join(data_cols)
    return f"""SELECT metric, value FROM (
SELECT 1 AS ord, 'n_events' AS metric, CAST(count(*) AS VARCHAR) AS value FROM {src}
UNION ALL SELECT 2, 'duplicate_event_rows', CAST(CAST(COALESCE(sum(n - 1), 0) AS BIGINT) AS VARCHAR)
  FROM (SELECT count(*) AS n FROM {src} GROUP BY {dc}) g
UNION ALL SELECT 3, 'duplicate_events_by_key', CAST(CAST(COALESCE(sum(n - 1), 0) AS BIGINT) AS VARCHAR)
  FROM (SELECT count(*) AS n FROM {src} GROUP BY user_id, ga_session_id, item_id, date, type) g
UNION ALL SELECT 4, 'columns_with_nulls', CAST({null_cols} AS VARCHAR) FROM {src}
UNION ALL SELECT 5, 'events_with_unknown_item', CAST(count(*) AS VARCHAR) FROM {src} e
  WHERE NOT EXISTS (SELECT 1 FROM items_first i WHERE i.id = e.item_id)
UNION ALL SELECT 6, 'events_with_unknown_user', CAST(count(*) AS VARCHAR) FROM {src} e
  WHERE NOT EXISTS (SELECT 1 FROM users_latest u WHERE u.id = e.user_id)
UNION ALL SELECT 7, 'min_event_date', {ts('min(date)')} FROM {src}
UNION ALL SELECT 8, 'max_event_date', {ts('max(date)')} FROM {src}
) t"""


def _dq_nulls(src: str) -> str:
    data_cols = ["user_id", "ga_session_id", "item_id", "date", "type", "device", "country"]
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS null_count FROM {src}" for c in data_cols
    )
    return f"SELECT * FROM ({parts}) t WHERE null_count > 0"


def _unknown(src: str, key: str, dim: str) -> str:
    return f"""SELECT * FROM {src} e WHERE NOT EXISTS (SELECT 1 FROM {dim} d WHERE d.id = e.{key})
ORDER BY user_id, ga_session_id, date, item_id, src_order LIMIT 50"""


def _silhouette(src: str) -> str:
    sq = " + ".join(f"{c} * {c}" for c in FEATURES)
    sums = ", ".join(f"sum({c}) AS s_{c}" for c in FEATURES)
    dot = " + ".join(f"p.{c} * c.s_{c}" for c in FEATURES)
    return f"""SELECT avg(s) AS silhouette FROM (
  SELECT user_id, CASE WHEN n_own = 1 THEN 0.0 WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0.0 END AS s FROM (
    SELECT user_id, max(CASE WHEN own THEN d * n / (n - 1) END) AS a, min(CASE WHEN NOT own THEN d END) AS b,
           max(CASE WHEN own THEN n END) AS n_own FROM (
      SELECT p.user_id, p.segment_id = c.segment_id AS own, c.n,
             p.sqn + c.sqn_sum / c.n - 2 * ({dot}) / c.n AS d
      FROM (SELECT *, {sq} AS sqn FROM {src}) p,
           (SELECT segment_id, count(*) AS n, sum({sq}) AS sqn_sum, {sums} FROM {src} GROUP BY segment_id) c) x
    GROUP BY user_id) y) z"""


def _inertia(src: str) -> str:
    return f"""SELECT sum(distance_sq) AS inertia FROM (SELECT z.user_id, {_dist} AS distance_sq
  FROM zlab z JOIN centroids c ON z.segment_id + 1 = c.cid) t"""


def oracle_sql() -> dict[str, str]:
    J = _JCOLS
    q: dict[str, str] = {}
    q["events_dedup"] = build("SELECT * FROM events_clean", "events_clean")
    q["items_first"] = build("SELECT * FROM items_first", "items_first", doubles=("price_in_usd",))
    q["users_latest"] = build("SELECT * FROM users_latest", "users_latest", doubles=("ltv",))
    q["country_fill"] = build("SELECT country, count(*) AS n_events FROM events_clean GROUP BY country", "events_clean")
    q["dq_summary"] = build(_dq_summary("events_clean"), "events_clean", "items_first", "users_latest")
    q["dq_summary_raw"] = build(_dq_summary("raw_events"), "raw_events", "items_first", "users_latest")
    q["dq_nulls"] = build(_dq_nulls("raw_events"), "raw_events")
    q["dq_unknown_items"] = build(_unknown("events_clean", "item_id", "items_first"), "events_clean", "items_first")
    q["dq_unknown_users"] = build(_unknown("events_clean", "user_id", "users_latest"), "events_clean", "users_latest")
    q["label_events"] = build(f"SELECT {_LAB_COLS} FROM events_labeled", "events_labeled", doubles=("price_in_usd",))
    q["content_type_counts"] = build(
        "SELECT content_type, count(*) AS n_events FROM events_labeled GROUP BY content_type "
        "ORDER BY n_events DESC, content_type LIMIT 30", "events_labeled")
    q["price_bucket_counts"] = build(
        "SELECT price_bucket, count(*) AS n_events FROM events_labeled GROUP BY price_bucket", "events_labeled")
    q["sessions"] = build("SELECT * FROM sessions", "sessions", doubles=_SESS_D)
    q["session_flags"] = build(
        "SELECT has_purchase, has_add_to_cart, count(*) AS n_sessions FROM sessions GROUP BY 1, 2", "sessions")
    q["user_session_features"] = build("SELECT * FROM user_sess", "user_sess", doubles=(
        "mean_session_duration", "purchase_rate_sessions", "add_to_cart_rate_sessions",
        "mean_events_per_session", "mean_unique_items_per_session"))
    q["user_event_features"] = build(
        "SELECT user_id, n_events, purchase_rate_events, active_days, first_seen, last_seen FROM user_ev",
        "user_ev", doubles=("purchase_rate_events",))
    q["content_shares"] = build(f"SELECT user_id, {', '.join(SHARE_COLS)} FROM user_ev", "user_ev",
                                doubles=tuple(SHARE_COLS))
    q["content_entropy"] = build("SELECT user_id, content_entropy FROM user_ev", "user_ev", doubles=("content_entropy",))
    q["user_features"] = build("SELECT * FROM user_features", "user_features", doubles=_UF_D)
    q["standardized_features"] = build("SELECT * FROM zfeat", "zfeat", doubles=tuple(FEATURES))
    q["nearest_centroid"] = build("SELECT user_id, segment_id, distance_sq FROM nearest", "nearest",
                                  doubles=("distance_sq",))
    q["inertia_given_labels"] = build(_inertia("zlab"), "zlab", "centroids", doubles=("inertia",))
    q["silhouette_given_labels"] = build(_silhouette("zlab"), "zlab", doubles=("silhouette",))
    q["outlier_policy"] = build("""SELECT user_id, CASE WHEN sh < 0.15 THEN -1 ELSE segment_id END AS segment_id FROM (
  SELECT user_id, segment_id, count(*) OVER (PARTITION BY segment_id) / count(*) OVER () AS sh FROM nearest) t""", "nearest")
    q["renumber_segments"] = build("""SELECT user_id, CAST(CASE WHEN segment_id < 0 THEN -1
  ELSE dense_rank() OVER (PARTITION BY segment_id >= 0 ORDER BY segment_id) - 1 END AS INTEGER) AS segment_id FROM (
  SELECT user_id, CASE WHEN sh < 0.15 THEN -1 ELSE segment_id END AS segment_id FROM (
    SELECT user_id, segment_id, count(*) OVER (PARTITION BY segment_id) / count(*) OVER () AS sh FROM nearest) t) u""",
                                   "nearest")
    prof, prof_d = _profile_sql("user_features", "assignments")
    q["segment_profile"] = build(prof, "user_features", "assignments", doubles=tuple(prof_d))
    q["segment_conversion"] = build("SELECT * FROM conversion", "conversion", doubles=_CONV)
    q["segment_quadrant"] = build("""SELECT segment_id, n_users, n_sessions, atc_rate, purchase_rate,
  median(atc_rate) OVER () AS atc_rate_median, median(purchase_rate) OVER () AS purchase_rate_median,
  n_users / max(n_users) OVER () * 600.0 + 40.0 AS bubble_size FROM conversion""", "conversion",
                                  doubles=("atc_rate", "purchase_rate", "atc_rate_median", "purchase_rate_median", "bubble_size"))
    q["segment_leakage_size"] = build(
        "SELECT segment_id, n_users, conversion_leakage, conversion_efficiency, atc_rate, purchase_rate FROM conversion",
        "conversion", doubles=_CONV)
    q["journeys_event_type"] = build(f"SELECT {J} FROM j_journeys", "j_journeys")
    q["journeys_content_type"] = build(f"SELECT {J} FROM jc_journeys", "jc_journeys")
    q["journeys_hybrid"] = build(f"SELECT {J} FROM jh_journeys", "jh_journeys")
    q["journeys_keep_repeats"] = build(f"SELECT {J} FROM jr_journeys", "jr_journeys")
    q["journeys_truncated"] = build(f"SELECT {J} FROM jt_journeys", "jt_journeys")
    q["transition_counts"] = build("SELECT * FROM j_transitions", "j_transitions", doubles=("p",))
    q["transition_counts_content"] = build("SELECT * FROM jc_transitions", "jc_transitions", doubles=("p",))
    targets = ["add_to_cart", "begin_checkout", "error", "purchase", "view"]
    wide = ", ".join(f"COALESCE(max(CASE WHEN \"to\" = '{t}' THEN p END), 0.0) AS {t}" for t in targets)
    q["transition_matrix"] = build(f'SELECT "from", {wide} FROM j_transitions GROUP BY "from"', "j_transitions",
                                   doubles=tuple(targets))
    wide_c = ", ".join(f"COALESCE(max(CASE WHEN \"to\" = '{t}' THEN p END), 0.0) AS \"{t}\"" for t in VOCAB)
    q["transition_matrix_content"] = build(f'SELECT "from", {wide_c} FROM jc_transitions GROUP BY "from"',
                                           "jc_transitions", doubles=tuple(f'"{t}"' for t in VOCAB))
    q["top_paths"] = build("""SELECT path, count(*) AS n_sessions, avg(CAST(has_purchase AS DOUBLE)) AS purchase_rate,
  avg(CAST(has_add_to_cart AS DOUBLE)) AS add_to_cart_rate, avg(n_steps) AS avg_steps
FROM j_journeys GROUP BY path ORDER BY n_sessions DESC, path LIMIT 50""", "j_journeys",
                           doubles=("purchase_rate", "add_to_cart_rate", "avg_steps"))
    q["funnel"] = build("""SELECT step, n_sessions, rate_from_start, rate_from_prev FROM (
SELECT 0 AS ord, 'sessions' AS step, n AS n_sessions, CAST(1.0 AS DOUBLE) AS rate_from_start, CAST(1.0 AS DOUBLE) AS rate_from_prev FROM f WHERE n > 0
UNION ALL SELECT 1, 'add_to_cart', n_cart, n_cart / n, n_cart / n FROM f WHERE n > 0
UNION ALL SELECT 2, 'purchase', n_purchase, n_purchase / n, CASE WHEN n_cart > 0 THEN n_purchase / n_cart ELSE 0.0 END FROM f WHERE n > 0
) t""", "f", doubles=("rate_from_start", "rate_from_prev"))
    q["segment_path_lift"] = build("""SELECT r.segment_id, r.path, r.n_sessions, r.n_sessions / st.seg_total AS p_seg,
  pt.path_total / tot.all_total AS p_all, (r.n_sessions / st.seg_total) / (pt.path_total / tot.all_total) AS lift
FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY n_sessions DESC, path) AS rk FROM sp) r
JOIN (SELECT segment_id, sum(n_sessions) AS seg_total FROM sp GROUP BY segment_id) st ON r.segment_id = st.segment_id
JOIN (SELECT path, sum(n_sessions) AS path_total FROM sp GROUP BY path) pt ON r.path = pt.path
CROSS JOIN (SELECT sum(n_sessions) AS all_total FROM sp) tot
WHERE r.rk <= 50""", "sp", doubles=("p_seg", "p_all", "lift"))
    q["segment_shares_week"] = build("SELECT * FROM shares_w", "shares_w", doubles=("share",))
    q["segment_shares_month"] = build("SELECT * FROM shares_m", "shares_m", doubles=("share",))
    q["segment_shares_periods"] = build(" UNION ALL ".join(
        f"SELECT '{k}' AS period_kind, * FROM {src}" for k, src in (("W", "shares_mw"), ("M", "shares_m"), ("D", "shares_md"))),
        "shares_mw", "shares_m", "shares_md", doubles=("share",))
    q["drift_week"] = build("SELECT * FROM drift_w", "drift_w", doubles=("l1_drift", "psi_drift"))
    q["drift_month"] = build("SELECT * FROM drift_m", "drift_m", doubles=("l1_drift", "psi_drift"))
    q["stability_drift_summary"] = build("""SELECT metric, value FROM (
SELECT 0 AS ord, 'temporal_l1_mean' AS metric, avg(l1_drift) AS value FROM drift_m
UNION ALL SELECT 1, 'temporal_l1_max', max(l1_drift) FROM drift_m
UNION ALL SELECT 2, 'temporal_psi_mean', avg(psi_drift) FROM drift_m
UNION ALL SELECT 3, 'temporal_psi_max', max(psi_drift) FROM drift_m) t""", "drift_m", doubles=("value",))
    q["ari_given_labels"] = build(_ari("cont"), "cont", doubles=("ari",))
    q["bootstrap_draws"] = build("SELECT user_id, run, draws FROM user_draws", "user_draws")
    q["bootstrap_sizes"] = build("""SELECT run, CAST(any_value(size) AS BIGINT) AS n_draws, count(*) AS n_drawn
FROM user_draws, user_draws_n GROUP BY run""", "user_draws", "user_draws_n")
    q["bootstrap_ari_given_labels"] = build(f"SELECT run, {_ari_by_run('boot_cont')}", "boot_cont", doubles=("ari",))
    q["k_selection"] = build("""SELECT CAST(k AS INTEGER) AS k, silhouette, inertia, silhouette_error
FROM seg_silhouette JOIN seg_cost USING (k)""", "seg_silhouette", "seg_cost", doubles=("silhouette", "inertia", "silhouette_error"))
    q["kmeans_segments"] = build("SELECT user_id, segment_id FROM seg_assign", "seg_assign")
    q["bootstrap_stability"] = build(f"""SELECT run, ari AS ari_vs_baseline, silhouette, silhouette_error
FROM (SELECT run, {_ari_by_run('boot_fit_cont')}) a JOIN boot_silhouette USING (run)""", "boot_fit_cont", "boot_silhouette",
                                     doubles=("ari_vs_baseline", "silhouette", "silhouette_error"))
    q["sessions_month"] = build("SELECT * FROM m_sessions", "m_sessions", doubles=_SESS_D)
    q["user_features_month"] = build("SELECT * FROM m_user_features", "m_user_features", doubles=_UF_D)
    cells = """SELECT event_id, CASE WHEN event_id % 9 = 0 THEN user_id || '.7' ELSE CAST(user_id AS VARCHAR) END AS user_id,
  CAST(event_id % 100 AS BIGINT) AS ga_session_id,
  CASE event_id % 6 WHEN 0 THEN 'US' WHEN 1 THEN 'DE' WHEN 4 THEN 'N/A' WHEN 5 THEN 'IN' END AS country,
  CASE event_id % 4 WHEN 0 THEN 'mobile' WHEN 1 THEN 'desktop' WHEN 3 THEN 'tablet' END AS device,
  CASE WHEN event_id % 41 <> 0 THEN event_type END AS type,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id,
  CASE WHEN event_id % 53 <> 1 THEN date_trunc('second', ts) END AS date
FROM events"""
    typed = "CAST(trunc(CAST(user_id AS DOUBLE)) AS BIGINT) AS user_id, ga_session_id, country, device, type, item_id, date"
    q["parsed_events"] = f"SELECT {typed} FROM ({cells}) t"
    q["loaded_events"] = f"""SELECT user_id, ga_session_id, coalesce(country, 'Unknown') AS country, device, type, item_id, date
FROM (SELECT event_id, {typed} FROM ({cells}) t) p
WHERE user_id IS NOT NULL AND ga_session_id IS NOT NULL AND type IS NOT NULL AND date IS NOT NULL AND item_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY user_id, ga_session_id, item_id, date, type ORDER BY event_id) = 1"""
    q["parsed_items"] = build("""SELECT p_partkey AS id, trim(p_name) AS name, CASE WHEN p_partkey % 10 <> 0 THEN p_brand END AS brand,
  CAST(p_size AS VARCHAR) AS variant, trim(p_type) AS category,
  CASE p_partkey % 7 WHEN 1 THEN 12.5::DOUBLE WHEN 3 THEN 100.0 WHEN 5 THEN -3.0 END AS price_in_usd FROM part""",
                              doubles=("price_in_usd",))
    q["parsed_users"] = build("""SELECT c_custkey AS id,
  CASE c_custkey % 5 WHEN 1 THEN 0.0::DOUBLE WHEN 3 THEN 0.0 WHEN 4 THEN 2.25 ELSE CAST(c_custkey % 17 AS DOUBLE) END AS ltv,
  CASE WHEN c_custkey % 6 <> 5 THEN TIMESTAMP '2024-01-01 00:00:00' + (c_custkey % 9) * INTERVAL 1 DAY END AS date
FROM customer""", doubles=("ltv",))
    q["loaded_items"], q["loaded_users"] = q["parsed_items"], q["parsed_users"]
    q["stored_sessions"] = build("SELECT * FROM sessions", "sessions", doubles=_SESS_D)
    q["stored_assignments_csv"] = build("SELECT user_id, segment_id FROM assignments", "assignments")
    q["ordered_outputs"] = build("""SELECT output, n AS n_rows, n AS n_indexed, true AS rows_in_order, true AS files_in_order FROM (
SELECT 'sessions' AS output, count(*) AS n FROM sessions UNION ALL SELECT 'journeys', count(*) FROM j_journeys
UNION ALL SELECT 'assignments', count(*) FROM assignments) t""", "sessions", "j_journeys", "assignments")
    q["dq_durations"] = build("""SELECT 'n_events' AS metric, CAST(count(*) AS VARCHAR) AS value FROM events_clean
UNION ALL SELECT 'negative_session_duration', CAST(count(*) FILTER (WHERE src_order % 7 = 0) AS VARCHAR) FROM events_clean""", "events_clean")
    q["segment_conversion_idle"] = build("SELECT * FROM conversion_idle", "conversion_idle", doubles=_CONV)
    finite = "CASE WHEN user_id % 5 = 0 OR user_id % 7 = 0 OR user_id % 11 = 0 THEN 0.0 ELSE mean_session_duration END"
    q["standardized_infinite"] = build(f"""SELECT user_id,
  (x - avg(x) OVER ()) / COALESCE(NULLIF(stddev_pop(x) OVER (), 0), 1) AS mean_session_duration,
  (CAST(n_events AS DOUBLE) - avg(n_events) OVER ()) / COALESCE(NULLIF(stddev_pop(n_events) OVER (), 0), 1) AS n_events
FROM (SELECT user_id, n_events, {finite} AS x FROM user_features) t""", "user_features", doubles=("mean_session_duration", "n_events"))
    means = ", ".join(f"avg({c}) AS {c}" for c in FEATURES)
    q["lloyd_step"] = build(f"""SELECT n.segment_id, count(*) AS n_users, {means}
FROM zfeat z JOIN nearest n ON z.user_id = n.user_id GROUP BY n.segment_id""", "zfeat", "nearest", doubles=tuple(FEATURES))
    q["kmeans_invariants"] = """SELECT true AS labels_are_nearest, true AS centers_are_means, true AS ids_are_contiguous,
  true AS others_are_minus_one, true AS chosen_k_is_best, true AS cost_falls_with_k"""
    q["segment_conversion_month"] = build("SELECT * FROM m_conversion", "m_conversion", doubles=_CONV)
    q["journeys_month"] = build(f"SELECT {J} FROM jm_journeys", "jm_journeys")
    q["top_paths_month"] = build("""SELECT path, count(*) AS n_sessions, avg(CAST(has_purchase AS DOUBLE)) AS purchase_rate,
  avg(CAST(has_add_to_cart AS DOUBLE)) AS add_to_cart_rate, avg(n_steps) AS avg_steps
FROM jm_journeys GROUP BY path ORDER BY n_sessions DESC, path LIMIT 50""", "jm_journeys",
                                 doubles=("purchase_rate", "add_to_cart_rate", "avg_steps"))
    return q


cte("j_funnel", ["j_journeys"], """SELECT count(*) AS n, count(*) FILTER (WHERE has_add_to_cart) AS n_cart,
  count(*) FILTER (WHERE has_purchase) AS n_purchase FROM j_journeys""")
cte("f", ["j_funnel"], "SELECT * FROM j_funnel")
cte("j_sp", ["j_journeys", "assignments"], """SELECT a.segment_id, j.path, count(*) AS n_sessions
FROM j_journeys j JOIN assignments a ON j.user_id = a.user_id GROUP BY a.segment_id, j.path""")
cte("sp", ["j_sp"], "SELECT * FROM j_sp")
cte("ari_cont", ["nearest"], """SELECT true_segment AS t, segment_id AS p, CAST(count(*) AS DOUBLE) AS n_ij
FROM nearest GROUP BY true_segment, segment_id""")
cte("cont", ["ari_cont"], "SELECT * FROM ari_cont")
cte("boot_cont", ["nearest", "zlab_draws"], """SELECT run, true_segment AS t, segment_id AS p, CAST(sum(draws) AS DOUBLE) AS n_ij
FROM nearest JOIN zlab_draws USING (user_id) GROUP BY run, true_segment, segment_id""")
cte("boot_fit_cont", ["boot_labels", "seg_assign"], """SELECT run, segment_id AS t, cluster AS p, sum(w) AS n_ij
FROM boot_labels b JOIN seg_assign a ON a.user_id = b.id GROUP BY run, segment_id, cluster""")
