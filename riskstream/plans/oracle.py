"""Independent DuckDB SQL for every query with an oracle.

Written with plain per-user windows (no chunking), so it checks the
skew-safe Spark plans against the textbook formulation. Fixture views come
from ``sources.fixtures`` as CTEs.
"""

from __future__ import annotations

from ..sources.fixtures import with_views

DAY = 86400000000
HOUR = 3600000000
WEEK = 7 * DAY


def hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (f"(12742.0 * asin(sqrt(least(1.0, pow(sin((radians({lat2}) - radians({lat1})) / 2), 2)"
            f" + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2)))))")


def speed(dist: str, dt: str) -> str:
    return f"(CASE WHEN {dt} <= 0 OR {dt} / 3600.0 < 1e-6 THEN 0.0 ELSE {dist} / ({dt} / 3600.0) END)"


HOUR_SQL = f"CAST((us // {HOUR}) % 24 AS INTEGER)"
DOW_SQL = f"CAST(((us // {DAY}) + 3) % 7 AS INTEGER)"

# Previous row within 24 h, gap sessions, running profile before the row.
PROFILE_CTES = f"""
b AS (
  SELECT *, lag(us) OVER w AS pu, lag(latitude) OVER w AS plat, lag(longitude) OVER w AS plon
  FROM txn WINDOW w AS (PARTITION BY user_id ORDER BY us, transaction_id)),
c AS (SELECT *, (pu IS NOT NULL AND us - pu < {DAY}) AS has FROM b),
c2 AS (SELECT *, sum(CASE WHEN has THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY us, transaction_id
        ROWS UNBOUNDED PRECEDING) AS sess FROM c),
p AS (
  SELECT *, count(*) OVER ws AS n, avg(amount) OVER ws AS mean_, stddev_pop(amount) OVER ws AS sd_
  FROM c2 WINDOW ws AS (PARTITION BY user_id, sess ORDER BY us, transaction_id
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (
  SELECT *,
    CASE WHEN has THEN (us - pu) / 1e6 ELSE 0.0 END AS dt,
    CASE WHEN has THEN {hav('plat', 'plon', 'latitude', 'longitude')} ELSE 0.0 END AS dist,
    {HOUR_SQL} AS hour_of_day,
    CASE WHEN n > 1 THEN sd_ ELSE 0.0 END AS std_, coalesce(mean_, 0.0) AS mean0
  FROM p),
g AS (
  SELECT *, CASE WHEN has THEN {speed('dist', 'dt')} ELSE 0.0 END AS spd,
    CASE WHEN std_ > 0 THEN (amount - mean0) / std_ ELSE 0.0 END AS z
  FROM f),
h AS (SELECT *, coalesce(has AND dt > 0 AND spd > 1200, false) AS impossible FROM g)"""

RULE_CTES = """
r AS (
  SELECT *,
    CASE WHEN amount > 1000 AND n > 10 THEN 0.8 ELSE 0.0 END AS s1,
    CASE WHEN amount > 1000 AND n > 10 THEN 'HIGH_AMOUNT_FREQUENCY' END AS f1,
    CASE WHEN impossible THEN 1.0 WHEN spd > 800 THEN 0.7 ELSE 0.0 END AS s2,
    CASE WHEN impossible THEN 'IMPOSSIBLE_TRAVEL' WHEN spd > 800 THEN 'SUSPICIOUS_TRAVEL_SPEED' END AS f2,
    CASE WHEN hour_of_day < 4 THEN 0.3 ELSE 0.0 END AS s3,
    CASE WHEN hour_of_day < 4 THEN 'LATE_NIGHT_TRANSACTION' END AS f3,
    CASE WHEN dt < 60 THEN 0.6 WHEN dt < 300 THEN 0.3 ELSE 0.0 END AS s4,
    CASE WHEN dt < 60 THEN 'RAPID_SUCCESSION' WHEN dt < 300 THEN 'QUICK_SUCCESSION' END AS f4,
    CASE WHEN abs(z) > 3 THEN 0.7 WHEN abs(z) > 2 THEN 0.4 ELSE 0.0 END AS s5,
    CASE WHEN abs(z) > 3 THEN 'AMOUNT_ANOMALY' WHEN abs(z) > 2 THEN 'MODERATE_AMOUNT_ANOMALY' END AS f5
  FROM h),
rs AS (
  SELECT *, least(1.0, ((((s1 + s2) + s3) + s4) + s5) / 5.0) AS prob,
    concat_ws(',', f1, f2, f3, f4, f5) AS factors
  FROM r)"""


def level(p: str) -> str:
    return (f"CASE WHEN {p} >= 0.85 THEN 'CRITICAL' WHEN {p} >= 0.7 THEN 'HIGH' "
            f"WHEN {p} >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END")


def rule_score() -> str:
    return with_views(f"""WITH {PROFILE_CTES},{RULE_CTES}
SELECT transaction_id, user_id, us, round(prob, 6) AS fraud_probability, {level('prob')} AS risk_level,
  factors AS risk_factors, 'rules' AS model_used, 'rule-based-v1' AS model_version
FROM rs""", "txn")


ORACLE: dict[str, str] = {}


def dec_round(sql: str, digits: int = 6) -> str:
    """Rewrite ``round(x, 6)`` to round through DECIMAL, i.e. HALF_UP on the
    decimal value as Spark's ``round`` does (plain double rounding breaks
    exact ties such as means of cent amounts the other way)."""
    out, i, key = [], 0, "round("
    while True:
        j = sql.find(key, i)
        if j < 0 or (j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + len(key)])
            i = j + len(key)
            continue
        depth, k, comma = 0, j + len(key), -1
        while k < len(sql):
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                if depth == 0:
                    break
                depth -= 1
            elif ch == "," and depth == 0:
                comma = k
            k += 1
        arg, nd = sql[j + len(key):comma], sql[comma + 1:k].strip()
        if comma < 0 or nd != str(digits):
            out.append(sql[i:j + len(key)])
            i = j + len(key)
            continue
        out.append(sql[i:j])
        out.append(f"CAST(round(CAST({dec_round(arg, digits)} AS DECIMAL(38,10)), {digits}) AS DOUBLE)")
        i = k + 1


def register(name: str, sql: str) -> None:
    ORACLE[name] = dec_round(sql)


register("rule_score", rule_score())

# Two more rules, over seven.
register("rule_score_extended", with_views(f"""WITH {PROFILE_CTES},{RULE_CTES},
rx AS (SELECT *, CASE WHEN amount > 2000 AND hour_of_day BETWEEN 0 AND 5 THEN 1.0 WHEN amount > 2000 THEN 0.5 ELSE 0.0 END AS s6,
    CASE WHEN amount > 2000 AND hour_of_day BETWEEN 0 AND 5 THEN 'LARGE_AT_NIGHT' WHEN amount > 2000 THEN 'LARGE_AMOUNT' END AS f6,
    CASE WHEN coalesce(n, 0) = 0 THEN 0.2 ELSE 0.0 END AS s7, CASE WHEN coalesce(n, 0) = 0 THEN 'NEW_USER' END AS f7 FROM rs),
ry AS (SELECT *, least(1.0, ((((((s1 + s2) + s3) + s4) + s5) + s6) + s7) / 7.0) AS prob7 FROM rx)
SELECT transaction_id, user_id, us, round(prob7, 6) AS fraud_probability, {level('prob7')} AS risk_level,
  concat_ws(',', f1, f2, f3, f4, f5, f6, f7) AS risk_factors FROM ry""", "txn"))


# ---------------------------------------------------------------------------
# B: validation
# ---------------------------------------------------------------------------
def _str_errs(col: str, lo, hi, required: bool) -> list[str]:
    out = []
    if required:
        out.append(f"CASE WHEN {col} IS NULL THEN '{col}:missing' END")
    if lo:
        out.append(f"CASE WHEN {col} IS NOT NULL AND length({col}) < {lo} THEN '{col}:string_too_short' END")
    if hi:
        out.append(f"CASE WHEN {col} IS NOT NULL AND length({col}) > {hi} THEN '{col}:string_too_long' END")
    return out


def _num_errs(col: str, lo: float, hi: float) -> list[str]:
    fin = f"(NOT isnan({col}) AND abs({col}) != 'inf'::double)"
    return [f"CASE WHEN {col} IS NULL THEN '{col}:missing' END",
            f"CASE WHEN {col} IS NOT NULL AND NOT {fin} THEN '{col}:finite_number' END",
            f"CASE WHEN {col} IS NOT NULL AND {fin} AND {col} < {lo} THEN '{col}:greater_than_equal' END",
            f"CASE WHEN {col} IS NOT NULL AND {fin} AND {col} > {hi} THEN '{col}:less_than_equal' END"]


_ERRS = (_str_errs("transaction_id", 1, 64, True) + _str_errs("user_id", 1, 64, True)
         + _num_errs("amount", 0.01, 1000000.0) + _str_errs("currency", 3, 3, False)
         + _str_errs("merchant_id", 1, 64, True) + _str_errs("merchant_category", 1, 32, True)
         + _num_errs("latitude", -90.0, 90.0) + _num_errs("longitude", -180.0, 180.0)
         + _str_errs("device_id", None, 64, False)
         + ["CASE WHEN channel IS NOT NULL AND NOT regexp_matches(channel, '^(online|offline|mobile|api)$') "
            "THEN 'channel:string_pattern_mismatch' END"])
VALIDATE_CTE = f"""v AS (SELECT *, concat_ws(';', {', '.join(_ERRS)}) AS errors FROM txn_raw)"""

register("validate_txn", with_views(f"""WITH {VALIDATE_CTE}
SELECT transaction_id, errors = '' AS is_valid, errors FROM v""", "txn_raw"))

register("normalize_txn", with_views(f"""WITH {VALIDATE_CTE}
SELECT transaction_id, coalesce(us, 1735689600000000) AS us, coalesce(currency, 'USD') AS currency,
  coalesce(channel, 'online') AS channel, latitude, longitude
FROM v WHERE errors = ''""", "txn_raw"))

register("validation_summary", with_views(f"""WITH {VALIDATE_CTE},
x AS (SELECT unnest(string_split(errors, ';')) AS e FROM v WHERE errors != '')
SELECT split_part(e, ':', 1) AS field, split_part(e, ':', 2) AS type, count(*) AS n_rows
FROM x GROUP BY 1, 2""", "txn_raw"))

register("batch_outcome", with_views("""
SELECT event_id // 100 AS batch_id, bool_and(status = 'success') AS success, count(*) AS total_processed,
  count(*) FILTER (WHERE status != 'success') AS failures
FROM scored GROUP BY 1""", "scored"))

# ---------------------------------------------------------------------------
# C: scalar functions
# ---------------------------------------------------------------------------
GEO_CTE = f"""gb AS (SELECT transaction_id, {hav('latitude', 'longitude', '51.5074', '-0.1278')} AS km,
  ((us % 7200000000) - 3600000000) / 1e6 AS dt FROM txn)"""

register("haversine_km", with_views(f"WITH {GEO_CTE} SELECT transaction_id, round(km, 6) AS km FROM gb", "txn"))
register("travel_speed_kmh", with_views(
    f"WITH {GEO_CTE} SELECT transaction_id, round({speed('km', 'dt')}, 6) AS speed_kmh FROM gb", "txn"))
register("impossible_travel", with_views(
    f"WITH {GEO_CTE} SELECT transaction_id, (dt > 0 AND {speed('km', 'dt')} > 1200) AS impossible FROM gb", "txn"))
register("amount_log", with_views(
    "SELECT transaction_id, round(ln(1 + amount), 6) AS amount_log FROM txn", "txn"))
register("temporal_features", with_views(
    f"SELECT transaction_id, {HOUR_SQL} AS hour_of_day, {DOW_SQL} AS day_of_week, {DOW_SQL} >= 5 AS is_weekend "
    "FROM txn", "txn"))
register("amount_zscore", with_views(
    "SELECT transaction_id, round(CASE WHEN (us % 3) * 100 > 0 THEN (amount - 500.0) / ((us % 3) * 100.0) "
    "ELSE 0.0 END, 6) AS z FROM txn", "txn"))
register("risk_level", with_views(
    f"SELECT event_id, {level('fraud_probability')} AS level FROM scored", "scored"))
register("normalize_endpoint", with_views("""
WITH s AS (SELECT event_id, string_split(trim(path, '/'), '/') AS segs FROM requests)
SELECT event_id, '/' || array_to_string(list_transform(segs, lambda x:
  CASE WHEN (length(x) = 36 AND contains(x, '-')) OR regexp_matches(x, '^[0-9]+$') OR length(x) > 20
       THEN '{id}' ELSE x END), '/') AS endpoint FROM s""", "requests"))

# ---------------------------------------------------------------------------
# D: history features
# ---------------------------------------------------------------------------
VEL_CTE = f"""vw AS (SELECT *,
  count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN {HOUR} PRECEDING AND 1 PRECEDING) AS txn_count_1h,
  count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN {DAY} PRECEDING AND 1 PRECEDING) AS txn_count_24h,
  count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN {WEEK} PRECEDING AND 1 PRECEDING) AS txn_count_7d,
  coalesce(sum(amount) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN {DAY} PRECEDING AND 1 PRECEDING), 0.0)
    AS total_amount_24h,
  count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN {DAY - 1} PRECEDING AND CURRENT ROW) AS set_size
FROM txn)"""

LAST_SELECT = ("SELECT transaction_id, round(dt, 6) AS time_since_last_txn_seconds, "
               "round(dist, 6) AS distance_from_last_txn_km, round(spd, 6) AS travel_speed_kmh, "
               "impossible AS is_impossible_travel FROM h")

register("last_txn_features", with_views(f"WITH {PROFILE_CTES}\n{LAST_SELECT}", "txn"))

register("asof_last_txn", with_views(f"""WITH
txd AS (
  SELECT concat('TXN_', lpad(CAST(e.event_id AS varchar), 10, '0')) AS transaction_id,
    concat('USER_', lpad(CAST(e.user_id AS varchar), 8, '0')) AS user_id,
    1704067200000000 + (e.us - 1704067200000000) // 24 AS us,
    CAST(c.lat AS double) AS latitude, CAST(c.lon AS double) AS longitude
  FROM e JOIN city c ON e.ci = c.i),
j AS (
  SELECT r.*, hh.us AS pu, hh.latitude AS plat, hh.longitude AS plon
  FROM txd r ASOF LEFT JOIN txn hh ON r.user_id = hh.user_id AND r.us > hh.us),
b2 AS (SELECT *, (pu IS NOT NULL AND us - pu < {DAY}) AS has FROM j),
f AS (SELECT *, CASE WHEN has THEN (us - pu) / 1e6 ELSE 0.0 END AS dt,
        CASE WHEN has THEN {hav('plat', 'plon', 'latitude', 'longitude')} ELSE 0.0 END AS dist FROM b2),
g AS (SELECT *, CASE WHEN has THEN {speed('dist', 'dt')} ELSE 0.0 END AS spd FROM f),
h AS (SELECT *, coalesce(has AND dt > 0 AND spd > 1200, false) AS impossible FROM g)
{LAST_SELECT}""", "txn"))

register("velocity_windows", with_views(f"""WITH {VEL_CTE}
SELECT transaction_id, txn_count_1h, txn_count_24h, txn_count_7d, round(total_amount_24h, 6) AS total_amount_24h
FROM vw""", "txn", dense=True))

register("velocity_windows_ttl", with_views(f"""WITH {VEL_CTE},
v2 AS (SELECT *, lag(us) OVER w AS pu, lag(set_size) OVER w AS pset FROM vw
       WINDOW w AS (PARTITION BY user_id ORDER BY us, transaction_id))
SELECT transaction_id, txn_count_1h, txn_count_24h,
  CAST(CASE WHEN pu IS NOT NULL AND us - pu < {DAY} THEN pset ELSE 0 END AS BIGINT) AS txn_count_7d,
  round(total_amount_24h, 6) AS total_amount_24h
FROM v2""", "txn", dense=True))

register("user_profile_running", with_views(f"""WITH {PROFILE_CTES},
ss AS (SELECT *, min(us) OVER (PARTITION BY user_id, sess) AS sess_start FROM h)
SELECT transaction_id, n AS user_txn_count_total, round(mean0, 6) AS user_avg_amount,
  round(std_, 6) AS user_std_amount,
  CASE WHEN n > 0 THEN sess_start ELSE us END AS first_seen_us,
  CASE WHEN n > 0 THEN pu ELSE us END AS last_seen_us
FROM ss""", "txn"))

# scored at the critical threshold: the scored view's probability by transaction
FRAUDS = "sum(CASE WHEN (CAST(substr(transaction_id, 5) AS BIGINT) * 37) % 1000 >= 850 THEN 1 ELSE 0 END)"

register("user_profile_snapshot", with_views(f"""WITH {PROFILE_CTES},
ls AS (SELECT user_id, max(sess) AS ms FROM c2 GROUP BY 1)
SELECT c2.user_id, count(*) AS txn_count_total, round(avg(amount), 6) AS avg_amount,
  round(coalesce(stddev_pop(amount), 0.0), 6) AS std_amount, min(us) AS first_seen_us, max(us) AS last_seen_us,
  CAST({FRAUDS} AS BIGINT) AS fraud_count
FROM c2 JOIN ls ON c2.user_id = ls.user_id AND c2.sess = ls.ms GROUP BY 1""", "txn"))

register("rolling_rows_features", with_views("""
SELECT transaction_id,
  least(row_number() OVER w, 10) AS txn_count_1h, least(row_number() OVER w, 50) AS txn_count_24h,
  least(row_number() OVER w, 100) AS txn_count_7d,
  round(sum(amount) OVER (PARTITION BY user_id ORDER BY us, transaction_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 6)
    AS total_amount_24h
FROM txn WINDOW w AS (PARTITION BY user_id ORDER BY us, transaction_id)""", "txn"))

USER_STATS_CTE = """us_ AS (SELECT user_id, avg(amount) AS ua, coalesce(stddev_samp(amount), 0.0) AS usd,
  count(*) AS uc FROM txn GROUP BY 1)"""
register("user_stats_join", with_views(f"""WITH {USER_STATS_CTE}
SELECT transaction_id, round(ua, 6) AS user_avg_amount, round(usd, 6) AS user_std_amount, uc AS user_txn_count,
  round(CASE WHEN usd > 0 THEN (amount - ua) / usd ELSE 0.0 END, 6) AS amount_zscore
FROM txn JOIN us_ USING (user_id)""", "txn"))

CONSEC_CTE = f"""ct AS (
  SELECT *, lag(us) OVER w AS pu2, lag(latitude) OVER w AS plat2, lag(longitude) OVER w AS plon2
  FROM txn WINDOW w AS (PARTITION BY user_id ORDER BY us, transaction_id)),
ct2 AS (SELECT *, CASE WHEN pu2 IS NOT NULL THEN {hav('plat2', 'plon2', 'latitude', 'longitude')} ELSE 0.0 END
          AS distance_from_last,
        CASE WHEN pu2 IS NOT NULL THEN (us - pu2) / 1e6 ELSE 0.0 END AS time_since_last_txn FROM ct)"""
register("consecutive_travel", with_views(f"""WITH {CONSEC_CTE}
SELECT transaction_id, round(distance_from_last, 6) AS distance_from_last,
  round(time_since_last_txn, 6) AS time_since_last_txn, round(distance_from_last, 6) AS travel_speed,
  CAST(distance_from_last > 1200 AS INTEGER) AS is_impossible_travel
FROM ct2""", "txn"))

register("merchant_risk_join", with_views("""
WITH m AS (SELECT merchant_id, avg(is_fraud) AS r FROM txn GROUP BY 1)
SELECT transaction_id, round(coalesce(r, 0.5), 6) AS merchant_risk_score FROM txn LEFT JOIN m USING (merchant_id)""",
                                          "txn"))

MERCH_PRIOR = ("coalesce(avg(is_fraud) OVER (PARTITION BY merchant_id ORDER BY us "
               "RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.5)")
register("merchant_risk_prior", with_views(
    f"SELECT transaction_id, round({MERCH_PRIOR}, 6) AS merchant_risk_score FROM txn", "txn"))

register("user_fraud_history", with_views("""
SELECT transaction_id, CAST(coalesce(sum(is_fraud) OVER (PARTITION BY user_id ORDER BY us, transaction_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS user_fraud_history FROM txn""", "txn"))

register("user_fraud_history_scored", with_views(f"""
WITH a AS (SELECT *, lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS pu FROM scored),
b AS (SELECT *, sum(CASE WHEN pu IS NULL OR us - pu >= {DAY} THEN 1 ELSE 0 END)
        OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS sess FROM a)
SELECT event_id, CAST(coalesce(sum(CASE WHEN fraud_probability >= 0.85 THEN 1 ELSE 0 END) OVER
  (PARTITION BY user_id, sess ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
  AS user_fraud_history_count
FROM b""", "scored"))

MERCH_COUNT = (f"count(*) OVER (PARTITION BY merchant_id ORDER BY us RANGE BETWEEN {DAY} PRECEDING "
               "AND 1 PRECEDING)")
register("merchant_txn_count_24h", with_views(
    f"SELECT transaction_id, {MERCH_COUNT} AS merchant_txn_count_24h FROM txn", "txn", dense=True))

# Full point-in-time feature row.
PIT_CTES = f"""{PROFILE_CTES},
pv AS (SELECT h.*, vw.txn_count_1h, vw.txn_count_24h, vw.txn_count_7d, vw.total_amount_24h,
         {MERCH_PRIOR.replace('is_fraud', 'h.is_fraud').replace('merchant_id', 'h.merchant_id').replace('ORDER BY us', 'ORDER BY h.us')}
           AS merchant_risk_score,
         {MERCH_COUNT.replace('merchant_id', 'h.merchant_id').replace('ORDER BY us', 'ORDER BY h.us')}
           AS merchant_txn_count_24h
       FROM h JOIN vw USING (transaction_id)),
pit AS (SELECT *, least(1.0, (txn_count_1h / 10.0) * 0.3 + (txn_count_24h / 50.0) * 0.7) AS velocity_score,
          CAST(0 AS BIGINT) AS user_fraud_history_count, {DOW_SQL} AS day_of_week, {DOW_SQL} >= 5 AS is_weekend
        FROM pv)"""

# the same with the user's earlier frauds of the session
PIT_SCORED = PIT_CTES.replace("CAST(0 AS BIGINT) AS user_fraud_history_count",
    f"CAST(coalesce({FRAUDS} OVER (PARTITION BY user_id, sess ORDER BY us, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING "
    "AND 1 PRECEDING), 0) AS BIGINT) AS user_fraud_history_count")

PIT_SELECT = """SELECT transaction_id, round(amount, 6) AS amount, round(ln(1 + amount), 6) AS amount_log,
  round(z, 6) AS amount_zscore, hour_of_day, day_of_week, is_weekend,
  round(dt, 6) AS time_since_last_txn_seconds, txn_count_1h, txn_count_24h, txn_count_7d,
  round(total_amount_24h, 6) AS total_amount_24h, round(dist, 6) AS distance_from_last_txn_km,
  round(spd, 6) AS travel_speed_kmh, impossible AS is_impossible_travel, round(mean0, 6) AS user_avg_amount,
  round(std_, 6) AS user_std_amount, n AS user_txn_count_total, user_fraud_history_count,
  round(merchant_risk_score, 6) AS merchant_risk_score, merchant_txn_count_24h,
  round(velocity_score, 6) AS velocity_score
FROM pit"""

register("point_in_time_features", with_views(f"WITH {VEL_CTE},{PIT_SCORED}\n{PIT_SELECT}", "txn", dense=True))

MODEL_FACTORS = """concat_ws(',',
  CASE WHEN impossible THEN 'IMPOSSIBLE_TRAVEL' END, CASE WHEN z > 3.0 THEN 'UNUSUAL_AMOUNT' END,
  CASE WHEN velocity_score > 0.7 THEN 'HIGH_VELOCITY' END, CASE WHEN txn_count_1h > 5 THEN 'RAPID_TRANSACTIONS' END,
  CASE WHEN dist > 500 THEN 'DISTANT_TRANSACTION' END,
  CASE WHEN user_fraud_history_count > 0 THEN 'PRIOR_FRAUD_HISTORY' END,
  CASE WHEN dt < 60 THEN 'TOO_QUICK' END, CASE WHEN hour_of_day < 4 THEN 'UNUSUAL_TIME' END)"""

register("model_risk_factors", with_views(
    f"WITH {VEL_CTE},{PIT_SCORED}\nSELECT transaction_id, {MODEL_FACTORS} AS factors FROM pit", "txn", dense=True))

register("velocity_score", with_views(f"""WITH {VEL_CTE}
SELECT transaction_id, round(least(1.0, (txn_count_1h / 10.0) * 0.3 + (txn_count_24h / 50.0) * 0.7), 6)
  AS velocity_score FROM vw""", "txn", dense=True))

register("feature_vector", with_views(f"""WITH {VEL_CTE},{PIT_CTES},
fv AS (SELECT transaction_id, [CAST(amount AS FLOAT), CAST(ln(1 + amount) AS FLOAT), CAST(z AS FLOAT),
  CAST(hour_of_day AS FLOAT), CAST(day_of_week AS FLOAT), CAST(is_weekend AS FLOAT), CAST(dt AS FLOAT),
  CAST(txn_count_1h AS FLOAT), CAST(txn_count_24h AS FLOAT), CAST(txn_count_7d AS FLOAT),
  CAST(total_amount_24h AS FLOAT), CAST(dist AS FLOAT), CAST(spd AS FLOAT), CAST(impossible AS FLOAT),
  CAST(mean0 AS FLOAT), CAST(std_ AS FLOAT), CAST(n AS FLOAT), CAST(user_fraud_history_count AS FLOAT),
  CAST(velocity_score AS FLOAT), CAST(merchant_risk_score AS FLOAT)] AS v FROM pit)
SELECT transaction_id, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS pos,
  round(CAST(unnest(v) AS DOUBLE), 6) AS x FROM fv""", "txn"))

TRAIN_SQL = f"""WITH {USER_STATS_CTE}, {CONSEC_CTE},
m AS (SELECT merchant_id, avg(is_fraud) AS r FROM txn GROUP BY 1),
t2 AS (SELECT ct2.*, ua, usd, uc, coalesce(m.r, 0.5) AS mr,
  row_number() OVER w AS rn,
  sum(amount) OVER (PARTITION BY ct2.user_id ORDER BY us, transaction_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)
    AS s50,
  coalesce(sum(is_fraud) OVER (PARTITION BY ct2.user_id ORDER BY us, transaction_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ufh
  FROM ct2 JOIN us_ USING (user_id) LEFT JOIN m USING (merchant_id)
  WINDOW w AS (PARTITION BY ct2.user_id ORDER BY us, transaction_id))
SELECT transaction_id, round(amount, 6) AS amount, round(ln(1 + amount), 6) AS amount_log, {HOUR_SQL} AS hour_of_day,
  {DOW_SQL} AS day_of_week, CAST({DOW_SQL} >= 5 AS INTEGER) AS is_weekend, round(ua, 6) AS user_avg_amount,
  round(usd, 6) AS user_std_amount, uc AS user_txn_count,
  round(CASE WHEN usd > 0 THEN (amount - ua) / usd ELSE 0.0 END, 6) AS amount_zscore,
  least(rn, 10) AS txn_count_1h, least(rn, 50) AS txn_count_24h, least(rn, 100) AS txn_count_7d,
  round(s50, 6) AS total_amount_24h,
  round(greatest(0.0, least(1.0, (least(rn, 10) / 10.0) * 0.3 + (least(rn, 50) / 50.0) * 0.7)), 6) AS velocity_score,
  round(distance_from_last, 6) AS distance_from_last, round(time_since_last_txn, 6) AS time_since_last_txn,
  round(distance_from_last, 6) AS travel_speed, CAST(distance_from_last > 1200 AS INTEGER) AS is_impossible_travel,
  round(mr, 6) AS merchant_risk_score, CAST(ufh AS BIGINT) AS user_fraud_history
FROM t2"""
register("training_features", with_views(TRAIN_SQL, "txn"))

# ---------------------------------------------------------------------------
# E: rules and scoring
# ---------------------------------------------------------------------------
for _i, _n in enumerate(["rule_amount_velocity", "rule_impossible_travel", "rule_time_pattern",
                         "rule_frequency", "rule_amount_anomaly"], start=1):
    register(_n, with_views(f"WITH {PROFILE_CTES},{RULE_CTES}\nSELECT transaction_id, s{_i} AS score, "
                            f"f{_i} AS factor FROM r", "txn"))

register("alert_report_row", with_views(f"""WITH {PROFILE_CTES},{RULE_CTES}
SELECT transaction_id, substr(transaction_id, 1, 16) || '...' AS short_id,
  printf('%.2f', prob * 100) || '%' AS probability,
  replace(concat_ws(', ', f1, f2, f3, f4, f5), '_', ' ') AS factors
FROM rs""", "txn"))

HYBRID_TAIL = """
SELECT transaction_id, round(CASE WHEN mp IS NOT NULL THEN mp ELSE prob END, 6) AS fraud_probability,
  {lvl} AS risk_level,
  CASE WHEN mp IS NOT NULL THEN {mf} ELSE concat_ws(',', f1, f2, f3, f4, f5, 'FALLBACK_MODE') END AS risk_factors,
  CASE WHEN mp IS NOT NULL THEN 'gbt' ELSE 'rules_fallback' END AS model_used,
  CASE WHEN mp IS NOT NULL THEN 'gbt-v1' ELSE 'rule-based-v1' END AS model_version,
  CAST(CASE WHEN mp IS NOT NULL THEN 21 ELSE 0 END AS INTEGER) AS features_used
FROM rs2""".replace("{lvl}", level("CASE WHEN mp IS NOT NULL THEN mp ELSE prob END")).replace("{mf}", MODEL_FACTORS)

_RULES_ON_PIT = RULE_CTES.replace("FROM h)", "FROM pit)")
register("hybrid_score", with_views(f"""WITH {VEL_CTE},{PIT_CTES},{_RULES_ON_PIT},
rs2 AS (SELECT *, CASE WHEN CAST(substr(transaction_id, 5) AS BIGINT) % 3 = 0 THEN NULL
  ELSE CAST((CAST(substr(transaction_id, 5) AS BIGINT) * 37) % 1000 AS DOUBLE) / 1000 END AS mp FROM rs)
{HYBRID_TAIL}""", "txn", dense=True))

register("score_batch", with_views(f"""WITH {VEL_CTE},{PIT_CTES},{_RULES_ON_PIT},
rs2 AS (SELECT *, CAST(NULL AS DOUBLE) AS mp FROM rs)
{HYBRID_TAIL}""", "txn"))

# ---------------------------------------------------------------------------
# A: class balance, profile lookup
# ---------------------------------------------------------------------------
register("class_distribution", with_views("""
WITH c AS (SELECT is_fraud, count(*) AS n_rows, CAST(sum(is_fraud) AS BIGINT) AS pos FROM txn GROUP BY 1)
SELECT is_fraud, n_rows, CAST(sum(n_rows) OVER () AS BIGINT) AS total_rows,
  CAST(sum(pos) OVER () AS BIGINT) AS positives, round(sum(pos) OVER () / sum(n_rows) OVER (), 6) AS fraud_rate
FROM c""", "txn"))

register("profile_lookup", with_views(f"""WITH {PROFILE_CTES},
ls AS (SELECT user_id, max(sess) AS ms FROM c2 GROUP BY 1),
prof AS (SELECT c2.user_id, count(*) AS cnt, avg(amount) AS av, coalesce(stddev_pop(amount), 0.0) AS sd,
  {FRAUDS} AS fc
  FROM c2 JOIN ls ON c2.user_id = ls.user_id AND c2.sess = ls.ms GROUP BY 1),
req AS (SELECT DISTINCT concat('USER_', lpad(CAST(c_custkey AS varchar), 8, '0')) AS user_id FROM customer)
SELECT req.user_id, prof.user_id IS NOT NULL AS found, round(coalesce(av, 0.0), 6) AS avg_amount,
  round(coalesce(sd, 0.0), 6) AS std_amount, CAST(coalesce(cnt, 0) AS BIGINT) AS txn_count_total,
  CAST(coalesce(fc, 0) AS BIGINT) AS fraud_count
FROM req LEFT JOIN prof ON req.user_id = prof.user_id""", "txn"))

# ---------------------------------------------------------------------------
# evaluation
# ---------------------------------------------------------------------------
register("confusion_matrix", with_views("""
WITH g AS (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS t(actual, predicted)),
c AS (SELECT label AS actual, CAST(fraud_probability >= 0.5 AS INTEGER) AS predicted, count(*) AS n
      FROM scored GROUP BY 1, 2)
SELECT g.actual, g.predicted, CAST(coalesce(n, 0) AS BIGINT) AS n FROM g LEFT JOIN c USING (actual, predicted)""",
                                        "scored"))

register("classification_report", with_views("""
WITH s AS (SELECT count(*) FILTER (WHERE label = 1 AND fraud_probability >= 0.5) AS tp,
  count(*) FILTER (WHERE label = 0 AND fraud_probability >= 0.5) AS fp,
  count(*) FILTER (WHERE label = 1 AND fraud_probability < 0.5) AS fn,
  count(*) FILTER (WHERE label = 0 AND fraud_probability < 0.5) AS tn FROM scored),
m AS (SELECT *, tp + fp + fn + tn AS n,
  CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p1, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r1,
  CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0.0 END AS p0, CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0.0 END AS r0
  FROM s),
f AS (SELECT *, CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0.0 END AS f0,
  CASE WHEN p1 + r1 > 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0.0 END AS f1 FROM m),
rows AS (
  SELECT '0' AS class, p0 AS precision, r0 AS recall, f0 AS f1_score, tn + fp AS support FROM f
  UNION ALL SELECT '1', p1, r1, f1, tp + fn FROM f
  UNION ALL SELECT 'accuracy', (tp + tn) / n, (tp + tn) / n, (tp + tn) / n, n FROM f
  UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM f
  UNION ALL SELECT 'weighted avg', (p0 * (tn + fp) + p1 * (tp + fn)) / n, (r0 * (tn + fp) + r1 * (tp + fn)) / n,
    (f0 * (tn + fp) + f1 * (tp + fn)) / n, n FROM f)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score,
  CAST(support AS BIGINT) AS support FROM rows""", "scored"))

ROC_CTE = """sc AS (SELECT fraud_probability AS threshold, count(*) FILTER (WHERE label = 1) AS pos,
  count(*) FILTER (WHERE label != 1) AS neg FROM scored GROUP BY 1),
tot AS (SELECT count(*) FILTER (WHERE label = 1) AS P, count(*) FILTER (WHERE label != 1) AS N FROM scored),
cum AS (SELECT threshold, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM sc
  WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)),
roc AS (SELECT 'inf'::double AS threshold, 0.0 AS fpr, 0.0 AS tpr
  UNION ALL SELECT threshold, CASE WHEN (SELECT N FROM tot) > 0 THEN fp / (SELECT N FROM tot) ELSE 0.0 END,
    CASE WHEN (SELECT P FROM tot) > 0 THEN tp / (SELECT P FROM tot) ELSE 0.0 END FROM cum),
pr AS (SELECT 'inf'::double AS threshold, 1.0 AS precision, 0.0 AS recall
  UNION ALL SELECT threshold, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END,
    CASE WHEN (SELECT P FROM tot) > 0 THEN tp / (SELECT P FROM tot) ELSE 0.0 END FROM cum)"""

register("roc_curve", with_views(f"""WITH {ROC_CTE}
SELECT threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM roc""", "scored"))
register("roc_auc", with_views(f"""WITH {ROC_CTE},
l AS (SELECT fpr, tpr, lag(fpr) OVER (ORDER BY threshold DESC) AS pf, lag(tpr) OVER (ORDER BY threshold DESC) AS pt
  FROM roc)
SELECT round(coalesce(sum((fpr - pf) * (tpr + pt) / 2), 0.0), 6) AS roc_auc FROM l""", "scored"))
register("pr_curve", with_views(f"""WITH {ROC_CTE}
SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall FROM pr""",
                                "scored"))
register("pr_auc", with_views(f"""WITH {ROC_CTE},
l AS (SELECT precision, recall, lag(precision) OVER (ORDER BY threshold DESC) AS pp,
  lag(recall) OVER (ORDER BY threshold DESC) AS pr_ FROM pr)
SELECT round(coalesce(sum((recall - pr_) * (precision + pp) / 2), 0.0), 6) AS pr_auc FROM l""", "scored"))


# ---------------------------------------------------------------------------
# H: monitoring
# ---------------------------------------------------------------------------
MODEL_B = [0.001, 0.005, 0.01, 0.02, 0.03, 0.05, 0.1]
STORE_B = [0.001, 0.005, 0.01, 0.025, 0.05, 0.1]
SCORE_B = [0.005, 0.01, 0.02, 0.03, 0.04, 0.05, 0.075, 0.1, 0.25]
REQ_B = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 1.0]


def hist_sql(src: str, value: str, bounds: list, by: list[str]) -> str:
    byc = ", ".join(by)
    aggs = ", ".join(f"count(*) FILTER (WHERE {value} <= {b!r}) AS b{i}" for i, b in enumerate(bounds))
    arms = " UNION ALL ".join(f"SELECT {byc}, '{b!r}' AS le, {i} AS bucket, b{i} AS cumulative_count, cnt, sm FROM g"
                              for i, b in enumerate(bounds))
    arms += f" UNION ALL SELECT {byc}, '+Inf', {len(bounds)}, cnt, cnt, sm FROM g"
    return f"""WITH g AS (SELECT {byc}, {aggs}, count(*) AS cnt, sum({value}) AS sm FROM {src} GROUP BY {byc}),
u AS ({arms})
SELECT {byc}, le, CAST(bucket AS INTEGER) AS bucket, cumulative_count, cnt AS count, round(sm, 6) AS sum FROM u"""


register("score_counters", with_views(
    "SELECT risk_level, model_used, count(*) AS n FROM scored GROUP BY 1, 2", "scored"))
register("latency_histogram", with_views(
    hist_sql("(SELECT *, latency_ms / 1000.0 AS lat_s FROM scored)", "lat_s", SCORE_B, ["model_used"]), "scored"))
register("amount_totals", with_views(
    "SELECT currency, risk_level, round(sum(amount), 6) AS amount_total FROM scored WHERE amount > 0 GROUP BY 1, 2",
    "scored"))
register("fraud_rate_running", with_views("""
WITH m AS (SELECT us // 60000000 AS minute, count(*) AS n,
  count(*) FILTER (WHERE risk_level IN ('HIGH', 'CRITICAL')) AS k FROM scored GROUP BY 1)
SELECT minute, CAST(sum(n) OVER w AS BIGINT) AS total_so_far, CAST(sum(k) OVER w AS BIGINT) AS alerts_so_far,
  round(sum(k) OVER w / sum(n) OVER w, 6) AS fraud_rate
FROM m WINDOW w AS (ORDER BY minute ROWS UNBOUNDED PRECEDING)""", "scored"))
register("alert_counters", with_views("""
SELECT 'fraud_alerts_total' AS counter, risk_level AS label, count(*) AS n FROM scored
  WHERE risk_level IN ('HIGH', 'CRITICAL') GROUP BY 2
UNION ALL
SELECT 'high_value_fraud_total', currency, count(*) FROM scored
  WHERE risk_level IN ('HIGH', 'CRITICAL') AND amount > 10000.0 GROUP BY 2""", "scored"))

ENDPOINT_SQL = """'/' || array_to_string(list_transform(string_split(trim(path, '/'), '/'), lambda x:
  CASE WHEN (length(x) = 36 AND contains(x, '-')) OR regexp_matches(x, '^[0-9]+$') OR length(x) > 20
       THEN '{id}' ELSE x END), '/')"""
REQ_NM = f"(SELECT *, {ENDPOINT_SQL} AS endpoint FROM requests WHERE path != '/metrics')"

register("request_counters", with_views(
    f"SELECT method, endpoint, status_code, count(*) AS n FROM {REQ_NM} r GROUP BY 1, 2, 3", "requests"))
register("request_duration_histogram", with_views(
    hist_sql(REQ_NM + " r", "duration_s", REQ_B, ["method", "endpoint"]), "requests"))
register("outcome_counters", with_views("""
WITH o AS (SELECT CASE WHEN model_used = 'gbt' THEN 'model' ELSE 'rules' END AS name, 'predict' AS operation,
  status, latency_ms / 1000.0 AS latency_s FROM scored)
SELECT name, operation, status, count(*) AS n,
  round(sum(CASE WHEN status = 'success' AND name IN ('model') THEN latency_s END), 6) AS success_latency_s
FROM o GROUP BY 1, 2, 3""", "scored"))


def winsum_sql(src: str, labels: list[str], values: dict[str, str], n: int = 10) -> str:
    """Sparse windowed sums: each occupied 30 s bin spread to the n grid
    points that see it."""
    lab = ", ".join(labels)
    lab_c = (lab + ", ") if labels else ""
    vals = ", ".join(f"sum({v}) AS {k}" for k, v in values.items())
    vals2 = ", ".join(f"sum({k}) AS {k}" for k in values)
    return f"""bn AS (SELECT {lab_c}(us + 29999999) // 30000000 AS k, {vals} FROM {src} GROUP BY ALL),
sp AS (SELECT {lab_c}unnest(range(k, k + {n})) AS k2, {', '.join(values)} FROM bn),
ws AS (SELECT {lab_c}k2 * 30000000 AS t_us, {vals2} FROM sp GROUP BY ALL)"""


register("windowed_rate", with_views(f"""WITH {winsum_sql('scored', ['risk_level'], {'increase': '1'})}
SELECT risk_level, t_us, CAST(increase AS BIGINT) AS increase, round(increase / 300.0, 6) AS rate FROM ws""",
                                     "scored"))

_QV = {f"c{i}": f"CASE WHEN lat_s <= {b!r} THEN 1 ELSE 0 END" for i, b in enumerate(SCORE_B)}
_QV["total"] = "1"


def _quantile_expr(bounds: list, q: float) -> str:
    parts, prev_b, prev_c = [], "0.0", "0"
    for i, b in enumerate(bounds):
        c = f"c{i}"
        inside = (f"coalesce({prev_b} + ({b!r} - {prev_b}) * ((({q} * total) - {prev_c}) / "
                  f"nullif(CAST({c} - {prev_c} AS DOUBLE), 0)), {b!r})")
        parts.append(f"WHEN {c} >= {q} * total THEN {inside}")
        prev_b, prev_c = repr(b), c
    return f"CASE WHEN total > 0 THEN (CASE {' '.join(parts)} ELSE {bounds[-1]!r} END) END"


register("histogram_quantile", with_views(f"""WITH
{winsum_sql('(SELECT *, latency_ms / 1000.0 AS lat_s FROM scored)', ['model_used'], _QV)}
SELECT model_used, t_us, round({_quantile_expr(SCORE_B, 0.95)}, 6) AS quantile FROM ws""", "scored"))

register("error_ratio", with_views(f"""WITH
{winsum_sql(REQ_NM, ['endpoint'], {'errors': "CASE WHEN starts_with(status_code, '5') THEN 1 ELSE 0 END",
                                    'total': '1'})}
SELECT endpoint, t_us, CAST(errors AS BIGINT) AS errors, CAST(total AS BIGINT) AS total,
  round(errors / total, 6) AS ratio FROM ws""", "requests"))


def hold_sql(src: str, labels: list[str], cond: str, hold_us: int) -> str:
    lab = ", ".join(labels)
    part = f"PARTITION BY {lab}" if labels else ""
    return f"""hf AS (SELECT * FROM {src} WHERE coalesce({cond}, false)),
hr AS (SELECT *, t_us // 30000000 - row_number() OVER (ORDER BY t_us) AS run0,
         t_us // 30000000 - row_number() OVER ({part} ORDER BY t_us) AS run FROM hf),
hs AS (SELECT *, min(t_us) OVER ({part}{', ' if labels else 'PARTITION BY '}run) AS active_since_us FROM hr),
ho AS (SELECT *, CASE WHEN t_us - active_since_us >= {hold_us} THEN 'firing' ELSE 'pending' END AS state FROM hs)"""


register("alert_hold", with_views(f"""WITH {winsum_sql('scored', ['risk_level'], {'increase': '1'})},
{hold_sql('ws', ['risk_level'], 'increase >= 1', 120000000)}
SELECT risk_level, t_us, CAST(increase AS BIGINT) AS increase, active_since_us, state FROM ho""", "scored"))

# ---------------------------------------------------------------------------
# I: alert feed
# ---------------------------------------------------------------------------
AS_OF = 1706659200000000
register("dashboard_stats", with_views(f"""
SELECT count(*) AS total_transactions,
  count(*) FILTER (WHERE risk_level IN ('HIGH', 'CRITICAL')) AS fraud_detected,
  round(count(*) FILTER (WHERE risk_level IN ('HIGH', 'CRITICAL')) / count(*), 6) AS fraud_rate,
  round(avg(latency_ms), 6) AS avg_latency_ms,
  count(*) FILTER (WHERE risk_level IN ('HIGH', 'CRITICAL') AND us > {AS_OF - 3600000000}) AS alerts_last_hour,
  round(coalesce(sum(CASE WHEN risk_level IN ('HIGH', 'CRITICAL') THEN amount END), 0.0), 6) AS total_amount_blocked
FROM scored WHERE us <= {AS_OF}""", "scored"))

register("alert_history", with_views("""
SELECT event_id, us, risk_level, CAST(row_number() OVER (ORDER BY us DESC, event_id DESC) AS INTEGER) AS position
FROM scored WHERE risk_level IN ('HIGH', 'CRITICAL') ORDER BY us DESC, event_id DESC LIMIT 100""", "scored"))

register("route_alerts", with_views("""
WITH subs AS (SELECT c_custkey AS subscriber, unnest(CASE WHEN c_mktsegment IN ('BUILDING', 'AUTOMOBILE')
    THEN ['CRITICAL'] ELSE ['HIGH', 'CRITICAL'] END) AS level FROM customer),
rooms AS (SELECT level, count(DISTINCT subscriber) AS subscribers FROM subs GROUP BY 1)
SELECT event_id, 'alerts:' || risk_level AS room, subscribers
FROM scored JOIN rooms ON scored.risk_level = rooms.level WHERE risk_level IN ('HIGH', 'CRITICAL')""", "scored"))

register("risk_distribution", with_views(f"""WITH {PROFILE_CTES},{RULE_CTES},
lv AS (SELECT * FROM (VALUES ('LOW'), ('MEDIUM'), ('HIGH'), ('CRITICAL')) AS t(risk_level)),
cnt AS (SELECT {level('prob')} AS risk_level, count(*) AS n FROM rs GROUP BY 1)
SELECT lv.risk_level, CAST(coalesce(n, 0) AS BIGINT) AS n FROM lv LEFT JOIN cnt USING (risk_level)""", "txn"))

register("recent_alerts", with_views(f"""WITH {PROFILE_CTES},{RULE_CTES}
SELECT transaction_id, us, {level('prob')} AS risk_level, substr(transaction_id, 1, 16) || '...' AS short_id,
  printf('%.2f', prob * 100) || '%' AS probability, replace(concat_ws(', ', f1, f2, f3, f4, f5), '_', ' ') AS factors
FROM rs WHERE {level('prob')} IN ('MEDIUM') ORDER BY us DESC, transaction_id DESC LIMIT 10""", "txn", dense=True))

register("rate_status", with_views("""
WITH r AS (SELECT us // 86400000000 AS day,
  count(*) FILTER (WHERE risk_level IN ('HIGH', 'CRITICAL') AND label = 1) / count(*) AS fraud_rate
  FROM scored GROUP BY 1)
SELECT day, round(fraud_rate, 6) AS fraud_rate, CASE WHEN fraud_rate < 0.001 THEN 'Normal' ELSE 'Elevated' END
  AS status FROM r""", "scored"))


# ---------------------------------------------------------------------------
# G: preparation
# ---------------------------------------------------------------------------
_G1 = [(c, "numeric", i) for i, c in enumerate([
    "amount", "amount_log", "amount_zscore", "hour_of_day", "day_of_week", "is_weekend", "time_since_last_txn",
    "txn_count_1h", "txn_count_24h", "txn_count_7d", "total_amount_24h", "distance_from_last", "travel_speed",
    "is_impossible_travel", "user_avg_amount", "user_std_amount", "user_txn_count", "user_fraud_history",
    "merchant_risk_score", "velocity_score"])] + [(c, "categorical", i) for i, c in enumerate(
    ["currency", "merchant_category", "channel"])]
register("select_available_features", with_views(
    TRAIN_SQL[:TRAIN_SQL.index("\nSELECT transaction_id, round(amount, 6)")] + "\n" + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, '{k}' AS kind, {i} AS position, count(*) AS n_non_null FROM t2"
        for c, k, i in _G1), "txn"))

_TRAIN_CTES = TRAIN_SQL[:TRAIN_SQL.index("\nSELECT transaction_id, round(amount, 6)")]
_VEL_SHARE = "(least(rn, 10) / 10.0) * 0.3 + (least(rn, 50) / 50.0) * 0.7"
_TRAIN_EXPR = {
    "amount": "amount", "amount_log": "ln(1 + amount)",
    "amount_zscore": "CASE WHEN usd > 0 THEN (amount - ua) / usd ELSE 0.0 END", "hour_of_day": HOUR_SQL,
    "day_of_week": DOW_SQL, "is_weekend": f"CAST({DOW_SQL} >= 5 AS INTEGER)", "time_since_last_txn": "time_since_last_txn",
    "txn_count_1h": "least(rn, 10)", "txn_count_24h": "least(rn, 50)", "txn_count_7d": "least(rn, 100)",
    "total_amount_24h": "s50", "distance_from_last": "distance_from_last", "travel_speed": "distance_from_last",
    "is_impossible_travel": "CAST(distance_from_last > 1200 AS INTEGER)", "user_avg_amount": "ua", "user_std_amount": "usd",
    "user_txn_count": "uc", "user_fraud_history": "ufh", "merchant_risk_score": "mr",
    "velocity_score": f"greatest(0.0, least(1.0, {_VEL_SHARE}))"}
register("impute_median", with_views(f"""{_TRAIN_CTES},
gone AS (SELECT transaction_id, {', '.join(
    f"CASE WHEN (CAST(substr(transaction_id, 5) AS BIGINT) + {i}) % 9 != 0 THEN CAST({x} AS DOUBLE) END AS {c}"
    for i, (c, x) in enumerate(_TRAIN_EXPR.items()))} FROM t2),
med AS (SELECT {', '.join(f"median({c}) AS m_{c}" for c in _TRAIN_EXPR)} FROM gone)
SELECT transaction_id, {', '.join(f"round(coalesce({c}, (SELECT m_{c} FROM med)), 6) AS {c}" for c in _TRAIN_EXPR)}
FROM gone""", "txn"))

register("standard_scale", with_views(f"""{_TRAIN_CTES},
x AS (SELECT transaction_id, {', '.join(f"CAST({x} AS DOUBLE) AS {c}" for c, x in _TRAIN_EXPR.items())} FROM t2),
fit AS (SELECT {', '.join(f"avg({c}) AS m_{c}, coalesce(nullif(stddev_pop({c}), 0), 1) AS s_{c}" for c in _TRAIN_EXPR)} FROM x)
SELECT transaction_id, {', '.join(f"round(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in _TRAIN_EXPR)} FROM x, fit""", "txn"))


def _gain(side: str) -> str:
    """Gain of a first split with penalties 0.1 and 1 and a hessian of 3 at
    least: a row's gradient is 0.5 less its label, its hessian 0.25."""
    more = {"left": (" + gm", " + hm"), "right": ("", "")}[side]
    gl, hl = f"(gl{more[0]})", f"(hl{more[1]})"
    def score(g, h):
        return f"power(greatest(abs({g}) - 0.1::DOUBLE, 0), 2) / ({h} + 1)"
    return (f"CASE WHEN {hl} >= 3 AND ht - {hl} >= 3 THEN round({score(gl, hl)} + {score(f'gt - {gl}', f'ht - {hl}')} - "
            f"{score('gt', 'ht')}, 6) END AS gain_missing_{side}")


register("split_gains", with_views(f"""{_TRAIN_CTES},
x AS (SELECT is_fraud, {', '.join(f"CAST({x} AS DOUBLE) AS {c}" for c, x in _TRAIN_EXPR.items())} FROM t2),
long AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, {c} AS v, is_fraud FROM x" for c in _TRAIN_EXPR)}),
ends AS (SELECT feature, min(v) AS lo, max(v) AS hi FROM long GROUP BY feature),
cuts AS (SELECT feature, lo + (hi - lo) * i / 16 AS cut FROM ends, range(1, 16) r(i) WHERE lo IS NOT NULL),
sums AS (SELECT c.feature, c.cut, sum(CASE WHEN v <= cut THEN 0.5 - is_fraud ELSE 0 END)::DOUBLE AS gl,
    sum(CASE WHEN v <= cut THEN 0.25 ELSE 0 END)::DOUBLE AS hl, sum(0.5 - is_fraud)::DOUBLE AS gt, sum(0.25)::DOUBLE AS ht,
    sum(CASE WHEN v IS NULL THEN 0.5 - is_fraud ELSE 0 END)::DOUBLE AS gm, sum(CASE WHEN v IS NULL THEN 0.25 ELSE 0 END)::DOUBLE AS hm
  FROM cuts c JOIN long l USING (feature) GROUP BY c.feature, c.cut)
SELECT feature, round(cut, 6) AS cut, {_gain('left')}, {_gain('right')} FROM sums""", "txn"))

register("tree_score", with_views(f"""{_TRAIN_CTES},
x AS (SELECT transaction_id, {', '.join(f"CAST({x} AS DOUBLE) AS {c}" for c, x in _TRAIN_EXPR.items())} FROM t2),
p AS (SELECT transaction_id, 1 / (1 + exp(-(
    CASE WHEN merchant_risk_score <= 0.1 OR merchant_risk_score IS NULL THEN
      CASE WHEN amount_zscore <= 2 OR amount_zscore IS NULL THEN CASE WHEN hour_of_day <= 4 THEN -0.2::DOUBLE ELSE -0.9::DOUBLE END
           ELSE 0.35::DOUBLE END
    WHEN velocity_score <= 0.3 THEN 0.8::DOUBLE ELSE 1.4::DOUBLE END
  + (CASE WHEN distance_from_last <= 1200 OR distance_from_last IS NULL THEN CASE WHEN amount <= 500 THEN -0.6::DOUBLE ELSE 0.15::DOUBLE END
     WHEN time_since_last_txn <= 3600 OR time_since_last_txn IS NULL THEN 1.1::DOUBLE ELSE 0.4::DOUBLE END
  + CASE WHEN amount_zscore <= 3 OR amount_zscore IS NULL THEN CASE WHEN merchant_risk_score <= 0.01 THEN -0.5::DOUBLE ELSE 0.05::DOUBLE END
    ELSE 0.9::DOUBLE END)))) AS p FROM x)
SELECT transaction_id, round(p, 6) AS fraud_probability,
  CASE WHEN p >= 0.85 THEN 'CRITICAL' WHEN p >= 0.70 THEN 'HIGH' WHEN p >= 0.50 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM p""", "txn"))


def _onehot(c: str) -> str:
    return (f"array_to_string(list_transform((SELECT list_sort(list(DISTINCT coalesce({c}, 'unknown'))) FROM txn), "
            f"lambda x: CASE WHEN x = coalesce(r.{c}, 'unknown') THEN '1' ELSE '0' END), '') AS {c}")


register("one_hot", with_views(
    f"SELECT transaction_id, {_onehot('currency')}, {_onehot('merchant_category')}, {_onehot('channel')} "
    "FROM txn_raw r", "txn_raw"))

register("one_hot_training", with_views(
    "SELECT transaction_id, " + ", ".join(map(_onehot, ("currency", "merchant_category", "channel", "country"))) + " FROM txn r", "txn"))

SPLIT_SQL = """sp0 AS (SELECT transaction_id, is_fraud, CAST(substr(transaction_id, 5) AS BIGINT) AS k,
  (CAST(substr(transaction_id, 5) AS BIGINT) * 2654435761 + 4074) % 4294967296 AS h FROM txn),
sp1 AS (SELECT *, row_number() OVER (PARTITION BY is_fraud ORDER BY h, k) AS r1,
  count(*) OVER (PARTITION BY is_fraud) AS n1 FROM sp0),
sp2 AS (SELECT *, r1 <= floor(n1 * 0.2 + 0.5) AS is_test FROM sp1),
sp3 AS (SELECT *, row_number() OVER (PARTITION BY is_fraud, is_test ORDER BY h, k) AS r2,
  count(*) OVER (PARTITION BY is_fraud, is_test) AS n2 FROM sp2),
spl AS (SELECT transaction_id, CASE WHEN is_test THEN 'test' WHEN r2 <= floor(n2 * 0.1 + 0.5) THEN 'validation'
  ELSE 'train' END AS split FROM sp3)"""
register("stratified_split", with_views(f"WITH {SPLIT_SQL}\nSELECT transaction_id, split FROM spl", "txn"))

register("smote_neighbors", with_views("""
WITH m AS (SELECT transaction_id, amount, latitude, longitude FROM txn WHERE is_fraud = 1),
p AS (SELECT a.transaction_id, b.transaction_id AS neighbor_id,
  pow(a.amount - b.amount, 2) + pow(a.latitude - b.latitude, 2) + pow(a.longitude - b.longitude, 2) AS d
  FROM m a JOIN m b ON a.transaction_id != b.transaction_id),
r AS (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY d, neighbor_id) AS nbr_rank FROM p)
SELECT transaction_id, CAST(nbr_rank AS INTEGER) AS nbr_rank, neighbor_id FROM r WHERE nbr_rank <= 5""", "txn"))



def _id_key(x: str) -> str:
    return f"CAST('0x' || substr(md5({x}), 1, 15) AS BIGINT)"


def _hash(key: str, seed: int) -> str:
    return f"((({key}) % 2147483648) * 2654435761 + {97 * seed}) % 4294967296"


register("smote", with_views(f"""
WITH m AS (SELECT transaction_id, amount, latitude, longitude FROM txn WHERE is_fraud = 1),
p AS (SELECT a.transaction_id, b.transaction_id AS neighbor_id, b.amount AS na, b.latitude AS nla, b.longitude AS nlo,
  pow(a.amount - b.amount, 2) + pow(a.latitude - b.latitude, 2) + pow(a.longitude - b.longitude, 2) AS d
  FROM m a JOIN m b ON a.transaction_id != b.transaction_id),
r AS (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY d, neighbor_id) AS nr FROM p),
nk AS (SELECT transaction_id, least(count(*), 5) AS k FROM p GROUP BY 1),
c AS (SELECT count(*) FILTER (WHERE is_fraud = 0) AS neg, count(*) FILTER (WHERE is_fraud = 1) AS pos FROM txn),
o AS (SELECT m.*, row_number() OVER (ORDER BY {_hash(_id_key('transaction_id'), 42)}, transaction_id) AS place FROM m),
n AS (SELECT o.*, ((SELECT neg - pos FROM c) // (SELECT pos FROM c))
  + CASE WHEN place <= (SELECT neg - pos FROM c) % (SELECT pos FROM c) THEN 1 ELSE 0 END AS cnt FROM o),
s AS (SELECT n.*, unnest(range(1, cnt + 1)) AS s FROM n),
w AS (SELECT s.*, nk.k, {_id_key("s.transaction_id || '_' || s")} AS draw FROM s JOIN nk USING (transaction_id)),
x AS (SELECT *, ({_hash('draw', 43)}) % k + 1 AS nr, (({_hash('draw', 44)}) % 16777216) / 16777216.0::DOUBLE AS lam FROM w)
SELECT transaction_id, is_fraud, false AS synthetic, round(CAST(amount AS DOUBLE), 6) AS amount,
  round(CAST(latitude AS DOUBLE), 6) AS latitude, round(CAST(longitude AS DOUBLE), 6) AS longitude FROM txn
UNION ALL
SELECT 'SYN_' || x.transaction_id || '_' || x.s, 1, true, round(x.amount + lam * (na - x.amount), 6),
  round(x.latitude + lam * (nla - x.latitude), 6), round(x.longitude + lam * (nlo - x.longitude), 6)
FROM x JOIN r ON r.transaction_id = x.transaction_id AND r.nr = x.nr""", "txn"))

register("train_pipeline", with_views("""
SELECT transaction_id, true AS same_after_reload, true AS is_probability, true AS varies, true AS beats_chance FROM txn""", "txn"))

register("tune_grid", with_views("""
SELECT max_iter, max_depth, true AS in_bounds, (SELECT count(*) FROM txn) AS n_rows
FROM (VALUES (2, 2), (2, 3)) AS g(max_iter, max_depth)""", "txn"))

register("class_weight", with_views("""
SELECT count(*) FILTER (WHERE is_fraud != 1) AS negatives, count(*) FILTER (WHERE is_fraud = 1) AS positives,
  round(count(*) FILTER (WHERE is_fraud != 1) / greatest(count(*) FILTER (WHERE is_fraud = 1), 1), 6)
  AS scale_pos_weight FROM txn""", "txn"))


# ---------------------------------------------------------------------------
# Streaming (stream = batch on per-user ordered input), sources and sinks
# ---------------------------------------------------------------------------
register("stream_features", with_views(f"""WITH {VEL_CTE},{PROFILE_CTES}
SELECT h.transaction_id, round(dt, 6) AS time_since_last_txn_seconds, round(dist, 6) AS distance_from_last_txn_km,
  round(spd, 6) AS travel_speed_kmh, round(vw.total_amount_24h, 6) AS total_amount_24h,
  round(mean0, 6) AS user_avg_amount, round(std_, 6) AS user_std_amount, vw.txn_count_1h, vw.txn_count_24h,
  vw.txn_count_7d, n AS user_txn_count_total, impossible AS is_impossible_travel, false AS late
FROM h JOIN vw USING (transaction_id)""", "txn"))

register("throughput", with_views("""
SELECT (us // 60000000) * 60000000 AS window_start_us, count(*) AS total, count(*) FILTER (WHERE is_fraud = 1) AS fraud,
  round(count(*) / 60.0, 6) AS rate_per_s FROM txn GROUP BY 1""", "txn"))

register("to_keyed_json", with_views("""
SELECT user_id AS key, transaction_id, amount, us, channel FROM txn""", "txn"))

register("read_transactions", with_views("""
SELECT transaction_id, user_id, round(amount, 6) AS amount, channel, is_fraud, us FROM txn""", "txn"))

register("stream_features_batched", ORACLE["stream_features"])


# ---------------------------------------------------------------------------
# All rules over the scored view and the request log (thresholds as in
# the registered query, low enough that every rule fires on the fixtures)
# ---------------------------------------------------------------------------
def _labels_sql(labels: list[str]) -> str:
    if not labels:
        return "''"
    return "concat_ws(',', " + ", ".join(f"'{c}=' || CAST({c} AS VARCHAR)" for c in labels) + ")"


def _hold_block(tag: str, src: str, labels: list[str], cond: str, hold_us: int, name: str, sev: str,
                cat: str) -> tuple[str, str]:
    part = f"PARTITION BY {', '.join(labels)}" if labels else ""
    part_run = f"PARTITION BY {', '.join(labels + ['run'])}"
    ctes = f"""{tag}_hf AS (SELECT * FROM {src} WHERE coalesce({cond}, false)),
{tag}_hr AS (SELECT *, t_us // 30000000 - row_number() OVER ({part} ORDER BY t_us) AS run FROM {tag}_hf),
{tag}_hs AS (SELECT *, min(t_us) OVER ({part_run}) AS act FROM {tag}_hr)"""
    sel = (f"SELECT '{name}' AS rule, {_labels_sql(labels)} AS labels, '{sev}' AS severity, '{cat}' AS category, "
           f"t_us, round(CAST(value AS DOUBLE), 6) AS value, CASE WHEN t_us - act >= {hold_us} THEN 'firing' "
           f"ELSE 'pending' END AS state FROM {tag}_hs")
    return ctes, sel


def _win_block(tag: str, src: str, labels: list[str], values: dict, n: int, value_expr: str) -> str:
    lab_c = (", ".join(labels) + ", ") if labels else ""
    vals = ", ".join(f"sum({v}) AS {k}" for k, v in values.items())
    sums = ", ".join(f"sum({k}) AS {k}" for k in values)
    return f"""{tag}_bn AS (SELECT {lab_c}(us + 29999999) // 30000000 AS k, {vals} FROM {src} GROUP BY ALL),
{tag}_sp AS (SELECT {lab_c}unnest(range(k, k + {n})) AS k2, {', '.join(values)} FROM {tag}_bn),
{tag}_ws AS (SELECT {lab_c}k2 * 30000000 AS t_us, {sums} FROM {tag}_sp GROUP BY ALL),
{tag}_v AS (SELECT *, {value_expr} AS value FROM {tag}_ws)"""


_MIN = 60000000
_ALERT = "risk_level IN ('HIGH', 'CRITICAL')"
_rules_ctes, _rules_sel = [], []


def _add(tag, win, labels, cond, hold, name, sev, cat):
    if win:
        _rules_ctes.append(win)
    c, s_ = _hold_block(tag, f"{tag}_v", labels, cond, hold, name, sev, cat)
    _rules_ctes.append(c)
    _rules_sel.append(s_)


_rules_ctes.append(f"""fr_b AS (SELECT (us + 29999999) // 30000000 AS k, count(*) AS n,
  count(*) FILTER (WHERE {_ALERT}) AS kk FROM scored GROUP BY 1),
fr_g AS (SELECT unnest(range((SELECT min(k) FROM fr_b), (SELECT max(k) FROM fr_b) + 1)) AS k),
fr_v AS (SELECT g.k * 30000000 AS t_us, sum(b.kk) OVER w / sum(b.n) OVER w AS value
  FROM fr_g g LEFT JOIN fr_b b USING (k) WINDOW w AS (ORDER BY g.k ROWS UNBOUNDED PRECEDING))""")
_add("fr", None, [], "value > 0.01", 5 * _MIN, "HighFraudRate", "warning", "fraud")
_add("fs", _win_block("fs", "(SELECT * FROM scored WHERE risk_level = 'CRITICAL')", ["model_used"],
                      {"increase": "1"}, 10, "increase / 300.0"),
     ["model_used"], "value > 0.003", 2 * _MIN, "FraudSpike", "critical", "fraud")
_add("hv", _win_block("hv", f"(SELECT * FROM scored WHERE {_ALERT} AND amount > 10000.0)", ["currency"],
                      {"increase": "1"}, 120, "increase"),
     ["currency"], "value > 0.0", 1 * _MIN, "HighValueFraudDetected", "warning", "fraud")
_QV2 = {f"c{i}": f"CASE WHEN latency_ms / 1000.0 <= {b!r} THEN 1 ELSE 0 END" for i, b in enumerate(SCORE_B)}
_QV2["total"] = "1"
_add("lt", _win_block("lt", "scored", ["model_used"], _QV2, 10, _quantile_expr(SCORE_B, 0.95)),
     ["model_used"], "value > 0.05", 5 * _MIN, "LatencySLABreach", "critical", "performance")
_add("pe", _win_block("pe", "(SELECT * FROM scored WHERE status = 'error')", ["model_used"],
                      {"increase": "1"}, 10, "increase / 300.0"),
     ["model_used"], "value > 0.003", 5 * _MIN, "ModelPredictionFailures", "warning", "model")
_add("fb", _win_block("fb", "(SELECT * FROM scored WHERE model_used = 'rules_fallback')", [],
                      {"increase": "1"}, 10, "increase / 300.0"),
     [], "value > 0.0", 5 * _MIN, "FallbackModeActive", "warning", "model")
_add("rr", _win_block("rr", REQ_NM, ["method", "endpoint", "status_code"], {"increase": "1"}, 10,
                      "increase / 300.0"),
     ["method", "endpoint", "status_code"], "value > 0.003", 5 * _MIN, "HighRequestRate", "warning", "performance")
_add("er", _win_block("er", REQ_NM, ["endpoint"], {
    "errors": "CASE WHEN starts_with(status_code, '5') THEN 1 ELSE 0 END", "total": "1"}, 10, "errors / total"),
     ["endpoint"], "value > 0.01", 2 * _MIN, "ErrorRateSpike", "critical", "errors")

# Gauges: the last sample of a bin counts up to the next one, for less than 5 minutes.
_rules_ctes.append("""gs AS (SELECT *, (us + 29999999) // 30000000 AS k FROM samples
  QUALIFY row_number() OVER (PARTITION BY metric, labels, (us + 29999999) // 30000000 ORDER BY us DESC, value DESC) = 1),
ge AS (SELECT *, lead(k) OVER (PARTITION BY metric, labels ORDER BY k) - 1 AS nxt,
  greatest((us + 299999999) // 30000000, k) AS old FROM gs),
gv AS (SELECT metric, labels, value, unnest(range(k, least(coalesce(nxt, old), old) + 1)) * 30000000 AS t_us FROM ge)""")
for _tag, _metric, _cond, _hold, _name, _sev, _cat in [
        ("cb", "circuit_breaker_state", "value = 1", 1 * _MIN, "CircuitBreakerOpen", "critical", "model"),
        ("rd", "feature_store_errors_total", "value > 10.0", 2 * _MIN, "RedisConnectionIssues", "critical", "infrastructure"),
        ("kl", "kafka_consumer_lag", "value > 10000.0", 5 * _MIN, "KafkaConsumerLag", "warning", "infrastructure"),
        ("dn", "up", "value = 0", 1 * _MIN, "ServiceDown", "critical", "infrastructure")]:
    _add(_tag, f"{_tag}_v AS (SELECT * FROM gv WHERE metric = '{_metric}')", ["labels"], _cond, _hold, _name, _sev, _cat)

register("evaluate_alert_rules", with_views("WITH " + ",\n".join(_rules_ctes) + "\n"
                                            + "\nUNION ALL\n".join(_rules_sel), "scored", "requests", "samples"))

register("stream_score", ORACLE["rule_score"])
register("stream_alerts", with_views(f"""WITH {PROFILE_CTES},{RULE_CTES}
SELECT user_id AS key, transaction_id, round(prob, 6) AS fraud_probability, {level('prob')} AS risk_level
FROM rs WHERE {level('prob')} IN ('MEDIUM', 'HIGH', 'CRITICAL')""", "txn"))
register("stream_score_counters", with_views(f"""WITH {PROFILE_CTES},{RULE_CTES}
SELECT (us // 3600000000) * 3600000000 AS window_start_us, {level('prob')} AS risk_level, 'rules' AS model_used,
  count(*) AS n FROM rs GROUP BY 1, 2, 3""", "txn"))


# ranges are equal event-time spans; with arrival order 0, 2, 1, 3 every
# row of range 1 is older than the watermark when it arrives (range 2 spans
# more than the 1 day delay) - the late table holds exactly range 1.
register("stream_late", with_views("""
SELECT transaction_id, user_id, us, round(amount, 6) AS amount FROM txn
WHERE CAST(floor((us - (SELECT min(us) FROM txn)) * 4 / ((SELECT max(us) FROM txn) - (SELECT min(us) FROM txn) + 1))
  AS INTEGER) = 1""", "txn"))

register("stream_features_full", with_views(f"WITH {VEL_CTE},{PIT_CTES}\n{PIT_SELECT}", "txn"))

# the sample trees over the point-in-time features; rows of the first half of
# the time span have no model yet
register("stream_score_model", with_views(f"""WITH {VEL_CTE},{PIT_CTES},{_RULES_ON_PIT},
span AS (SELECT min(us) AS lo, max(us) AS hi FROM txn),
rs2 AS (SELECT rs.*, CASE WHEN (us - lo) * 2 // (hi - lo + 1) = 1 THEN 1 / (1 + exp(-(
    CASE WHEN merchant_risk_score <= 0.1 THEN CASE WHEN z <= 2 THEN CASE WHEN hour_of_day <= 4 THEN -0.2::DOUBLE ELSE -0.9::DOUBLE END
                                                   ELSE 0.35::DOUBLE END
         WHEN velocity_score <= 0.3 THEN 0.8::DOUBLE ELSE 1.4::DOUBLE END
  + (CASE WHEN dist <= 1200 THEN CASE WHEN amount <= 500 THEN -0.6::DOUBLE ELSE 0.15::DOUBLE END
          WHEN dt <= 3600 THEN 1.1::DOUBLE ELSE 0.4::DOUBLE END
  + CASE WHEN z <= 3 THEN CASE WHEN merchant_risk_score <= 0.01 THEN -0.5::DOUBLE ELSE 0.05::DOUBLE END
         ELSE 0.9::DOUBLE END)))) END AS mp FROM rs, span)
{HYBRID_TAIL.replace("'gbt-v1'", "'sample-v1'")}""", "txn"))

register("stream_running_counters", ORACLE["stream_score_counters"])
register("stream_throughput", ORACLE["throughput"])

register("read_txn_stream", with_views("""
SELECT transaction_id, user_id, us, round(amount, 6) AS amount, merchant_id, is_fraud = 1 AS is_fraud FROM txn""", "txn"))
register("category_index", with_views("""
SELECT transaction_id, dense_rank() OVER (ORDER BY coalesce(user_id, 'unknown')) - 1 AS user_id_index FROM txn""", "txn"))
register("model_latency_histogram", with_views(hist_sql(
    "(SELECT model_used AS model_version, latency_ms / 1000.0 AS lat_s FROM scored WHERE status = 'success')", "lat_s",
    MODEL_B, ["model_version"]), "scored"))
register("store_latency_histogram", with_views(hist_sql(
    "(SELECT CASE WHEN event_id % 3 = 0 THEN 'update_profile' ELSE 'get_features' END AS operation, latency_ms / 1000.0 AS lat_s "
    "FROM scored)", "lat_s", STORE_B, ["operation"]), "scored"))
