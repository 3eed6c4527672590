"""DuckDB SQL for the registered queries, over the same tables."""

from __future__ import annotations

import math

# Nothing of the library is imported: what both must agree on is stated here once more, so that a slip in either shows.

#: Days from the first one at which the held-out window and monitoring begin, length of the reference window, and the defects' hub and day.
SPLIT, MONITOR_FROM, REFERENCE = 20, 26, 10
TOLERANCE = 20.0
HUB, DAY = "error", "2024-01-10"
#: The law of Poisson weights of mean 1, up to 7.
LADDER = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(7)]
#: Checks of a daily run on the derived feed: name, family, operator, bounds, reason.
DAILY_CHECKS = [
    ("quarantine_rate", "data_quality", "<=", 0.2, 0.2, "rows fail the contract"),
    ("hour_count_days_wrong", "data_quality", "<=", 3.0, 3.0, "a hub-day has other hours than the calendar"),
    ("duplicate_conflicts", "integrity", "==", 0.0, 0.0, "two copies of a row disagree"),
    ("reconcile_share_off", "reconciliation", "<", 0.06, 0.06, "too many hours differ between the two hourly copies"),
    ("reconcile_mean_abs", "reconciliation", "within", 2.0, 7.0, "the two hourly copies lie apart on average"),
    ("band_coverage", "calibration", "within", 0.85, 0.95, "the band does not hold the share it promises"),
]
#: The model checks of a release.
MODEL_CHECKS = [
    ("overall_improvement", "accuracy", "<", 0.0, 0.0, "the challenger is not better by more than noise"),
    ("peak_no_regression", "regression", "<=", 0.0, 0.0, "the challenger is worse at the peak"),
    ("hub_no_regression", "bias", "<=", 0.0, 0.0, "the challenger is worse at a hub"),
    ("band_coverage", "calibration", "within", 0.85, 0.95, "the band does not hold the share it promises"),
    ("psi_max", "drift", "<=", 0.25, 0.25, "an input has moved"),
]
#: The data checks of a release.
RELEASE_CHECKS = [("quarantine_rate", "data_quality", "<=", 0.02, 0.02, ""), ("hour_count_days_wrong", "data_quality", "==", 0.0, 0.0, ""), ("duplicate_conflicts", "integrity", "==", 0.0, 0.0, ""), ("reconcile_share_off", "reconciliation", "<=", 0.02, 0.02, ""), ("reconcile_mean_abs", "reconciliation", "<=", 0.5, 0.5, "")]
#: The published wording and order.
UPSTREAM = ["data_quality", "integrity", "reconciliation", "drift", "accuracy", "regression", "bias", "calibration"]
THRESHOLD_PHRASES = ["raise the threshold", "lower the threshold", "change the threshold", "loosen", "relax the", "tighten the", "new threshold", "adjust the threshold"]
DECISION_PHRASES = ["should ship", "can ship", "safe to ship", "may ship", "promote the", "approve the", "override", "ignore the", "waive", "bypass", "release it", "release the candidate", "ship it"]
ZONE = "America/New_York"
TYPES = ["click", "error", "purchase", "signup", "view"]
FIRST = "DATE '2024-01-01'"


def fx(e: str, digits: int = 6) -> str:
    return f"floor(({e}) * 1e{digits} + 0.49987) / 1e{digits}"


def cents(e: str) -> str:
    return f"printf('%.2f', {fx(e, 9)})::DOUBLE"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def epoch(day: str) -> str:
    return f"epoch(timezone('{ZONE}', ({day})::TIMESTAMP))"


def hours(day: str) -> str:
    return f"((epoch(timezone('{ZONE}', ({day} + 1)::TIMESTAMP)) - {epoch(day)}) / 3600)::INT"


#: Days of orders and their hours.
DAYS = "days AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders)"
DAYS_N = f"dn AS (SELECT day, {hours('day')} AS n, timezone('UTC', timezone('{ZONE}', day::TIMESTAMP)) AS midnight FROM days)"
POS = "ph AS (SELECT day, n, midnight, unnest(range(1, n + 1))::INT AS position FROM dn)"
CLOCK = "pc AS (SELECT *, CASE WHEN n = 25 AND position >= 3 THEN position - 1 WHEN n = 23 AND position >= 2 THEN position + 1 ELSE position END AS clock FROM ph)"
CAL = (DAYS, DAYS_N, POS, CLOCK)

O: dict[str, str] = {}
O["calendar_hours"] = with_(DAYS, DAYS_N) + "SELECT day, midnight AS midnight_utc, n AS hours, n * 12 AS intervals FROM dn"
O["utc_round_trip"] = with_(DAYS, DAYS_N, POS) + "SELECT day, position, midnight + to_hours(position) AS utc, day AS back_day, position AS back FROM ph"
O["hour_labels"] = with_(*CAL) + "SELECT day, position, lpad(clock::VARCHAR, 2, '0') || CASE WHEN n = 25 AND position = 3 THEN '*' ELSE '' END AS label, clock FROM pc"
BLOCK = "CASE WHEN clock BETWEEN 12 AND 19 THEN 'peak' WHEN clock BETWEEN 8 AND 11 OR clock BETWEEN 20 AND 22 THEN 'shoulder' ELSE 'off_peak' END"
O["hour_blocks"] = with_(*CAL) + f"SELECT {BLOCK} AS block, count(*) AS n, count(DISTINCT clock) AS clocks FROM pc GROUP BY 1"
NUMBERED = """
numbered AS (SELECT *, CASE WHEN n = 23 THEN clock - (clock >= 3)::INT
    WHEN n = 25 THEN CASE WHEN clock >= 3 THEN clock + 1 WHEN clock = 2 AND CASE WHEN max(restart) OVER (PARTITION BY day, clock) = 1
      THEN max(restart) OVER (PARTITION BY day, clock ORDER BY seq) = 1 ELSE row_number() OVER (PARTITION BY day, clock ORDER BY seq) >= 2 END THEN 3 ELSE clock END
    ELSE clock END AS hour
  FROM (SELECT *, coalesce(minute <= lag(minute) OVER (PARTITION BY day, clock ORDER BY seq), FALSE)::INT AS restart FROM stamps))"""
O["positions_hourly"] = with_(*CAL, "stamps AS (SELECT *, 0 AS minute, position * 100 AS seq FROM pc)", NUMBERED) + "SELECT day, day::TIMESTAMP + to_hours(clock - 1) AS stamp, position, hour FROM numbered"
O["positions_interval"] = with_(*CAL, "stamps AS (SELECT *, position * 100 + minute AS seq FROM (SELECT *, unnest(range(5, 65, 5))::INT AS minute FROM pc))", NUMBERED) + "SELECT day, clock, minute, position, hour FROM numbered"

# feeds; no day of the events changes its clock
IV = """iv AS (SELECT event_type AS zone, ts::DATE AS day, value AS lbmp, event_id AS seq, round_even((epoch_us(ts) - epoch_us(ts::DATE::TIMESTAMP)) / 6e7, 0)::INT AS minutes FROM events)"""
IW = """iw AS (SELECT *, minutes - lag(minutes, 1, 0) OVER (PARTITION BY zone, day ORDER BY seq) AS length FROM iv)"""
RT = """rt AS (SELECT zone, day, greatest(ceil(minutes / 60.0)::INT, 1) AS hour, coalesce(sum((CASE WHEN length <= 0 THEN 5 ELSE length END) * lbmp), 0) / sum(CASE WHEN length <= 0 THEN 5 ELSE length END) AS price_rt, count(*) AS intervals FROM iw GROUP BY ALL)"""
CELLS = """cells AS (SELECT event_type AS zone, ts::DATE AS day, hour(ts)::INT + 1 AS hour, avg((props::JSON->>'k')::DOUBLE) AS k, avg(value) AS v, avg(user_id) AS u FROM events GROUP BY ALL)"""
PUB = f"""pub AS (SELECT zone AS hub, day, hour, {cents('k')} AS price_da, {cents('price_rt')} AS price_rt, 'USD/MWh' AS unit, 'preliminary' AS status, (day - DATE '1970-01-01') * 100 + hour AS seq FROM cells LEFT JOIN rt USING (zone, day, hour))"""
VER = f"""ver AS (SELECT zone AS hub, day, hour, {cents('k')} AS price_da, {cents('v')} AS price_rt, 'USD/MWh' AS unit, 'verified' AS status FROM cells)"""
REV = """rev AS (SELECT hub, day, hour, price_da, CASE WHEN hour % 5 = 0 THEN NULL ELSE price_rt END AS price_rt, status FROM ver
  UNION ALL SELECT hub, (day + INTERVAL 72 MONTH)::DATE, hour, price_da, price_rt, status FROM ver WHERE hour = 1)"""
FIN = """fin AS (SELECT p.hub, p.day, p.hour, CASE WHEN r.hub IS NOT NULL THEN r.price_da ELSE p.price_da END AS price_da, CASE WHEN r.hub IS NOT NULL THEN r.price_rt ELSE p.price_rt END AS price_rt,
  p.unit, CASE WHEN r.hub IS NOT NULL THEN r.status ELSE p.status END AS status, p.seq FROM pub p LEFT JOIN rev r ON p.hub = r.hub AND p.day = r.day AND p.hour = r.hour)"""
FEED = (IV, IW, RT, CELLS, PUB)
FINAL = (*FEED, VER, REV, FIN)
O["interval_integration"] = with_(IV, IW, RT) + f"SELECT zone, day, hour, {fx('price_rt')} AS price_rt, intervals FROM rt WHERE zone <> 'signup'"
O["forecast_vintage"] = with_(CELLS) + f"SELECT upper(zone) AS hub, day, hour, {fx('u')} AS load_forecast_mw FROM cells"
O["published_rows"] = with_(*FEED) + "SELECT * FROM pub"
O["verified_rows"] = with_(CELLS, VER) + "SELECT * FROM ver"
O["feed_extent"] = "SELECT min(ts::DATE) AS first_day, max(ts::DATE) AS last_day FROM events"
O["table_manifest"] = "\nUNION ALL ".join(f"SELECT '{t}' AS name, (SELECT count(*) FROM {t}) AS rows, (SELECT string_agg(column_name, ',' ORDER BY ord) FROM (SELECT column_name, row_number() OVER () AS ord FROM (DESCRIBE {t}))) AS columns" for t in ("events", "orders", "lineitem"))
O["manifest_changes"] = f"SELECT DISTINCT ts::DATE AS day, CASE WHEN ts::DATE = {FIRST} THEN 'missing' ELSE 'changed' END AS change FROM events WHERE ts::DATE IN ({FIRST}, {FIRST} + 9)"

# contract
ROWS = """rows AS (SELECT event_id, CASE WHEN event_id % 71 <> 0 THEN event_type END AS hub, CASE WHEN event_id % 73 <> 0 THEN ts::DATE END AS day, (hour(ts) + event_id % 3)::DOUBLE AS hour,
  CASE WHEN event_id % 79 <> 0 THEN (props::JSON->>'k')::DOUBLE END AS price_da, CASE WHEN event_id % 5 <> 0 THEN value END AS price_rt,
  CASE WHEN event_id % 97 = 0 THEN 'USD/kWh' WHEN event_id % 97 <> 1 THEN 'USD/MWh' END AS unit,
  CASE WHEN event_id % 89 = 0 THEN 'draft' WHEN event_id % 2 = 0 THEN 'preliminary' ELSE 'verified' END AS status FROM events)"""


def reason(hubs: list[str] | None = None, high: str = "300", inserts: dict[str, str] | None = None) -> str:
    """The contract's CASE over typed columns; ``inserts`` are conditions ahead of a field's own."""
    listed = ", ".join(f"'{h}'" for h in hubs or ["click", "error", "purchase", "view"])
    x = {k: "" for k in ("hub", "day", "hour", "price_da", "price_rt", "unit", "status", "end")} | (inserts or {})
    return f"""CASE {x['hub']} WHEN hub IS NULL THEN 'bad_type' {x['day']} WHEN day IS NULL THEN 'bad_type'
    {x['hour']} WHEN hour IS NULL THEN 'bad_type' WHEN hour < 1 THEN 'hour_before_day' WHEN hour > 25 OR hour <> floor(hour) THEN 'hour_beyond_day'
    {x['price_da']} WHEN price_da IS NULL THEN 'bad_type' WHEN price_da < -500 OR price_da > {high} THEN 'price_out_of_range'
    {x['price_rt']} WHEN price_rt < -500 OR price_rt > {high} THEN 'price_out_of_range'
    {x['unit']} WHEN unit IS DISTINCT FROM 'USD/MWh' THEN 'unit_not_usd_mwh' {x['status']} WHEN coalesce(status NOT IN ('preliminary', 'verified'), TRUE) THEN 'unknown_status'
    {x['end']} WHEN hour > {hours('day')} THEN 'hour_beyond_day' WHEN hub NOT IN ({listed}) THEN 'unknown_hub' END"""


MARKED = f"marked AS (SELECT *, {reason()} AS reason FROM rows)"
O["contract_reasons"] = with_(ROWS, MARKED) + "SELECT event_id, reason FROM marked"
O["contract_accepted"] = with_(ROWS, MARKED) + "SELECT * EXCLUDE (reason) FROM marked WHERE reason IS NULL"
O["reason_counts"] = with_(ROWS, MARKED) + "SELECT reason, count(*) AS n FROM marked WHERE reason IS NOT NULL GROUP BY 1"
O["quarantine_rate"] = with_(ROWS, MARKED) + f"SELECT count(*) AS published, count(reason) AS quarantined, {fx('count(reason) / greatest(count(*), 1)')} AS rate FROM marked"
FORMS = """forms AS (SELECT *, event_id % 83 AS m FROM rows)"""
PAYLOAD = "pay AS (SELECT *, " + reason(inserts={
    "hub": "WHEN m IN (12, 13) THEN 'bad_type'",
    "day": "WHEN hub IS NOT NULL AND day IS NOT NULL AND m = 3 THEN 'date_from_datetime_inexact' WHEN hub IS NOT NULL AND m = 11 THEN 'date_from_datetime_inexact' WHEN m IN (10, 16, 24) THEN 'bad_type'",
    "hour": "WHEN m = 2 THEN 'missing_field' WHEN m = 5 THEN 'hour_beyond_day' WHEN m IN (6, 19, 25) THEN 'bad_type'",
    "price_da": "WHEN m = 7 THEN 'price_out_of_range' WHEN m = 20 THEN 'bad_type'",
    "price_rt": "WHEN m IN (8, 23) THEN 'bad_type'",
    "unit": "WHEN m = 0 THEN 'missing_field'",
    "end": "WHEN m = 9 THEN 'unexpected_field'",
}) + """ AS reason FROM (SELECT * REPLACE (CASE WHEN m = 1 THEN NULL ELSE price_rt END AS price_rt, CASE WHEN m = 14 THEN DATE '2024-01-01' ELSE day END AS day,
  CASE WHEN m = 17 THEN 1 ELSE hour END AS hour, CASE WHEN m = 22 THEN 1 ELSE price_da END AS price_da) FROM forms))"""  # fmt: skip
O["contract_payload"] = with_(ROWS, FORMS, PAYLOAD) + "SELECT event_id, reason FROM pay"
O["payload_accepted"] = with_(ROWS, FORMS, PAYLOAD) + "SELECT event_id, hub, day, hour::INT AS hour, price_da, price_rt, unit, status FROM pay WHERE reason IS NULL"

# reconciliation
DUP = """dup AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate, l_partkey, l_suppkey, 0 AS copy FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate, l_partkey, l_suppkey, 1 FROM lineitem WHERE l_orderkey % 10 = 0)"""
EXACT = """firsts AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_quantity, l_extendedprice ORDER BY copy, l_shipdate, l_partkey, l_suppkey) AS r,
    count(*) OVER (PARTITION BY l_orderkey, l_linenumber, l_quantity, l_extendedprice) AS copies FROM dup),
exact AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY copy, l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS place, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS key_rows FROM firsts WHERE r = 1)"""
O["dedup_clean"] = with_(DUP, EXACT) + "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM exact WHERE place = 1"
O["dedup_conflicts"] = with_(DUP, EXACT) + "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, copies FROM exact WHERE key_rows > 1"
O["dedup_counts"] = with_(DUP, EXACT) + "SELECT sum(copies)::BIGINT AS rows, (sum(copies) - count(*))::BIGINT AS retries, count(*) FILTER (key_rows > 1 AND place = 1) AS conflicting_keys FROM exact"


def counts(rows: str, hubs: list[str]) -> str:
    listed = ", ".join(f"'{h}'" for h in hubs)
    return f"""span AS (SELECT min(day) AS a, max(day) AS b FROM {rows}),
grid AS (SELECT unnest(range(a, b + INTERVAL 1 DAY, INTERVAL 1 DAY))::DATE AS day FROM span),
counts AS (SELECT hub, day, coalesce(seen, 0) AS hours_seen, {hours('day')} AS hours_expected FROM grid CROSS JOIN (SELECT unnest([{listed}]) AS hub) LEFT JOIN (SELECT hub, day, count(*) AS seen FROM {rows} GROUP BY ALL) USING (hub, day))"""


O["interval_counts"] = with_(*FEED, counts("pub", [*TYPES, "refund"])) + "SELECT *, hours_seen = hours_expected AS ok FROM counts"
O["wrong_days"] = with_(*FEED, counts("pub", TYPES)) + "SELECT hub, count(*) AS days, sum(hours_seen)::BIGINT AS hours_seen FROM counts WHERE hours_seen <> hours_expected GROUP BY hub"
O["revised_rows"] = with_(*FINAL) + "SELECT * FROM fin"
O["ghost_revisions"] = with_(CELLS, VER) + "SELECT hub, (day + INTERVAL 72 MONTH)::DATE AS day, hour FROM ver WHERE hour = 1"


def gap(a: str, b: str, by: str = "hub", rollup: bool = True) -> str:
    return f"""SELECT {by}, {fx(f'avg((abs(b - a) > {TOLERANCE})::INT)')} AS share_off, {fx('avg(abs(b - a))')} AS mean_abs, count(*) AS n
FROM (SELECT x.*, x.price_rt AS a, y.price_rt AS b FROM {a} x JOIN {b} y USING (hub, day, hour)) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY {f'ROLLUP ({by})' if rollup else by}"""


O["revision_gap"] = with_(*FINAL) + gap("pub", "fin")
O["hourly_copies"] = with_(*FEED, VER) + gap("pub", "ver")

# features
SPREAD = "spread AS (SELECT hub, day, avg(price_rt - price_da) AS s FROM {rows} WHERE price_rt IS NOT NULL {more} GROUP BY ALL)"
LAGS = """lags AS (SELECT hub, day, max(s) OVER (PARTITION BY hub ORDER BY day - DATE '1970-01-01' RANGE BETWEEN 2 PRECEDING AND 2 PRECEDING) AS lag2_spread,
  avg(s) OVER (PARTITION BY hub ORDER BY day - DATE '1970-01-01' RANGE BETWEEN 8 PRECEDING AND 2 PRECEDING) AS roll7_spread
  FROM (SELECT DISTINCT hub, day FROM (SELECT hub, day FROM spread UNION ALL SELECT hub, day FROM {want})) LEFT JOIN spread USING (hub, day))"""


def feature_sql(source: str = "pub") -> tuple[str, ...]:
    base = f"""base AS (SELECT hub, day, hour, price_da, price_rt, price_rt - price_da AS y, u AS load_forecast_mw, hour AS clock_hour, {BLOCK.replace('clock', 'hour')} AS block, (isodow(day) < 6)::INT::DOUBLE AS weekday
  FROM fin JOIN (SELECT zone AS hub, day, hour, u FROM cells) USING (hub, day, hour) WHERE price_rt IS NOT NULL)"""
    return (*FINAL, base, SPREAD.format(rows=source, more=""), LAGS.format(want="base"), "feats AS (SELECT * FROM base JOIN lags USING (hub, day) WHERE lag2_spread IS NOT NULL AND roll7_spread IS NOT NULL AND load_forecast_mw IS NOT NULL)")


O["daily_spread"] = with_(*FEED, SPREAD.format(rows="pub", more="")) + f"SELECT hub, day, {fx('s')} AS spread FROM spread"
O["spread_lags"] = with_(*FEED, SPREAD.format(rows="pub", more=""), LAGS.format(want="pub")) + f"SELECT hub, day, {fx('lag2_spread')} AS lag2_spread, {fx('roll7_spread')} AS roll7_spread FROM lags"
FIXED = ", ".join(f"{fx(c)} AS {c}" for c in ("price_da", "price_rt", "y", "load_forecast_mw", "weekday", "lag2_spread", "roll7_spread"))
O["feature_rows"] = with_(*feature_sql()) + f"SELECT hub, day, hour, clock_hour, block, {FIXED} FROM feats"
O["feature_rows_leaked"] = with_(*feature_sql("fin")) + f"SELECT hub, day, hour, {fx('lag2_spread')} AS lag2_spread, {fx('roll7_spread')} AS roll7_spread FROM feats"
DESIGN = {"price_da": "price_da", "load_forecast_mw": "load_forecast_mw", "lag2_spread": "lag2_spread", "roll7_spread": "roll7_spread", "weekday": "weekday", "is_peak": "(block = 'peak')::INT", "is_shoulder": "(block = 'shoulder')::INT"}
DESIGN |= {f"hub_{t}": f"(hub = '{t}')::INT" for t in TYPES[1:]} | {"da_sq": "price_da * price_da", "peak_x_da": "(block = 'peak')::INT * price_da"}
O["design_rows"] = with_(*feature_sql()) + "SELECT hub, day, hour, " + ", ".join(f"{fx(e)} AS {n}" for n, e in DESIGN.items()) + " FROM feats"
O["window_split"] = with_(*feature_sql()) + f"""SELECT CASE WHEN day - {FIRST} < {SPLIT} THEN 'train' WHEN day - {FIRST} < {MONITOR_FROM} THEN 'test' ELSE 'after' END AS name,
  day - {FIRST} < {SPLIT} AND day - {FIRST} >= {SPLIT - REFERENCE} AS reference, count(*) AS n FROM feats GROUP BY ALL"""

# the ridge fits of the design: sums in one aggregate, equations solved by elimination, which needs no pivots as the penalty makes them definite
NAMES = list(DESIGN)
COV = "[" + ", ".join("[" + ", ".join(f"covar_pop(c{min(i, j)}, c{max(i, j)})" for j in range(len(NAMES))) + "]" for i in range(len(NAMES))) + "]"
SIZES = {"champion": len(NAMES) - 2, "challenger": len(NAMES)}
TRAIN = f"""tr AS (SELECT {', '.join(f'({e})::DOUBLE AS c{k}' for k, e in enumerate(DESIGN.values()))}, y FROM feats WHERE day - {FIRST} < {SPLIT}),
st AS (SELECT count(*) AS n, avg(y) AS my, [{', '.join(f'avg(c{k})' for k in range(len(NAMES)))}] AS mean, [{', '.join(f'CASE WHEN stddev_pop(c{k}) < 1e-12 * greatest(1, abs(avg(c{k}))) THEN 1 ELSE stddev_pop(c{k}) END' for k in range(len(NAMES)))}] AS sd,
  {COV} AS cov, [{', '.join(f'covar_pop(c{k}, y)' for k in range(len(NAMES)))}] AS cy FROM tr)"""


def eliminated(name: str, p: int) -> str:
    start = f"list_transform(range(1, {p + 1}), lambda i: list_append(list_transform(range(1, {p + 1}), lambda j: n * cov[i][j] / sd[i] / sd[j] + (i = j)::INT), n * cy[i] / sd[i]))"
    step = "list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda x: x / r[k]) ELSE list_transform(r, lambda x, j: x - r[k] * m[k][j] / m[k][k]) END)"
    return f"{name} AS (SELECT 1 AS k, {start} AS m FROM st UNION ALL SELECT k + 1, {step} FROM {name} WHERE k <= {p})"


def solved(name: str, p: int) -> str:
    parts = ", ".join(f"{fx(e, 4)} AS {c}" for c, e in (("mean", "mean[i]"), ("scale", "sd[i]"), ("coef", f"m[i][{p + 1}]"), ("intercept", "my")))
    return f"SELECT '{name}' AS model, {NAMES[:p]}[i] AS feature, {parts} FROM {name}, st, (SELECT unnest(range(1, {p + 1})) AS i) WHERE k = {p + 1}"


O["spread_model"] = with_(*feature_sql(), TRAIN, *[eliminated(m, p) for m, p in SIZES.items()]).replace("WITH", "WITH RECURSIVE", 1) + "\nUNION ALL ".join(solved(m, p) for m, p in SIZES.items())

# models: closed forms of one and two standardised features
PRED = """d AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS key, l_extendedprice AS y, l_quantity AS x1, p_retailprice AS x2, l_returnflag AS block, l_linestatus AS hub FROM lineitem JOIN part ON l_partkey = p_partkey)"""
FIT = """s AS (SELECT count(*) AS n, avg(x1) AS m1, stddev_pop(x1) AS s1, avg(x2) AS m2, stddev_pop(x2) AS s2, avg(y) AS my, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2, corr(x1, x2) AS r FROM d),
f AS (SELECT *, n * c1 / s1 / (n + 1) AS b0, ((n + 1) * n * c1 / s1 - n * r * n * c2 / s2) / ((n + 1) ** 2 - (n * r) ** 2) AS b1, ((n + 1) * n * c2 / s2 - n * r * n * c1 / s1) / ((n + 1) ** 2 - (n * r) ** 2) AS b2 FROM s)"""
SCORED = "sc AS (SELECT d.*, my + (x1 - m1) / s1 * b0 AS p_champion, my + (x1 - m1) / s1 * b1 + (x2 - m2) / s2 * b2 AS p_challenger, my + (x1 - m1) / s1 * b1 + (0 - m2) / s2 * b2 AS p_lost FROM d, f)"
MODEL = (PRED, FIT, SCORED)
O["ridge_fit"] = with_(PRED, FIT) + "\nUNION ALL ".join(f"SELECT '{m}' AS model, '{x}' AS feature, {fx(mean, 3)} AS mean, {fx(s, 3)} AS scale, {fx(b, 3)} AS coef, {fx('my', 3)} AS intercept FROM f" for m, x, mean, s, b in (("champion", "x1", "m1", "s1", "b0"), ("challenger", "x1", "m1", "s1", "b1"), ("challenger", "x2", "m2", "s2", "b2")))
O["ridge_score"] = with_(*MODEL) + f"SELECT key, {fx('y', 3)} AS y, {fx('p_champion', 3)} AS p_champion, {fx('p_challenger', 3)} AS p_challenger FROM sc"
O["serving_skew"] = with_(*MODEL) + f"SELECT block, {fx('avg(abs(y - p_challenger))', 3)} AS mae, {fx('avg(abs(y - p_lost))', 3)} AS mae_skewed FROM sc GROUP BY block"
BANDS = "bd AS (SELECT block, quantile_cont(y - p_challenger, 0.05) AS lo, quantile_cont(y - p_challenger, 0.95) AS hi FROM sc GROUP BY block)"
BANDED = "bn AS (SELECT sc.*, p_challenger + lo AS lo, p_challenger + hi AS hi FROM sc JOIN bd USING (block))"
O["residual_bands"] = with_(*MODEL, BANDS) + f"SELECT block, {fx('lo', 3)} AS band_lo, {fx('hi', 3)} AS band_hi FROM bd"
O["band_rows"] = with_(*MODEL, BANDS, BANDED) + f"SELECT key, {fx('y', 3)} AS y, {fx('lo', 3)} AS lo, {fx('hi', 3)} AS hi FROM bn"
O["coverage"] = with_(*MODEL, BANDS, BANDED) + f"SELECT hub, {fx('avg((y BETWEEN lo AND hi)::INT)', 3)} AS coverage FROM bn GROUP BY hub"
O["pinball"] = with_(*MODEL, BANDS, BANDED) + f"SELECT hub, {fx('(avg(greatest(0.05 * (y - lo), -0.95 * (y - lo))) + avg(greatest(0.95 * (y - hi), -0.05 * (y - hi)))) / 2', 3)} AS pinball FROM bn GROUP BY hub"
E0, E1 = "abs(y - p_champion)", "abs(y - p_challenger)"
O["segment_errors"] = with_(*MODEL) + f"""SELECT CASE WHEN block IS NULL AND hub IS NULL THEN 'overall' WHEN hub IS NULL THEN 'block' ELSE 'hub' END AS kind, coalesce(block, hub, 'overall') AS segment,
  count(*) AS n, {fx(f'avg({E0})', 3)} AS mae_champion, {fx(f'avg({E1})', 3)} AS mae_challenger, {fx(f'avg({E1} - {E0})', 3)} AS diff FROM sc GROUP BY GROUPING SETS ((), (block), (hub))"""
PSI = f"""pv AS (SELECT ts::DATE - {FIRST} AS n, value, user_id::DOUBLE AS user_id, (props::JSON->>'k')::DOUBLE * CASE WHEN ts::DATE - {FIRST} >= {SPLIT} THEN 2 ELSE 1 END AS k, 1.0::DOUBLE AS one FROM events WHERE ts::DATE - {FIRST} >= {SPLIT - REFERENCE} AND ts::DATE - {FIRST} < {MONITOR_FROM}),
long AS (SELECT n < {SPLIT} AS ref, feature, x FROM pv UNPIVOT (x FOR feature IN (value, user_id, k, one))),
cuts AS (SELECT feature, list_sort(list_distinct(quantile_cont(x, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]))) AS e FROM long WHERE ref GROUP BY feature),
bins AS (SELECT feature, unnest(range(0, len(e) - 1)) AS bin FROM cuts WHERE len(e) > 1),
dealt AS (SELECT feature, ref, len(list_filter(e[2:len(e) - 1], lambda c: c <= x)) AS bin FROM long JOIN cuts USING (feature) WHERE len(e) > 1),
shares AS (SELECT b.feature, greatest(count(*) FILTER (ref) / (SELECT greatest(count(*), 1) FROM dealt t WHERE t.feature = b.feature AND ref), 1e-4) AS r, greatest(count(*) FILTER (NOT ref) / (SELECT greatest(count(*), 1) FROM dealt t WHERE t.feature = b.feature AND NOT ref), 1e-4) AS c
  FROM bins b LEFT JOIN dealt d ON b.feature = d.feature AND b.bin = d.bin GROUP BY b.feature, b.bin),
psi AS (SELECT feature, coalesce(p, 0.0) AS psi FROM cuts LEFT JOIN (SELECT feature, sum((c - r) * ln(c / r)) AS p FROM shares GROUP BY feature) USING (feature))"""
O["psi_features"] = with_(PSI) + f"SELECT feature, {fx('psi')} AS psi FROM psi"
STEPS = " ".join(f"WHEN u < {x} THEN {k}" for k, x in enumerate(LADDER))


def boot(draws: int) -> str:
    return f"""draws AS (SELECT sc.*, {E1} - {E0} AS diff, unnest(range(0, {draws})) AS draw FROM sc),
weighed AS (SELECT *, CASE {STEPS} ELSE {len(LADDER)} END AS w FROM (SELECT *, ('0x' || substr(md5('7|' || key || '|' || draw), 1, 8))::UBIGINT / 4294967296.0 AS u FROM draws)),
parts AS (SELECT draw, block, hub, sum(w * diff) AS wd, sum(w) AS w FROM weighed GROUP BY ALL),
means AS (SELECT 'overall' AS kind, 'overall' AS segment, draw, sum(wd) / sum(w) AS m FROM parts GROUP BY ALL UNION ALL SELECT 'block', block, draw, sum(wd) / sum(w) FROM parts GROUP BY ALL UNION ALL SELECT 'hub', hub, draw, sum(wd) / sum(w) FROM parts GROUP BY ALL),
boot AS (SELECT kind, segment, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM means GROUP BY ALL)"""


O["paired_bootstrap"] = with_(*MODEL, boot(2000)) + f"SELECT kind, segment, {fx('lo', 3)} AS lo, {fx('hi', 3)} AS hi FROM boot"

# gate
DROWS = """drows AS (SELECT * FROM pub UNION ALL SELECT hub, day, hour, price_da, CASE WHEN hour = 5 THEN price_rt + 3 ELSE price_rt END, unit, status, seq + (1::BIGINT << 40) FROM pub WHERE day(day) % 7 = 3 AND hour IN (5, 6))"""


def cleaned(rows: str, by: str = "") -> str:
    key = f"{by}hub, day, hour"
    return f"""ex AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY f, price_da, price_rt, status) AS place, count(*) OVER (PARTITION BY {key}) AS key_rows
  FROM (SELECT {key}, price_da, price_rt, status, min(seq) AS f FROM {rows} WHERE reason IS NULL GROUP BY ALL)),
clean AS (SELECT * FROM ex WHERE place = 1)"""


HUBS4 = ["click", "error", "purchase", "view"]
SUMMARY = f"""mk AS (SELECT *, {reason()} AS reason FROM drows), {cleaned('mk')}, {counts('clean', HUBS4)},
rates AS (SELECT day, count(reason) / greatest(count(*), 1) AS quarantine_rate FROM mk GROUP BY day),
clash AS (SELECT day, count(*) FILTER (key_rows > 1 AND place = 1) AS duplicate_conflicts FROM ex GROUP BY day),
wrong AS (SELECT day, count(*) FILTER (hours_seen <> hours_expected) AS hour_count_days_wrong FROM counts GROUP BY day),
gaps AS ({gap('clean', 'ver', 'day', False).replace(fx(f'avg((abs(b - a) > {TOLERANCE})::INT)'), f'avg((abs(b - a) > {TOLERANCE})::INT)').replace(fx('avg(abs(b - a))'), 'avg(abs(b - a))')}),
summary AS (SELECT day::VARCHAR AS run_id, day, quarantine_rate::DOUBLE AS quarantine_rate, hour_count_days_wrong::DOUBLE AS hour_count_days_wrong, duplicate_conflicts::DOUBLE AS duplicate_conflicts, share_off AS reconcile_share_off, mean_abs AS reconcile_mean_abs
  FROM rates LEFT JOIN clash USING (day) LEFT JOIN wrong USING (day) LEFT JOIN gaps USING (day))"""
CHECKS5 = ["quarantine_rate", "hour_count_days_wrong", "duplicate_conflicts", "reconcile_share_off", "reconcile_mean_abs"]


def valued(names: list[str], source: str = "summary", digits: int = 6) -> str:
    return "vals AS (" + " UNION ALL ".join(f"SELECT run_id, '{c}' AS \"check\", {fx(c, digits)} AS value FROM {source}" for c in names) + ")"


def suite(checks) -> str:
    return "suite AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, '{c[0]}', '{c[1]}', '{c[2]}', {c[3]}::DOUBLE, {c[4]}::DOUBLE, '{c[5]}')" for k, c in enumerate(checks)) + ") t(ord, \"check\", family, op, lo, hi, why))"


JUDGED = """judged AS (SELECT run_id, ord, "check", family, value, op, lo, hi, why, v_run IS NOT NULL AS there,
    coalesce(CASE WHEN value IS NULL OR isnan(value) THEN FALSE WHEN op = '<=' THEN value <= hi WHEN op = '<' THEN value < hi WHEN op = '==' THEN value = lo WHEN op = 'within' THEN value BETWEEN lo AND hi END, FALSE) AS passed
  FROM (SELECT r.run_id, s.*, v.value, v.run_id AS v_run FROM (SELECT DISTINCT run_id FROM vals) r CROSS JOIN suite s LEFT JOIN vals v ON v.run_id = r.run_id AND v."check" = s."check")),
res AS (SELECT * EXCLUDE (why, there), CASE WHEN NOT there THEN 'no value computed' WHEN passed THEN '' ELSE why END AS reason FROM judged)"""
GATE = (*FEED, VER, DROWS, SUMMARY, valued(CHECKS5), suite(DAILY_CHECKS), JUDGED)
O["gate_values"] = with_(*GATE[:-2]) + "SELECT * FROM vals"
O["gate_results"] = with_(*GATE) + "SELECT * FROM res"
VERDICT = "SELECT run_id, count(*) FILTER (passed) AS passed, count(*) AS total, CASE WHEN bool_and(passed) THEN 0 ELSE 2 END AS exit_code FROM res GROUP BY run_id"
O["gate_by_run"] = with_(*GATE) + VERDICT
CHECK_JSON = """'{"ord":' || ord || ',"check":"' || "check" || '","family":"' || family || '"' || coalesce(',"value":' || value::VARCHAR, '') || ',"op":"' || op || '","lo":' || lo::VARCHAR || ',"hi":' || hi::VARCHAR || ',"passed":' || passed::VARCHAR || ',"reason":"' || reason || '"}'"""
O["gate_report"] = with_(*GATE) + f"""SELECT run_id, '{{"checks":[' || string_agg({CHECK_JSON}, ',' ORDER BY ord) || '],"passed":' || count(*) FILTER (passed) || ',"total":' || count(*) || ',"exit_code":' || CASE WHEN bool_and(passed) THEN 0 ELSE 2 END || '}}' AS report FROM res GROUP BY run_id"""
ONE = f"""one AS (SELECT 'candidate' AS run_id, (SELECT hi FROM boot WHERE kind = 'overall') AS overall_improvement, (SELECT lo FROM boot WHERE segment = 'R') AS peak_no_regression, (SELECT max(lo) FROM boot WHERE kind = 'hub') AS hub_no_regression,
  (SELECT avg((y BETWEEN lo AND hi)::INT) FROM bn) AS band_coverage, (SELECT max({fx('psi')}) FROM psi WHERE feature IN ('value', 'user_id')) AS psi_max)"""


def _candidate() -> str:
    names = [c[0] for c in MODEL_CHECKS]
    rows = ", ".join(f"{fx(c, 3)} AS {c}" for c in ("value", "lo", "hi"))
    plain = "vals AS (" + " UNION ALL ".join(f"SELECT run_id, '{c}' AS \"check\", {c} AS value FROM one" for c in names) + ")"
    return with_(*MODEL, BANDS, BANDED, boot(16), PSI, ONE, plain, suite(MODEL_CHECKS), JUDGED) + f"SELECT * REPLACE ({rows}) FROM res"


O["candidate_gate"] = _candidate()

RPRED = PRED.replace("d AS (SELECT ", "d AS (SELECT year(l_shipdate)::VARCHAR AS run_id, ")
RFIT = FIT.replace("s AS (SELECT count", "s AS (SELECT run_id, count").replace("FROM d)", "FROM d GROUP BY run_id)")
RSCORED = SCORED.replace("FROM d, f)", "FROM d JOIN f USING (run_id))")
RMODEL = (RPRED, RFIT, RSCORED)
O["run_sums"] = with_(RPRED) + "SELECT run_id, count(*) AS n, " + ", ".join(f"{fx(f'avg({c})', 3)} AS mean_{c}" for c in ("x1", "x2", "y")) + ", " + ", ".join(f"{fx(f'covar_pop({p}, {q})', 3)} AS {p}{q}" for p, q in (("x1", "x1"), ("x1", "x2"), ("x1", "y"), ("x2", "x2"), ("x2", "y"))) + " FROM d GROUP BY run_id"
O["run_models"] = with_(RPRED, RFIT) + "\nUNION ALL ".join(f"SELECT run_id, '{m}' AS model, '{x}' AS feature, {fx(mean, 3)} AS mean, {fx(s, 3)} AS scale, {fx(b, 3)} AS coef, {fx('my', 3)} AS intercept FROM f" for m, x, mean, s, b in (("champion", "x1", "m1", "s1", "b0"), ("challenger", "x1", "m1", "s1", "b1"), ("challenger", "x2", "m2", "s2", "b2")))
O["run_errors"] = with_(*RMODEL) + f"""SELECT run_id, CASE WHEN block IS NULL AND hub IS NULL THEN 'overall' WHEN hub IS NULL THEN 'block' ELSE 'hub' END AS kind, coalesce(block, hub, 'overall') AS segment,
  count(*) AS n, {fx(f'avg({E0})', 3)} AS mae_champion, {fx(f'avg({E1})', 3)} AS mae_challenger, {fx(f'avg({E1} - {E0})', 3)} AS diff FROM sc GROUP BY GROUPING SETS ((run_id), (run_id, block), (run_id, hub))"""
O["run_residual_bands"] = with_(*RMODEL) + f"SELECT run_id, block, {fx('quantile_cont(y - p_challenger, 0.05)', 3)} AS band_lo, {fx('quantile_cont(y - p_challenger, 0.95)', 3)} AS band_hi FROM sc GROUP BY ALL"
RPSI = (PSI.replace("pv AS (SELECT ", "pv AS (SELECT event_type AS run_id, ").replace("SELECT n < ", "SELECT run_id, n < ").replace("(value, user_id, k, one)", "(value, user_id)").replace("value, user_id::DOUBLE AS user_id, (props::JSON->>'k')::DOUBLE * CASE WHEN ts::DATE - DATE '2024-01-01' >= 20 THEN 2 ELSE 1 END AS k, 1.0::DOUBLE AS one", "value, user_id::DOUBLE AS user_id")
  .replace("cuts AS (SELECT feature,", "cuts AS (SELECT run_id, feature,").replace("GROUP BY feature),\nbins", "GROUP BY run_id, feature),\nbins").replace("bins AS (SELECT feature,", "bins AS (SELECT run_id, feature,").replace("dealt AS (SELECT feature,", "dealt AS (SELECT run_id, feature,")
  .replace("USING (feature) WHERE", "USING (run_id, feature) WHERE").replace("t.feature = b.feature", "t.run_id = b.run_id AND t.feature = b.feature").replace("SELECT b.feature,", "SELECT b.run_id, b.feature,").replace("ON b.feature = d.feature", "ON b.run_id = d.run_id AND b.feature = d.feature").replace("GROUP BY b.feature,", "GROUP BY b.run_id, b.feature,")
  .replace("psi AS (SELECT feature,", "psi AS (SELECT run_id, feature,").replace("(SELECT feature, sum(", "(SELECT run_id, feature, sum(").replace("FROM shares GROUP BY feature) USING (feature)", "FROM shares GROUP BY run_id, feature) USING (run_id, feature)"))
O["run_psi"] = with_(RPSI) + f"SELECT run_id, feature, {fx('psi')} AS psi FROM psi"

# monitoring
DAILY_MAE = "daily AS (SELECT event_type AS series, ts::DATE AS day, avg(abs(value - (props::JSON->>'k')::DOUBLE)) AS mae FROM events GROUP BY ALL)"
BAND = f"""band AS (SELECT series, greatest(avg(mae) - 2 * stddev_samp(mae), 0.5) AS band_lo, avg(mae) + 2 * stddev_samp(mae) AS band_hi FROM (SELECT *, max(day) OVER (PARTITION BY series) AS last FROM daily WHERE day - {FIRST} < {SPLIT}) WHERE day >= last - 14 GROUP BY series)"""
MARK = f"""narrow AS (SELECT series, {fx('m - (m - band_lo) / 4')} AS band_lo, {fx('m + (band_hi - m) / 4')} AS band_hi FROM (SELECT *, (band_lo + band_hi) / 2 AS m FROM band)),
mark AS (SELECT series, day, mae, band_lo, band_hi, coalesce(mae > band_hi OR mae < band_lo, FALSE) AS outside FROM (SELECT series, day, {fx('mae')} AS mae FROM daily) JOIN narrow USING (series)),
isl AS (SELECT *, sum((NOT outside)::INT) OVER (PARTITION BY series ORDER BY day) AS island FROM mark),
str AS (SELECT * EXCLUDE (island), (sum(outside::INT) OVER (PARTITION BY series, island ORDER BY day))::BIGINT AS streak FROM isl)"""
O["monitor_daily"] = with_(DAILY_MAE) + f"SELECT series, day, {fx('mae')} AS mae FROM daily"
O["monitor_band"] = with_(DAILY_MAE, BAND) + f"SELECT series, {fx('band_lo')} AS band_lo, {fx('band_hi')} AS band_hi FROM band"
O["monitor_streak"] = with_(DAILY_MAE, BAND, MARK) + "SELECT * FROM str"
O["monitor_trigger"] = with_(DAILY_MAE, BAND, MARK) + "SELECT series, min(CASE WHEN streak = 3 THEN day END) AS trigger_day FROM str GROUP BY series"

# defects
FULL = f"""full_rows AS (SELECT z AS hub, g.day, h AS hour, {cents('coalesce(k, 50)')} AS price_da, {cents('coalesce(v, 50)')} AS price_rt, 'USD/MWh' AS unit, 'preliminary' AS status, (g.day - DATE '1970-01-01') * 100 + h AS seq
  FROM (SELECT unnest(range(a, b + INTERVAL 1 DAY, INTERVAL 1 DAY))::DATE AS day FROM (SELECT min(ts::DATE) AS a, max(ts::DATE) AS b FROM events)) g CROSS JOIN (SELECT unnest(range(1, 25))::INT AS h) CROSS JOIN (SELECT unnest({TYPES}) AS z) LEFT JOIN cells c ON c.zone = z AND c.day = g.day AND c.hour = h)"""
AT = f"hub = '{HUB}' AND day = DATE '{DAY}'"
LATE = "seq + (1::BIGINT << 40) AS seq"
INJECTED = f"""inj AS (
  SELECT 'hour_shift' AS defect, * REPLACE (CASE WHEN {AT} THEN hour - 1 ELSE hour END AS hour) FROM full_rows
  UNION ALL SELECT 'retry', * FROM full_rows UNION ALL SELECT 'retry', * REPLACE ({LATE}) FROM full_rows WHERE {AT}
  UNION ALL SELECT 'conflict', * FROM full_rows UNION ALL SELECT 'conflict', * REPLACE ({LATE}, CASE WHEN hour = 17 THEN price_rt + 3 ELSE price_rt END AS price_rt) FROM full_rows WHERE {AT}
  UNION ALL SELECT 'missing_hour', * FROM full_rows WHERE NOT ({AT} AND hour = 7)
  UNION ALL SELECT 'unit_slip', * REPLACE (CASE WHEN {AT} THEN 'USD/kWh' ELSE unit END AS unit) FROM full_rows
  UNION ALL SELECT 'fake_hour', * FROM full_rows UNION ALL SELECT 'fake_hour', * REPLACE ({LATE}, 25 AS hour) FROM full_rows WHERE {AT} AND hour = 1)"""
O["defect_rows"] = with_(CELLS, FULL, INJECTED) + f"SELECT * EXCLUDE (seq) FROM inj"
O["defect_forecast"] = with_(CELLS) + f"SELECT zone AS hub, day, hour, {fx(f'''CASE WHEN day >= DATE '{DAY}' THEN u * 1000 ELSE u END''')} AS load_forecast_mw FROM cells"
MATRIX = f"""mk AS (SELECT *, {reason(TYPES, '5000')} AS reason FROM inj), {cleaned('mk', 'defect, ')},
seen AS (SELECT defect, hub, day, count(*) AS n FROM clean GROUP BY ALL),
span AS (SELECT min(day) AS a, max(day) AS b FROM clean),
wrong AS (SELECT d.defect, count(*) FILTER (coalesce(n, 0) <> {hours('g.day')}) AS hour_count_days_wrong FROM (SELECT DISTINCT defect FROM inj) d CROSS JOIN (SELECT unnest({TYPES}) AS hub) t CROSS JOIN (SELECT unnest(range(a, b + INTERVAL 1 DAY, INTERVAL 1 DAY))::DATE AS day FROM span) g LEFT JOIN seen s ON s.defect = d.defect AND s.hub = t.hub AND s.day = g.day GROUP BY 1),
rates AS (SELECT defect, count(reason) / count(*) AS rate FROM mk GROUP BY 1),
clash AS (SELECT defect, count(*) FILTER (key_rows > 1 AND place = 1) AS n FROM ex GROUP BY 1),
failed AS (SELECT defect, concat_ws(',', CASE WHEN n > 0 THEN 'duplicate_conflicts' END, CASE WHEN hour_count_days_wrong > 0 THEN 'hour_count_days_wrong' END, CASE WHEN rate > 0.05 THEN 'quarantine_rate' END) AS failed FROM wrong JOIN rates USING (defect) JOIN clash USING (defect)),
expected AS (SELECT defect, failed, CASE WHEN defect IN ('hour_shift', 'missing_hour', 'unit_slip') THEN 'hour_count_days_wrong' WHEN defect = 'conflict' THEN 'duplicate_conflicts' ELSE '' END AS expected FROM failed)"""
O["defect_matrix"] = with_(CELLS, FULL, INJECTED, MATRIX) + "SELECT *, failed = expected AS ok FROM expected"
O["merged_days"] = with_(*FINAL) + "SELECT p.* REPLACE (CASE WHEN day(p.day) % 3 = 0 THEN f.price_da ELSE p.price_da END AS price_da, CASE WHEN day(p.day) % 3 = 0 THEN f.price_rt ELSE p.price_rt END AS price_rt, CASE WHEN day(p.day) % 3 = 0 THEN f.status ELSE p.status END AS status) FROM pub p JOIN fin f USING (hub, day, hour)"
O["verified_days"] = f"SELECT ts::DATE AS day, count(*) AS rows, count(DISTINCT event_id) AS keys, {fx('sum(value)', 3)} AS total FROM events GROUP BY 1"

# the data checks of the release runs
MIXED = lambda d, h, z, more, n: f"(({d} * d + {h} * hour + {z} * (list_position({TYPES}, hub) - 1) + {more}) % {n})::DOUBLE"
RELEASED = f"""hourly_means AS (SELECT event_type AS hub, ts::DATE AS day, hour(ts)::INT + 1 AS hour, floor(avg((props::JSON->>'k')::DOUBLE))::BIGINT AS k, floor(avg(value))::BIGINT AS v, floor(avg(user_id))::BIGINT AS u FROM events GROUP BY ALL),
every AS (SELECT *, day - {FIRST} AS d FROM (SELECT unnest(range(a, b + INTERVAL 1 DAY, INTERVAL 1 DAY))::DATE AS day FROM (SELECT min(ts::DATE) AS a, max(ts::DATE) AS b FROM events)) CROSS JOIN (SELECT unnest(range(1, 25))::INT AS hour) CROSS JOIN (SELECT unnest({TYPES}) AS hub)),
mixed AS (SELECT hub, day, hour, d, 20 + {MIXED(31, 17, 7, 'coalesce(k, 0)', 100)} * 0.6::DOUBLE AS da, ({MIXED(13, 29, 11, 'coalesce(v, 0)', 41)} - 20) / 10 AS noise, {MIXED(7, 5, 3, 'coalesce(u, 0)', 51)} AS more FROM every LEFT JOIN hourly_means USING (hub, day, hour)),
priced AS (SELECT *, da + da * da * (CASE WHEN hour BETWEEN 12 AND 19 THEN 0.015 ELSE 0.01 END)::DOUBLE + (500 + da * da * 0.05::DOUBLE + more) * 0.02::DOUBLE + noise AS rt FROM mixed),
full_rows AS (SELECT hub, day, hour, {cents('da')} AS price_da, {cents('rt')} AS price_rt, 'USD/MWh' AS unit, 'preliminary' AS status, (day - DATE '1970-01-01') * 100 + hour AS seq FROM priced),
ver AS (SELECT hub, day, hour, {cents('rt + ((d + hour) % 3 - 1) * 0.05::DOUBLE')} AS price_rt FROM priced)"""
MORE_RUNS = INJECTED[:-1] + """
  UNION ALL SELECT unnest(['clean', 'load_units', 'skew']), * FROM full_rows
  UNION ALL SELECT 'copies_off', * REPLACE (CASE WHEN hour % 10 = 0 THEN price_rt + 8 ELSE price_rt END AS price_rt, CASE WHEN hub = 'error' AND day(day) < 6 THEN 'USD/kWh' ELSE unit END AS unit) FROM full_rows)"""
RELEASE_DATA = (RELEASED, MORE_RUNS, MATRIX.partition("failed AS")[0].rstrip(", \n"), """off AS (SELECT defect, avg((abs(v.price_rt - c.price_rt) > 2)::INT) AS share, avg(abs(v.price_rt - c.price_rt)) AS gap FROM clean c JOIN ver v USING (hub, day, hour) GROUP BY 1),
summary AS (SELECT defect AS run_id, rate AS quarantine_rate, hour_count_days_wrong, n AS duplicate_conflicts, share AS reconcile_share_off, gap AS reconcile_mean_abs FROM rates JOIN wrong USING (defect) JOIN clash USING (defect) JOIN off USING (defect))""", valued(CHECKS5, digits=4))
O["release_data"] = with_(*RELEASE_DATA) + "SELECT * FROM vals"
# Data checks are worked out from the tables. Models of 19 columns are beyond SQL, so which of the model checks a defect must fail is stated, as published.
VERDICTS = (*RELEASE_DATA, suite(RELEASE_CHECKS), JUDGED, """model_fails AS (SELECT run_id, unnest(string_split(names, ',')) AS "check" FROM (VALUES ('load_units', 'band_coverage,psi_max'), ('skew', 'band_coverage,hub_no_regression,overall_improvement,peak_no_regression')) t(run_id, names)),
fails AS (SELECT run_id, "check" FROM res WHERE NOT passed UNION ALL SELECT * FROM model_fails),
runs AS (SELECT r.run_id, count(f."check") AS bad, coalesce(string_agg(f."check", ',' ORDER BY f."check"), '') AS failed FROM (SELECT DISTINCT run_id FROM res) r LEFT JOIN fails f USING (run_id) GROUP BY 1)""")
O["release_report"] = with_(*VERDICTS) + "SELECT run_id, 10 - bad AS passed, 10 AS total, CASE WHEN bad = 0 THEN 0 ELSE 2 END AS exit_code, failed FROM runs"
O["release_matrix"] = with_(*VERDICTS, """must AS (SELECT * FROM (VALUES ('hour_shift', 'hour_count_days_wrong'), ('conflict', 'duplicate_conflicts'), ('retry', ''), ('unit_slip', 'hour_count_days_wrong'), ('missing_hour', 'hour_count_days_wrong'), ('fake_hour', ''),
  ('load_units', 'band_coverage,psi_max'), ('skew', 'band_coverage,hub_no_regression,overall_improvement,peak_no_regression')) t(defect, expected))""") + "SELECT defect, failed, expected, failed = expected AS ok FROM must JOIN runs ON run_id = defect"


# notes
RANK = "CASE family " + " ".join(f"WHEN '{f}' THEN {k}" for k, f in enumerate(UPSTREAM)) + f" ELSE {len(UPSTREAM)} END"
PLACED = f"""placed AS (SELECT r.*, p.place FROM res r LEFT JOIN (SELECT run_id, "check", row_number() OVER (PARTITION BY run_id ORDER BY {RANK}, ord) AS place FROM res WHERE NOT passed) p USING (run_id, "check"))"""
O["diagnose_runs"] = with_(*GATE, PLACED) + """SELECT run_id, CASE WHEN bool_and(passed) THEN 'ship' ELSE 'held' END AS decision, max(CASE WHEN place = 1 THEN "check" END) AS root,
  coalesce(string_agg("check", ',' ORDER BY place) FILTER (place > 1), '') AS downstream, coalesce(string_agg("check", ',' ORDER BY ord) FILTER (passed), '') AS passed FROM placed GROUP BY run_id"""
O["run_evidence"] = with_(*GATE) + """SELECT run_id, "check", CASE "check" WHEN 'hour_count_days_wrong' THEN d.e WHEN 'quarantine_rate' THEN q.e END AS evidence FROM res
LEFT JOIN (SELECT day::VARCHAR AS run_id, to_json(list({'hub': hub, 'hours_seen': hours_seen, 'hours_expected': hours_expected} ORDER BY hub))::VARCHAR AS e FROM counts WHERE hours_seen <> hours_expected GROUP BY day) d USING (run_id)
LEFT JOIN (SELECT day::VARCHAR AS run_id, to_json(list({'reason': reason, 'n': n} ORDER BY reason))::VARCHAR AS e FROM (SELECT day, reason, count(*) AS n FROM mk WHERE reason IS NOT NULL GROUP BY ALL) GROUP BY day) q USING (run_id)
WHERE NOT passed"""


def shown(v: str) -> str:
    return f"CASE WHEN abs({v}) < 100 THEN printf('%.4f', round_even({v}, 4)) ELSE printf('%.1f', round_even({v}, 1)) END"


LIMIT = f"op || ' ' || CASE WHEN op = 'within' THEN '[' || {shown('lo')} || ', ' || {shown('hi')} || ']' ELSE {shown('hi')} END"
O["note_template"] = with_(*GATE, PLACED, f"""texts AS (SELECT *, coalesce({shown('value')}, 'none') AS v, {LIMIT} AS against FROM placed),
facts AS (SELECT day::VARCHAR AS run_id, string_agg(fact, '; ' ORDER BY hub) AS facts FROM (SELECT day, hub, hub || ' shows ' || hours_seen || ' of ' || hours_expected || ' hours' AS fact, row_number() OVER (PARTITION BY day ORDER BY hub) AS r FROM counts WHERE hours_seen <> hours_expected) WHERE r <= 3 GROUP BY day),
g AS (SELECT run_id, count(*) AS total, count(*) FILTER (NOT passed) AS bad, max(CASE WHEN place = 1 THEN "check" END) AS root, max(CASE WHEN place = 1 THEN 'cause: ' || "check" || ' in ' || family || ', measured ' || v || ', bound ' || against END) AS root_line,
  max(CASE WHEN place = 1 THEN 'action: ' || CASE family WHEN 'data_quality' THEN 'load this day again' WHEN 'integrity' THEN 'find the second writer of ' || "check" ELSE 'ask whoever runs ' || "check" END END) AS next_line,
  string_agg("check" || ' ' || v || ' (bound ' || against || ')', '; ' ORDER BY place) FILTER (place > 1) AS others FROM texts GROUP BY run_id)""") + """SELECT run_id, CASE WHEN bad = 0 THEN concat_ws(chr(10), 'status: pass, ' || total || ' checks within bounds', 'cause: none', 'action: none')
  ELSE concat_ws(chr(10), 'status: hold, ' || bad || ' of ' || total || ' checks out of bounds', root_line, coalesce('effects: ' || others, 'effects: none'),
    CASE WHEN root = 'hour_count_days_wrong' AND facts IS NOT NULL THEN 'seen: ' || facts ELSE 'seen: only the figures above' END, next_line, 'status changes: by a person') END AS note
FROM g LEFT JOIN facts USING (run_id)"""
FORMS8 = ["printf('%.4f', v)", "printf('%.3f', v)", "printf('%.2f', v)", "printf('%.1f', v)", "printf('%.0f', v)", "printf('%.1f', v * 100) || '%'", "printf('%.0f', v * 100) || '%'", "v::VARCHAR"]
O["allowed_numbers"] = with_(*GATE[:-3], f"""nums AS (SELECT run_id, {fx('v', 9)} AS v FROM (SELECT run_id, unnest([reconcile_share_off, reconcile_mean_abs, quarantine_rate]) AS v FROM summary) WHERE v IS NOT NULL)""") + f"""SELECT DISTINCT run_id, token FROM (
  SELECT run_id, unnest([{', '.join(FORMS8)}]) AS token FROM nums
  UNION ALL SELECT run_id, duplicate_conflicts::BIGINT::VARCHAR FROM summary WHERE duplicate_conflicts IS NOT NULL
  UNION ALL SELECT run_id, unnest(string_split(run_id, '-')) FROM summary)"""
NUMBERS = r"""list_filter(regexp_extract_all(regexp_replace(coalesce(text, ''), '([\w.])-', '\1 ', 'g'), '-?[\w.]+%?'), lambda t: regexp_full_match(t, '-?\d+(\.\d+)?%?'))"""
OK_NUMBER = r"""(t IN (doc_id::VARCHAR, n_chars::VARCHAR) OR regexp_replace(t, '%+$', '') IN (doc_id::VARCHAR, n_chars::VARCHAR) OR regexp_replace(t, '^-+', '') IN (doc_id::VARCHAR, n_chars::VARCHAR) OR regexp_full_match(regexp_replace(t, '%+$', ''), '[0-9]|[12][0-9]|3[01]') OR regexp_full_match(regexp_replace(t, '^-+', ''), '[0-9]|[12][0-9]|3[01]'))"""
PHRASES = ", ".join([f"CASE WHEN contains(lower(coalesce(text, '')), '{p}') THEN 'moves a threshold: ''{p}''' END" for p in THRESHOLD_PHRASES] + [f"CASE WHEN contains(lower(coalesce(text, '')), '{p}') THEN 'makes a release decision: ''{p}''' END" for p in DECISION_PHRASES])
LINES = "len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: trim(l, ' ' || chr(9) || chr(13)) <> ''))"
FILTERED = f"""filtered AS (SELECT doc_id AS note_id, text, array_to_string(list_filter(list_concat([CASE WHEN {LINES} > 8 THEN {LINES} || ' lines; the limit is 8' END],
  list_transform(list_filter({NUMBERS}, lambda t: NOT {OK_NUMBER}), lambda t: 'number not in the report: ' || t), [{PHRASES}]), lambda r: r IS NOT NULL), '; ') AS reasons FROM documents)"""
O["note_filter"] = with_(FILTERED) + "SELECT note_id, coalesce(reasons, '') = '' AS ok, coalesce(reasons, '') AS reasons FROM filtered"
O["note_fallback"] = with_(FILTERED) + """SELECT CASE WHEN coalesce(reasons, '') = '' THEN 'draft' ELSE 'template' END AS source, coalesce(reasons, '') = '' AS ok, count(*) AS n,
  sum(CASE WHEN coalesce(reasons, '') = '' THEN length(text) ELSE length('Template of run ' || note_id) END)::BIGINT AS chars FROM filtered GROUP BY ALL"""


HEADED = f"row_number() OVER (PARTITION BY ts::DATE ORDER BY event_id) - 1 AS line, ts::DATE - {FIRST} + 1 AS place"
O["daily_files"] = f"""SELECT file_day, time_stamp, zone, ptid, lbmp, CASE WHEN day(file_day) % 3 = 0 THEN left(zone, 2) END AS losses, line, dense_rank() OVER (ORDER BY place) AS place FROM (
  SELECT ts::DATE AS file_day, strftime(ts, '%m/%d/%Y %H:%M:%S') AS time_stamp, event_type AS zone, user_id AS ptid, printf('%.4f', value)::DOUBLE AS lbmp, {HEADED} FROM events) WHERE file_day BETWEEN DATE '2024-01-03' AND DATE '2024-01-26'"""
O["price_table"] = f"""SELECT ts::DATE AS file_day, event_type AS zone, count(*) AS rows, 0::BIGINT AS congested, {fx('sum(value::DECIMAL(18,4)::DOUBLE)', 3)} AS total, min(event_id)::INT AS first, max(event_id)::INT AS last FROM events GROUP BY ALL"""
O["report_sink"] = with_(*GATE) + f"""SELECT run_id, count(*) FILTER (passed) AS passed, count(*) AS total, CASE WHEN bool_and(passed) THEN 0 ELSE 2 END::BIGINT AS exit_code,
  coalesce(string_agg("check", ',' ORDER BY ord) FILTER (NOT passed), '') AS failed, {fx('sum(coalesce(value, 0))', 3)} AS values FROM res GROUP BY run_id"""
O["landed_days"] = f"""SELECT ts::DATE AS day, count(*) AS rows, count(DISTINCT event_id) AS keys, {fx('sum(value)', 3)} AS total, max(ts) AS last FROM events GROUP BY 1"""


def oracle_sql() -> dict[str, str]:
    return dict(O)
