"""The checked queries in SQL for DuckDB.

Written row by row: every pair of log rows is joined and counted one at a time,
so that the counting of copies in the Spark plans is checked against it.
"""

from __future__ import annotations

# --- source tables -----------------------------------------------------------

_TABLES = """
txn_requests AS (
  SELECT event_id AS request_id, ts AS op_time,
         CAST(round(value * 100) AS BIGINT) * 1000 AS trans_amt, user_id AS client_id,
         CASE WHEN event_type = 'signup' THEN 'BE' ELSE 'CW' END AS master_trans_type,
         CASE event_id % 3 WHEN 0 THEN 'ybl' WHEN 1 THEN 'NSDL' ELSE 'YBLN' END AS aggregator
  FROM events
),
txn_responses AS (
  SELECT event_id AS request_id, ts AS op_time, 'INSERT' AS op_name, '00' AS rc,
         CAST(NULL AS VARCHAR) AS message
  FROM events
  UNION ALL
  SELECT event_id, ts + INTERVAL 1 SECOND, 'UPDATE', '00',
         CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'Success' END
  FROM events
  UNION ALL
  SELECT event_id, ts + INTERVAL 500 MILLISECOND, 'UPDATE', '00', 'PENDING'
  FROM events WHERE event_id % 10 = 0
),
txn_devices AS (
  SELECT event_id AS request_id, ts AS op_time, 'DP' || (event_id % 5) AS dpid FROM events
  UNION ALL
  SELECT event_id, ts, 'DPX' FROM events WHERE event_id % 50 = 0
),
bio_log AS (
  SELECT event_id AS request_id, ts AS op_time, 'INSERT' AS op_name, user_id AS client_id,
         CASE event_id % 3 WHEN 0 THEN 'YBL' WHEN 1 THEN 'NSDL' ELSE 'YBLN' END AS aggregator,
         CAST(NULL AS VARCHAR) AS rc
  FROM events
  UNION ALL
  SELECT event_id, ts + INTERVAL 2 SECOND, 'UPDATE', user_id,
         CASE event_id % 3 WHEN 0 THEN 'YBL' WHEN 1 THEN 'NSDL' ELSE 'YBLN' END,
         CASE WHEN CAST(json_extract(props, '$.k') AS INTEGER) >= 20 THEN '00' ELSE 'U1' END
  FROM events
),
daily_requests AS (
  SELECT event_id AS request_id, user_id AS client_id,
         TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(event_id % 113 AS INTEGER))
           + to_minutes(event_id % 1439) AS log_date_time,
         CASE WHEN event_id % 29 = 0 THEN 0
              ELSE CAST(round(value * 100) AS BIGINT) * 1000 END AS trans_amt,
         CASE WHEN event_id % 41 = 0 THEN NULL ELSE 'BANK_' || (event_id % 37) END
           AS cust_bank_name
  FROM events
),
daily_responses AS (
  SELECT event_id AS request_id,
         TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(event_id % 113 AS INTEGER))
           + to_minutes(event_id % 1439) AS log_date_time,
         CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'SUCCESS' END AS message
  FROM events
),
client_locations AS (
  SELECT c_custkey AS retailer_id,
         CASE WHEN c_nationkey = 24 THEN NULL ELSE n_name END AS final_state
  FROM customer JOIN nation ON c_nationkey = n_nationkey
)"""

def _mean(value: str) -> str:
    """Mean whose last bit does not depend on the order of rows."""
    return f"sum({value} ORDER BY {value}) / nullif(count({value}), 0)"


def _spread(value: str, mean: str, less: int) -> str:
    """Standard deviation in two passes; ``mean`` comes from a CTE before. less: 1 for samples."""
    off = f"({value} - {mean})"
    return f"sqrt(sum({off} * {off} ORDER BY {value}) / nullif(count({value}) - {less}, 0))"


# --- hourly family (as of 2024-01-30) ----------------------------------------

_HOURLY = f"""
latest AS (
  SELECT request_id, op_time, message FROM (
    SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY op_time DESC, message DESC) AS rn
    FROM txn_responses
    WHERE op_name = 'UPDATE'
      AND CAST(op_time AS DATE) BETWEEN DATE '2024-01-23' AND DATE '2024-01-30'
  ) WHERE rn = 1
),
txn_rows AS (
  SELECT CAST(q.op_time AS DATE) AS date, strftime(q.op_time, '%H:00') AS hour, q.trans_amt,
         lower(q.aggregator) AS agg, lower(u.message) = 'success' AS ok
  FROM txn_requests q
  JOIN txn_responses i ON i.request_id = q.request_id AND i.op_name = 'INSERT'
   AND CAST(i.op_time AS DATE) BETWEEN DATE '2024-01-23' AND DATE '2024-01-30'
  JOIN latest u ON u.request_id = q.request_id
  JOIN txn_devices d ON d.request_id = q.request_id
   AND CAST(d.op_time AS DATE) BETWEEN DATE '2024-01-23' AND DATE '2024-01-30'
  WHERE q.master_trans_type = 'CW'
    AND CAST(q.op_time AS DATE) BETWEEN DATE '2024-01-23' AND DATE '2024-01-30'
),
txn_cells AS (
  SELECT date, hour,
         CAST(sum(trans_amt) FILTER (WHERE ok) AS BIGINT) AS success_amount,
         count(*) AS total_txns,
         count(*) FILTER (WHERE ok) AS success_txns,
         count(*) FILTER (WHERE ok AND agg = 'ybl') AS ybl_success,
         count(*) FILTER (WHERE agg = 'ybl') AS ybl_total,
         count(*) FILTER (WHERE ok AND agg = 'nsdl') AS nsdl_success,
         count(*) FILTER (WHERE agg = 'nsdl') AS nsdl_total,
         count(*) FILTER (WHERE ok AND agg = 'ybln') AS ybln_success,
         count(*) FILTER (WHERE agg = 'ybln') AS ybln_total
  FROM txn_rows GROUP BY date, hour
),
txn_rates AS (
  SELECT date, hour, success_amount / 1e7 AS gtv, total_txns, success_txns,
         success_txns / nullif(total_txns, 0) * 100 AS r,
         ybl_success / nullif(ybl_total, 0) * 100 AS r_ybl,
         nsdl_success / nullif(nsdl_total, 0) * 100 AS r_nsdl,
         ybln_success / nullif(ybln_total, 0) * 100 AS r_ybln
  FROM txn_cells
),
q1_mean AS (
  SELECT hour, {_mean("r")} AS m FROM txn_rates WHERE date < DATE '2024-01-30' GROUP BY hour
),
q1_past AS (
  SELECT hour,
         round(quantile_disc(gtv, 0.5), 2) AS median_amount_cr,
         CAST(quantile_disc(success_txns, 0.5) AS DOUBLE) AS median_success_txns,
         round(quantile_disc(r, 0.5), 2) AS median_success_rate,
         round({_spread("r", "m", 0)}, 2) AS sd,
         round(quantile_disc(r_ybl, 0.5), 2) AS median_ybl_success_rate,
         round(quantile_disc(r_nsdl, 0.5), 2) AS median_nsdl_success_rate,
         round(quantile_disc(r_ybln, 0.5), 2) AS median_ybln_success_rate
  FROM txn_rates JOIN q1_mean USING (hour) WHERE date < DATE '2024-01-30' GROUP BY hour
),
q1_now AS (
  SELECT date, hour, gtv AS total_amount_cr, success_txns,
         round(r, 2) AS overall_success_rate, round(r_ybl, 2) AS ybl_success_rate,
         round(r_nsdl, 2) AS nsdl_success_rate, round(r_ybln, 2) AS ybln_success_rate
  FROM txn_rates WHERE date = DATE '2024-01-30'
),
q1 AS (
  SELECT n.date, coalesce(n.hour, p.hour) AS hour, n.total_amount_cr, n.success_txns,
         n.overall_success_rate, n.ybl_success_rate, n.nsdl_success_rate, n.ybln_success_rate,
         p.median_amount_cr, p.median_success_txns, p.median_success_rate,
         p.median_ybl_success_rate, p.median_nsdl_success_rate, p.median_ybln_success_rate,
         CASE WHEN n.overall_success_rate < p.median_success_rate - p.sd THEN 'lower anomaly ↓'
              WHEN n.overall_success_rate > p.median_success_rate + p.sd THEN 'upper anomaly ↑'
              ELSE 'normal' END AS success_rate_anomaly
  FROM q1_past p FULL JOIN q1_now n ON n.hour = p.hour
),
q3_days AS (
  SELECT date, hour, gtv AS total_amount_cr, total_txns, success_txns,
         coalesce(round(r, 2), 0) AS overall_success_rate,
         coalesce(round(r_ybl, 2), 0) AS ybl_success_rate,
         coalesce(round(r_nsdl, 2), 0) AS nsdl_success_rate,
         coalesce(round(r_ybln, 2), 0) AS ybln_success_rate
  FROM txn_rates
),
q3_mean AS (
  SELECT hour, {_mean("overall_success_rate")} AS avg_success_rate,
         {_mean("total_amount_cr")} AS avg_amount_cr
  FROM q3_days WHERE date < DATE '2024-01-30' GROUP BY hour
),
q3_past AS (
  SELECT hour, any_value(avg_success_rate) AS avg_success_rate,
         {_spread("overall_success_rate", "avg_success_rate", 1)} AS stddev_success_rate,
         any_value(avg_amount_cr) AS avg_amount_cr,
         {_spread("total_amount_cr", "avg_amount_cr", 1)} AS stddev_amount_cr
  FROM q3_days JOIN q3_mean USING (hour) WHERE date < DATE '2024-01-30' GROUP BY hour
),
q3 AS (
  SELECT d.hour, d.overall_success_rate, d.total_amount_cr, d.total_txns, d.success_txns,
         d.ybl_success_rate, d.nsdl_success_rate, d.ybln_success_rate,
         p.avg_success_rate, p.stddev_success_rate, p.avg_amount_cr, p.stddev_amount_cr,
         CASE WHEN d.overall_success_rate < p.avg_success_rate - 2 * p.stddev_success_rate
                THEN 'low'
              WHEN d.overall_success_rate > p.avg_success_rate + 2 * p.stddev_success_rate
                THEN 'high'
              ELSE 'normal' END AS success_rate_anomaly,
         CASE WHEN d.total_amount_cr < p.avg_amount_cr - 2 * p.stddev_amount_cr THEN 'low'
              WHEN d.total_amount_cr > p.avg_amount_cr + 2 * p.stddev_amount_cr THEN 'high'
              ELSE 'normal' END AS amount_cr_anomaly
  FROM q3_days d LEFT JOIN q3_past p ON p.hour = d.hour
  WHERE d.date = DATE '2024-01-30'
)"""


def _bio(name: str, first: str, normal: str, no_data: bool, counts: bool) -> str:
    """CTEs for authentication by hour, history starting on ``first``."""
    missing = "WHEN n.r IS NULL THEN 'No Data'" if no_data else ""
    extra = ", n.attempts AS total_attempts, n.successes AS successful_attempts" if counts else ""
    return f"""
{name}_rows AS (
  SELECT CAST(u.op_time AS DATE) AS date, strftime(u.op_time, '%H:00') AS hour,
         i.client_id, i.aggregator, u.rc = '00' AS ok
  FROM bio_log i JOIN bio_log u ON u.request_id = i.request_id
  WHERE i.op_name = 'INSERT' AND u.op_name = 'UPDATE'
    AND CAST(i.op_time AS DATE) BETWEEN DATE '{first}' AND DATE '2024-01-30'
    AND CAST(u.op_time AS DATE) BETWEEN DATE '{first}' AND DATE '2024-01-30'
),
{name}_cells AS (
  SELECT date, hour, count(client_id) AS attempts,
         count(client_id) FILTER (WHERE ok) AS successes,
         count(DISTINCT client_id) FILTER (WHERE ok) AS any_success,
         count(DISTINCT client_id) FILTER (WHERE aggregator = 'NSDL') AS nsdl,
         count(DISTINCT client_id) FILTER (WHERE aggregator = 'NSDL' AND ok) AS nsdl_success,
         count(DISTINCT client_id) FILTER (WHERE aggregator IN ('YBL', 'YBLN')) AS ybl,
         count(DISTINCT client_id) FILTER (WHERE aggregator IN ('YBL', 'YBLN') AND ok)
           AS ybl_success
  FROM {name}_rows GROUP BY date, hour
),
{name}_rates AS (
  SELECT date, hour, attempts, successes,
         successes / nullif(attempts, 0) * 100 AS r,
         nsdl_success / nullif(nsdl, 0) * 100 AS r_nsdl,
         ybl_success / nullif(ybl, 0) * 100 AS r_ybl,
         successes / nullif(any_success, 0) AS per_user
  FROM {name}_cells
),
{name}_mean AS (
  SELECT hour, {_mean("r")} AS mean FROM {name}_rates
  WHERE date < DATE '2024-01-30' GROUP BY hour
),
{name}_past AS (
  SELECT hour, round(quantile_disc(r, 0.5), 2) AS m, round(quantile_disc(r_nsdl, 0.5), 2) AS m_nsdl,
         round(quantile_disc(r_ybl, 0.5), 2) AS m_ybl,
         round(quantile_disc(per_user, 0.5), 2) AS m_per_user, {_spread("r", "mean", 1)} AS sd
  FROM {name}_rates JOIN {name}_mean USING (hour) WHERE date < DATE '2024-01-30' GROUP BY hour
),
{name}_now AS (
  SELECT date, hour, attempts, successes, round(r, 2) AS r, round(r_nsdl, 2) AS r_nsdl,
         round(r_ybl, 2) AS r_ybl, round(per_user, 2) AS per_user
  FROM {name}_rates WHERE date = DATE '2024-01-30'
),
{name} AS (
  SELECT n.date, coalesce(n.hour, p.hour) AS hour,
         n.r AS fa2_rate_yesterday, p.m AS median_fa2_succ_rate,
         n.r_nsdl AS nsdl_rate_yesterday, p.m_nsdl AS median_fa2_succ_rate_nsdl,
         n.r_ybl AS ybl_rate_yesterday, p.m_ybl AS median_fa2_succ_rate_ybl,
         n.per_user AS per_user_rate_yesterday, p.m_per_user AS median_fa2_per_user_rate{extra},
         CASE WHEN n.r < p.m - p.sd THEN 'Lower Anomaly ↓'
              WHEN n.r > p.m + p.sd THEN 'Upper Anomaly ↑'
              {missing} ELSE '{normal}' END AS fa2_succ_flag
  FROM {name}_past p FULL JOIN {name}_now n ON n.hour = p.hour
)"""


_BIO = _bio("q2", "2024-01-22", "Normal", True, False) + "," + _bio(
    "q4", "2024-01-23", "normal", False, True
)

# --- daily family (as of 2024-04-22) -----------------------------------------

_PAIRS = """
pair_rows AS (
  SELECT a.request_id, a.client_id, a.cust_bank_name, a.trans_amt,
         CAST(a.log_date_time AS DATE) AS day, CAST(b.log_date_time AS DATE) AS answer_day,
         b.message = 'SUCCESS' AS ok
  FROM daily_requests a JOIN daily_responses b ON a.request_id = b.request_id
),
state_rows AS (
  SELECT p.*, v.final_state
  FROM pair_rows p JOIN client_locations v ON v.retailer_id = p.client_id
  WHERE v.final_state IS NOT NULL
)"""

_MEASURES = """
         sum(CASE WHEN ok AND trans_amt > 0 THEN trans_amt END) / 1e7 AS gtv,
         count(CASE WHEN trans_amt > 0 THEN request_id END) AS txns,
         count(CASE WHEN ok AND trans_amt > 0 THEN request_id END) AS successes,
         count(CASE WHEN ok AND trans_amt > 0 THEN request_id END)
           / nullif(count(CASE WHEN trans_amt > 0 THEN request_id END), 0) * 100 AS rate"""


def _in(first: str, last: str) -> str:
    return (
        f"day BETWEEN DATE '{first}' AND DATE '{last}'"
        f" AND answer_day BETWEEN DATE '{first}' AND DATE '{last}'"
    )


_YESTERDAY = _in("2024-04-21", "2024-04-21")
_HISTORY = _in("2024-01-23", "2024-04-20")
_RANGE = _in("2024-03-23", "2024-04-21")

_STATE = f"""
s_now AS (SELECT final_state, {_MEASURES} FROM state_rows WHERE {_YESTERDAY} GROUP BY final_state),
s_days AS (
  SELECT final_state, day, {_MEASURES} FROM state_rows WHERE {_HISTORY} GROUP BY final_state, day
),
s_mean AS (
  SELECT final_state, {_mean("gtv")} AS a_gtv, {_mean("rate")} AS a_rate
  FROM s_days GROUP BY final_state
),
s_past AS (
  SELECT final_state, quantile_disc(gtv, 0.5) AS m_gtv, quantile_disc(rate, 0.5) AS m_rate,
         {_spread("gtv", "a_gtv", 1)} AS sd_gtv, {_spread("rate", "a_rate", 1)} AS sd_rate
  FROM s_days JOIN s_mean USING (final_state) GROUP BY final_state
),
s_weekday AS (
  SELECT final_state, {_MEASURES} FROM state_rows
  WHERE {_HISTORY} AND dayofweek(day) = dayofweek(DATE '2024-04-21') GROUP BY final_state
),
s_monthday AS (
  SELECT final_state, {_MEASURES} FROM state_rows
  WHERE {_HISTORY} AND day(day) = 21 GROUP BY final_state
),
q5 AS (
  SELECT n.final_state, n.gtv AS yesterday_gtv, n.txns AS yesterday_transactions,
         n.rate AS yesterday_success_rate, p.m_gtv AS median_90d_gtv,
         p.m_rate AS median_90d_success_rate, p.sd_gtv AS stddev_90d_gtv,
         p.sd_rate AS stddev_90d_success_rate, w.gtv AS same_weekday_median_gtv,
         w.rate AS same_weekday_median_success_rate, m.gtv AS same_day_month_median_gtv,
         m.rate AS same_day_month_median_success_rate,
         n.gtv / nullif(p.m_gtv, 0) AS gtv_vs_median_ratio,
         n.rate / nullif(p.m_rate, 0) AS success_vs_median_ratio
  FROM s_now n
  LEFT JOIN s_past p ON p.final_state = n.final_state
  LEFT JOIN s_weekday w ON w.final_state = n.final_state
  LEFT JOIN s_monthday m ON m.final_state = n.final_state
)"""


def _trend(name: str, first: str) -> str:
    return f"""
{name} AS (
  SELECT day AS date, final_state, gtv, txns AS transactions, rate AS success_rate FROM (
    SELECT day, final_state, {_MEASURES} FROM state_rows
    WHERE {_in(first, "2024-04-21")} GROUP BY day, final_state)
)"""


_TRENDS = ",".join(
    [_trend("q6", "2024-04-12"), _trend("q7", "2024-03-23"), _trend("q11", "2024-01-23")]
)

_BANKS = f"""
bank_days AS (
  SELECT final_state, day, cust_bank_name,
         CAST(sum(CASE WHEN ok AND trans_amt > 0 THEN trans_amt END) AS BIGINT) AS success_amount,
         {_MEASURES}
  FROM state_rows WHERE {_RANGE} AND cust_bank_name IS NOT NULL
  GROUP BY final_state, day, cust_bank_name
),
bank_totals AS (
  SELECT final_state, cust_bank_name, sum(success_amount) / 1e7 AS total_gtv,
         CAST(sum(txns) AS BIGINT) AS total_txns,
         sum(successes) / nullif(sum(txns), 0) * 100 AS total_rate,
         count(DISTINCT day) AS active_days
  FROM bank_days GROUP BY final_state, cust_bank_name
),
best_banks AS (
  SELECT * FROM (
    SELECT *, rank() OVER (PARTITION BY final_state ORDER BY total_gtv DESC) AS place
    FROM bank_totals WHERE total_gtv > 0
  ) WHERE place <= 5
),
q8 AS (
  SELECT d.final_state, d.day AS date, d.cust_bank_name, d.txns AS transaction_count, d.gtv,
         d.rate AS trans_percentage, t.total_gtv AS bank_total_gtv,
         t.total_txns AS bank_total_transactions, t.total_rate AS bank_success_rate,
         t.active_days
  FROM bank_days d JOIN best_banks t
    ON t.final_state = d.final_state AND t.cust_bank_name = d.cust_bank_name
),
q9 AS (
  SELECT cust_bank_name, txns AS transaction_count, gtv, rate AS trans_percentage FROM (
    SELECT cust_bank_name, {_MEASURES} FROM pair_rows
    WHERE {_YESTERDAY} AND cust_bank_name IS NOT NULL GROUP BY cust_bank_name)
  ORDER BY gtv DESC NULLS LAST, cust_bank_name LIMIT 25
),
q10 AS (
  SELECT final_state, cust_bank_name, txns AS transaction_count, successes AS success_count,
         txns AS total_count, gtv, rate AS trans_percentage FROM (
    SELECT final_state, cust_bank_name, {_MEASURES} FROM state_rows
    WHERE {_YESTERDAY} AND cust_bank_name IS NOT NULL GROUP BY final_state, cust_bank_name)
),
default_state AS (
  SELECT final_state FROM q10 GROUP BY final_state
  ORDER BY sum(gtv) DESC NULLS LAST, final_state LIMIT 1
)"""

# --- report building blocks --------------------------------------------------

_STATE_REPORTS = """
gainers AS (
  SELECT * FROM q5 WHERE yesterday_gtv > 1 AND gtv_vs_median_ratio > 1.1
  ORDER BY gtv_vs_median_ratio DESC, final_state LIMIT 5
),
decliners AS (
  SELECT * FROM q5 WHERE yesterday_gtv > 1 AND gtv_vs_median_ratio < 0.9
  ORDER BY gtv_vs_median_ratio, final_state LIMIT 5
),
shares AS (
  SELECT final_state, yesterday_gtv,
         round_even(yesterday_gtv / (SELECT sum(yesterday_gtv) FROM q5) * 100, 2) AS percentage
  FROM q5 WHERE yesterday_gtv IS NOT NULL
),
folded AS (
  SELECT final_state, yesterday_gtv, percentage FROM shares WHERE percentage >= 2
  UNION ALL
  SELECT 'Others (' || count(*) || ' states)', sum(yesterday_gtv),
         round_even(sum(yesterday_gtv) / (SELECT sum(yesterday_gtv) FROM q5) * 100, 2)
  FROM shares WHERE percentage < 2 HAVING count(*) > 0
),
variation AS (
  SELECT final_state, yesterday_gtv, median_90d_gtv,
         round_even((yesterday_gtv - median_90d_gtv) / nullif(median_90d_gtv, 0) * 100, 1)
           AS variation
  FROM q5
),
threshold AS (
  SELECT final_state, yesterday_gtv, median_90d_gtv, stddev_90d_gtv,
         median_90d_gtv - stddev_90d_gtv AS lower_threshold,
         median_90d_gtv + stddev_90d_gtv AS upper_threshold,
         CASE WHEN yesterday_gtv > median_90d_gtv + stddev_90d_gtv THEN 'Above 1σ'
              WHEN yesterday_gtv < median_90d_gtv - stddev_90d_gtv THEN 'Below 1σ'
              ELSE 'Normal' END AS status
  FROM q5
)"""

_SCORES = """
scores AS (
  SELECT least(100, greatest(0, coalesce((SELECT avg(overall_success_rate) FROM q3), 0))) AS txn,
         least(100, greatest(0, coalesce((SELECT avg(fa2_rate_yesterday) FROM q4), 0))) AS bio,
         (SELECT avg(ybl_success_rate) FROM q3) AS ybl,
         (SELECT avg(nsdl_success_rate) FROM q3) AS nsdl,
         (SELECT avg(ybln_success_rate) FROM q3) AS ybln
),
basic_scores AS (
  SELECT least(100, greatest(0, coalesce((SELECT avg(overall_success_rate) FROM q1), 0))) AS txn,
         least(100, greatest(0, coalesce((SELECT avg(fa2_rate_yesterday) FROM q2), 0))) AS bio,
         (SELECT avg(ybl_success_rate) FROM q1) AS ybl,
         (SELECT avg(nsdl_success_rate) FROM q1) AS nsdl,
         (SELECT avg(ybln_success_rate) FROM q1) AS ybln
)"""


_ANSWERED = """
answered AS (
  SELECT q.request_id, date_trunc('hour', q.op_time) AS h, lower(q.aggregator) AS agg, q.trans_amt,
         arg_max(lower(u.message) = 'success', u.op_time) AS ok
  FROM txn_requests q JOIN txn_responses u ON u.request_id = q.request_id
  WHERE q.master_trans_type = 'CW' AND u.op_name = 'UPDATE'
    AND u.op_time >= q.op_time
    AND date_trunc('hour', u.op_time) <= date_trunc('hour', q.op_time) + INTERVAL 1 HOUR
  GROUP BY ALL
)"""


def _light(value: str, green: int, yellow: int) -> str:
    return (
        f"CASE WHEN {value} >= {green} THEN 'green' WHEN {value} >= {yellow} THEN 'yellow'"
        " ELSE 'red' END"
    )


def _bands(source: str, bio: tuple[int, int]) -> str:
    return f"""
SELECT {_light("txn * 0.7 + bio * 0.3", 90, 75)} AS overall_band,
       {_light("txn", 95, 85)} AS txn_band, {_light("bio", *bio)} AS bio_band,
       {_light("ybl", 95, 85)} AS ybl_band, {_light("nsdl", 95, 85)} AS nsdl_band,
       {_light("ybln", 95, 85)} AS ybln_band
FROM {source}"""


def _series(source: str, pairs: dict[str, tuple[str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT hour, '{metric}' AS metric, round(CAST({now} AS DOUBLE), 8) AS \"current\","
        f" round(CAST({base} AS DOUBLE), 8) AS baseline FROM {source}"
        for metric, (now, base) in pairs.items()
    )


_HOURLY_CTES = (_TABLES, _HOURLY, _BIO)
_DAILY_CTES = (_TABLES, _PAIRS, _STATE, _TRENDS, _BANKS, _STATE_REPORTS)


def _sql(ctes: tuple[str, ...], body: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + body.strip()


def _hourly(body: str, *more: str) -> str:
    return _sql(_HOURLY_CTES + more, body)


def _daily(body: str) -> str:
    return _sql(_DAILY_CTES, body)


def _settled(source: str, *doubles: str) -> str:
    """All columns, floating-point ones rounded like the Spark side rounds them."""
    if not doubles:
        return f"SELECT * FROM {source}"
    rounded = ", ".join(f"round({d}, 8) AS {d}" for d in doubles)
    return f"SELECT * REPLACE ({rounded}) FROM {source}"


_Q3_DOUBLES = (
    "overall_success_rate", "total_amount_cr", "ybl_success_rate", "nsdl_success_rate",
    "ybln_success_rate", "avg_success_rate", "stddev_success_rate", "avg_amount_cr",
    "stddev_amount_cr",
)
_Q5_DOUBLES = (
    "yesterday_gtv", "yesterday_success_rate", "median_90d_gtv", "median_90d_success_rate",
    "stddev_90d_gtv", "stddev_90d_success_rate", "same_weekday_median_gtv",
    "same_weekday_median_success_rate", "same_day_month_median_gtv",
    "same_day_month_median_success_rate", "gtv_vs_median_ratio", "success_vs_median_ratio",
)
_TREND_DOUBLES = ("gtv", "success_rate")
_MOVERS = """
SELECT final_state, round_even(yesterday_gtv, 2) AS yesterday_gtv,
       round_even(median_90d_gtv, 2) AS median_90d_gtv,
       round_even(gtv_vs_median_ratio * 100, 1) AS gtv_vs_median_ratio
FROM {}"""

ORACLE: dict[str, str] = {
    # named datasets
    "txn_hourly_median": _hourly(_settled("q1", "total_amount_cr")),
    "bio_hourly_8d": _hourly(_settled("q2")),
    "txn_hourly_health": _hourly(_settled("q3", *_Q3_DOUBLES)),
    "bio_hourly_health": _hourly(_settled("q4")),
    "state_metrics": _daily(_settled("q5", *_Q5_DOUBLES)),
    "state_10d_trend": _daily(_settled("q6", *_TREND_DOUBLES)),
    "state_30d_trend": _daily(_settled("q7", *_TREND_DOUBLES)),
    "bank_health": _daily(
        _settled("q8", "gtv", "trans_percentage", "bank_total_gtv", "bank_success_rate")
    ),
    "bank_yesterday": _daily(_settled("q9", "gtv", "trans_percentage")),
    "bank_yesterday_by_state": _daily(_settled("q10", "gtv", "trans_percentage")),
    "bank_state_90d_trend": _daily(
        "SELECT date, final_state, round(gtv, 8) AS gtv, round(success_rate, 8) AS trans_percentage"
        " FROM q11"
    ),
    # facts and building blocks
    "table_counts": _sql(
        (_TABLES,),
        " UNION ALL ".join(
            f"SELECT '{name}' AS table_name, count(*) AS row_count,"
            f" count(DISTINCT {key}) AS distinct_keys FROM {name}"
            for name, key in (
                ("txn_requests", "request_id"), ("txn_responses", "request_id"),
                ("txn_devices", "request_id"), ("bio_log", "request_id"),
                ("daily_requests", "request_id"), ("daily_responses", "request_id"),
                ("client_locations", "retailer_id"),
            )
        ),
    ),
    "date_scan": _sql(
        (_TABLES,),
        """
SELECT request_id, client_id, trans_amt, aggregator FROM txn_requests
WHERE CAST(op_time AS DATE) BETWEEN DATE '2024-01-23' AND DATE '2024-01-30'""",
    ),
    "approx_medians": _daily(f"""
SELECT final_state, quantile_disc(amount, 0.5) AS median_amount,
       quantile_disc(txns, 0.5) AS median_txns
FROM (SELECT final_state, day, count(CASE WHEN trans_amt > 0 THEN request_id END) AS txns,
             CAST(sum(CASE WHEN ok AND trans_amt > 0 THEN trans_amt END) AS BIGINT) AS amount
      FROM state_rows WHERE {_in("2024-01-23", "2024-04-21")} GROUP BY final_state, day)
GROUP BY final_state"""),
    "txn_cells": _hourly("SELECT * FROM txn_cells"),
    "bio_cells": _hourly(
        "SELECT * REPLACE (CAST(attempts AS BIGINT) AS attempts) FROM q4_cells"
    ),
    "latest_update": _hourly(
        "SELECT request_id, epoch_us(op_time) AS op_micros, message FROM latest"
    ),
    "cdc_pairs": _hourly("""
SELECT i.request_id, i.rc, u.message, count(*) AS copies
FROM txn_responses i JOIN latest u ON u.request_id = i.request_id
WHERE i.op_name = 'INSERT'
  AND CAST(i.op_time AS DATE) BETWEEN DATE '2024-01-23' AND DATE '2024-01-30'
GROUP BY i.request_id, i.rc, u.message"""),
    "cdc_all_pairs": _hourly("""
SELECT i.request_id, i.rc, u.message, count(*) AS copies
FROM txn_responses i JOIN txn_responses u ON u.request_id = i.request_id
WHERE i.op_name = 'INSERT' AND u.op_name = 'UPDATE'
  AND CAST(i.op_time AS DATE) BETWEEN DATE '2024-01-23' AND DATE '2024-01-30'
  AND CAST(u.op_time AS DATE) BETWEEN DATE '2024-01-23' AND DATE '2024-01-30'
GROUP BY i.request_id, i.rc, u.message"""),
    "daily_state_fact": _daily("""
SELECT day, answer_day, final_state,
       count(CASE WHEN trans_amt > 0 THEN request_id END) AS txns,
       count(CASE WHEN ok AND trans_amt > 0 THEN request_id END) AS successes,
       CAST(sum(CASE WHEN ok AND trans_amt > 0 THEN trans_amt END) AS BIGINT) AS success_amount
FROM state_rows
WHERE day BETWEEN DATE '2024-01-23' AND DATE '2024-04-21'
  AND answer_day BETWEEN DATE '2024-01-23' AND DATE '2024-04-21'
GROUP BY day, answer_day, final_state"""),
    "daily_bank_fact": _daily(
        "SELECT day, final_state, cust_bank_name, txns, successes, success_amount FROM bank_days"
    ),
    "state_metrics_from_fact": _daily(_settled("q5", *_Q5_DOUBLES)),
    "state_metrics_per_day": _daily(f"""
SELECT * REPLACE ({", ".join(f"round({d}, 8) AS {d}" for d in _Q5_DOUBLES)}) FROM (
  SELECT q5.* EXCLUDE (same_weekday_median_gtv, same_weekday_median_success_rate,
                       same_day_month_median_gtv, same_day_month_median_success_rate),
         w.m_gtv AS same_weekday_median_gtv, w.m_rate AS same_weekday_median_success_rate,
         m.m_gtv AS same_day_month_median_gtv, m.m_rate AS same_day_month_median_success_rate
  FROM q5
  LEFT JOIN (SELECT final_state, quantile_disc(gtv, 0.5) AS m_gtv,
                    quantile_disc(rate, 0.5) AS m_rate
             FROM s_days WHERE dayofweek(day) = 0 GROUP BY final_state) w
    ON w.final_state = q5.final_state
  LEFT JOIN (SELECT final_state, quantile_disc(gtv, 0.5) AS m_gtv,
                    quantile_disc(rate, 0.5) AS m_rate
             FROM s_days WHERE day(day) = 21 GROUP BY final_state) m
    ON m.final_state = q5.final_state)"""),
    "bound_dates": _sql(
        (_TABLES,),
        """
SELECT cust_bank_name, count(*) AS requests, CAST(sum(trans_amt) AS BIGINT) AS amount
FROM daily_requests
WHERE CAST(log_date_time AS DATE) BETWEEN DATE '2024-03-23' AND DATE '2024-04-21'
GROUP BY cust_bank_name""",
    ),
    "csv_hourly": _hourly("""
SELECT 'txn' AS source, hour, success_rate_anomaly AS flag, overall_success_rate AS rate FROM q3
UNION ALL
SELECT 'bio', hour, fa2_succ_flag, fa2_rate_yesterday FROM q4"""),
    "csv_states": _daily(
        _settled(
            "(SELECT *, 'all' AS export FROM q5 UNION ALL"
            " SELECT *, 'filtered' FROM q5 WHERE yesterday_gtv >= 1)",
            *_Q5_DOUBLES,
        )
    ),
    # overview reports
    "health_score": _hourly(
        """
SELECT round(txn, 8) AS txn_score, round(bio, 8) AS bio_score,
       round(txn * 0.7 + bio * 0.3, 8) AS overall_score FROM scores""",
        _SCORES,
    ),
    "health_bands": _hourly(_bands("scores", (95, 85)), _SCORES),
    "health_bands_basic": _hourly(_bands("basic_scores", (90, 80)), _SCORES),
    "gtv_pace": _hourly("""
SELECT round(g, 8) AS total_gtv, round(a, 8) AS avg_gtv_per_hour, round(m, 8) AS median_gtv,
       CASE WHEN g > m * 24 THEN 'up' WHEN g < m * 20 THEN 'down' ELSE 'flat' END AS pace
FROM (SELECT coalesce(sum(total_amount_cr), 0) AS g, avg(total_amount_cr) AS a,
             avg(median_amount_cr) AS m FROM q1)"""),
    "anomaly_count": _hourly("""
SELECT t AS txn_anomalies, b AS bio_anomalies, t + b AS total_anomalies,
       CASE WHEN t + b > 5 THEN 'red' WHEN t + b > 0 THEN 'yellow' ELSE 'green' END AS severity
FROM (SELECT (SELECT count(*) FROM q1 WHERE success_rate_anomaly <> 'normal') AS t,
             (SELECT count(*) FROM q2 WHERE fa2_succ_flag <> 'Normal') AS b)"""),
    "aggregator_means": _hourly("""
SELECT round(y, 8) AS avg_ybl_rate, round(n, 8) AS avg_nsdl_rate, round(yn, 8) AS avg_ybln_rate,
       round(by_, 8) AS avg_ybl_bio_rate, round(bn, 8) AS avg_nsdl_bio_rate
FROM (SELECT avg(ybl_success_rate) AS y, avg(nsdl_success_rate) AS n,
             avg(ybln_success_rate) AS yn FROM q3),
     (SELECT avg(ybl_rate_yesterday) AS by_, avg(nsdl_rate_yesterday) AS bn FROM q4)"""),
    "txn_totals": _hourly("""
SELECT CAST(coalesce(sum(total_txns), 0) AS BIGINT) AS total_transactions,
       CAST(coalesce(sum(success_txns), 0) AS BIGINT) AS success_transactions,
       round(coalesce(sum(total_amount_cr), 0), 8) AS total_gtv,
       round(avg(total_amount_cr), 8) AS avg_gtv_per_hour, max(hour) AS last_hour FROM q3"""),
    "bio_totals": _hourly("""
SELECT CAST(coalesce(sum(total_attempts), 0) AS BIGINT) AS total_bio_attempts,
       CAST(coalesce(sum(successful_attempts), 0) AS BIGINT) AS successful_bio_attempts FROM q4"""),
    "data_coverage": _hourly("""
SELECT CASE WHEN (SELECT count(*) FROM q3) > 0 AND (SELECT count(*) FROM q4) > 0
            THEN 'Complete' ELSE 'Partial' END AS data_coverage"""),
    "hour_range": _hourly(
        _settled("q3", *_Q3_DOUBLES) + " WHERE hour BETWEEN '09:00' AND '17:00'"
    ),
    "txn_anomalies": _hourly("""
SELECT hour, success_rate_anomaly, overall_success_rate FROM q3
WHERE success_rate_anomaly <> 'normal'"""),
    "bio_anomalies": _hourly("""
SELECT hour, fa2_succ_flag, fa2_rate_yesterday FROM q4 WHERE fa2_succ_flag LIKE '%Anomaly%'"""),
    "bio_anomalies_basic": _hourly("""
SELECT hour, fa2_succ_flag, fa2_rate_yesterday FROM q2 WHERE fa2_succ_flag <> 'Normal'"""),
    "gtv_anomaly_k": _hourly("""
SELECT hour, round(total_amount_cr, 8) AS total_amount_cr,
       CASE WHEN total_amount_cr < avg_amount_cr - stddev_amount_cr THEN 'low' ELSE 'high' END
         AS amount_cr_anomaly
FROM q3
WHERE total_amount_cr < avg_amount_cr - stddev_amount_cr
   OR total_amount_cr > avg_amount_cr + stddev_amount_cr"""),
    "volume_status": _hourly("""
SELECT h AS last_hour, c AS current_volume, round(a, 8) AS avg_volume,
       CASE WHEN c > a * 1.2 THEN 'High' WHEN c < a * 0.8 THEN 'Low' ELSE 'Normal' END
         AS volume_status
FROM (SELECT max(hour) AS h, arg_max(total_txns, hour) AS c, avg(total_txns) AS a FROM q3)"""),
    "failed_txns": _hourly(
        "SELECT hour, success_txns, total_txns - success_txns AS failed_txns FROM q3"
    ),
    "failed_summary": _hourly("""
SELECT s AS total_success, f AS total_failed,
       round(coalesce(s / nullif(s + f, 0) * 100, 0), 8) AS success_pct,
       round(100 - coalesce(s / nullif(s + f, 0) * 100, 0), 8) AS failed_pct
FROM (SELECT CAST(coalesce(sum(success_txns), 0) AS BIGINT) AS s,
             CAST(coalesce(sum(total_txns - success_txns), 0) AS BIGINT) AS f FROM q3)"""),
    "success_range": _hourly("""
SELECT round(avg(overall_success_rate), 8) AS avg_success_rate,
       min(overall_success_rate) AS min_success_rate,
       max(overall_success_rate) AS max_success_rate FROM q3"""),
    "txn_detail": _hourly("""
SELECT hour, overall_success_rate, round_even(total_amount_cr, 2) AS total_amount_cr,
       success_txns, ybl_success_rate, nsdl_success_rate FROM q3"""),
    "bio_detail": _hourly("""
SELECT hour, fa2_rate_yesterday, nsdl_rate_yesterday, ybl_rate_yesterday,
       per_user_rate_yesterday FROM q4"""),
    "aggregator_long": _hourly("""
SELECT hour, 'YBL' AS aggregator, ybl_success_rate AS rate FROM q3
UNION ALL SELECT hour, 'NSDL', nsdl_success_rate FROM q3
UNION ALL SELECT hour, 'YBLN', ybln_success_rate FROM q3"""),
    "bio_aggregator_long": _hourly(
        "SELECT hour, 'NSDL' AS aggregator, nsdl_rate_yesterday AS rate FROM q4"
    ),
    "txn_vs_mean_series": _hourly(_series("q3", {
        "success_rate": ("overall_success_rate", "avg_success_rate"),
        "gtv": ("total_amount_cr", "avg_amount_cr"),
    })),
    "txn_vs_median_series": _hourly(_series("q1", {
        "success_rate": ("overall_success_rate", "median_success_rate"),
        "gtv": ("total_amount_cr", "median_amount_cr"),
        "success_txns": ("success_txns", "median_success_txns"),
    })),
    "bio_vs_median_series": _hourly(_series("q4", {
        "success_rate": ("fa2_rate_yesterday", "median_fa2_succ_rate"),
        "per_user_rate": ("per_user_rate_yesterday", "median_fa2_per_user_rate"),
    })),
    # state reports
    "top_gainers": _daily(_MOVERS.format("gainers")),
    "top_decliners": _daily(_MOVERS.format("decliners")),
    "gainer_table": _daily("""
SELECT final_state AS "State", round_even(yesterday_gtv, 2) AS "Yesterday (Cr)",
       round_even(median_90d_gtv, 2) AS "90d Median (Cr)",
       round_even(gtv_vs_median_ratio * 100, 1) AS "% vs Median"
FROM gainers"""),
    "share_table": _daily("""
SELECT final_state AS "State", round_even(yesterday_gtv, 2) AS "GTV (Cr)",
       round_even(percentage, 2) AS "Share (%)"
FROM folded"""),
    "top10_state_trend": _daily(
        _settled("q6", *_TREND_DOUBLES)
        + """
WHERE final_state IN (SELECT final_state FROM q6 GROUP BY final_state
                      ORDER BY avg(gtv) DESC NULLS LAST, final_state LIMIT 10)"""
    ),
    "available_states": _daily("SELECT DISTINCT final_state FROM q6"),
    "state_detail_30d": _daily("""
SELECT date, final_state, round(gtv, 8) AS gtv, transactions,
       round(success_rate, 8) AS success_rate,
       round(coalesce((SELECT median_90d_gtv FROM q5 WHERE final_state = 'NATION_10'), 0), 8)
         AS median_90d_gtv
FROM q7 WHERE final_state = 'NATION_10'"""),
    "state_summary": _daily("""
SELECT count(*) AS total_states, count(*) FILTER (WHERE yesterday_gtv > 0) AS active_states,
       round(coalesce(sum(yesterday_gtv), 0), 8) AS total_gtv,
       round(avg(yesterday_success_rate), 8) AS avg_success FROM q5"""),
    "top_states": _daily("""
SELECT final_state, round(yesterday_gtv, 8) AS yesterday_gtv FROM q5
ORDER BY q5.yesterday_gtv DESC NULLS LAST, final_state LIMIT 10"""),
    "state_share_others": _daily(_settled("folded", "yesterday_gtv")),
    "state_variation": _daily("""
SELECT final_state, round(yesterday_gtv, 8) AS yesterday_gtv,
       round(median_90d_gtv, 8) AS median_90d_gtv, variation,
       CASE WHEN variation > 10 THEN 'above' ELSE 'below' END AS side
FROM variation WHERE variation > 10 OR variation < -10"""),
    "above_median": _daily("""
SELECT final_state, round_even(yesterday_gtv, 2) AS yesterday_gtv,
       round_even(median_90d_gtv, 2) AS median_90d_gtv, variation
FROM variation WHERE variation > 10"""),
    "below_median": _daily("""
SELECT final_state, round_even(yesterday_gtv, 2) AS yesterday_gtv,
       round_even(median_90d_gtv, 2) AS median_90d_gtv, variation
FROM variation WHERE variation < -10"""),
    "state_threshold": _daily(
        _settled(
            "threshold", "yesterday_gtv", "median_90d_gtv", "stddev_90d_gtv",
            "lower_threshold", "upper_threshold",
        )
    ),
    "below_one_sigma": _daily("""
SELECT final_state, round_even(yesterday_gtv, 2) AS yesterday_gtv,
       round_even(lower_threshold, 2) AS lower_threshold,
       round_even(median_90d_gtv, 2) AS median_90d_gtv
FROM threshold WHERE status = 'Below 1σ'"""),
    "above_one_sigma": _daily("""
SELECT final_state, round_even(yesterday_gtv, 2) AS yesterday_gtv,
       round_even(upper_threshold, 2) AS upper_threshold,
       round_even(median_90d_gtv, 2) AS median_90d_gtv
FROM threshold WHERE status = 'Above 1σ'"""),
    "state_filter": _daily(
        _settled("q5", *_Q5_DOUBLES) + " WHERE yesterday_gtv >= 1 AND yesterday_success_rate >= 75"
    ),
    "state_table": _daily("""
SELECT final_state AS "State", round_even(yesterday_gtv, 2) AS "Yesterday GTV (Cr)",
       yesterday_transactions AS "Transactions",
       round_even(yesterday_success_rate, 2) AS "Success Rate (%)",
       round_even(median_90d_gtv, 2) AS "90d Median GTV (Cr)",
       round_even(median_90d_success_rate, 2) AS "90d Median Success (%)",
       round_even(gtv_vs_median_ratio, 2) AS "GTV vs Median Ratio"
FROM q5"""),
    # bank reports
    "bank_table": _daily("""
SELECT cust_bank_name, transaction_count, round_even(gtv, 2) AS gtv,
       round_even(trans_percentage, 2) AS trans_percentage FROM q9"""),
    "default_state_banks": _daily(
        _settled("q10", "gtv", "trans_percentage")
        + " WHERE final_state = (SELECT final_state FROM default_state)"
    ),
    "state_90d_series": _daily("""
SELECT date, final_state, round(gtv, 8) AS gtv, round(success_rate, 8) AS trans_percentage
FROM q11 WHERE final_state = (SELECT final_state FROM default_state)"""),
    # closed hours of the streams, which wait 10 minutes for late rows and, for metrics, for
    # the answers of the next hour
    "stream_hourly_metrics": _sql(
        (_TABLES, _ANSWERED),
        "SELECT strftime(h, '%Y-%m-%d %H:%M') AS hour_start, "
        + ", ".join(
            f"count(*) FILTER (WHERE {mine}) AS {name}_txns,"
            f" count(*) FILTER (WHERE {mine} AND ok) AS {name}_success,"
            f" round(coalesce(sum(trans_amt) FILTER (WHERE {mine} AND ok), 0) / 1e7, 8)"
            f" AS {name}_gtv"
            for name, mine in (
                ("total", "true"), ("ybl", "agg = 'ybl'"), ("nsdl", "agg = 'nsdl'"),
                ("ybln", "agg = 'ybln'"),
            )
        )
        + """
FROM answered
WHERE h + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE
GROUP BY h""",
    ),
    "stream_hourly_latest_update": _sql(
        (_TABLES,),
        """
SELECT strftime(date_trunc('hour', op_time), '%Y-%m-%d %H:%M') AS hour_start, request_id,
       arg_max(message, op_time) AS message
FROM txn_responses
WHERE op_name = 'UPDATE' AND date_trunc('hour', op_time) + INTERVAL 1 HOUR
      <= (SELECT max(op_time) FROM txn_responses WHERE op_name = 'UPDATE') - INTERVAL 10 MINUTE
GROUP BY date_trunc('hour', op_time), request_id""",
    ),
    # requests without an answer for 10 minutes, as far as the stream has come
    "stream_latest_update": _sql(
        (_TABLES,),
        """
SELECT request_id, epoch_us(op_time) AS op_micros, message
FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY op_time DESC, message DESC NULLS LAST) AS rn
      FROM txn_responses WHERE op_name = 'UPDATE')
WHERE rn = 1 AND op_time + INTERVAL 10 MINUTE
      <= (SELECT max(op_time) FROM txn_responses WHERE op_name = 'UPDATE') - INTERVAL 10 MINUTE""",
    ),
    "stream_active_users": _sql(
        (_TABLES,),
        """
SELECT strftime(date_trunc('hour', op_time), '%Y-%m-%d %H:%M') AS hour_start,
       count(DISTINCT client_id) AS active_users
FROM bio_log
WHERE date_trunc('hour', op_time) + INTERVAL 1 HOUR
      <= (SELECT max(op_time) FROM bio_log) - INTERVAL 10 MINUTE
GROUP BY date_trunc('hour', op_time)""",
    ),
}

# Statistics of single requests, and distinct clients.
_EIGHT_DAYS = "DATE '2024-01-23' AND DATE '2024-01-30'"
ORACLE["amount_statistics"] = _sql(
    (_TABLES,),
    f"""
SELECT aggregator, master_trans_type, count(*) AS txns,
       round(CAST(sum(trans_amt) AS DOUBLE) / count(*), 3) AS mean_amount,
       round(stddev_samp(trans_amt), 3) AS spread_amount,
       quantile_disc(trans_amt, 0.5) AS median_amount
FROM txn_requests WHERE CAST(op_time AS DATE) BETWEEN {_EIGHT_DAYS} AND trans_amt IS NOT NULL
GROUP BY ALL""",
)
ORACLE["users_from_sketches"] = _sql(
    (_TABLES,),
    f"""
SELECT CAST(op_time AS DATE) AS day, count(DISTINCT client_id) AS clients, true AS near
FROM bio_log WHERE CAST(op_time AS DATE) BETWEEN {_EIGHT_DAYS} GROUP BY ALL""",
)

# The same results by another way: from a kept fact, from a stream, observed.
ORACLE |= {
    f"kept_{name}": ORACLE[name]
    for name in ("state_metrics", "state_10d_trend", "state_30d_trend", "bank_state_90d_trend")
}
ORACLE |= {
    "stream_txn_page": ORACLE["txn_hourly_health"], "stream_bio_page": ORACLE["bio_hourly_health"],
    "data_coverage_observed": ORACLE["data_coverage"],
}
