"""The registered queries in plain SQL, for a side-by-side check on the same tables."""

from __future__ import annotations

ORACLE_SQL: dict[str, str] = {}

LINES = """lines AS (
  SELECT *, l_quantity AS stay_days, l_extendedprice::DECIMAL(12,2) AS gross,
         l_extendedprice::DECIMAL(12,2) * (1 - l_discount::DECIMAL(4,2)) AS cost,
         round(l_discount * 100) * 10 AS score, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS flag,
         round(l_tax * 100) * 10 AS wait
  FROM lineitem)"""
DEPARTMENT_LINES = f"""{LINES}, dl AS (
  SELECT lines.*, n_name AS department, n_nationkey FROM lines
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""
SURVEYS = "surveys AS (SELECT doc_id, quality * 60 + toxic * 25 + doc_id / 1000.0::DOUBLE AS score FROM labels)"
STAYED = f"""{SURVEYS}, waited AS (
  SELECT s.score, d.n_chars / 100.0::DOUBLE AS wait FROM surveys s JOIN documents d ON s.doc_id = d.doc_id)"""
PATIENTS = """patients AS (
  SELECT c_custkey AS patient_id, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS insurance_type,
         DATE '1998-01-01' - floor(c_acctbal * 3)::INTEGER AS date_of_birth FROM customer)"""
RAW_LABELS = """raw AS (
  SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey % 2 = 1 THEN lower(n_name) ELSE n_name END AS raw_label, n_name
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
MEASURED = f"""{LINES}, f AS (
  SELECT l_linestatus, stay_days, wait, flag, gross, gross - cost AS margin,
         CASE WHEN wait > 0 THEN least(score, 90.0) END AS satisfaction,
         score > 0 AND score <= 40 AS rushed, score > 80 AND score <= 100 AS excellent FROM lines)"""
SCORED = f"""{LINES}, scored AS (
  SELECT flag, round((1 / (1 + exp(-(l_quantity * 0.04::DOUBLE - l_discount * 20))))::DECIMAL(38,10), 4)::DOUBLE AS score
  FROM lines)"""
DAY = "strftime({}, '%Y-%m-%d')"
MOMENT = "strftime({}, '%Y-%m-%d %H:%M:%S')"
HASH = "('0x' || substr(md5({}), 1, 13))::BIGINT"
ROW_KEY = "concat_ws('|', l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice)"


def r(value: str, digits: int) -> str:
    """Half-up rounding over a decimal, as in the jobs."""
    return f"round(({value})::DECIMAL(38,10), {digits})::DOUBLE"


def day(value: str) -> str:
    return DAY.format(value)


def sql(name: str, text: str) -> None:
    ORACLE_SQL[name] = text


# --- business questions -----------------------------------------------------------------------------------

sql("q1_scorecard", f"""WITH {LINES}, {SURVEYS}
SELECT count(*) AS total_admissions, {r('avg(stay_days)', 2)} AS avg_los_days,
  {r('100.0::DOUBLE * sum(flag) / count(*)', 2)} AS readmission_rate_pct, {r('avg(wait)', 1)} AS avg_wait_minutes,
  {r('avg(score)', 1)} AS avg_discharge_efficiency,
  (SELECT {r('avg(score)', 1)} FROM surveys) AS avg_satisfaction,
  (SELECT {r('sum(o_totalprice::DECIMAL(12,2))', 0)} FROM orders) AS gross_billings
FROM lines""")

sql("q4_occupancy", f"""WITH {DEPARTMENT_LINES}, beds AS (SELECT s_nationkey, count(*) AS staffed_beds FROM supplier GROUP BY 1)
SELECT department, staffed_beds, {r('sum(stay_days)', 1)} AS total_bed_days,
  {r('100 * sum(stay_days) / (staffed_beds * 1096.0::DOUBLE)', 1)} AS occupancy_rate_pct
FROM dl JOIN beds ON n_nationkey = s_nationkey GROUP BY department, staffed_beds""")

sql("q5_width_bucket", f"""WITH {LINES}
SELECT (CASE WHEN score < 0 THEN 0 WHEN score >= 100 THEN 6 ELSE floor(score / 20) + 1 END)::INTEGER AS efficiency_bucket,
  count(*) AS admissions, {r('100.0::DOUBLE * sum(flag) / count(*)', 2)} AS readmission_rate_pct
FROM lines GROUP BY 1""")

sql("q5_cut", f"""WITH {LINES}
SELECT CASE WHEN score <= 20 THEN '0-20' WHEN score <= 40 THEN '20-40' WHEN score <= 60 THEN '40-60'
            WHEN score <= 80 THEN '60-80' ELSE '80-100' END AS bucket,
  count(flag) AS admissions, {r('100 * avg(flag)', 2)} AS readmission_rate_pct
FROM lines WHERE score > 0 AND score <= 100 GROUP BY 1""")

sql("q6_weekend", f"""SELECT CASE WHEN isodow(ts) >= 6 THEN 'Weekend' ELSE 'Weekday' END AS day_type,
  {r('avg(value)', 1)} AS avg_wait_minutes, count(*) AS admissions FROM events GROUP BY 1""")

sql("q7_margin", f"""WITH {DEPARTMENT_LINES}
SELECT department, {r('sum(gross)', 0)} AS gross_billings, {r('sum(cost)', 0)} AS operating_cost,
  {r('sum(gross - cost)', 0)} AS gross_margin,
  {r('100 * sum(gross - cost)::DOUBLE / nullif(sum(gross), 0)::DOUBLE', 1)} AS margin_pct
FROM dl GROUP BY department""")

sql("q8_cost_by_type", f"""WITH {LINES}
SELECT p_type AS procedure, count(*) AS times_performed, {r('sum(gross)::DOUBLE / count(gross)', 2)} AS avg_cost
FROM lines JOIN part ON l_partkey = p_partkey GROUP BY 1""")

sql("q9_case", f"""WITH {STAYED}
SELECT CASE WHEN wait < 15 THEN '<15 min' WHEN wait < 30 THEN '15-30 min' WHEN wait < 60 THEN '30-60 min'
            ELSE '60+ min' END AS wait_band,
  {r('avg(score)', 1)} AS avg_satisfaction, count(*) AS responses FROM waited GROUP BY 1""")

sql("q9_cut", f"""WITH {STAYED}
SELECT CASE WHEN wait <= 15 THEN '<15 min' WHEN wait <= 30 THEN '15-30 min' WHEN wait <= 60 THEN '30-60 min'
            ELSE '60+ min' END AS wait_band,
  {r('avg(score)', 1)} AS avg_satisfaction, count(score) AS responses
FROM waited WHERE wait > -1 AND wait <= 10000 GROUP BY 1""")

sql("q10_load", f"""SELECT CASE WHEN s_acctbal < 0 THEN 'Contract' WHEN s_acctbal < 3000 THEN 'Part-Time' ELSE 'Full-Time' END
    AS employment_status,
  count(DISTINCT s_suppkey) AS doctor_count, count(l_orderkey) AS total_admissions,
  {r('count(l_orderkey)::DOUBLE / count(DISTINCT s_suppkey)', 1)} AS admissions_per_doctor
FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1""")

sql("x3_group_table", f"""WITH {DEPARTMENT_LINES}, t AS (
  SELECT department, count(*) AS admissions, {r('avg(stay_days)', 2)} AS avg_los,
    {r('100.0::DOUBLE * sum(flag) / count(*)', 2)} AS readmission_rate_pct FROM dl GROUP BY 1)
SELECT *, readmission_rate_pct > (SELECT {r('100.0::DOUBLE * sum(flag) / count(*)', 2)} FROM dl) AS above_network FROM t""")

sql("x4_financials", f"""WITH {DEPARTMENT_LINES}
SELECT department, {r('sum(gross)', 0)} AS gross_billings, {r('sum(gross - cost)', 0)} AS gross_margin
FROM dl GROUP BY department""")

sql("x5_share", f"""SELECT o_orderpriority AS admission_type, count(*) AS admissions,
  {r('100.0::DOUBLE * count(*) / (SELECT count(*) FROM orders)', 1)} AS share_pct FROM orders GROUP BY 1""")

sql("x6_unknown_mix", f"""WITH {PATIENTS}
SELECT coalesce(insurance_type, 'Unknown') AS insurance_type, count(*) AS patients FROM patients GROUP BY 1""")

sql("i1_relative_risk", f"""WITH {LINES}, rates AS (
  SELECT avg(CASE WHEN score > 0 AND score <= 40 THEN flag END) AS e,
         avg(CASE WHEN score > 80 AND score <= 100 THEN flag END) AS b FROM lines)
SELECT {r('e * 100', 1)} AS exposed_rate_pct, {r('b * 100', 1)} AS baseline_rate_pct,
  {r('e / nullif(b, 0)', 2)} AS relative_risk FROM rates""")

sql("i2_gap_pct", f"""WITH m AS (SELECT avg(value) FILTER (WHERE isodow(ts) >= 6) AS w,
    avg(value) FILTER (WHERE isodow(ts) < 6) AS d FROM events)
SELECT {r('d', 1)} AS weekday_avg, {r('w', 1)} AS weekend_avg, {r('100 * (w - d) / nullif(d, 0)', 2)} AS gap_pct FROM m""")

# --- dashboard measures -----------------------------------------------------------------------------------

sql("t1_measures", f"""WITH {MEASURED}
SELECT l_linestatus, count(*) AS total_admissions, {r('avg(stay_days)', 6)} AS avg_length_of_stay,
  {r('avg(wait)', 6)} AS avg_triage_wait, {r('avg(satisfaction)', 6)} AS avg_satisfaction,
  {r('sum(gross)', 6)} AS gross_billings FROM f GROUP BY 1""")

sql("t2_rate_measure", f"""WITH {MEASURED}
SELECT count(*) AS total_admissions,
  {r('100.0::DOUBLE * count(*) FILTER (WHERE flag = 1) / count(*)', 6)} AS readmission_rate_pct FROM f""")

sql("t3_margin_fraction", f"""WITH {MEASURED}
SELECT l_linestatus, {r('sum(margin)', 6)} AS gross_margin,
  {r('sum(margin)::DOUBLE / nullif(sum(gross), 0)::DOUBLE', 6)} AS margin_fraction FROM f GROUP BY 1""")

sql("t4_bucket_rates", f"""WITH {MEASURED}, x AS (
  SELECT l_linestatus, 100.0::DOUBLE * avg(flag) FILTER (WHERE rushed) AS a,
    100.0::DOUBLE * avg(flag) FILTER (WHERE excellent) AS b FROM f GROUP BY 1)
SELECT l_linestatus, {r('a', 6)} AS rushed_rate_pct, {r('b', 6)} AS excellent_rate_pct,
  {r('a / nullif(b, 0)', 6)} AS relative_risk FROM x""")

# --- trends -----------------------------------------------------------------------------------------------

TREND = """counts AS (SELECT date_trunc('month', o_orderdate)::DATE AS m, count(*) AS n FROM orders GROUP BY 1), trend AS (
  SELECT m, n, n - lag(n) OVER (ORDER BY m) AS mom, avg(n) OVER w AS ma, count(*) OVER w AS k
  FROM counts WINDOW w AS (ORDER BY m ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))"""
TREND_COLUMNS = f"""{day('m')} AS admission_month, n AS admissions_count, mom AS mom_change,
  CASE WHEN k >= {{}} THEN {r('ma', 1)} END AS moving_avg_3m"""
SHIPPED = """daily AS (SELECT l_shipdate::DATE AS d, count(*) AS n FROM lineitem GROUP BY 1), monthly AS (
  SELECT date_trunc('month', d)::DATE AS m, sum(n)::BIGINT AS n, count(*) AS days FROM daily GROUP BY 1), months AS (
  SELECT unnest(generate_series((SELECT min(m) FROM monthly)::TIMESTAMP, (SELECT max(m) FROM monthly)::TIMESTAMP,
    INTERVAL 1 MONTH))::DATE AS m), filled AS (
  SELECT m, coalesce(n, 0) AS n, coalesce(days, 0) AS days FROM months LEFT JOIN monthly USING (m))"""

sql("q2_trend_partial", f"WITH {TREND} SELECT {TREND_COLUMNS.format(1)} FROM trend")
sql("q2_trend_full", f"WITH {TREND} SELECT {TREND_COLUMNS.format(3)} FROM trend")
sql("q2_tail6", f"WITH {TREND} SELECT {TREND_COLUMNS.format(3)} FROM trend ORDER BY m DESC LIMIT 6")
sql("x2_month_label", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS admissions FROM orders GROUP BY 1")
sql("v1_gapfilled_months", f"WITH {SHIPPED} SELECT {day('m')} AS month, n AS admissions FROM filled")
sql("t5_calendar_shift", f"""WITH {SHIPPED}
SELECT {day('a.m')} AS month, a.n AS admissions, b.n AS prior_month, a.n - coalesce(b.n, 0) AS mom_change
FROM filled a LEFT JOIN filled b ON b.m = a.m - INTERVAL 1 MONTH""")
sql("t6_daily_trailing", f"""WITH {SHIPPED}
SELECT {day('a.m')} AS month, {r('(SELECT avg(n) FROM daily WHERE d >= a.m - INTERVAL 2 MONTH AND d < a.m + INTERVAL 1 MONTH)', 4)}
  AS moving_avg_daily FROM months a""")
sql("t7_calendar", f"""WITH days AS (SELECT unnest(generate_series((SELECT min(o_orderdate) FROM orders),
  (SELECT max(o_orderdate) FROM orders), INTERVAL 1 DAY)) AS d)
SELECT {day('d')} AS date, year(d)::INTEGER AS year, month(d)::INTEGER AS month, isodow(d) >= 6 AS is_weekend FROM days""")

# --- outliers and distributions ---------------------------------------------------------------------------

OUTLIERS = f"""stats AS (SELECT event_type, avg(value) AS a, stddev_samp(value) AS s FROM events GROUP BY 1), outliers AS (
  SELECT event_id, e.event_type, value, {r('(value - a) / nullif(s, 0)', 2)} AS z_score
  FROM events e JOIN stats ON e.event_type = stats.event_type WHERE value > a + 3 * s)"""
sql("q3_outliers", f"WITH {OUTLIERS} SELECT * FROM outliers")
sql("q3_top_group", f"""WITH {OUTLIERS} SELECT (SELECT count(*) FROM outliers) AS n_outliers,
  (SELECT event_type FROM outliers GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 1) AS top_group""")
sql("v2_box", f"""WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS md,
    quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1), m AS (
  SELECT e.event_type, value, q1, md, q3, value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
  FROM events e JOIN q ON e.event_type = q.event_type)
SELECT event_type, count(*) AS n, {r('min(value) FILTER (WHERE inside)', 4)} AS whisker_low, {r('any_value(q1)', 4)} AS q1,
  {r('any_value(md)', 4)} AS median, {r('any_value(q3)', 4)} AS q3, {r('max(value) FILTER (WHERE inside)', 4)} AS whisker_high,
  count(*) FILTER (WHERE NOT inside) AS n_outliers FROM m GROUP BY 1""")
BUCKET4 = """CASE WHEN score <= 0 OR score > 100 THEN NULL WHEN score <= 40 THEN 'Rushed (0-40)'
  WHEN score <= 60 THEN 'Below Avg (40-60)' WHEN score <= 80 THEN 'Good (60-80)' ELSE 'Excellent (80-100)' END"""
sql("v3_rate_by_bucket", f"""WITH {LINES}
SELECT {BUCKET4} AS bucket, {r('100 * avg(flag)', 4)} AS rate_pct FROM lines WHERE score > 0 AND score <= 100 GROUP BY 1""")
sql("v4_band_mean", f"""WITH {STAYED}
SELECT CASE WHEN wait <= 15 THEN '<15' WHEN wait <= 30 THEN '15-30' WHEN wait <= 60 THEN '30-60' ELSE '60+' END AS wait_band,
  {r('avg(score)', 1)} AS avg_satisfaction, count(score) AS responses
FROM waited WHERE wait > 0 AND wait <= 10000 GROUP BY 1""")
sql("v5_mix", "SELECT o_orderpriority, " + ", ".join(
    r(f"100.0::DOUBLE * count(*) FILTER (WHERE o_orderstatus = '{v}') / count(*)", 4) + f' AS "{v}"' for v in "FOP"
) + " FROM orders GROUP BY 1")
FIELDS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "flag"]
sql("v6_corr", f"WITH {LINES} " + " UNION ALL ".join(
    f"SELECT '{a}' AS field_a, '{b}' AS field_b, "
    + r(f"covar_samp({a}, {b}) / nullif(stddev_samp({a}) * stddev_samp({b}), 0)", 6)
    + " AS corr FROM lines" for a in FIELDS for b in FIELDS
))
sql("d13_describe", " UNION ALL ".join(
    f"SELECT '{c}' AS field, count({c}) AS n, {r(f'avg({c})', 4)} AS mean, {r(f'stddev_samp({c})', 4)} AS std, "
    f"{r(f'min({c})', 4)} AS min, {r(f'quantile_cont({c}, 0.25)', 4)} AS q25, {r(f'quantile_cont({c}, 0.5)', 4)} AS q50, "
    f"{r(f'quantile_cont({c}, 0.75)', 4)} AS q75, {r(f'max({c})', 4)} AS max FROM lineitem" for c in FIELDS[:4]
))
sql("d14_value_counts", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
sql("d15_shares", f"SELECT toxic, {r('count(*)::DOUBLE / (SELECT count(*) FROM labels)', 4)} AS share FROM labels GROUP BY 1")

# --- data quality -----------------------------------------------------------------------------------------

DUPLICATES = "d AS (SELECT l_orderkey, l_linenumber, count(*) AS occurrences FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)"
LINE_COLUMNS = f"l_orderkey, l_linenumber, {MOMENT.format('l_shipdate')} AS l_shipdate, l_partkey, l_suppkey, l_extendedprice"
sql("j1_dup_keys", f"WITH {DUPLICATES} SELECT * FROM d")
sql("e5_dup_members", f"WITH {DUPLICATES} SELECT {LINE_COLUMNS} FROM lineitem SEMI JOIN d USING (l_orderkey, l_linenumber)")
sql("f3_dup_preview", f"""WITH {DUPLICATES} SELECT {LINE_COLUMNS} FROM lineitem SEMI JOIN d USING (l_orderkey, l_linenumber)
ORDER BY l_orderkey, l_linenumber, lineitem.l_shipdate, l_partkey, l_suppkey, l_extendedprice LIMIT 6""")
sql("j2_bad_rows", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal <= 0")
sql("h12_bad_share", f"""SELECT count(*) FILTER (WHERE c_acctbal <= 0) AS n_bad,
  {r('100.0::DOUBLE * count(*) FILTER (WHERE c_acctbal <= 0) / count(*)', 2)} AS bad_pct FROM customer""")
sql("j3_variants", f"WITH {RAW_LABELS} SELECT DISTINCT raw_label FROM raw")
sql("j4_missing", f"""WITH {SURVEYS}
SELECT count(*) - count(score) AS missing_satisfaction_score, count(*) - count(lang) AS missing_lang, count(*) AS total_rows
FROM documents LEFT JOIN surveys USING (doc_id)""")
sql("j5_orphans", "SELECT o_orderkey, o_custkey FROM orders ANTI JOIN lineitem ON o_orderkey = l_orderkey")
PATIENT_TYPES = {"patient_id": "bigint", "insurance_type": "string", "date_of_birth": "date"}
sql("a10_schema_info", f"WITH {PATIENTS} " + " UNION ALL ".join(
    f"SELECT '{c}' AS field, '{kind}' AS dtype, count({c}) AS n_non_null FROM patients" for c, kind in PATIENT_TYPES.items()
))
sql("d16_nulls", f"WITH {PATIENTS} " + " UNION ALL ".join(
    f"SELECT '{c}' AS field, count(*) - count({c}) AS n_null FROM patients" for c in PATIENT_TYPES
))
RULES = {
    "wait is positive": f"WITH {LINES} SELECT count(*) FROM lines WHERE NOT wait > 0",
    "shipment follows order": "SELECT count(*) FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey "
    "WHERE NOT coalesce(l_shipdate >= o_orderdate, false)",
    "stay between 1 and 50": "SELECT count(*) FROM lineitem WHERE NOT l_quantity BETWEEN 1 AND 50",
    "line key is unique": "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) FROM lineitem",
    "order key is unique": "SELECT count(*) - count(DISTINCT o_orderkey) FROM orders",
    "flag is 0 or 1": f"WITH {LINES} SELECT count(DISTINCT flag) FROM lines WHERE flag NOT IN (0, 1)",
    "return flag is A or N": "SELECT count(DISTINCT l_returnflag) FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')",
}
FOREIGN_KEYS = [
    ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("orders", "o_custkey", "customer", "c_custkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("documents", "doc_id", "labels", "doc_id"),
]


def rule_table(rules: dict[str, str]) -> str:
    parts = [f"SELECT '{name}' AS rule, ({text}) AS violations" for name, text in rules.items()]
    return f"SELECT rule, violations, violations = 0 AS passed FROM ({' UNION ALL '.join(parts)})"


sql("j12_rules", rule_table(RULES))
sql("j13_fk", rule_table({
    f"{c}.{fk} -> {p}.{pk}": f"SELECT count(*) FROM {c} WHERE {fk} NOT IN (SELECT {pk} FROM {p})" for c, fk, p, pk in FOREIGN_KEYS
}))
sql("j14_reconcile_keys", """WITH l AS (SELECT o_orderkey AS k, count(*) AS n FROM orders GROUP BY 1),
  r AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1)
SELECT (SELECT count(*) FROM orders) AS left_rows, (SELECT count(*) FROM lineitem) AS right_rows,
  count(*) FILTER (WHERE r.k IS NULL) AS only_left, count(*) FILTER (WHERE l.k IS NULL) AS only_right,
  count(*) FILTER (WHERE coalesce(l.n, 0) <> coalesce(r.n, 0)) = 0 AS matches
FROM l FULL JOIN r ON l.k = r.k""")
sql("j15_reconcile_metrics", f"""WITH {DEPARTMENT_LINES}, direct AS (
  SELECT count(*)::DOUBLE AS n, sum(gross)::DOUBLE AS g, max(l_quantity)::DOUBLE AS p FROM lines), parts AS (
  SELECT count(*) AS n, sum(gross) AS g FROM dl GROUP BY department), rolled AS (
  SELECT sum(n)::DOUBLE AS n, sum(g)::DOUBLE AS g, max(n)::DOUBLE AS p FROM parts), both_sides AS (
  SELECT 'rows' AS metric, direct.n AS left_value, rolled.n AS right_value FROM direct, rolled
  UNION ALL SELECT 'gross', direct.g, rolled.g FROM direct, rolled
  UNION ALL SELECT 'peak', direct.p, rolled.p FROM direct, rolled)
SELECT *, left_value IS NOT DISTINCT FROM right_value AS agrees FROM both_sides""")
sql("j7_removed", f"""WITH k AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
SELECT sum(n)::BIGINT AS total_rows, sum(n - 1)::BIGINT AS surplus_rows,
  {r('100 * sum(n - 1)::DOUBLE / sum(n)', 2)} AS surplus_pct FROM k""")

# --- cleaning ---------------------------------------------------------------------------------------------

sql("j7_dedupe_first", f"""WITH f AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS place FROM lineitem)
SELECT {LINE_COLUMNS}, l_quantity FROM f WHERE place = 1""")
sql("j8_impute_median", f"""WITH m AS (SELECT c_nationkey, median(c_acctbal) AS md FROM customer WHERE c_acctbal > 0 GROUP BY 1)
SELECT c_custkey, customer.c_nationkey, {r('CASE WHEN c_acctbal <= 0 THEN md ELSE c_acctbal END', 4)} AS c_acctbal
FROM customer LEFT JOIN m ON customer.c_nationkey = m.c_nationkey""")
sql("j9_canonical", f"WITH {RAW_LABELS} SELECT s_suppkey, s_nationkey, n_name AS label FROM raw")
sql("j9_audit", f"WITH {RAW_LABELS} SELECT s_suppkey, s_nationkey, n_name AS label, raw_label FROM raw")
FENCES = """q AS (SELECT quantile_cont(value, 0.25) AS v1, quantile_cont(value, 0.75) AS v3,
  quantile_cont(user_id::DOUBLE, 0.25) AS u1, quantile_cont(user_id::DOUBLE, 0.75) AS u3 FROM events), fence AS (
  SELECT v1 - 3 * (v3 - v1) AS vl, v3 + 3 * (v3 - v1) AS vh, u1 - 3 * (u3 - u1) AS ul, u3 + 3 * (u3 - u1) AS uh FROM q)"""
sql("j10_iqr_clip", f"""WITH {FENCES}
SELECT event_id, {r('greatest(least(value, vh), vl)', 4)} AS value, greatest(least(user_id::DOUBLE, uh), ul) AS user_id
FROM events, fence""")
sql("j10_clip_counts", f"""WITH {FENCES}
SELECT 'value' AS field, {r('any_value(vl)', 4)} AS low, {r('any_value(vh)', 4)} AS high,
  count(*) FILTER (WHERE value < vl OR value > vh) AS n_clipped FROM events, fence
UNION ALL SELECT 'user_id', {r('any_value(ul)', 4)}, {r('any_value(uh)', 4)},
  count(*) FILTER (WHERE user_id < ul OR user_id > uh) FROM events, fence""")

# --- features ---------------------------------------------------------------------------------------------

AGE = r("(o_orderdate::DATE - date_of_birth) / 365.25::DOUBLE", 1)
AGE_BAND = """CASE WHEN patient_age <= 0 OR patient_age > 120 THEN NULL WHEN patient_age <= 18 THEN '0-18'
  WHEN patient_age <= 35 THEN '19-35' WHEN patient_age <= 50 THEN '36-50' WHEN patient_age <= 65 THEN '51-65'
  WHEN patient_age <= 120 THEN '66+' END"""
sql("k1_age_band", f"""WITH {PATIENTS}, aged AS (SELECT o_orderkey, o_custkey AS patient_id, {AGE} AS patient_age
  FROM orders LEFT JOIN patients ON o_custkey = patient_id)
SELECT *, {AGE_BAND} AS age_group FROM aged""")
sql("k2_calendar", f"""SELECT o_orderkey, {MOMENT.format('o_orderdate')} AS o_orderdate,
  isodow(o_orderdate) >= 6 AS is_weekend_admission, month(o_orderdate)::INTEGER AS admission_month,
  month(o_orderdate) IN (12, 1, 2) AS is_flu_season FROM orders""")
CHILDREN = "c AS (SELECT l_orderkey, count(l_linenumber) AS n, sum(gross) AS cost FROM lines GROUP BY 1)"
BILLS = "b AS (SELECT l_orderkey, sum(gross) AS gross, sum(cost) AS cost FROM lines GROUP BY 1)"
sql("k3_children", f"""WITH {LINES}, {CHILDREN}
SELECT o_orderkey AS admission_id, coalesce(n, 0) AS treatment_count, coalesce(cost, 0)::DOUBLE AS total_treatment_cost
FROM orders LEFT JOIN c ON o_orderkey = l_orderkey""")
sql("k4_finance", f"""WITH {LINES}, {BILLS}
SELECT o_orderkey AS admission_id, floor(o_totalprice / 25000)::BIGINT AS stay, gross::DOUBLE AS gross_charge,
  (gross - cost)::DOUBLE AS margin, {r('gross::DOUBLE / nullif(floor(o_totalprice / 25000), 0)', 2)} AS cost_per_stay_day
FROM orders LEFT JOIN b ON o_orderkey = l_orderkey""")
sql("k5_survey", f"""WITH {SURVEYS} SELECT doc_id, score AS satisfaction_score FROM documents LEFT JOIN surveys USING (doc_id)""")
sql("d24_response_rate", f"""WITH {SURVEYS} SELECT {r('100.0::DOUBLE * count(score) / count(*)', 1)} AS response_rate_pct
FROM documents LEFT JOIN surveys USING (doc_id)""")
sql("k6_bucket", f"WITH {LINES} SELECT {BUCKET4} AS discharge_efficiency_bucket, count(*) AS n FROM lines GROUP BY 1")
sql("k7_features", f"""WITH {LINES}, {SURVEYS}, {PATIENTS}, {CHILDREN}, {BILLS}, stays AS (
  SELECT o_orderkey AS admission_id, o_custkey AS patient_id, c_nationkey AS department_id, n_name AS department,
    o_orderpriority AS admission_type, {r('o_totalprice / 50000', 1)} AS severity_score,
    floor(o_totalprice / 25000)::DOUBLE AS length_of_stay_days,
    (o_orderdate::DATE - DATE '1995-01-01') / 40.0::DOUBLE AS wait_minutes, {r('o_totalprice / 5000', 1)} AS score,
    CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS readmitted_30d, {AGE} AS patient_age, o_orderdate
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN patients ON o_custkey = patient_id)
SELECT admission_id, stays.patient_id, department_id, department, admission_type, severity_score, length_of_stay_days,
  wait_minutes, stays.score AS discharge_efficiency, {BUCKET4.replace('score', 'stays.score')} AS discharge_efficiency_bucket,
  readmitted_30d, patient_age, {AGE_BAND} AS age_group, isodow(o_orderdate) >= 6 AS is_weekend_admission,
  month(o_orderdate)::INTEGER AS admission_month, month(o_orderdate) IN (12, 1, 2) AS is_flu_season,
  coalesce(c.n, 0) AS treatment_count, coalesce(c.cost, 0)::DOUBLE AS total_treatment_cost, b.gross::DOUBLE AS gross_charge,
  (b.gross - b.cost)::DOUBLE AS margin, {r('b.gross::DOUBLE / nullif(length_of_stay_days, 0)', 2)} AS cost_per_stay_day,
  surveys.score AS satisfaction_score, {MOMENT.format('o_orderdate')} AS admission_date
FROM stays LEFT JOIN c ON admission_id = c.l_orderkey LEFT JOIN b ON admission_id = b.l_orderkey
LEFT JOIN surveys ON admission_id = surveys.doc_id""")

# --- table operators --------------------------------------------------------------------------------------

SAMPLED = int(0.012 * 16**13)
sql("r1_hash_sample", f"SELECT o_orderkey, o_custkey FROM orders WHERE {HASH.format('o_orderkey::VARCHAR')} < {SAMPLED}")
sql("r2_add_days", f"""SELECT o_orderkey, {MOMENT.format("o_orderdate + to_seconds(round(o_totalprice / 12345 * 86400)::BIGINT)")}
  AS discharge_date FROM orders""")
LINEAR = "-3.85::DOUBLE + (100 - o_totalprice / 5000) * 0.028::DOUBLE + (o_totalprice / 50000) * 0.18::DOUBLE"
sql("r3_logistic", f"SELECT o_orderkey, {r(f'1 / (1 + exp(-({LINEAR})))', 6)} AS risk FROM orders")
sql("r4_season_factor", f"""SELECT o_orderkey, {r('''(CASE month(o_orderdate) WHEN 12 THEN 1.35 WHEN 1 THEN 1.4 WHEN 2 THEN 1.25
  WHEN 7 THEN 0.85 WHEN 8 THEN 0.85 ELSE 1 END)::DOUBLE * (CASE WHEN isodow(o_orderdate) >= 6 THEN 1.15 ELSE 1 END)::DOUBLE''', 6)}
  AS factor FROM orders""")
sql("g2_union_all", f"""SELECT c_custkey, c_mktsegment FROM customer
UNION ALL SELECT c_custkey, c_mktsegment FROM customer WHERE {HASH.format('c_custkey::VARCHAR')} < {SAMPLED}""")
sql("h11_labels", """SELECT o_orderpriority, format('{:,}', count(*)) AS orders_label,
  format('${:.1f}M', sum(o_totalprice::DECIMAL(12,2))::DOUBLE / 1e6) AS gross_label FROM orders GROUP BY 1""")

# --- model ------------------------------------------------------------------------------------------------

sql("m2_split", f"""WITH {LINES}, h AS (SELECT *, {HASH.format(ROW_KEY)} AS hash, {ROW_KEY} AS key FROM lines), p AS (
  SELECT *, row_number() OVER (PARTITION BY flag ORDER BY hash, key) AS place, count(*) OVER (PARTITION BY flag) AS n FROM h)
SELECT flag, {LINE_COLUMNS}, CASE WHEN place <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM p""")
sql("m5_weights", f"""WITH {LINES}, c AS (SELECT flag, count(*) AS n FROM lines GROUP BY 1)
SELECT flag, n, {r('(SELECT sum(n) FROM c)::DOUBLE / ((SELECT count(*) FROM c) * n)', 8)} AS weight FROM c""")
sql("m7_auc", f"""WITH {SCORED}, g AS (
  SELECT score, sum(flag) AS pos, count(*) - sum(flag) AS neg FROM scored GROUP BY 1), w AS (
  SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
SELECT {r('sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)::DOUBLE)', 6)} AS auc FROM w""")
sql("m8_report", f"""WITH {SCORED}, p AS (SELECT flag, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS called FROM scored), k AS (
  SELECT c, (SELECT count(*) FROM p WHERE flag = c) AS support, (SELECT count(*) FROM p WHERE called = c) AS called,
    (SELECT count(*) FROM p WHERE flag = c AND called = c) AS hits FROM (SELECT unnest([0, 1]) AS c)), m AS (
  SELECT *, coalesce(hits::DOUBLE / nullif(called, 0), 0) AS precision, coalesce(hits::DOUBLE / nullif(support, 0), 0) AS recall FROM k), f AS (
  SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM m), u AS (
  SELECT c::VARCHAR AS "row", precision, recall, f1, support FROM f
  UNION ALL SELECT 'accuracy', sum(hits)::DOUBLE / sum(support), sum(hits)::DOUBLE / sum(support),
    sum(hits)::DOUBLE / sum(support), sum(support) FROM f
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM f
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
    sum(f1 * support) / sum(support), sum(support) FROM f)
SELECT "row", {r('precision', 6)} AS precision, {r('recall', 6)} AS recall, {r('f1', 6)} AS f1, support::BIGINT AS support FROM u""")
sql("m9_roc", f"""WITH {SCORED}, g AS (
  SELECT score, sum(flag) AS pos, count(*) - sum(flag) AS neg FROM scored GROUP BY 1), w AS (
  SELECT score, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp FROM g)
SELECT {r('fp::DOUBLE / (SELECT sum(neg) FROM g)', 6)} AS fpr, {r('tp::DOUBLE / (SELECT sum(pos) FROM g)', 6)} AS tpr,
  score AS threshold FROM w UNION ALL SELECT 0, 0, 'infinity'::DOUBLE""")

# --- sources and sinks ------------------------------------------------------------------------------------

sql("a_csv_roundtrip", f"""SELECT o_orderkey, o_custkey, o_totalprice, {MOMENT.format('o_orderdate')} AS o_orderdate,
  'a, "b" ' || o_orderpriority AS priority_note FROM orders""")
sql("a_json_roundtrip", f"WITH {PATIENTS} SELECT patient_id, insurance_type, {day('date_of_birth')} AS date_of_birth FROM patients")
sql("a5_json_document", "SELECT s_suppkey, s_acctbal FROM supplier")
sql("a_table_roundtrip", "SELECT l_orderkey, l_linenumber, l_quantity, l_linestatus FROM lineitem")
sql("a3_sql_scan", """SELECT n_name, count(*) AS suppliers, sum(s_acctbal::DECIMAL(12,2))::DOUBLE AS balance
FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""")
sql("a2_moments", f"SELECT event_id, {MOMENT.format('ts')} AS ts FROM events")

# --- slices, rules and profiles ---------------------------------------------------------------------------

sql("t1_by_year", f"""WITH {LINES}
SELECT year(l_shipdate)::INTEGER AS year, month(l_shipdate)::INTEGER AS month, n_regionkey, count(*) AS total_admissions,
  {r('avg(stay_days)', 6)} AS avg_length_of_stay, {r('sum(gross)', 6)} AS gross_billings,
  {r('sum(gross - cost)::DOUBLE / nullif(sum(gross), 0)::DOUBLE', 6)} AS margin_fraction
FROM lines JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3""")
sql("t7_calendar_span", f"""WITH days AS (SELECT unnest(generate_series(TIMESTAMP '1990-01-01',
  (SELECT max(o_orderdate)::DATE FROM orders)::TIMESTAMP, INTERVAL 1 DAY)) AS d)
SELECT {day('d')} AS date, year(d)::INTEGER AS year, month(d)::INTEGER AS month, isodow(d) >= 6 AS is_weekend FROM days""")
sql("v5_mix_long", f"""SELECT o_orderpriority, o_orderstatus,
  {r('100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority)', 4)} AS share_pct FROM orders GROUP BY 1, 2""")
sql("v4_band_mean_wide", f"""WITH {LINES}, banded AS (
  SELECT score, CASE WHEN stay_days > 0 AND stay_days <= 15 THEN '<15' WHEN stay_days > 15 AND stay_days <= 30 THEN '15-30'
    WHEN stay_days > 30 AND stay_days <= 60 THEN '30-60' WHEN stay_days > 60 AND stay_days <= 10000 THEN '60+' END AS wait_band FROM lines)
SELECT wait_band, {r('avg(score)', 1)} AS avg_satisfaction, count(score) AS responses FROM banded WHERE wait_band IS NOT NULL GROUP BY 1""")
sql("j11_clean_rules", """WITH bad AS (SELECT c_nationkey FROM customer WHERE NOT coalesce(c_acctbal > 0, false)), good AS (
  SELECT DISTINCT c_nationkey FROM customer WHERE c_acctbal > 0), found AS (
  SELECT 'line key is unique' AS rule, 0::BIGINT AS violations
  UNION ALL SELECT 'balance is positive', count(*) FROM bad WHERE c_nationkey NOT IN (SELECT c_nationkey FROM good)
  UNION ALL SELECT 'every supplier has a label', count(*) FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation))
SELECT rule, violations, violations = 0 AS passed FROM found""")
sql("j16_constraints", f"""WITH {PATIENTS}, found AS (
  SELECT 'segment is known' AS rule, count(*) FILTER (WHERE insurance_type NOT IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY')) AS violations FROM patients
  UNION ALL SELECT 'born before 2000', count(*) FILTER (WHERE date_of_birth >= DATE '2000-01-01') FROM patients
  UNION ALL SELECT 'patient is given', count(*) FILTER (WHERE patient_id IS NULL) FROM patients)
SELECT rule, violations, violations = 0 AS passed FROM found""")
_NUMBERS = {"patient_id": "patient_id", "year_of_birth": "year(date_of_birth)"}
sql("j6_profile", f"WITH {PATIENTS}, profile AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS field, '{kind}' AS dtype, count({c}) AS n_non_null, count(*) - count({c}) AS n_null FROM patients"
    for c, kind in (("patient_id", "bigint"), ("insurance_type", "string"), ("date_of_birth", "date"))
) + "), figures AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS field, count({e}) AS n, {r(f'avg({e})', 4)} AS mean, {r(f'stddev_samp({e})', 4)} AS std, {r(f'min({e})', 4)} AS min, "
    f"{r(f'quantile_cont({e}, 0.25)', 4)} AS q25, {r(f'quantile_cont({e}, 0.5)', 4)} AS q50, {r(f'quantile_cont({e}, 0.75)', 4)} AS q75, "
    f"{r(f'max({e})', 4)} AS max FROM patients" for c, e in _NUMBERS.items()
) + ") SELECT * FROM profile FULL JOIN figures USING (field)")

# --- model ------------------------------------------------------------------------------------------------

sql("m1_inputs", f"""WITH {PATIENTS} SELECT coalesce(insurance_type, '(missing)') AS insurance_type, patient_id::DOUBLE AS patient_id,
  (patient_id % 2)::DOUBLE AS readmitted FROM patients""")
CATEGORIES = ["p_type", "p_brand", "l_linestatus"]
sql("m3_categories", "WITH c AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS field, {c} AS category, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 2" for c in CATEGORIES
) + ") SELECT field, category, n, (row_number() OVER (PARTITION BY field ORDER BY n DESC, category) - 1)::INTEGER AS index FROM c")
sql("m6_called", f"""WITH {SCORED} SELECT threshold, count(*) FILTER (WHERE score >= threshold) AS called,
  count(*) FILTER (WHERE score >= threshold AND flag = 1) AS hits
FROM scored, (SELECT unnest([0.1, 0.25, 0.5, 0.75])::DOUBLE AS threshold) GROUP BY 1""")
SPLIT = f"""{LINES}, h AS (SELECT lines.*, p_type, p_brand, {HASH.format(ROW_KEY)} AS hash, {ROW_KEY} AS key
  FROM lines JOIN part ON l_partkey = p_partkey), p AS (
  SELECT *, row_number() OVER (PARTITION BY flag ORDER BY hash, key) AS place, count(*) OVER (PARTITION BY flag) AS n FROM h),
train AS (SELECT * FROM p WHERE place <= floor(n * 0.8::DOUBLE)), test AS (SELECT * FROM p WHERE place > floor(n * 0.8::DOUBLE))"""
sql("m4_forest", f"""WITH {SPLIT}, k AS (SELECT c, (SELECT count(*) FROM test WHERE flag = c) AS support FROM (SELECT unnest([0, 1]) AS c))
SELECT c::VARCHAR AS "row", support, true AS in_bounds FROM k
UNION ALL SELECT unnest(['accuracy', 'macro avg', 'weighted avg']), (SELECT count(*) FROM test), true""")
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "p_size", "p_retailprice"]
sql("m10_importances", f"WITH {SPLIT}, f AS (" + " UNION ALL ".join(
    [f"SELECT DISTINCT '{c}_vec_' || {c} AS feature FROM train" for c in CATEGORIES]
    + [f"SELECT '{c}_vec_{extra}'" for c in CATEGORIES for extra in ("__unknown", "invalidValues")]
    + [f"SELECT '{c}'" for c in NUMBERS]
) + ") SELECT feature, true AS is_share FROM f")

# --- measures by every subset of the slicers, variants, bitmaps, drill-down -------------------------------------------

sql("t_cube", f"""WITH {LINES}, f AS (
  SELECT year(l_shipdate)::INTEGER AS year, month(l_shipdate)::INTEGER AS month, n_regionkey, stay_days, gross, cost, flag, l_suppkey, l_partkey
  FROM lines JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)
SELECT year, month, n_regionkey, GROUPING(year, month, n_regionkey)::BIGINT AS slice, count(*) AS total_admissions,
  {r('avg(stay_days)', 6)} AS avg_length_of_stay, {r('sum(gross)', 6)} AS gross_billings,
  {r('sum(gross - cost)::DOUBLE / nullif(sum(gross), 0)::DOUBLE', 6)} AS margin_fraction,
  {r('100.0::DOUBLE * sum(flag) / count(*)', 6)} AS readmission_rate_pct,
  count(DISTINCT l_suppkey) AS doctors, count(DISTINCT l_partkey) AS procedures
FROM f GROUP BY CUBE (year, month, n_regionkey)""")

MISSPELT = """misspelt AS (
  SELECT c_custkey, CASE c_custkey % 16 WHEN 0 THEN lower(l) WHEN 1 THEN l[1:2] || l[4:] WHEN 2 THEN l[1:4] || l[4:4] || l[5:]
    WHEN 3 THEN l[1:1] || l[3:3] || l[2:2] || l[4:] WHEN 4 THEN l[1:4] || 'x' || l[6:] WHEN 5 THEN l || ' .' WHEN 6 THEN replace(l, ' ', '-')
    ELSE l END AS raw_label
  FROM (SELECT c_custkey, c_mktsegment || ' ' || n_name AS l FROM customer JOIN nation ON c_nationkey = n_nationkey))"""
CLUSTERS = f"""{MISSPELT}, spellings AS (
  SELECT raw_label AS label, count(*) AS n_rows, lower(regexp_replace(raw_label, '[^A-Za-z0-9]+', '', 'g')) AS norm FROM misspelt GROUP BY 1
), norms AS (SELECT DISTINCT norm, regexp_replace(norm, '[^0-9]+', '', 'g') AS figures FROM spellings), pairs AS (
  SELECT a.norm AS a, b.norm AS b FROM norms a JOIN norms b
    ON a.figures = b.figures AND damerau_levenshtein(a.norm, b.norm) <= 1 AND (a.norm = b.norm OR (length(a.norm) >= 5 AND length(b.norm) >= 5))
), reached AS (
  SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reached r JOIN pairs p ON r.b = p.a
), clustered AS (SELECT s.*, c.cluster FROM spellings s JOIN (SELECT a, min(b) AS cluster FROM reached GROUP BY a) c ON c.a = s.norm), named AS (
  SELECT label, n_rows, first_value(label) OVER (PARTITION BY cluster ORDER BY n_rows DESC, label) AS canonical,
    count(*) OVER (PARTITION BY cluster) AS cluster_spellings, (sum(n_rows) OVER (PARTITION BY cluster))::BIGINT AS cluster_rows FROM clustered)"""
sql("j3_variant_clusters", f"WITH RECURSIVE {CLUSTERS} SELECT * FROM named")
sql("j9_canonical_spelling", f"""WITH RECURSIVE {CLUSTERS}
SELECT c_custkey, raw_label, canonical AS label FROM misspelt LEFT JOIN named ON raw_label = named.label""")

sql("j13_fk_bitmap", ORACLE_SQL["j13_fk"])
sql("j5_orphans_bitmap", ORACLE_SQL["j5_orphans"])

sql("j14_drilldown", """WITH a AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, o_totalprice AS p FROM orders), b AS (
  SELECT k, c, s, CASE WHEN k % 1009 = 3 THEN p + 1 ELSE p END AS p FROM a WHERE k % 997 <> 5
  UNION ALL SELECT c_custkey * 1000 + 1000000000, c_custkey, 'O', c_acctbal FROM customer WHERE c_custkey % 101 = 7)
SELECT coalesce(a.k, b.k) AS key, count(a.k) AS left_rows, count(b.k) AS right_rows,
  CASE WHEN count(b.k) = 0 THEN 'missing' WHEN count(a.k) = 0 THEN 'extra' ELSE 'changed' END AS status
FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR (a.c, a.s, a.p) IS DISTINCT FROM (b.c, b.s, b.p) GROUP BY 1""")

# --- loads, publication, incremental state, buckets -------------------------------------------------------------------

sql("q2_incremental", ORACLE_SQL["q2_trend_full"])
sql("k7_bucketed", ORACLE_SQL["k7_features"])
sql("a1_quarantine", f"""SELECT o_orderkey, CASE WHEN o_orderkey % 50 NOT BETWEEN 1 AND 5 THEN o_custkey END AS o_custkey,
  CASE WHEN o_orderkey % 50 NOT BETWEEN 1 AND 5 THEN 'a, ' || o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 50 NOT BETWEEN 1 AND 5 THEN o_totalprice END AS o_totalprice,
  CASE WHEN o_orderkey % 50 NOT BETWEEN 1 AND 5 THEN {day('o_orderdate')} END AS o_orderdate,
  CASE o_orderkey % 50 WHEN 1 THEN 'o_totalprice is not double' WHEN 2 THEN 'too few fields' WHEN 3 THEN 'too many fields'
    WHEN 4 THEN 'o_custkey is missing' WHEN 5 THEN 'o_totalprice is not double; o_orderdate is not date' ELSE 'good' END AS outcome
FROM orders""")
sql("a6_publish", """SELECT n_name, count(*) AS customers, sum(c_acctbal::DECIMAL(12,2))::DOUBLE AS balance
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
sql("j17_gate", """WITH judged AS (
  SELECT 'orders' AS t, count(*) AS n, count(*) FILTER (WHERE NOT coalesce(o_totalprice > 0, false)) AS a,
    count(*) FILTER (WHERE o_custkey IS NULL) AS b, 'price is positive' AS ra, 'customer is given' AS rb FROM orders
  UNION ALL SELECT 'customer', count(*), count(*) FILTER (WHERE NOT coalesce(c_acctbal > 0, false)),
    count(*) FILTER (WHERE c_mktsegment IS NULL), 'balance is positive', 'segment is given' FROM customer)
SELECT t AS "table", 'rows written' AS rule, n AS violations, true AS passed, a + b = 0 AS published FROM judged
UNION ALL SELECT t, ra, a, a = 0, a + b = 0 FROM judged UNION ALL SELECT t, rb, b, b = 0, a + b = 0 FROM judged""")
