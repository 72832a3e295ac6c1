"""The same results in plain SQL, for checking against another engine. One query per catalogue entry."""

from __future__ import annotations

from stayflow.schemas import CATEGORICAL_COLS, DERIVED_COLS, NUMERICAL_COLS, PROFILE_DEFAULTS

RETAIL_RAW = """
retail_raw AS (
  SELECT CAST(o.o_orderkey AS VARCHAR) AS Invoice, CAST(l.l_partkey AS VARCHAR) AS StockCode, p.p_name AS Description,
         CASE WHEN l.l_returnflag = 'R' THEN -l.l_quantity ELSE l.l_quantity END AS Quantity,
         o.o_orderdate + INTERVAL '1' HOUR * (o.o_orderkey % 24) AS InvoiceDate,
         CASE WHEN l.l_partkey % 100 = 0 THEN CAST(0 AS DOUBLE) ELSE l.l_extendedprice / l.l_quantity END AS Price,
         CASE WHEN l.l_orderkey % 20 = 0 THEN NULL ELSE CAST(o.o_custkey AS DOUBLE) END AS CustomerIdRaw,
         n.n_name AS Country
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN part p ON l.l_partkey = p.p_partkey)"""

CLEAN = RETAIL_RAW + """,
clean AS (
  SELECT CAST(CAST(CustomerIdRaw AS BIGINT) AS VARCHAR) AS "Customer ID", Invoice, InvoiceDate, Quantity, Price,
         Quantity * Price AS TotalAmount
  FROM retail_raw WHERE CustomerIdRaw IS NOT NULL AND Quantity > 0 AND Price > 0)"""


def _rfm(snapshot: str) -> str:
    return CLEAN + f""",
snap AS (SELECT {snapshot} AS s FROM clean),
rfm AS (
  SELECT "Customer ID", CAST(floor((epoch_us(max(s)) - epoch_us(max(InvoiceDate))) / 86400000000.0) AS BIGINT) AS Recency,
         count(DISTINCT Invoice) AS Frequency, sum(TotalAmount) AS Monetary
  FROM clean, snap GROUP BY "Customer ID" HAVING sum(TotalAmount) > 0)"""


RFM = _rfm("max(InvoiceDate) + INTERVAL 1 DAY")
SEGMENTS = RFM + """,
seg AS (SELECT *, CASE WHEN Frequency >= 9 THEN 0 WHEN Recency <= 270 THEN 1 ELSE 2 END AS Cluster_ID FROM rfm)"""
PROFILE = SEGMENTS + """,
profile AS (
  SELECT Cluster_ID, avg(Recency) AS Recency_mean, avg(Frequency) AS Frequency_mean, avg(Monetary) AS Monetary_mean,
         count(*) AS Customer_Count, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS Pct_of_Base
  FROM seg GROUP BY Cluster_ID),
mid AS (SELECT median(Recency_mean) AS r, median(Frequency_mean) AS f, median(Monetary_mean) AS m FROM profile),
personas AS (
  SELECT profile.*, CASE
    WHEN Recency_mean <= r AND Frequency_mean >= f AND Monetary_mean >= m THEN 'Champions'
    WHEN Recency_mean > r AND (Frequency_mean >= f OR Monetary_mean >= m) THEN 'At Risk'
    WHEN Recency_mean <= r AND Frequency_mean < f AND Monetary_mean < m THEN 'New / Low Engagement'
    WHEN Recency_mean > r THEN 'Hibernating' ELSE 'Loyal / Steady' END AS Persona
  FROM profile, mid)"""

CHURN_RAW = """
hist AS (
  SELECT o_custkey, min(o_orderdate) AS first_d, max(o_orderdate) AS last_d, count(*) AS n_ord
  FROM orders WHERE o_orderdate < TIMESTAMP '2000-08-01 00:00:00' GROUP BY o_custkey),
fut AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2000-08-01 00:00:00'),
li AS (
  SELECT o.o_custkey, count(CASE WHEN l.l_discount >= 0.08 THEN 1 END) AS coupons,
         sum(l.l_extendedprice * l.l_discount) / 100 AS cashback, count(DISTINCT l.l_suppkey % 10) AS n_addr
  FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey
  WHERE o.o_orderdate < TIMESTAMP '2000-08-01 00:00:00' GROUP BY o.o_custkey),
ev AS (
  SELECT user_id, avg(value) / 100 AS hours, count(DISTINCT event_type) AS devices,
         max(CASE WHEN event_type = 'error' AND value > 200 THEN 1 ELSE 0 END) AS complain
  FROM events GROUP BY user_id),
churn_raw AS (
  SELECT c.c_custkey AS CustomerID, CASE WHEN fut.o_custkey IS NULL THEN 1 ELSE 0 END AS Churn,
    CAST(date_diff('day', CAST(hist.first_d AS DATE), DATE '2000-08-01') AS DOUBLE) / 30 AS Tenure,
    CASE c.c_custkey % 3 WHEN 0 THEN 'Phone' WHEN 1 THEN 'Mobile Phone' ELSE 'Computer' END AS PreferredLoginDevice,
    CAST(c.c_nationkey % 3 + 1 AS DOUBLE) AS CityTier,
    CASE WHEN c.c_acctbal < 0 THEN NULL ELSE CAST(floor(c.c_acctbal / 250) AS DOUBLE) END AS WarehouseToHome,
    CASE c.c_custkey % 7 WHEN 0 THEN 'CC' WHEN 1 THEN 'COD' WHEN 2 THEN 'Credit Card' WHEN 3 THEN 'Cash on Delivery'
         WHEN 4 THEN 'Debit Card' WHEN 5 THEN 'UPI' ELSE 'E wallet' END AS PreferredPaymentMode,
    CASE c.c_custkey % 2 WHEN 0 THEN 'Male' ELSE 'Female' END AS Gender,
    ev.hours AS HourSpendOnApp, CAST(ev.devices AS DOUBLE) AS NumberOfDeviceRegistered,
    CASE WHEN c.c_custkey % 13 = 0 THEN 'Others' WHEN c.c_mktsegment = 'BUILDING' THEN 'Mobile'
         WHEN c.c_mktsegment = 'FURNITURE' THEN 'Mobile Phone' WHEN c.c_mktsegment = 'MACHINERY' THEN 'Laptop & Accessory'
         WHEN c.c_mktsegment = 'HOUSEHOLD' THEN 'Grocery' ELSE 'Fashion' END AS PreferedOrderCat,
    CAST(c.c_custkey % 5 + 1 AS DOUBLE) AS SatisfactionScore,
    CASE (c.c_custkey * 31) % 3 WHEN 0 THEN 'Single' WHEN 1 THEN 'Married' ELSE 'Divorced' END AS MaritalStatus,
    CAST(li.n_addr AS DOUBLE) AS NumberOfAddress, CAST(ev.complain AS DOUBLE) AS Complain,
    CASE WHEN c.c_custkey % 11 = 0 THEN NULL ELSE CAST(c.c_custkey % 16 + 10 AS DOUBLE) END AS OrderAmountHikeFromlastYear,
    CAST(li.coupons AS DOUBLE) AS CouponUsed, CAST(hist.n_ord AS DOUBLE) AS OrderCount,
    CAST(date_diff('day', CAST(hist.last_d AS DATE), DATE '2000-08-01') AS DOUBLE) AS DaySinceLastOrder,
    li.cashback AS CashbackAmount
  FROM customer c LEFT JOIN hist ON c.c_custkey = hist.o_custkey LEFT JOIN fut ON c.c_custkey = fut.o_custkey
  LEFT JOIN li ON c.c_custkey = li.o_custkey LEFT JOIN ev ON c.c_custkey = ev.user_id)"""

CHURN = CHURN_RAW + """,
churn AS (
  SELECT * REPLACE (
    CAST(CustomerID AS VARCHAR) AS CustomerID,
    CASE PreferredLoginDevice WHEN 'Phone' THEN 'Mobile Phone' ELSE PreferredLoginDevice END AS PreferredLoginDevice,
    CASE PreferredPaymentMode WHEN 'CC' THEN 'Credit Card' WHEN 'COD' THEN 'Cash on Delivery' ELSE PreferredPaymentMode END
      AS PreferredPaymentMode,
    CASE PreferedOrderCat WHEN 'Mobile' THEN 'Mobile Phone' ELSE PreferedOrderCat END AS PreferedOrderCat)
  FROM churn_raw),
prob AS (SELECT *, ((CAST(CustomerID AS BIGINT) * 7919) % 1000) / 1000.0::DOUBLE AS p FROM churn)"""

TIER = "CASE WHEN p >= 0.7 THEN 'High Risk' WHEN p >= 0.3 THEN 'Medium Risk' ELSE 'Low Risk' END"
# Action and persona texts, as in functions/rules.py.
ACTION = """CASE
    WHEN Persona = 'Champions' AND Risk_Tier = 'High Risk' THEN '[CRITICAL] Immediate VIP Concierge Call & Personal Executive Discount'
    WHEN Persona IN ('Champions', 'Loyal / Steady') AND Risk_Tier IN ('High Risk', 'Medium Risk')
      THEN '[HIGH PRIORITY] Exclusive Loyalty Upgrade & Renewal Offer'
    WHEN Persona = 'At Risk' AND Risk_Tier = 'High Risk' THEN '[WIN-BACK] Automated Re-engagement Email & 20% Discount Code'
    WHEN Risk_Tier = 'High Risk' THEN '[PUSH NOTIFICATION] App Activity Bonus & Feature Highlight'
    ELSE '[MONITOR] Standard Engagement & Regular Newsletter' END"""
INTEGRATED = PROFILE + "," + CHURN + f""",
integrated AS (
  SELECT seg."Customer ID" AS CustomerID, seg.Recency, seg.Frequency, seg.Monetary, seg.Cluster_ID, personas.Persona,
         prob.p AS Churn_Probability, {TIER} AS Risk_Tier, false AS synthetic_rfm
  FROM seg JOIN personas USING (Cluster_ID) JOIN prob ON prob.CustomerID = seg."Customer ID")"""

# category values after recoding
CATEGORIES = {
    "PreferredLoginDevice": ["Computer", "Mobile Phone"],
    "PreferredPaymentMode": ["Cash on Delivery", "Credit Card", "Debit Card", "E wallet", "UPI"],
    "Gender": ["Female", "Male"],
    "PreferedOrderCat": ["Fashion", "Grocery", "Laptop & Accessory", "Mobile Phone", "Others"],
    "MaritalStatus": ["Divorced", "Married", "Single"],
}
FEATURES = NUMERICAL_COLS + DERIVED_COLS + [f"{c}_{v}" for c in CATEGORICAL_COLS for v in CATEGORIES[c]]

DERIVED = CHURN + """,
bridge AS (SELECT median(Tenure) AS t, median(OrderCount) AS o, median(CouponUsed) AS c, median(DaySinceLastOrder) AS d FROM churn),
derived AS (
  SELECT churn.*,
    coalesce(OrderCount, o) / (coalesce(Tenure, t) + 1.0) AS OrderVelocity,
    coalesce(CouponUsed, c) / (coalesce(OrderCount, o) + 1.0) AS CouponUsageRatio,
    CashbackAmount / (coalesce(OrderCount, o) + 1.0) AS CashbackPerOrder,
    coalesce(Complain, 0) * (6.0 - coalesce(SatisfactionScore, 3)) AS ComplainRiskInteraction,
    coalesce(DaySinceLastOrder, d) / (coalesce(Tenure, t) * 30.0 + 1.0) AS InactivityRatio
  FROM churn, bridge)"""

_numbers = NUMERICAL_COLS + DERIVED_COLS
MATRIX = DERIVED + ",\nmeds AS (SELECT " + ", ".join(f"median({c}) AS {c}" for c in _numbers) + " FROM derived),\nmatrix AS (SELECT derived.CustomerID, derived.Churn, " + ", ".join(
    [f"coalesce(derived.{c}, meds.{c}) AS {c}" for c in _numbers]
    + [f"CASE WHEN derived.{c} = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"{c}_{v}\"" for c in CATEGORICAL_COLS for v in CATEGORIES[c]]
) + " FROM derived, meds)"


def _standardised(kind: str, weight: str = "") -> str:
    """Features minus mean, over a deviation; a constant column is only centred."""
    stats = ", ".join(f'avg("{f}") AS "m_{f}", {kind}("{f}") AS "s_{f}"' for f in FEATURES)
    cols = ", ".join(
        f'(x."{f}" - "m_{f}") / CASE WHEN "s_{f}" > 1e-12 * greatest(1.0, abs("m_{f}")) THEN "s_{f}" ELSE 1.0 END{weight} AS "{f}"'
        for f in FEATURES
    )
    return MATRIX + f",\nstats AS (SELECT {stats} FROM matrix),\nz AS (SELECT x.CustomerID, x.Churn, {cols} FROM matrix x, stats)"


def _rounded(cols: list[str], digits: int) -> str:
    return ", ".join(f'round("{c}", {digits}) AS "{c}"' for c in cols)


def _single(cols: list[str]) -> str:
    return ", ".join(f'CAST("{c}" AS REAL) AS "{c}"' for c in cols)


ATTRIBUTION = _standardised("stddev_samp", " * " + repr(1.0 / len(FEATURES)))
IMPORTANCE = ATTRIBUTION + ",\nlong AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, avg(abs(\"{f}\")) AS mean_abs_shap FROM z" for f in FEATURES) + ")"
FACTORS = ATTRIBUTION + ",\nfactors AS (" + " UNION ALL ".join(
    f"SELECT z.CustomerID AS customer_id, {i} AS place, '{f}' AS feature, CAST(round_even(z.\"{f}\", 4) AS DOUBLE) AS shap_value, "
    f"CAST(round_even(matrix.\"{f}\", 4) AS DOUBLE) AS feature_value, CASE WHEN z.\"{f}\" > 0 THEN 'increases_churn_risk' ELSE 'reduces_churn_risk' END AS impact "
    f"FROM z JOIN matrix USING (CustomerID)" for i, f in enumerate(FEATURES)) + ")"

RANKS = CHURN + """,
ranked AS (
  SELECT CustomerID, Churn, row_number() OVER (PARTITION BY Churn ORDER BY md5(CustomerID || '|42'), CustomerID) AS rnk FROM churn)"""
SPLIT = RANKS + """,
cnt AS (SELECT Churn, count(*) AS n, sum(count(*)) OVER () AS total FROM churn GROUP BY Churn),
share AS (SELECT Churn, ceil(total * 0.2 - 1e-9) AS wanted, n * ceil(total * 0.2 - 1e-9) / total AS exact FROM cnt),
sizes AS (
  SELECT Churn, floor(exact) + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, Churn)
         <= max(wanted) OVER () - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS n_test FROM share),
split AS (
  SELECT CustomerID, Churn, CASE WHEN rnk <= n_test THEN 'test' ELSE 'train' END AS split FROM ranked JOIN sizes USING (Churn))"""

SCORES = CHURN + """,
s AS (SELECT p AS score, count(CASE WHEN Churn = 1 THEN 1 END) AS pos, count(CASE WHEN Churn = 0 THEN 1 END) AS neg FROM prob GROUP BY p),
cum AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS cp, sum(neg) OVER (ORDER BY score DESC) AS cn FROM s)"""

POINTS = SEGMENTS + """,
pts AS (SELECT "Customer ID" AS id, Cluster_ID AS label, Recency / 100.0::DOUBLE AS a, Frequency::DOUBLE AS b, Monetary / 1000000.0::DOUBLE AS c,
        Recency FROM seg)"""
_dist = "sqrt((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b) + (x.c - y.c) * (x.c - y.c))"


def _silhouette(points: str, dist: str) -> str:
    """Per-row silhouette of a table (id, label, ...) by brute force over all pairs."""
    return f"""
sizes AS (SELECT label, count(*) AS n FROM {points} GROUP BY label),
sums AS (SELECT x.id, x.label AS own, y.label AS other, sum({dist}) AS d FROM {points} x, {points} y GROUP BY x.id, x.label, y.label),
ab AS (
  SELECT sums.id, max(CASE WHEN own = other THEN CASE WHEN n > 1 THEN d / (n - 1) END END) AS a, min(CASE WHEN own <> other THEN d / n END) AS b
  FROM sums JOIN sizes ON sums.other = sizes.label GROUP BY sums.id),
sil AS (SELECT id, CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END AS silhouette FROM ab)"""


def _davies_bouldin_3d(points: str) -> str:
    return f"""
cen AS (SELECT label, avg(a) AS a, avg(b) AS b, avg(c) AS c FROM {points} GROUP BY label),
spread AS (SELECT x.label, avg({_dist}) AS s, sum({_dist} * {_dist}) AS sq FROM {points} x JOIN cen y ON x.label = y.label GROUP BY x.label),
ratio AS (
  SELECT x.label, max((sx.s + sy.s) / {_dist}) AS r FROM cen x JOIN cen y ON x.label <> y.label
  JOIN spread sx ON sx.label = x.label JOIN spread sy ON sy.label = y.label GROUP BY x.label)
SELECT round((SELECT avg(r) FROM ratio), 6) AS davies_bouldin, round((SELECT sum(sq) FROM spread), 4) AS inertia"""


_EMB = "emb AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings)"


def _select_k() -> str:
    bands = ", ".join(f"CAST(least({k - 1}, floor(Recency * {k} / 1800.0)) AS INT) AS k{k}" for k in range(2, 6))
    parts = [f"SELECT {k} AS k, id, k{k} AS label, a, b, c FROM banded" for k in range(2, 6)]
    return "WITH " + POINTS + f""",
banded AS (SELECT *, {bands} FROM pts),
lab AS ({" UNION ALL ".join(parts)}),
sizes AS (SELECT k, label, count(*) AS n FROM lab GROUP BY k, label),
sums AS (SELECT x.k, x.id, x.label AS own, y.label AS other, sum({_dist}) AS d FROM lab x JOIN lab y ON x.k = y.k GROUP BY x.k, x.id, x.label, y.label),
ab AS (
  SELECT sums.k, sums.id, max(CASE WHEN own = other THEN CASE WHEN n > 1 THEN d / (n - 1) END END) AS a, min(CASE WHEN own <> other THEN d / n END) AS b
  FROM sums JOIN sizes ON sums.other = sizes.label AND sums.k = sizes.k GROUP BY sums.k, sums.id),
score AS (SELECT k, avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM ab GROUP BY k)
SELECT k, round(silhouette, 6) AS silhouette FROM score ORDER BY silhouette DESC, k LIMIT 1"""


def _select_gmm() -> str:
    parts = [f"SELECT {k} AS k, CAST(least({k - 1}, floor(Recency * {k} / 1800.0)) AS INT) AS label, a, b, c FROM pts" for k in range(2, 5)]
    diag = "(ln(va) + ln(vb) + ln(vc))"
    sph = "(3 * ln((va + vb + vc) / 3))"
    return "WITH " + POINTS + f""",
lab AS ({" UNION ALL ".join(parts)}),
comp AS (SELECT k, label, count(*) AS n, var_pop(a) + 1e-6 AS va, var_pop(b) + 1e-6 AS vb, var_pop(c) + 1e-6 AS vc FROM lab GROUP BY k, label),
tot AS (SELECT count(*) AS total FROM pts),
ll AS (
  SELECT k, 'diag' AS covariance_type, sum(n * (ln(n / total) - 0.5 * ({diag} + 3 * (ln(2 * pi()) + 1)))) AS ll, 7 * k - 1 AS params, max(total) AS n
  FROM comp, tot GROUP BY k UNION ALL
  SELECT k, 'spherical', sum(n * (ln(n / total) - 0.5 * ({sph} + 3 * (ln(2 * pi()) + 1)))), 5 * k - 1, max(total) FROM comp, tot GROUP BY k)
SELECT k, covariance_type, round(-2 * ll + params * ln(n), 4) AS bic, round(-2 * ll + 2 * params, 4) AS aic
FROM ll ORDER BY -2 * ll + params * ln(n), covariance_type, k LIMIT 1"""


def _yeo_johnson_columns(lams: dict[str, float]) -> str:
    return ", ".join(f"(power({c} + 1.0, {lam!r}) - 1.0) / {lam!r} AS {c}" for c, lam in lams.items())


FIXED_LAMBDAS = {"Recency": 0.25, "Frequency": 0.6, "Monetary": 0.65}
LAMBDA_GRID = [-0.5, -0.25, 0.25, 0.5, 0.75, 1.0, 1.25, 1.5]


def _lambda_grid() -> str:
    grid = ", ".join(f"({v!r}::DOUBLE)" for v in LAMBDA_GRID)
    parts = [
        f"SELECT '{c}' AS \"column\", l AS lambda, round(-count(*) / 2.0::DOUBLE * ln(var_pop((power({c} + 1.0, l) - 1.0) / l)) + (l - 1) * sum(ln({c} + 1.0)), 3) AS log_likelihood "
        f"FROM rfm, (VALUES {grid}) g(l) GROUP BY l" for c in FIXED_LAMBDAS
    ]
    return "WITH " + RFM + " " + " UNION ALL ".join(parts)


_defaults = ", ".join(
    f"'{v}' AS {c}" if c == "Gender" else f"CAST({float(v)!r} AS REAL) AS {c}" if c == "CashbackAmount"
    else f"coalesce({c}, '{v}') AS {c}" if isinstance(v, str) else f"CAST(coalesce({c}, {float(v)!r}) AS REAL) AS {c}"
    for c, v in PROFILE_DEFAULTS.items()
)
_HASH = "CAST('0x' || substr(md5(CustomerID || '|{0}'), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE"

ORACLE: dict[str, str] = {
    "dataset_summary": "WITH " + RETAIL_RAW + "," + CHURN_RAW + """
SELECT 'retail' AS dataset, count(*) AS n_rows, 8 AS n_columns, count(DISTINCT CustomerIdRaw) AS n_customers, NULL::DOUBLE AS churn_rate_pct FROM retail_raw
UNION ALL SELECT 'churn', count(*), 20, count(DISTINCT CustomerID), round(avg(Churn) * 100, 6) FROM churn_raw""",
    "csv_source": "WITH " + CLEAN + """
SELECT "Customer ID", count(*) AS n_rows, round(sum(TotalAmount), 3) AS amount, strftime(max(InvoiceDate), '%Y-%m-%d %H:%M:%S') AS last_purchase
FROM clean GROUP BY "Customer ID\"""",
    "retail_clean": "WITH " + CLEAN + """
SELECT "Customer ID", Invoice, strftime(InvoiceDate, '%Y-%m-%d %H:%M:%S') AS InvoiceDate, Quantity, round(Price, 8) AS Price,
       round(TotalAmount, 4) AS TotalAmount FROM clean""",
    "retail_retention": "WITH " + RETAIL_RAW + """
SELECT count(*) AS initial_rows, count(CASE WHEN CustomerIdRaw IS NOT NULL AND Quantity > 0 AND Price > 0 THEN 1 END) AS final_rows,
       round(count(CASE WHEN CustomerIdRaw IS NOT NULL AND Quantity > 0 AND Price > 0 THEN 1 END) * 100.0::DOUBLE / count(*), 6) AS retained_pct FROM retail_raw""",
    "churn_clean": "WITH " + CHURN + " SELECT * REPLACE (" + ", ".join(
        f"CAST({c} AS REAL) AS {c}" for c in NUMERICAL_COLS) + ") FROM churn",
    "rfm_table": "WITH " + RFM + ' SELECT "Customer ID", Recency, Frequency, round(Monetary, 3) AS Monetary FROM rfm',
    "rfm_custom_snapshot": "WITH " + _rfm("max(TIMESTAMP '2000-06-15 12:50:00')")
    + ' SELECT "Customer ID", Recency, Frequency, round(Monetary, 3) AS Monetary FROM rfm',
    "rfm_scaled_fixed_lambda": "WITH " + RFM + f""",
t AS (SELECT "Customer ID", {_yeo_johnson_columns(FIXED_LAMBDAS)} FROM rfm)
SELECT "Customer ID", """ + ", ".join(
        f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}_scaled" for c in FIXED_LAMBDAS) + " FROM t",
    "yeo_johnson_grid": _lambda_grid(),
    "cluster_profile": "WITH " + PROFILE + """
SELECT Cluster_ID, round(Recency_mean, 6) AS Recency_mean, round(Frequency_mean, 6) AS Frequency_mean, round(Monetary_mean, 3) AS Monetary_mean,
       Customer_Count, Pct_of_Base FROM profile""",
    "personas": "WITH " + PROFILE + """
SELECT Cluster_ID, round(Recency_mean, 6) AS Recency_mean, round(Frequency_mean, 6) AS Frequency_mean, round(Monetary_mean, 3) AS Monetary_mean,
       Customer_Count, Pct_of_Base, Persona FROM personas""",
    "persona_counts": "WITH " + PROFILE + " SELECT Persona, count(*) AS n_clusters FROM personas GROUP BY Persona",
    "risk_tiers": "WITH " + CHURN + f" SELECT CustomerID, p, {TIER} AS Risk_Tier FROM prob",
    "id_overlap": "WITH " + RFM + "," + CHURN + ' SELECT count(*) > 0 AS overlap FROM rfm JOIN churn ON "Customer ID" = CustomerID',
    "integrated_customers": "WITH " + INTEGRATED + " SELECT * REPLACE (round(Monetary, 3) AS Monetary) FROM integrated",
    "integrated_fallback": "WITH " + CHURN + f""",
cuts AS (SELECT quantile_cont(p, 0.33) AS lo, quantile_cont(p, 0.66) AS hi FROM prob)
SELECT CustomerID, CAST(floor({_HASH.format('R')} * 99) + 1 AS BIGINT) AS Recency, CAST(floor({_HASH.format('F')} * 19) + 1 AS BIGINT) AS Frequency,
       round({_HASH.format('M')} * 9500 + 500, 6) AS Monetary, CASE WHEN p < lo THEN 0 WHEN p < hi THEN 1 ELSE 2 END AS Cluster_ID,
       CASE WHEN p < lo THEN 'Champions' WHEN p < hi THEN 'Loyal / Steady' ELSE 'Hibernating' END AS Persona,
       p AS Churn_Probability, {TIER} AS Risk_Tier, true AS synthetic_rfm FROM prob, cuts""",
    "risk_matrix": "WITH " + INTEGRATED + """
SELECT coalesce(Persona, 'Total') AS Persona, count(CASE WHEN Risk_Tier = 'High Risk' THEN 1 END) AS "High Risk",
       count(CASE WHEN Risk_Tier = 'Medium Risk' THEN 1 END) AS "Medium Risk", count(CASE WHEN Risk_Tier = 'Low Risk' THEN 1 END) AS "Low Risk",
       count(*) AS "Total" FROM integrated GROUP BY ROLLUP (Persona)""",
    "risk_counts": "WITH " + INTEGRATED + """
SELECT count(*) AS total_customers, count(CASE WHEN Risk_Tier = 'High Risk' THEN 1 END) AS high_risk_customers,
       count(CASE WHEN Risk_Tier = 'Medium Risk' THEN 1 END) AS medium_risk_customers,
       count(CASE WHEN Risk_Tier = 'Low Risk' THEN 1 END) AS low_risk_customers FROM integrated""",
    "priority_cohorts": "WITH " + INTEGRATED + f"""
SELECT CustomerID, Recency, Frequency, round(Monetary, 3) AS Monetary, Cluster_ID, Persona, Churn_Probability, Risk_Tier, {ACTION} AS Recommended_Action
FROM integrated WHERE Risk_Tier IN ('High Risk', 'Medium Risk')""",
    "action_top50": "WITH " + INTEGRATED + f"""
SELECT CustomerID, round(Monetary, 3) AS Monetary, Persona, Churn_Probability, Risk_Tier, {ACTION} AS Recommended_Action
FROM integrated WHERE Risk_Tier IN ('High Risk', 'Medium Risk') ORDER BY Churn_Probability DESC, integrated.Monetary DESC, CustomerID LIMIT 50""",
    "churn_derived": "WITH " + DERIVED + " SELECT CustomerID, " + _single(DERIVED_COLS) + " FROM derived",
    "churn_medians": "WITH " + DERIVED + " " + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST(median({c}) AS REAL) AS median_value FROM derived" for c in _numbers),
    "churn_matrix": "WITH " + MATRIX + " SELECT CustomerID, Churn, " + _single(FEATURES) + " FROM matrix",
    "churn_matrix_scaled": "WITH " + _standardised("stddev_pop") + " SELECT CustomerID, Churn, " + _rounded(FEATURES, 6) + " FROM z",
    "split_assign": "WITH " + SPLIT + " SELECT CustomerID, Churn, split FROM split",
    "split_check": "WITH " + SPLIT + """
SELECT coalesce(split, 'overall') AS split, count(*) AS n_rows, round(avg(Churn) * 100, 6) AS churn_pct FROM split GROUP BY ROLLUP (split)""",
    "folds": "WITH " + RANKS + " SELECT CustomerID, Churn, CAST((rnk - 1) % 5 AS INT) AS fold FROM ranked",
    "class_ratio": "WITH " + CHURN + """
SELECT count(CASE WHEN Churn = 0 THEN 1 END) AS negatives, count(CASE WHEN Churn = 1 THEN 1 END) AS positives,
       round(count(CASE WHEN Churn = 0 THEN 1 END) / count(CASE WHEN Churn = 1 THEN 1 END)::DOUBLE, 6) AS scale_pos_weight FROM churn""",
    "class_weights": "WITH " + CHURN + """
SELECT Churn, count(*) AS n_rows, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)::DOUBLE), 6) AS weight FROM churn GROUP BY Churn""",
    "confusion": "WITH " + CHURN + """,
c AS (SELECT count(CASE WHEN Churn = 0 AND p < 0.5 THEN 1 END) AS tn, count(CASE WHEN Churn = 0 AND p >= 0.5 THEN 1 END) AS fp,
      count(CASE WHEN Churn = 1 AND p < 0.5 THEN 1 END) AS fn, count(CASE WHEN Churn = 1 AND p >= 0.5 THEN 1 END) AS tp FROM prob)
SELECT tn, fp, fn, tp, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall,
       round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1_score FROM c""",
    "roc_auc": "WITH " + SCORES + """
SELECT CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg, round(sum(neg * (cp - pos / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)), 6) AS roc_auc FROM cum""",
    "average_precision": "WITH " + SCORES + " SELECT round(sum(pos * (cp / (cp + cn)::DOUBLE)) / sum(pos), 6) AS pr_auc FROM cum",
    "select_k": _select_k(),
    "select_gmm": _select_gmm(),
    "davies_bouldin": "WITH " + POINTS + "," + _davies_bouldin_3d("pts"),
    "silhouette_euclidean": "WITH " + POINTS + "," + _silhouette("pts", _dist) + ' SELECT id AS "Customer ID", round(silhouette, 6) AS silhouette FROM sil',
    "silhouette_embeddings": "WITH " + _EMB + "," + _silhouette("emb", "list_distance(x.v, y.v)") + " SELECT id AS vec_id, round(silhouette, 6) AS silhouette FROM sil",
    "knn_graph": "WITH " + POINTS + f""",
pairs AS (SELECT x.id AS src, y.id AS dst, {_dist} AS distance FROM pts x JOIN pts y ON x.id <> y.id),
best AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS rank FROM pairs)
SELECT src, dst, round(distance, 6) AS distance, CAST(rank AS INT) AS rank FROM best WHERE rank <= 15""",
    "knn_embeddings": "WITH " + _EMB + """,
pairs AS (SELECT x.id AS src, y.id AS dst, list_distance(x.v, y.v) AS distance FROM emb x JOIN emb y ON x.id <> y.id),
best AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS rank FROM pairs)
SELECT src, dst, round(distance, 6) AS distance, CAST(rank AS INT) AS rank FROM best WHERE rank <= 5""",
    "zscore_attribution": "WITH " + ATTRIBUTION + " SELECT CustomerID, " + _rounded(FEATURES, 6) + " FROM z",
    "global_importance": "WITH " + IMPORTANCE + """
SELECT feature, round(mean_abs_shap, 6) AS mean_abs_shap FROM long ORDER BY round(mean_abs_shap, 12) DESC, feature LIMIT 15""",
    "explain_topk": "WITH " + FACTORS + """,
ranked AS (
  SELECT *, 'risk' AS side, row_number() OVER (PARTITION BY customer_id ORDER BY shap_value DESC, place) AS rank FROM factors WHERE shap_value > 0
  UNION ALL
  SELECT *, 'protective', row_number() OVER (PARTITION BY customer_id ORDER BY shap_value, place) FROM factors WHERE shap_value < 0)
SELECT customer_id, side, CAST(rank AS INT) AS rank, feature, shap_value, CAST(floor(feature_value) AS BIGINT) AS feature_value_floor, impact FROM ranked WHERE rank <= 5""",
    "score_post": "WITH " + CHURN + f"""
SELECT CASE WHEN CAST(CustomerID AS BIGINT) % 2 = 1 THEN CustomerID ELSE printf('BATCH_%04d', CAST(CustomerID AS BIGINT) + 1) END AS customer_id,
       round(p, 4) AS churn_probability, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS churn_prediction, {TIER} AS risk_tier,
       round(CASE WHEN p >= 0.5 THEN p ELSE 1 - p END, 4) AS confidence_score, 'stand_in' AS model_version FROM prob""",
    "batch_positions": """
SELECT printf('BATCH_%04d', row_number() OVER (ORDER BY c_custkey)) AS customer_id, c_custkey FROM customer""",
    "unknown_customers": "WITH " + RFM + """
SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS customer_id FROM part WHERE CAST(p_partkey AS VARCHAR) NOT IN (SELECT "Customer ID" FROM rfm)""",
    "known_customers": "WITH " + RFM + """
SELECT "Customer ID" AS customer_id, Recency, Frequency, round(Monetary, 3) AS Monetary FROM rfm
WHERE "Customer ID" IN (SELECT CAST(p_partkey AS VARCHAR) FROM part)""",
    "profile_defaults": "WITH " + CHURN + f" SELECT CustomerID, {_defaults} FROM churn",
}

# what fitted models must satisfy, whatever their parameters are
_ids = 'SELECT "Customer ID", '


def _holdout(*names: str) -> str:
    return "WITH " + SPLIT + " SELECT name AS model_name, count(*) AS n_rows, count(*) FILTER (Churn = 1) AS n_positive, true AS rates_agree, " \
        "true AS auc_in_range FROM split, (SELECT unnest([" + ", ".join(f"'{n}'" for n in names) + "]) AS name) WHERE split = 'test' GROUP BY name"


_WANTED = "(SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS id FROM part)"
_GBT = ("HistGradientBoosting", "XGBoost", "LightGBM")

ORACLE |= {
    "yeo_johnson_fit": "WITH " + RFM + """
SELECT unnest(['Recency', 'Frequency', 'Monetary']) AS feature, count(*) AS n_rows, 0.0 AS mean, 1.0 AS std, 0 AS n_better, true AS fitted FROM rfm""",
    "kmeans_grid": "WITH " + RFM + """
SELECT k, (SELECT count(*) FROM rfm) AS n_rows, 0 AS n_off_center, true AS inertia_agrees, true AS in_range, 'squared' AS silhouette_metric
FROM (SELECT unnest(range(2, 11)) AS k)""",
    "kmeans_segments": "WITH " + RFM + " " + _ids + "0 AS n_nearer, true AS known_cluster FROM rfm",
    "gmm_grid": "WITH " + RFM + """,
g AS (SELECT k, t FROM (SELECT unnest(range(2, 11)) AS k), (SELECT unnest(['full', 'tied', 'diag', 'spherical']) AS t)),
p AS (SELECT k, t, 3 * k + k - 1 + CASE t WHEN 'full' THEN 6 * k WHEN 'tied' THEN 6 WHEN 'diag' THEN 3 * k ELSE k END AS n FROM g)
SELECT k, t AS covariance_type, round(n * (ln((SELECT count(*) FROM rfm)) - 2), 4) AS bic_less_aic, true AS in_range, 'squared' AS silhouette_metric FROM p""",
    "gmm_soft": "WITH " + RFM + " " + _ids + "3 AS n_components, 1.0 AS total, true AS likeliest FROM rfm",
    "gmm_soft_diag": "WITH " + RFM + " " + _ids + "3 AS n_components, 1.0 AS total, true AS likeliest FROM rfm",
    "pca_2d": "WITH " + RFM + """
SELECT unnest(['PC1', 'PC2']) AS component, count(*) AS n_rows, 0.0 AS mean, 0.0 AS correlation, 3.0 AS total_variance FROM rfm""",
    "pca_3d": """
WITH e AS (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings),
t AS (SELECT sum(v) AS total FROM (SELECT var_samp(CAST(v AS DOUBLE)) AS v FROM e GROUP BY i))
SELECT unnest(['PC1', 'PC2', 'PC3']) AS component, (SELECT count(*) FROM embeddings) AS n_rows, 0.0 AS mean, 0.0 AS correlation, round(total, 4) AS total_variance FROM t""",
    "segmentation_job": "WITH " + RFM + """
SELECT count(*) AS n_customers, round(avg(Recency), 4) AS Recency_mean, round(avg(Frequency), 4) AS Frequency_mean, round(avg(Monetary), 2) AS Monetary_mean,
       100.0 AS pct, 0 AS n_unnamed FROM rfm""",
    "knn_projection": "WITH " + CHURN + """
SELECT count(*) AS n_rows, 5 * count(*) AS n_edges, 0 AS n_loops, 0 AS n_repeated, 0 AS n_disordered, true AS recall_reached FROM churn""",
    "lr_rf_metrics": _holdout("Logistic Regression", "Random Forest"),
    "gbt_metrics": _holdout(*_GBT),
    "gbt_smote_metrics": _holdout(*_GBT),
    "mlp_metrics": _holdout("Deep Tabular MLP"),
    "tune_champion": "WITH " + SPLIT + """
SELECT count(*) AS n_rows, count(*) FILTER (Churn = 1) AS n_positive, true AS rates_agree, true AS auc_in_range, true AS best_by_cv, true AS report_agrees
FROM split WHERE split = 'test'""",
    "smote_balance": "WITH " + CHURN + """,
n AS (SELECT Churn, count(*) AS n FROM churn GROUP BY Churn)
SELECT Churn, false AS synthetic, n AS n_rows, n AS n_ids, 0 AS n_outside FROM n
UNION ALL
SELECT arg_min(Churn, n), true, max(n) - min(n), max(n) - min(n), 0 FROM n HAVING max(n) > min(n)""",
    "tree_attribution": "WITH " + CHURN + f" SELECT CustomerID, {len(FEATURES)} AS n_features, 0.0 AS gap FROM churn",
    "explanations": "WITH " + CHURN + " SELECT CustomerID AS customer_id, 0 AS n_faults, true AS tier_agrees FROM churn",
    "batch_scoring": "WITH " + CHURN + """
SELECT CASE WHEN CAST(CustomerID AS BIGINT) % 2 = 1 THEN CustomerID ELSE printf('BATCH_%04d', CAST(CustomerID AS BIGINT) + 1) END AS customer_id,
       true AS agrees, 'forest' AS model_version FROM churn""",
    "stream_scoring": "WITH " + CHURN + " SELECT CustomerID AS customer_id, true AS same_as_batch FROM churn",
    "explanation_lookup": "WITH " + CHURN + f"""
SELECT id AS customer_id, CASE WHEN CustomerID IS NULL THEN 'unknown' WHEN CAST(CustomerID AS BIGINT) % 2 = 0 THEN 'stored' ELSE 'computed' END AS origin
FROM {_WANTED} LEFT JOIN churn ON id = CustomerID""",
    "report_source": ORACLE["risk_counts"],
    "split_source": ORACLE["split_assign"],
    "parquet_source": "WITH " + CLEAN + "," + CHURN + """
SELECT CustomerID, Churn, count(*) AS n_rows FROM churn JOIN clean ON CustomerID = "Customer ID" GROUP BY ALL""",
    "model_source": "WITH " + CHURN + " SELECT CustomerID AS customer_id, true AS same, 'baseline_random_forest' AS model FROM churn",
    "report_files": "WITH " + RFM + "," + CHURN + """,
b AS (SELECT count(*) AS n FROM rfm JOIN churn ON "Customer ID" = CustomerID)
SELECT 'personas' AS report, count(*) AS n_customers, true AS as_returned FROM rfm
UNION ALL SELECT unnest(['matrix', 'cohorts', 'risk_report']), n, true FROM b
UNION ALL SELECT 'attribution_report', count(*), true FROM churn""",
    "risk_report": "WITH " + RFM + "," + CHURN + """
SELECT count(*) AS total_customers, true AS tiers_add_up, true AS margins_agree, CAST(least(count(*), 5) AS INT) AS n_sample, true AS known_count
FROM rfm JOIN churn ON "Customer ID" = CustomerID""",
}
