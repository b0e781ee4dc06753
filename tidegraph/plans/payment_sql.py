"""DuckDB SQL of the payment queries, used as oracle.

``NF`` and the common table expressions below state the terms of the queries in SQL.
"""

from __future__ import annotations

from tidegraph.functions.normal import NO_VALUE_WORDS, WHITESPACE

_WS = "'" + WHITESPACE + "'"
_WORDS = ", ".join(f"'{w}'" for w in NO_VALUE_WORDS)


def nf(column: str) -> str:
    """SQL of the normal form of a column."""
    t = f"lower(trim({column}, {_WS}))"
    return f"(CASE WHEN {t} NOT IN ({_WORDS}) THEN {t} END)"


def current(*columns: str) -> str:
    """CTE body of the current transactions with the given select list."""
    inner = "SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY raw_ingested_at DESC NULLS LAST, raw_delivery_id DESC) AS rn FROM transactions WHERE transaction_id IS NOT NULL"
    return f"SELECT transaction_id, {', '.join(columns)} FROM ({inner}) WHERE rn = 1"


TIMED = "transaction_time IS NOT NULL AND transaction_time >= 0"
PAID = "amount IS NOT NULL AND NOT isnan(amount) AND amount >= 0"
DAY = "(transaction_time // 86400)"
CENTS = "CAST(round(amount * 100) AS BIGINT)"

P1_FOUND = f"""
WITH cur AS ({current("transaction_time", nf("recipient_id") + " AS r", nf("card_id") + " AS c", nf("device_id") + " AS d")})
SELECT {DAY} AS day_no, r AS recipient_id FROM cur WHERE {TIMED} AND r IS NOT NULL
GROUP BY 1, 2 HAVING count(DISTINCT c) >= 20 AND count(DISTINCT c) >= 3 * count(DISTINCT d)
"""

P1_CUBE = f"""
WITH cur AS ({current("transaction_time", nf("recipient_id") + " AS r", nf("product_code") + " AS p", nf("card_id") + " AS c", nf("device_id") + " AS d")})
SELECT CAST(grouping_id(day_no, r, p) AS INT) AS grouping_level, day_no, r AS recipient_id, p AS product_code, count(DISTINCT c) AS exact_card, count(DISTINCT d) AS exact_device, true AS card_within, true AS device_within
FROM (SELECT {DAY} AS day_no, r, p, c, d FROM cur WHERE {TIMED} AND (c IS NOT NULL OR d IS NOT NULL)) GROUP BY CUBE (day_no, r, p)
"""

P2_FOUND = f"""
WITH RECURSIVE cur AS ({current(*(f"{nf(c)} AS {c}" for c in ("card_id", "customer_id", "device_id", "address_id")))}),
keys AS (
  SELECT transaction_id AS t, unnest(['c:' || card_id, 'u:' || customer_id, 'd:' || (CASE WHEN device_id NOT IN (SELECT device_id FROM hub_devices) THEN device_id END), 'a:' || address_id]) AS k FROM cur
),
firsts AS (SELECT t, min(k) AS k0 FROM keys WHERE k IS NOT NULL GROUP BY t),
ties AS (SELECT DISTINCT f.k0 AS u, k.k AS v FROM firsts f JOIN keys k ON f.t = k.t WHERE k.k IS NOT NULL),
edges AS (SELECT u, v FROM ties UNION SELECT v, u FROM ties),
verts AS (SELECT DISTINCT u AS v FROM edges),
lab(v, m) USING KEY (v) AS (
  SELECT v, v AS m FROM verts
  UNION
  SELECT * FROM (
    SELECT e.v AS v, min(x.m) AS m FROM lab AS x JOIN edges e ON x.v = e.u JOIN recurring.lab AS r ON r.v = e.v
    WHERE x.m < r.m GROUP BY e.v)
),
grp AS (SELECT l.m, min(f.t) AS g FROM firsts f JOIN lab l ON f.k0 = l.v GROUP BY l.m)
SELECT c.transaction_id, coalesce(g.g, c.transaction_id) AS group_id
FROM cur c LEFT JOIN firsts f ON c.transaction_id = f.t LEFT JOIN lab l ON f.k0 = l.v LEFT JOIN grp g ON l.m = g.m
"""


P3_FOUND = f"""
WITH cur AS ({current("amount", nf("recipient_id") + " AS r")}),
feat AS (SELECT DISTINCT transaction_id, CAST(specific_max_entity_degree AS DOUBLE) AS d, specific_max_pagerank AS p FROM graph_features),
vals AS (
  SELECT 'amount' AS measure, r, amount AS x FROM cur
  UNION ALL SELECT 'specific_max_entity_degree', r, d FROM cur JOIN feat USING (transaction_id)
  UNION ALL SELECT 'specific_max_pagerank', r, p FROM cur JOIN feat USING (transaction_id)
),
q AS (SELECT measure, r, count(*) AS n, quantile_disc(x, 0.5) AS q50, quantile_disc(x, 0.9) AS q90 FROM vals
  WHERE r IS NOT NULL AND x IS NOT NULL AND NOT isnan(x) AND x >= 0 GROUP BY 1, 2)
SELECT measure, r AS recipient_id FROM q WHERE n >= 25 AND q90 > 0 AND q90 >= 8 * q50
"""

# NaN is made NULL before the filter: filtered with NOT isnan() in a union, DuckDB keeps some NaN.
P3_RANKS = f"""
WITH cur AS ({current("transaction_time", "amount", nf("recipient_id") + " AS r", nf("product_code") + " AS p")}),
feat AS (SELECT DISTINCT transaction_id, CAST(specific_max_entity_degree AS DOUBLE) AS d, specific_max_pagerank AS pr FROM graph_features),
vals AS (
  SELECT 'amount' AS measure, r, p, transaction_time, amount AS x FROM cur
  UNION ALL SELECT 'specific_max_entity_degree', r, p, transaction_time, d FROM cur JOIN feat USING (transaction_id)
  UNION ALL SELECT 'specific_max_pagerank', r, p, transaction_time, pr FROM cur JOIN feat USING (transaction_id)),
ok AS (SELECT * FROM (SELECT * REPLACE (CASE WHEN isnan(x) OR x < 0 THEN NULL ELSE x END AS x) FROM vals) WHERE x IS NOT NULL),
each AS (SELECT measure, 'recipient_id' AS dimension, r AS key_value FROM ok UNION ALL SELECT measure, 'product_code', p FROM ok
  UNION ALL SELECT measure, 'day_no', CAST({DAY} AS VARCHAR) FROM ok WHERE {TIMED})
SELECT measure, dimension, key_value, count(*) AS n, true AS ranks_within FROM each WHERE key_value IS NOT NULL GROUP BY 1, 2, 3
"""

_P4_BASE = f"""
cur AS ({current("transaction_time", "amount", nf("card_id") + " AS card")}),
daily AS (SELECT card, {DAY} AS d, CAST(sum({CENTS}) AS BIGINT) AS cents, count(*) AS n FROM cur WHERE card IS NOT NULL AND {TIMED} AND {PAID} GROUP BY 1, 2),
span AS (SELECT card, min(d) AS d0, max(d) AS d1 FROM daily GROUP BY card),
days AS (SELECT card, d0, d1, unnest(range(d0, d1 + 1)) AS d FROM span),
roll AS (
  SELECT k.card, k.d, k.d0, k.d1,
    CAST(sum(coalesce(x.cents, 0)) OVER w7 AS BIGINT) AS c7, CAST(sum(coalesce(x.cents, 0)) OVER w30 AS BIGINT) AS c30,
    CAST(sum(coalesce(x.n, 0)) OVER w7 AS BIGINT) AS n7, CAST(sum(coalesce(x.n, 0)) OVER w30 AS BIGINT) AS n30
  FROM days k LEFT JOIN daily x ON k.card = x.card AND k.d = x.d
  WINDOW w7 AS (PARTITION BY k.card ORDER BY k.d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), w30 AS (PARTITION BY k.card ORDER BY k.d ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)
)
"""
P4_FOUND = f"WITH {_P4_BASE} SELECT card AS card_id, d AS day_no FROM roll WHERE d >= d0 + 29 AND c30 >= 150000 AND c7 * 5 >= c30 * 4"
P4_ROLLING = f"""WITH {_P4_BASE} SELECT card AS card_id, d AS day_no, c7 / 100.0 AS total_7, n7 AS n_7, c30 / 100.0 AS total_30, n30 AS n_30,
round(CASE WHEN n7 > 0 THEN c7 / 100.0 / n7 END, 6) AS mean_7, round(CASE WHEN n30 > 0 THEN c30 / 100.0 / n30 END, 6) AS mean_30 FROM roll"""

P4_CORRECTED = f"""WITH {_P4_BASE.replace("max(d) AS d1", "(SELECT max(d) FROM daily) AS d1")} SELECT card AS card_id, d AS day_no, c7 AS cents_7, n7 AS n_7, c30 AS cents_30, n30 AS n_30 FROM roll"""

P5_FOUND = f"""
WITH cur AS ({current("transaction_time", "amount", nf("card_id") + " AS card", nf("raw_event_type") + " AS e")}),
ok AS (SELECT * FROM cur WHERE card IS NOT NULL AND {TIMED} AND {PAID}),
whole AS (SELECT card, sum({CENTS}) AS c, max(transaction_time) AS t FROM ok GROUP BY card),
part AS (SELECT card, e, count(*) AS n, sum({CENTS}) AS c, max(transaction_time) AS t FROM ok WHERE e IS NOT NULL GROUP BY 1, 2)
SELECT p.card AS card_id, p.e AS event_type FROM part p JOIN whole w ON p.card = w.card
WHERE p.n >= 5 AND p.c * 2 >= w.c AND p.t <= w.t - 2592000
"""
P5_ENTRIES = f"""
WITH cur AS ({current("transaction_time", "amount", nf("card_id") + " AS card", nf("raw_event_type") + " AS e")})
SELECT card AS card_id, e AS event_type, count(*) AS n, CAST(sum({CENTS}) AS BIGINT) AS cents, max(transaction_time) AS last_time
FROM cur WHERE card IS NOT NULL AND {TIMED} AND {PAID} GROUP BY 1, 2
"""

# Fixed value: the number of event types of the test data, as TESTDATA states it.
_TYPES = 216
_TRIPLES = ", ".join(
    f"CAST(coalesce(sum(n) FILTER (WHERE i = {i}), 0) AS BIGINT) AS n_{i}, coalesce(sum(cents) FILTER (WHERE i = {i}), 0) / 100.0 AS total_{i}, max(t) FILTER (WHERE i = {i}) AS last_{i}" for i in range(_TYPES)
)
P5_FEATURES = f"""
WITH cur AS ({current("transaction_time", "amount", nf("card_id") + " AS card", nf("raw_event_type") + " AS e")}),
types AS (SELECT e, row_number() OVER (ORDER BY e) - 1 AS i FROM (SELECT DISTINCT {nf("raw_event_type")} AS e FROM transactions) WHERE e IS NOT NULL),
part AS (SELECT card, i, count(*) AS n, sum({CENTS}) AS cents, max(transaction_time) AS t FROM cur LEFT JOIN types ON cur.e = types.e WHERE card IS NOT NULL AND {TIMED} AND {PAID} GROUP BY 1, 2)
SELECT card AS card_id, CAST(sum(n) AS BIGINT) AS n_all, sum(cents) / 100.0 AS total_all, max(t) AS last_time_all, {_TRIPLES} FROM part GROUP BY card
"""

_P6_ROWS = f"""
cur AS ({current("amount", nf("device_id") + " AS device_id", nf("payer_email_domain") + " AS payer_email_domain")}),
keyed AS (
  SELECT 'device_id' AS field_name, device_id AS key_value, amount FROM cur
  UNION ALL SELECT 'payer_email_domain', payer_email_domain, amount FROM cur)
"""
P6_TOTALS = f"""WITH {_P6_ROWS} SELECT field_name, key_value, count(*) AS n, count(CASE WHEN {PAID} THEN 1 END) AS n_amounts,
coalesce(CAST(sum(CASE WHEN {PAID} THEN {CENTS} END) AS BIGINT), 0) AS cents FROM keyed GROUP BY 1, 2"""
P6_FOUND = f"""WITH {_P6_ROWS} SELECT field_name, key_value FROM keyed WHERE key_value IS NOT NULL GROUP BY 1, 2
HAVING count(*) * 100 >= (SELECT count(*) FROM cur)"""

_P7_BASE = f"""
cur AS ({current("transaction_time", nf("card_id") + " AS card")}),
ok AS (SELECT * FROM cur WHERE card IS NOT NULL AND {TIMED}),
rep AS (SELECT report_id, transaction_id, is_fraud, known_time, lead(known_time) OVER (PARTITION BY transaction_id ORDER BY known_time, report_id) AS next_known
  FROM label_reports WHERE is_fraud IS NOT NULL AND known_time IS NOT NULL),
pairs AS (
  SELECT t.transaction_id, r.report_id, r.known_time FROM ok t JOIN ok s ON t.card = s.card AND s.transaction_time < t.transaction_time
  JOIN rep r ON r.transaction_id = s.transaction_id
  WHERE r.is_fraud = 1 AND r.known_time <= t.transaction_time AND (r.next_known IS NULL OR r.next_known > t.transaction_time))
"""
P7_FOUND = f"WITH {_P7_BASE} SELECT transaction_id, report_id FROM pairs"
P7_HISTORY = f"""WITH {_P7_BASE} SELECT o.transaction_id, count(p.report_id) AS known_frauds, max(p.known_time) AS last_known_time
FROM ok o LEFT JOIN pairs p ON o.transaction_id = p.transaction_id GROUP BY 1"""
