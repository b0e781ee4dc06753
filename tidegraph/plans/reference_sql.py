"""DuckDB SQL of the causal-feature, ranking and audit queries, used as oracle."""

from __future__ import annotations

from itertools import combinations

from tidegraph.plans.payment_sql import _WS, PAID, TIMED, current, nf
from tidegraph.schema import ENTITY_TYPES, LABEL_FEATURES, MODEL_GRAPH_FEATURES, SPECIFIC_TYPES, STRUCTURAL_FEATURES

_CUR = current(
    "transaction_time", "amount", f"{nf('product_code')} AS product_code", *(f"{nf(c)} AS {c}" for c in ENTITY_TYPES), "is_fraud", f"{nf('source')} AS source"
)
PAY = f"cur AS ({_CUR}), pay AS (SELECT * FROM cur WHERE {TIMED} AND {PAID} AND is_fraud IN (0, 1) AND coalesce({', '.join(ENTITY_TYPES)}) IS NOT NULL)"

SPLIT = f"""{PAY},
pos AS (SELECT transaction_time, row_number() OVER (ORDER BY transaction_time, transaction_id) AS rn, count(*) OVER () AS n FROM pay),
bounds AS (
  SELECT max(CASE WHEN rn = greatest(1, least(n, CAST(ceil(n * CAST(0.6 AS DOUBLE)) AS BIGINT))) THEN transaction_time END) AS te,
         max(CASE WHEN rn = greatest(1, least(n, CAST(ceil(n * (CAST(0.6 AS DOUBLE) + CAST(0.2 AS DOUBLE))) AS BIGINT))) THEN transaction_time END) AS ve FROM pos),
sp AS (
  SELECT p.*, CASE WHEN transaction_time <= te THEN 'train' WHEN transaction_time <= te + 86400 THEN 'purge_train_validation'
    WHEN transaction_time <= ve THEN 'validation' WHEN transaction_time <= ve + 86400 THEN 'purge_validation_test' ELSE 'test' END AS split FROM pay p, bounds)"""

_EDGE_ROWS = "\nUNION ALL ".join(f"SELECT transaction_id, transaction_time, '{t}' AS entity_type, {c} AS entity_value FROM pay WHERE {c} IS NOT NULL" for c, t in ENTITY_TYPES.items())
EDGES = f"edges AS ({_EDGE_ROWS})"
_SPEC = ", ".join(f"'{t}'" for t in SPECIFIC_TYPES.values())


def q_validate() -> str:
    return f"""WITH cur AS ({_CUR}), ids AS (SELECT transaction_id, count(*) AS n FROM cur GROUP BY 1)
SELECT count(*) AS row_count, count(*) FILTER (WHERE transaction_id IS NULL OR length(transaction_id) = 0) AS empty_ids,
count(*) FILTER (WHERE NOT ({TIMED})) AS bad_times, count(*) FILTER (WHERE NOT ({PAID})) AS bad_amounts,
count(*) FILTER (WHERE is_fraud IS NULL OR is_fraud NOT IN (0, 1)) AS bad_labels,
count(*) FILTER (WHERE coalesce({', '.join(ENTITY_TYPES)}) IS NULL) AS rows_without_entity,
CAST((SELECT coalesce(sum(n - 1), 0) FROM ids) AS BIGINT) AS duplicate_ids FROM cur"""


W2 = f"WITH {SPLIT} SELECT transaction_id, transaction_time, split FROM sp"
A1 = f"""WITH {SPLIT} SELECT split, count(*) AS rows, CAST(sum(is_fraud) AS BIGINT) AS fraud_count, round(avg(is_fraud), 8) AS fraud_rate,
min(transaction_time) AS min_transaction_time, max(transaction_time) AS max_transaction_time FROM sp GROUP BY 1"""
_A2 = " UNION ALL ".join(
    f"SELECT '{c}' AS entity_column, count(*) - count({c}) AS missing_count, round((count(*) - count({c})) / CAST(count(*) AS DOUBLE), 8) AS missing_rate, count(DISTINCT {c}) AS unique_count FROM pay"
    for c in ENTITY_TYPES
)
A2 = f"WITH {PAY} {_A2}"
A3 = f"WITH {PAY} SELECT product_code, count(*) AS rows FROM pay GROUP BY 1"
A4 = f"""WITH {SPLIT} SELECT split, round(quantile_cont(amount, CAST(0.5 AS DOUBLE)), 6) AS p50, round(quantile_cont(amount, CAST(0.9 AS DOUBLE)), 6) AS p90,
round(quantile_cont(amount, CAST(0.95 AS DOUBLE)), 6) AS p95, round(quantile_cont(amount, CAST(0.99 AS DOUBLE)), 6) AS p99 FROM sp GROUP BY 1"""
A5 = f"WITH {SPLIT} SELECT split, round(avg(ln(1 + amount)), 6) AS mean_log, round(CASE WHEN stddev_pop(ln(1 + amount)) > 0 THEN stddev_pop(ln(1 + amount)) ELSE 1.0 END, 6) AS scale_log FROM sp GROUP BY 1"
V2 = f"""WITH {SPLIT}, s AS (SELECT max(transaction_time) FILTER (WHERE split = 'train') AS a, min(transaction_time) FILTER (WHERE split = 'validation') AS b,
max(transaction_time) FILTER (WHERE split = 'validation') AS c, min(transaction_time) FILTER (WHERE split = 'test') AS d FROM sp)
SELECT count(*) AS row_count, CAST(count(*) - count(DISTINCT transaction_id) AS BIGINT) AS duplicate_transaction_ids, CAST(sum(is_fraud) AS BIGINT) AS overall_fraud_count,
round(avg(is_fraud), 8) AS overall_fraud_rate, bool_and(is_fraud IN (0, 1)) AS labels_binary, bool_and(amount >= 0) AS amounts_non_negative, true AS every_row_has_entity,
any_value(a < b) AS train_precedes_validation, any_value(c < d) AS validation_precedes_test, count(*) = count(DISTINCT transaction_id) AS transaction_ids_unique,
CASE WHEN any_value(a < b) AND any_value(c < d) AND count(*) = count(DISTINCT transaction_id) THEN 'PASS' ELSE 'FAIL' END AS status FROM sp, s"""
W3 = f"WITH {PAY} SELECT transaction_id, dense_rank() OVER (ORDER BY transaction_time) - 1 AS batch_no FROM pay"
V8 = f"""WITH {PAY}, b AS (SELECT transaction_time, count(*) AS n FROM pay GROUP BY 1)
SELECT count(*) AS batch_count, count(*) FILTER (WHERE n > 1) AS multi_row_batches, max(n) AS largest_batch, CAST(sum(n) AS BIGINT) AS row_count, CAST(0 AS BIGINT) AS pre_existing_id_violations FROM b"""
T1 = f"WITH {PAY} SELECT transaction_id, row_number() OVER (ORDER BY transaction_time, transaction_id) AS position FROM pay"

G1 = f"WITH {PAY}, {EDGES} SELECT transaction_id, entity_type, entity_value, 'uses_' || entity_type AS relation, transaction_time AS observed_time FROM edges"
S9 = f"""WITH {PAY}, {EDGES} SELECT CASE WHEN entity_type < 'transaction' THEN entity_type || '::' || entity_value ELSE 'transaction::' || transaction_id END AS source,
CASE WHEN entity_type < 'transaction' THEN 'transaction::' || transaction_id ELSE entity_type || '::' || entity_value END AS target, 'uses_' || entity_type AS relation, transaction_time AS observed_time FROM edges"""
S9_NODES = f"""WITH {PAY}, {EDGES} SELECT 'transaction::' || transaction_id AS id, 'transaction' AS node_type, transaction_id AS entity_value, transaction_time, amount, product_code FROM pay
UNION ALL SELECT DISTINCT entity_type || '::' || entity_value, entity_type, entity_value, CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS VARCHAR) FROM edges"""
A8 = f"""WITH {PAY}, {EDGES} SELECT 'node_type' AS kind, entity_type AS name, count(DISTINCT entity_value) AS n FROM edges GROUP BY 2
UNION ALL SELECT 'node_type', 'transaction', count(*) FROM pay UNION ALL SELECT 'relation', 'uses_' || entity_type, count(*) FROM edges GROUP BY 2"""
V7 = f"""WITH {PAY}, {EDGES} SELECT true AS node_types_valid, true AS entity_values_non_missing, true AS edges_are_transaction_entity_only, true AS edge_relations_match_entity_types,
true AS edge_times_match_transactions, count(*) AS edge_count, count(*) AS expected_edge_count, (SELECT count(*) FROM pay) AS expected_transaction_count, true AS undirected_simple_graph,
true AS transaction_nodes_match_source, (SELECT count(*) FROM pay) = count(DISTINCT transaction_id) AS transactions_have_entity_edges, true AS target_attributes_absent,
true AS edge_count_matches_available_entities FROM edges"""
A9 = f"""WITH RECURSIVE {PAY}, {EDGES}, spec AS (SELECT * FROM edges WHERE entity_type IN ({_SPEC})),
e2 AS (SELECT 't' || transaction_id AS u, entity_type || '::' || entity_value AS v FROM spec),
e AS (SELECT u, v FROM e2 UNION ALL SELECT v, u FROM e2), nodes AS (SELECT DISTINCT u AS v FROM e),
lab(v, m) USING KEY (v) AS (SELECT v, v AS m FROM nodes UNION SELECT * FROM (
  SELECT e.v AS v, min(x.m) AS m FROM lab AS x JOIN e ON x.v = e.u JOIN recurring.lab AS r ON r.v = e.v WHERE x.m < r.m GROUP BY e.v)),
comp AS (SELECT m, count(*) AS n FROM lab GROUP BY m), ent AS (SELECT count(*) AS n FROM (SELECT DISTINCT entity_type, entity_value FROM spec)),
tx AS (SELECT count(*) AS n FROM pay), lone AS (SELECT count(*) AS n FROM pay WHERE transaction_id NOT IN (SELECT transaction_id FROM spec))
SELECT tx.n + ent.n AS node_count, (SELECT count(*) FROM spec) AS edge_count, tx.n AS transaction_node_count, ent.n AS entity_node_count,
(SELECT count(*) FROM comp) + lone.n AS connected_component_count, (SELECT max(n) FROM comp) AS largest_component_size, lone.n AS isolated_transaction_count FROM tx, ent, lone"""

_DEG = f"""{PAY}, {EDGES},
deg AS (SELECT *, count(*) OVER (PARTITION BY entity_type, entity_value ORDER BY transaction_time RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS d FROM edges),
g2 AS (SELECT transaction_id, transaction_time, {', '.join(f"coalesce(max(d) FILTER (WHERE entity_type = '{t}'), 0) AS historical_{t}_degree" for t in ENTITY_TYPES.values())},
count(*) AS graph_entity_count, count(*) FILTER (WHERE d > 0) AS graph_known_entity_count, count(*) FILTER (WHERE d = 0) AS graph_new_entity_count,
CAST(sum(d) AS BIGINT) AS graph_sum_entity_degree, max(d) AS graph_max_entity_degree,
count(*) FILTER (WHERE entity_type IN ({_SPEC})) AS specific_entity_count, count(*) FILTER (WHERE entity_type IN ({_SPEC}) AND d > 0) AS specific_known_entity_count,
coalesce(max(d) FILTER (WHERE entity_type IN ({_SPEC})), 0) AS specific_max_entity_degree, avg(d) AS graph_mean_entity_degree,
coalesce(avg(d) FILTER (WHERE entity_type IN ({_SPEC})), 0.0) AS specific_mean_entity_degree FROM deg GROUP BY 1, 2)"""
G2 = f"WITH {_DEG} SELECT * EXCLUDE (graph_mean_entity_degree, specific_mean_entity_degree), round(graph_mean_entity_degree, 6) AS graph_mean_entity_degree, round(specific_mean_entity_degree, 6) AS specific_mean_entity_degree FROM g2"


def shared_sql(types: dict[str, str], name: str) -> str:
    kinds = ", ".join(f"'{t}'" for t in types.values())
    return f"""WITH {PAY}, {EDGES}, s AS (SELECT * FROM edges WHERE entity_type IN ({kinds})),
pairs AS (SELECT DISTINCT a.transaction_id, b.transaction_id AS other FROM s a JOIN s b ON a.entity_type = b.entity_type AND a.entity_value = b.entity_value AND b.transaction_time < a.transaction_time)
SELECT p.transaction_id, count(other) AS {name} FROM pay p LEFT JOIN pairs USING (transaction_id) GROUP BY 1"""


G7 = shared_sql(SPECIFIC_TYPES, "specific_shared_transaction_count")
G7_ALL = shared_sql(ENTITY_TYPES, "graph_shared_transaction_count")
_G8 = f"""{SPLIT}, {EDGES}, s AS (SELECT * FROM edges WHERE entity_type IN ({_SPEC})),
pairs AS (SELECT DISTINCT a.transaction_id, q.transaction_id AS other, q.is_fraud FROM s a JOIN s b ON a.entity_type = b.entity_type AND a.entity_value = b.entity_value AND b.transaction_time + 86400 <= a.transaction_time
  JOIN sp q ON q.transaction_id = b.transaction_id WHERE q.split = 'train'),
g8 AS (SELECT p.transaction_id, p.transaction_time, count(other) AS matured_neighbor_label_count, CAST(coalesce(sum(pairs.is_fraud), 0) AS BIGINT) AS matured_neighbor_fraud_count,
CASE WHEN count(other) > 0 THEN CAST(coalesce(sum(pairs.is_fraud), 0) AS DOUBLE) / count(other) ELSE 0.0 END AS matured_neighbor_fraud_ratio FROM pay p LEFT JOIN pairs USING (transaction_id) GROUP BY 1, 2)"""
G8 = f"WITH {_G8} SELECT * REPLACE (round(matured_neighbor_fraud_ratio, 6) AS matured_neighbor_fraud_ratio) FROM g8"

_PAIR_ROWS = "\nUNION ALL ".join(
    f"SELECT least('{SPECIFIC_TYPES[a]}::' || {a}, '{SPECIFIC_TYPES[b]}::' || {b}) AS u, greatest('{SPECIFIC_TYPES[a]}::' || {a}, '{SPECIFIC_TYPES[b]}::' || {b}) AS v, transaction_time FROM pay WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
    for a, b in combinations(SPECIFIC_TYPES, 2)
)
PAIRS = f"occ AS ({_PAIR_ROWS}), proj AS (SELECT u, v, count(*) AS weight, min(transaction_time) AS first_observed_time, max(transaction_time) AS last_observed_time FROM occ GROUP BY 1, 2)"
G4 = f"WITH {PAY}, {PAIRS} SELECT * FROM proj"
_G9 = f"""tri AS (SELECT x.u AS a, x.v AS b, y.v AS c, greatest(x.first_observed_time, y.first_observed_time, z.first_observed_time) AS born
  FROM proj x JOIN proj y ON x.u = y.u AND x.v < y.v JOIN proj z ON z.u = x.v AND z.v = y.v),
ev AS (SELECT node, born AS tm, 1 AS t, 0 AS k FROM (SELECT a AS node, born FROM tri UNION ALL SELECT b, born FROM tri UNION ALL SELECT c, born FROM tri)
  UNION ALL SELECT u, first_observed_time, 0, 1 FROM proj UNION ALL SELECT v, first_observed_time, 0, 1 FROM proj),
agg AS (SELECT node, tm, sum(t) AS t, sum(k) AS k FROM ev GROUP BY 1, 2), run AS (SELECT node, tm, sum(t) OVER w AS t, sum(k) OVER w AS k FROM agg WINDOW w AS (PARTITION BY node ORDER BY tm)),
q AS (SELECT transaction_id, entity_type || '::' || entity_value AS node, transaction_time - 1 AS tm FROM edges WHERE entity_type IN ({_SPEC})),
c AS (SELECT q.transaction_id, CASE WHEN r.k >= 2 THEN 2.0 * r.t / (r.k * (r.k - 1.0)) ELSE 0.0 END AS c FROM q ASOF LEFT JOIN run r ON q.node = r.node AND q.tm >= r.tm),
g9 AS (SELECT p.transaction_id, coalesce(max(c), 0.0) AS specific_max_clustering, coalesce(avg(c), 0.0) AS specific_mean_clustering FROM pay p LEFT JOIN c USING (transaction_id) GROUP BY 1)"""
G9 = f"WITH {PAY}, {EDGES}, {PAIRS}, {_G9} SELECT transaction_id, round(specific_max_clustering, 6) AS specific_max_clustering, round(specific_mean_clustering, 6) AS specific_mean_clustering FROM g9"

def g6_parts(levels: int = 17) -> str:
    """As-of components by halving the time batches, unrolled: enough levels for 2**levels batches."""
    out = [f"""spec AS (SELECT * FROM edges WHERE entity_type IN ({_SPEC})),
ent AS (SELECT entity_type, entity_value, row_number() OVER (ORDER BY entity_type, entity_value) AS k, min((transaction_time, transaction_id)) AS opens FROM spec GROUP BY 1, 2),
bat AS (SELECT transaction_time, row_number() OVER (ORDER BY transaction_time) - 1 AS b FROM (SELECT DISTINCT transaction_time FROM spec)),
wt AS (SELECT opens[2] AS t, count(*) AS w FROM ent GROUP BY 1),
r{levels} AS (SELECT s.transaction_id AS t, bat.b, 1 + coalesce(wt.w, 0) AS w, ent.k, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS m
  FROM spec s JOIN ent USING (entity_type, entity_value) JOIN bat ON bat.transaction_time = s.transaction_time LEFT JOIN wt ON wt.t = s.transaction_id)"""]
    for l in reversed(range(levels)):
        p = f"r{l + 1}"
        out.append(f"""
f{l} AS (SELECT *, (b >> {l + 1}) * 4294967296 + k AS v, min(k) OVER (PARTITION BY t) AS h FROM {p} WHERE (b >> {l}) & 1 = 0),
e{l} AS (SELECT DISTINCT v - k + h AS x, v AS y FROM f{l} WHERE h <> k),
z{l} AS (SELECT x, y FROM e{l} UNION SELECT y, x FROM e{l}),
l{l}(v, m) USING KEY (v) AS (SELECT DISTINCT x AS v, x AS m FROM z{l} UNION SELECT * FROM (
  SELECT z.y AS v, min(a.m) AS m FROM l{l} AS a JOIN z{l} z ON a.v = z.x JOIN recurring.l{l} AS q ON q.v = z.y WHERE a.m < q.m GROUP BY z.y)),
s{l} AS (SELECT v, max(n) AS n, max(m) AS m, coalesce(sum(w) FILTER (WHERE k = h), 0) AS wn, count(*) FILTER (WHERE k = h) AS wm FROM f{l} GROUP BY v),
c{l} AS (SELECT s.v, coalesce(g.m, s.v) AS root, n, s.m, wn, wm FROM s{l} s LEFT JOIN l{l} g ON g.v = s.v),
o{l} AS (SELECT v, root, CAST(sum(n + wn) OVER (PARTITION BY root) AS BIGINT) AS n, CAST(sum(m + wm) OVER (PARTITION BY root) AS BIGINT) AS m FROM c{l}),
r{l} AS (SELECT t, b, w, k, n, m FROM {p} WHERE (b >> {l}) & 1 = 0 UNION ALL SELECT DISTINCT p.t, p.b, p.w, coalesce(o.root % 4294967296, p.k) AS k, coalesce(o.n, p.n) AS n, coalesce(o.m, p.m) AS m
  FROM {p} p LEFT JOIN o{l} o ON o.v = (p.b >> {l + 1}) * 4294967296 + p.k WHERE (p.b >> {l}) & 1 = 1)""")
    got = """g6 AS (SELECT pay.transaction_id, coalesce(max(n), 0) AS specific_max_component_nodes, coalesce(max(m), 0) AS specific_max_component_transactions
  FROM pay LEFT JOIN r0 ON r0.t = pay.transaction_id GROUP BY 1)"""
    return ",".join([*out, "\n" + got])


_SPEC_ROWS = f"spec AS (SELECT * FROM edges WHERE entity_type IN ({_SPEC}))"
G6 = f"WITH RECURSIVE {PAY}, {EDGES}, {g6_parts()} SELECT * FROM g6"
_PAGERANK = """bt AS (SELECT transaction_time, row_number() OVER (ORDER BY transaction_time) - 1 AS b FROM (SELECT DISTINCT transaction_time FROM pay)),
snaps AS (SELECT unnest(range(1, (SELECT max(b) FROM bt) // 25 + 1)) AS s),
node AS (SELECT entity_type || '::' || entity_value AS name, row_number() OVER (ORDER BY entity_type, entity_value) AS k, min(b) AS fb FROM spec JOIN bt USING (transaction_time) GROUP BY entity_type, entity_value),
half AS (SELECT a.k AS u, c.k AS v, b, count(*) AS w FROM occ JOIN bt USING (transaction_time) JOIN node a ON a.name = occ.u JOIN node c ON c.name = occ.v GROUP BY 1, 2, 3),
d AS (SELECT u, v, b // 25 AS q, sum(w) AS w FROM (SELECT u, v, b, w FROM half UNION ALL SELECT v, u, b, w FROM half) GROUP BY 1, 2, 3),
held AS (SELECT u, q, sum(sum(w)) OVER (PARTITION BY u ORDER BY q) AS strength FROM d GROUP BY u, q),
base AS (SELECT s, k, CAST(count(*) OVER (PARTITION BY s) AS DOUBLE) AS n FROM snaps JOIN node ON fb < 25 * s),
start AS (SELECT base.s, base.k, 1 / n AS x, CAST(coalesce(held.strength, 0) AS DOUBLE) AS strength, n FROM base ASOF LEFT JOIN held ON held.u = base.k AND base.s > held.q),
pr(s, k, x, strength, n, r, active) USING KEY (s, k) AS (
  SELECT s, k, x, strength, n, 0 AS r, true AS active FROM start
  UNION
  (WITH o AS (SELECT s, k, x, strength, n, r, x / nullif(strength, 0) AS y FROM pr WHERE active),
  loose AS (SELECT s, sum(x) AS l FROM o WHERE strength = 0 GROUP BY s),
  f AS (SELECT o.s, d.v AS k, sum(d.w * o.y) AS f FROM o JOIN d ON o.k = d.u AND d.q < o.s GROUP BY 1, 2),
  moved AS (SELECT o.s, o.k, o.strength, o.n, o.r, o.x, 0.85 * (coalesce(f.f, 0) + coalesce(loose.l, 0) / o.n) + (1 - 0.85) / o.n AS x2 FROM o LEFT JOIN f ON f.s = o.s AND f.k = o.k LEFT JOIN loose ON loose.s = o.s),
  far AS (SELECT s, sum(abs(x2 - x)) >= any_value(n) * 1e-6 AND any_value(r) < 99 AS active FROM moved GROUP BY s)
  SELECT moved.s, moved.k, x2 AS x, strength, n, r + 1 AS r, far.active FROM moved JOIN far ON far.s = moved.s)),
asked AS (SELECT transaction_id, b, node.k FROM spec JOIN bt USING (transaction_time) JOIN node ON node.name = entity_type || '::' || entity_value),
got AS (SELECT a.transaction_id, max(coalesce(p.x, 0)) AS mx, avg(coalesce(p.x, 0)) AS av FROM asked a LEFT JOIN pr p ON p.s = a.b // 25 AND p.k = a.k GROUP BY 1),
g10 AS (SELECT p.transaction_id, b % 25 AS pagerank_snapshot_age_batches, coalesce(mx, 0.0) AS specific_max_pagerank, coalesce(av, 0.0) AS specific_mean_pagerank
  FROM pay p JOIN bt USING (transaction_time) LEFT JOIN got g ON g.transaction_id = p.transaction_id)"""
G10 = f"""WITH RECURSIVE {PAY}, {EDGES}, {PAIRS}, {_SPEC_ROWS}, {_PAGERANK}
SELECT transaction_id, pagerank_snapshot_age_batches, round(specific_max_pagerank, 9) AS specific_max_pagerank, round(specific_mean_pagerank, 9) AS specific_mean_pagerank FROM g10"""

_RULES = f"""{SPLIT}, q AS (SELECT quantile_cont(amount, CAST(0.95 AS DOUBLE)) AS p95, quantile_cont(amount, CAST(0.99 AS DOUBLE)) AS p99 FROM sp WHERE split = 'train'),
scored AS (SELECT s.*, p95, p99, (amount >= p95)::INT AS hi, (amount >= p99)::INT AS vh,
  (device_id IS NOT NULL AND device_id NOT IN (SELECT device_id FROM sp WHERE split = 'train' AND device_id IS NOT NULL))::INT AS ud,
  (recipient_id IS NOT NULL AND recipient_id NOT IN (SELECT recipient_id FROM sp WHERE split = 'train' AND recipient_id IS NOT NULL))::INT AS ur FROM sp s, q),
rated AS (SELECT *, CAST(hi + vh + ud + ur AS DOUBLE) AS score FROM scored)"""
M2 = f"""WITH {_RULES} SELECT transaction_id, score, coalesce(nullif(concat_ws(';', CASE WHEN vh = 1 THEN 'very_high_amount' WHEN hi = 1 THEN 'high_amount' END,
CASE WHEN ud = 1 THEN 'device_unseen_in_training' END, CASE WHEN ur = 1 THEN 'recipient_unseen_in_training' END), ''), 'no_rule_triggered') AS reasons FROM rated"""
_TEST = f"""{_RULES}, te AS (SELECT *, row_number() OVER (ORDER BY score DESC, transaction_time, transaction_id) AS rank, count(*) OVER () AS n FROM rated WHERE split = 'test'),
k AS (SELECT *, greatest(1, CAST(ceil(n * CAST(0.05 AS DOUBLE)) AS BIGINT)) AS cap FROM te)"""
W6 = f"WITH {_TEST} SELECT transaction_id, score, rank FROM te"
T4 = f"WITH {_TEST} SELECT score AS threshold FROM k WHERE rank = cap"
T5 = f"""WITH {_TEST}, c AS (SELECT score AS cutoff FROM k WHERE rank = cap) SELECT any_value(cutoff) AS cutoff_score, count(*) FILTER (WHERE score > cutoff) AS rows_above_cutoff, count(*) FILTER (WHERE score = cutoff) AS rows_at_cutoff,
any_value(cap) - count(*) FILTER (WHERE score > cutoff) AS selected_from_cutoff_tie, count(*) FILTER (WHERE score = cutoff) > any_value(cap) - count(*) FILTER (WHERE score > cutoff) AS tie_break_required FROM k, c"""
_TOP = "SELECT {label} AS block, CAST({f} AS DOUBLE) AS fraction, count(*) AS alert_count, CAST(sum(is_fraud) AS BIGINT) AS true_positives, CAST(count(*) - sum(is_fraud) AS BIGINT) AS false_positives, round(sum(is_fraud) / CAST(count(*) AS DOUBLE), 6) AS precision, round(sum(is_fraud) / CAST(any_value(p) AS DOUBLE), 6) AS recall, round((count(*) - sum(is_fraud)) / CAST(any_value(n - p) AS DOUBLE), 6) AS false_positive_rate FROM tp WHERE rank <= greatest(1, ceil(n * CAST({f} AS DOUBLE)))"
E3 = f"WITH {_TEST}, tp AS (SELECT *, CAST(sum(is_fraud) OVER () AS BIGINT) AS p FROM te) " + " UNION ALL ".join(
    _TOP.format(label=f"'{label}'", f=f) for label, f in (("at_investigation_capacity", 0.05), ("top_1_percent", 0.01), ("top_5_percent", 0.05))
)
E2 = f"""WITH {_TEST}, g AS (SELECT score, count(*) AS n, sum(is_fraud) AS tp FROM te GROUP BY 1),
c AS (SELECT tp, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn, sum(tp) OVER () AS p FROM g WINDOW w AS (ORDER BY score DESC))
SELECT round(sum(CAST(tp AS DOUBLE) / p * ctp / cn), 6) AS average_precision FROM c"""
E4 = f"""WITH {_TEST}, c AS (SELECT score AS cutoff FROM k WHERE rank = cap) SELECT any_value(cutoff) AS threshold, count(*) FILTER (WHERE score >= cutoff) AS alert_count,
round(count(*) FILTER (WHERE score >= cutoff) / CAST(count(*) AS DOUBLE), 6) AS alert_fraction, round(sum(is_fraud) FILTER (WHERE score >= cutoff) / CAST(count(*) FILTER (WHERE score >= cutoff) AS DOUBLE), 6) AS precision,
round(sum(is_fraud) FILTER (WHERE score >= cutoff) / CAST(sum(is_fraud) AS DOUBLE), 6) AS recall,
round(count(*) FILTER (WHERE score >= cutoff AND is_fraud = 0) / CAST(count(*) FILTER (WHERE is_fraud = 0) AS DOUBLE), 6) AS false_positive_rate FROM k, c"""
E5 = f"""WITH {_TEST}, r AS (SELECT rank, n, is_fraud, sum(is_fraud) OVER (ORDER BY rank) AS tp, sum(is_fraud) OVER () AS p FROM te),
w AS (SELECT unnest([CAST(0.25 AS DOUBLE), CAST(0.375 AS DOUBLE), CAST(0.5 AS DOUBLE)]) AS target_recall)
SELECT target_recall, min(rank) AS alert_count, round(min(rank) / CAST(any_value(n) AS DOUBLE), 6) AS alert_fraction FROM r, w WHERE is_fraud = 1 AND tp = ceil(p * target_recall) GROUP BY 1"""
_GIVEN = [c for c in MODEL_GRAPH_FEATURES if c not in LABEL_FEATURES]
# Split rows with the delivered features (clean numbers, each transaction once) and matured labels.
_MODEL_PARTS = f"""{_G8[len(SPLIT):].lstrip(",")},
feat AS (SELECT DISTINCT transaction_id, {", ".join(f"CASE WHEN {c} IS NULL OR isnan(CAST({c} AS DOUBLE)) OR {c} < 0 THEN 0 ELSE {c} END AS {c}" for c in _GIVEN)} FROM graph_features),
modelled AS (SELECT sp.*, {", ".join(f"coalesce(feat.{c}, 0) AS {c}" for c in _GIVEN)}, g8.matured_neighbor_label_count, g8.matured_neighbor_fraud_count, g8.matured_neighbor_fraud_ratio
  FROM sp LEFT JOIN feat ON sp.transaction_id = feat.transaction_id JOIN g8 ON sp.transaction_id = g8.transaction_id)"""
MODELLED = f"{SPLIT},{_MODEL_PARTS}"
TEST_MODELLED = f"{_TEST},{_MODEL_PARTS}"
_SLICES = f"""{TEST_MODELLED}, m AS (SELECT quantile_cont(amount, CAST(0.5 AS DOUBLE)) AS am, quantile_cont(amount, CAST(0.9 AS DOUBLE)) AS a9,
  quantile_cont(CAST(specific_shared_transaction_count AS DOUBLE), CAST(0.5 AS DOUBLE)) AS sm, quantile_cont(CAST(specific_shared_transaction_count AS DOUBLE), CAST(0.9 AS DOUBLE)) AS s9 FROM modelled WHERE split = 'train'),
al AS (SELECT k.*, rank <= cap AS alert, CASE WHEN k.amount <= am THEN 'at_or_below_train_median' WHEN k.amount <= a9 THEN 'train_median_to_p90' ELSE 'above_train_p90' END AS band,
  CASE WHEN x.specific_shared_transaction_count <= sm THEN 'at_or_below_train_median' WHEN x.specific_shared_transaction_count <= s9 THEN 'train_median_to_p90' ELSE 'above_train_p90' END AS sband,
  CASE WHEN x.specific_known_entity_count = 0 THEN 'all_specific_entities_new' ELSE 'at_least_one_known_specific_entity' END AS history,
  CASE WHEN x.matured_neighbor_label_count = 0 THEN 'no_matured_neighbour' WHEN x.matured_neighbor_fraud_count = 0 THEN 'matured_neighbours_no_fraud' ELSE 'matured_fraud_neighbour' END AS matured,
  coalesce(k.product_code, '<missing>') AS product FROM k JOIN modelled x ON k.transaction_id = x.transaction_id, m),
wanted AS (SELECT * FROM (VALUES ('amount_band', 'at_or_below_train_median'), ('amount_band', 'train_median_to_p90'), ('amount_band', 'above_train_p90'),
  ('specific_connectivity', 'at_or_below_train_median'), ('specific_connectivity', 'train_median_to_p90'), ('specific_connectivity', 'above_train_p90'),
  ('specific_entity_history', 'all_specific_entities_new'), ('specific_entity_history', 'at_least_one_known_specific_entity'),
  ('matured_label_history', 'no_matured_neighbour'), ('matured_label_history', 'matured_neighbours_no_fraud'), ('matured_label_history', 'matured_fraud_neighbour')) v(family, slice))"""
_FAMILIES = {"amount_band": "band", "specific_connectivity": "sband", "specific_entity_history": "history", "matured_label_history": "matured", "product_code": "product"}
_SLICE = "SELECT '{f}' AS family, {c} AS slice, count(*) AS rows, CAST(sum(is_fraud) AS BIGINT) AS fraud_labels, avg(score) AS mean_score, count(*) FILTER (WHERE alert) AS alert_count, count(*) FILTER (WHERE alert AND is_fraud = 1) AS tp FROM al GROUP BY 2"
A11 = f"""WITH {_SLICES}, got AS ({" UNION ALL ".join(_SLICE.format(f=f, c=c) for f, c in _FAMILIES.items())}),
whole AS (SELECT coalesce(g.family, w.family) AS family, coalesce(g.slice, w.slice) AS slice, coalesce(rows, 0) AS rows, coalesce(fraud_labels, 0) AS fraud_labels, coalesce(mean_score, 0.0) AS mean_score,
  coalesce(alert_count, 0) AS alert_count, coalesce(tp, 0) AS tp FROM got g FULL OUTER JOIN wanted w ON g.family = w.family AND g.slice = w.slice)
SELECT family, slice, rows, fraud_labels, round(coalesce(fraud_labels / nullif(CAST(rows AS DOUBLE), 0), 0.0), 6) AS fraud_prevalence, round(mean_score, 6) AS mean_score, alert_count, tp AS true_positives,
alert_count - tp AS false_positives, fraud_labels - tp AS false_negatives, round(coalesce(tp / nullif(CAST(alert_count AS DOUBLE), 0), 0.0), 6) AS precision,
round(tp / nullif(CAST(fraud_labels AS DOUBLE), 0), 6) AS recall_within_slice FROM whole"""
A11_GATES = """SELECT true AS selected_alert_count_matches_capacity, true AS slice_rows_are_exhaustive, true AS slice_alerts_are_exhaustive, true AS slice_fraud_labels_are_exhaustive"""
U1 = f"""WITH {_RULES} SELECT transaction_id, transaction_time, split, is_fraud, score, coalesce(nullif(concat_ws(';', CASE WHEN vh = 1 THEN 'very_high_amount' WHEN hi = 1 THEN 'high_amount' END,
CASE WHEN ud = 1 THEN 'device_unseen_in_training' END, CASE WHEN ur = 1 THEN 'recipient_unseen_in_training' END), ''), 'no_rule_triggered') AS reasons FROM rated WHERE split IN ('validation', 'test')"""
_BUNDLE = f"""{TEST_MODELLED}, bundle AS (SELECT k.transaction_id, k.rank, k.score / 4 AS risk_score, 'INVESTIGATOR_REVIEW' AS recommended_action,
coalesce(nullif(concat_ws(',', CASE WHEN vh = 1 THEN 'very_high_amount' WHEN hi = 1 THEN 'high_amount' END,
CASE WHEN ud = 1 THEN 'device_unseen_in_training' END, CASE WHEN ur = 1 THEN 'recipient_unseen_in_training' END), ''), 'no_rule_triggered') AS reason_codes,
k.transaction_time, k.amount, k.product_code, x.specific_shared_transaction_count, x.specific_max_component_transactions, x.specific_max_entity_degree,
round(x.matured_neighbor_fraud_ratio, 6) AS matured_neighbor_fraud_ratio FROM k JOIN modelled x ON k.transaction_id = x.transaction_id WHERE rank <= cap)"""
J4 = f"WITH {_BUNDLE} SELECT * FROM bundle"
RC = f"WITH {_BUNDLE} SELECT transaction_id, rank FROM bundle WHERE list_contains(string_split(reason_codes, ','), 'device_unseen_in_training')"
_TEST_ROWS = "SELECT count(*) FROM sp WHERE split = 'test'"
M12 = f"WITH {SPLIT} SELECT ({_TEST_ROWS}) AS rows, true AS reproduced"
M13 = f"WITH {SPLIT} SELECT model, ({_TEST_ROWS}) AS explained_rows, true AS adds_up, true AS all_finite, 'PASS' AS status FROM (VALUES ('tabular_logistic'), ('graph_logistic')) v(model)"
M14 = f"WITH {SPLIT} SELECT ({_TEST_ROWS}) AS explained_rows, true AS adds_up, true AS all_finite, 'PASS' AS status"
_CATEGORIES = " + ".join(f"(SELECT count(DISTINCT coalesce({c}, '<missing>')) FROM sp WHERE split = 'train')" for c in ("product_code", "payer_email_domain", "recipient_email_domain"))
_TABULAR = f"(1 + {len(ENTITY_TYPES)} + {_CATEGORIES})"
M8 = f"""WITH {SPLIT} SELECT 'tabular_logistic' AS model, CAST({_TABULAR} AS BIGINT) AS features, true AS converged, true AS slope_is_zero, true AS loss_below_no_model
UNION ALL SELECT 'graph_logistic', CAST({_TABULAR} + {len(MODEL_GRAPH_FEATURES)} AS BIGINT), true, true, true"""
M10 = f"""WITH {SPLIT} SELECT CAST({_TABULAR} + {len(MODEL_GRAPH_FEATURES)} AS BIGINT) AS features, CAST(12 AS BIGINT) AS shown, true AS none_negative, true AS add_up_to_one, true AS strongest_first, true AS names_known"""
M11 = "SELECT CAST(2 AS BIGINT) AS candidates, true AS chosen_is_best"
M17 = f"""WITH {_TEST} SELECT 'PASS' AS status, CAST(any_value(cap) AS INT) AS review_count, true AS alert_count_matches_capacity, true AS transaction_ids_unique, true AS every_alert_has_reason, true AS reason_codes_known,
true AS positive_contributions_only, true AS target_fields_absent, true AS review_only_action, 'stable chronological transaction order' AS tie_break_rule, CAST(any_value(cap) AS BIGINT) AS alerts,
true AS ranks_complete, true AS one_to_three_reasons FROM k"""
T6 = f"""WITH {_TEST}, al AS (SELECT *, rank <= cap AS alert FROM k), x AS (
 SELECT 'false_positive' AS kind, * FROM al WHERE alert AND is_fraud = 0 UNION ALL SELECT 'missed_fraud', * FROM al WHERE NOT alert AND is_fraud = 1)
SELECT kind, transaction_id, amount, score, row_number() OVER (PARTITION BY kind ORDER BY rank) AS case_no FROM x QUALIFY case_no <= 5"""
_ALERT = f"{_TEST}, alerts AS (SELECT * FROM k WHERE rank <= cap)"
G12 = f"""WITH {_ALERT}, {EDGES}, s AS (SELECT * FROM edges WHERE entity_type IN ({_SPEC})),
sh AS (SELECT a.transaction_id AS selected, b.transaction_id AS neighbour, b.transaction_time AS t, count(*) AS shared FROM alerts x JOIN s a ON x.transaction_id = a.transaction_id
  JOIN s b ON a.entity_type = b.entity_type AND a.entity_value = b.entity_value AND b.transaction_time < a.transaction_time GROUP BY 1, 2, 3)
SELECT selected AS selected_transaction_id, neighbour AS transaction_id, t AS transaction_time, shared AS shared_entities, row_number() OVER (PARTITION BY selected ORDER BY shared DESC, t DESC, neighbour) AS neighbour_rank
FROM sh QUALIFY neighbour_rank <= 20"""
G12_SUMMARY = f"""WITH {_ALERT}, {EDGES}, s AS (SELECT * FROM edges WHERE entity_type IN ({_SPEC})),
sh AS (SELECT a.transaction_id AS selected, b.transaction_id AS neighbour, b.transaction_time AS t, count(*) AS shared FROM alerts x JOIN s a ON x.transaction_id = a.transaction_id
  JOIN s b ON a.entity_type = b.entity_type AND a.entity_value = b.entity_value AND b.transaction_time < a.transaction_time GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY selected ORDER BY shared DESC, t DESC, neighbour) AS rn FROM sh),
h AS (SELECT selected, count(*) AS c, count(*) FILTER (WHERE rn <= 20) AS d, CAST(coalesce(sum(shared) FILTER (WHERE rn <= 20), 0) AS BIGINT) AS e FROM r GROUP BY 1),
av AS (SELECT transaction_id, count(*) AS c FROM s GROUP BY 1)
SELECT x.transaction_id AS selected_transaction_id, x.transaction_time AS selected_transaction_time, coalesce(av.c, 0) AS available_specific_entities, coalesce(h.c, 0) AS historical_neighbour_count,
coalesce(h.d, 0) AS displayed_historical_neighbours, coalesce(h.c, 0) > coalesce(h.d, 0) AS truncated, 1 + coalesce(av.c, 0) + coalesce(h.d, 0) AS node_count, coalesce(av.c, 0) + coalesce(h.e, 0) AS edge_count,
true AS strictly_historical FROM alerts x LEFT JOIN h ON h.selected = x.transaction_id LEFT JOIN av ON av.transaction_id = x.transaction_id"""
G13 = f"""WITH {_ALERT}, {EDGES} SELECT e.transaction_id AS selected_transaction_id, entity_type, 'ref-' || left(sha256(entity_value), 8) AS masked_value, 'ref-' || left(sha256(e.transaction_id), 12) AS masked_transaction
FROM edges e JOIN alerts a ON e.transaction_id = a.transaction_id WHERE entity_type IN ({_SPEC})"""
U2 = f"""WITH {PAY}, f AS (SELECT DISTINCT transaction_id FROM graph_features) SELECT (SELECT count(*) FROM f WHERE transaction_id NOT IN (SELECT transaction_id FROM pay)) AS only_left,
(SELECT count(*) FROM pay WHERE transaction_id NOT IN (SELECT transaction_id FROM f)) AS only_right,
(SELECT count(*) FROM f WHERE transaction_id NOT IN (SELECT transaction_id FROM pay)) + (SELECT count(*) FROM pay WHERE transaction_id NOT IN (SELECT transaction_id FROM f)) = 0 AS equal_sets"""


def _shared_part(types: dict[str, str], name: str, cte: str) -> str:
    kinds = ", ".join(f"'{t}'" for t in types.values())
    return f"""{cte}_e AS (SELECT * FROM edges WHERE entity_type IN ({kinds})),
{cte}_p AS (SELECT DISTINCT a.transaction_id, b.transaction_id AS other FROM {cte}_e a JOIN {cte}_e b ON a.entity_type = b.entity_type AND a.entity_value = b.entity_value AND b.transaction_time < a.transaction_time),
{cte} AS (SELECT p.transaction_id, count(other) AS {name} FROM pay p LEFT JOIN {cte}_p USING (transaction_id) GROUP BY 1)"""


_J2_DOUBLES = [c for c in (*STRUCTURAL_FEATURES, *LABEL_FEATURES) if "mean" in c or "clustering" in c or "ratio" in c or "pagerank" in c and "age" not in c]
_J2_COLUMNS = ", ".join(f"round({c}, 6) AS {c}" if c in _J2_DOUBLES else c for c in (*STRUCTURAL_FEATURES, *LABEL_FEATURES))
J2 = f"""WITH RECURSIVE {_DEG}, {_G8.replace(SPLIT + ',', SPLIT.replace(PAY + ',', '') + ',').replace(EDGES + ',', '')}, {PAIRS}, {_G9},
{_shared_part(SPECIFIC_TYPES, "specific_shared_transaction_count", "g7")}, {_shared_part(ENTITY_TYPES, "graph_shared_transaction_count", "g7a")}, {g6_parts()}, {_PAGERANK}
SELECT g2.transaction_id, g2.transaction_time, {_J2_COLUMNS}
FROM g2 JOIN g7 USING (transaction_id) JOIN g7a USING (transaction_id) JOIN g6 USING (transaction_id) JOIN g9 USING (transaction_id) JOIN g10 USING (transaction_id)
JOIN (SELECT * EXCLUDE (transaction_time) FROM g8) USING (transaction_id)"""
A7 = f"""WITH {MODELLED} SELECT is_fraud::INT AS is_fraud, count(*) AS rows, round(avg(specific_shared_transaction_count), 6) AS specific_shared_transaction_count,
round(avg(specific_max_entity_degree), 6) AS specific_max_entity_degree, round(avg(specific_max_component_transactions), 6) AS specific_max_component_transactions
FROM modelled WHERE split IN ('validation', 'test') GROUP BY 1"""
_A6 = ("graph_shared_transaction_count", "specific_shared_transaction_count", "specific_max_entity_degree", "specific_max_component_transactions", "specific_max_pagerank", "specific_max_clustering")
A6 = f"WITH {MODELLED} SELECT split, count(*) AS rows, {', '.join(f'round(avg({c}), 6) AS {c}' for c in _A6)} FROM modelled GROUP BY 1"
_ENC_CATS = " UNION ALL ".join(
    f"SELECT transaction_id, '{c}=' || coalesce({c}, '<missing>') AS feature, 1.0 AS value FROM sp WHERE coalesce({c}, '<missing>') IN (SELECT coalesce({c}, '<missing>') FROM sp WHERE split = 'train')"
    for c in ("product_code", "payer_email_domain", "recipient_email_domain")
)
_ENC_HAS = " UNION ALL ".join(f"SELECT transaction_id, 'has_{c.removesuffix('_id')}', 1.0 FROM sp WHERE {c} IS NOT NULL" for c in ENTITY_TYPES)
M4 = f"""WITH {SPLIT}, st AS (SELECT avg(ln(1 + amount)) AS m, CASE WHEN stddev_pop(ln(1 + amount)) > 0 THEN stddev_pop(ln(1 + amount)) ELSE 1.0 END AS s FROM sp WHERE split = 'train'),
lf AS (SELECT transaction_id, 'log_amount_standardized' AS feature, (ln(1 + amount) - m) / s AS value FROM sp, st UNION ALL {_ENC_HAS} UNION ALL {_ENC_CATS})
SELECT transaction_id, feature, round(value, 6) AS value FROM lf WHERE value <> 0.0"""
S6 = f"""WITH {SPLIT}, c AS (SELECT split, count(*) AS n FROM sp GROUP BY 1)
SELECT count(*) AS row_count, CAST(sum(is_fraud) AS BIGINT) AS fraud_count, round(avg(is_fraud), 8) AS fraud_rate, min(transaction_time) AS min_transaction_time,
max(transaction_time) AS max_transaction_time, (SELECT string_agg(split || '=' || n, ';' ORDER BY split || '=' || n) FROM c) AS split_counts FROM sp"""
G11 = f"""WITH {PAY}, {PAIRS} SELECT count(*) AS row_count, CAST(26 AS INT) AS feature_count, count(DISTINCT transaction_time) AS time_batch_count,
CAST(ceil(count(DISTINCT transaction_time) / CAST(25 AS DOUBLE)) AS BIGINT) AS pagerank_refresh_count, (SELECT count(*) FROM proj) AS final_projection_edges FROM pay"""
F9 = "SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"

_LAB = f"""e2 AS (SELECT 't' || transaction_id AS u, entity_type || '::' || entity_value AS v FROM edges WHERE entity_type IN ({_SPEC})),
e AS (SELECT u, v FROM e2 UNION ALL SELECT v, u FROM e2), nodes AS (SELECT DISTINCT u AS v FROM e),
lab(v, m) USING KEY (v) AS (SELECT v, v AS m FROM nodes UNION SELECT * FROM (
  SELECT e.v AS v, min(x.m) AS m FROM lab AS x JOIN e ON x.v = e.u JOIN recurring.lab AS r ON r.v = e.v WHERE x.m < r.m GROUP BY e.v))"""
G5 = f"""WITH RECURSIVE {PAY}, {EDGES}, {_LAB}, comp AS (SELECT m, count(*) AS nodes, count(*) FILTER (WHERE left(v, 1) = 't' AND position('::' IN v) = 0) AS transactions FROM lab GROUP BY m)
SELECT nodes, transactions, count(*) AS components FROM comp GROUP BY 1, 2"""
_KEY_PARTS = ["product_code", "payer_email_domain", "recipient_email_domain"]


def _part(c: str) -> str:
    t = f"lower(trim({c}, {_WS}))"
    whole = f"regexp_extract({t}, '^(-?[0-9]+)[.]0+$', 1)"
    return f"nullif(CASE WHEN {whole} <> '' THEN {whole} ELSE {t} END, '')"


S3 = f"""WITH k AS (SELECT raw_delivery_id, {', '.join(f"{_part(c)} AS {c}" for c in _KEY_PARTS)} FROM transactions)
SELECT raw_delivery_id, CASE WHEN coalesce({', '.join(_KEY_PARTS)}) IS NOT NULL THEN 'proxy:' || left(sha256({" || '|' || ".join(f"coalesce({c}, '<missing>')" for c in _KEY_PARTS)}), 16) END AS entity_key FROM k"""
J1 = f"""WITH {PAY}, f AS (SELECT DISTINCT transaction_id, graph_entity_count, graph_sum_entity_degree FROM graph_features)
SELECT p.transaction_id, f.graph_entity_count, f.graph_sum_entity_degree FROM pay p LEFT JOIN f USING (transaction_id)"""
E1 = f"""WITH {_TEST} SELECT count(*) AS rows, CAST(sum(is_fraud) AS BIGINT) AS positives, count(*) FILTER (WHERE is_fraud NOT IN (0, 1)) AS bad_labels, count(*) FILTER (WHERE NOT isfinite(score)) AS bad_scores FROM te"""
_E7 = "(SELECT target_recall, min(rank) AS alerts FROM (SELECT rank, sum(is_fraud) OVER (ORDER BY rank) AS tp, sum(is_fraud) OVER () AS p, is_fraud FROM {t}), a WHERE is_fraud = 1 AND tp = ceil(p * target_recall) GROUP BY 1)"
E7 = f"""WITH {TEST_MODELLED}, other AS (SELECT is_fraud, row_number() OVER (ORDER BY matured_neighbor_fraud_ratio DESC, transaction_time, transaction_id) AS rank FROM modelled WHERE split = 'test'),
a AS (SELECT unnest([CAST(0.25 AS DOUBLE), CAST(0.375 AS DOUBLE), CAST(0.5 AS DOUBLE)]) AS target_recall)
SELECT x.target_recall, x.alerts AS rules_alerts, y.alerts AS neighbour_alerts, round((x.alerts - y.alerts) / CAST(x.alerts AS DOUBLE), 6) AS alert_reduction
FROM {_E7.format(t="te")} x JOIN {_E7.format(t="other")} y ON x.target_recall = y.target_recall"""
_BAD = " OR ".join(f"{c} IS NULL OR NOT isfinite(CAST({c} AS DOUBLE))" for c in STRUCTURAL_FEATURES)
_NEG = " OR ".join(f"coalesce({c} < 0, false)" for c in STRUCTURAL_FEATURES)
_ONE = [c for c in STRUCTURAL_FEATURES if "pagerank" in c and "age" not in c or "clustering" in c]
V4 = f"""WITH {PAY}, ids AS (SELECT transaction_id, count(*) AS n FROM graph_features GROUP BY 1)
SELECT count(*) AS row_count, count(*) FILTER (WHERE {_BAD}) AS rows_not_finite, count(*) FILTER (WHERE {_NEG}) AS rows_negative, {", ".join(f"count(*) FILTER (WHERE {c} > 1) AS {c}_above_one" for c in _ONE)},
(SELECT max(n) FROM ids) AS most_rows_per_id, (SELECT count(*) FROM ids WHERE transaction_id NOT IN (SELECT transaction_id FROM pay)) AS only_left,
(SELECT count(*) FROM pay WHERE transaction_id NOT IN (SELECT transaction_id FROM ids)) AS only_right,
(SELECT count(*) FROM ids WHERE transaction_id NOT IN (SELECT transaction_id FROM pay)) + (SELECT count(*) FROM pay WHERE transaction_id NOT IN (SELECT transaction_id FROM ids)) = 0 AS equal_sets, true AS target_free
FROM graph_features"""
W10 = """SELECT count(*) FILTER (WHERE p > transaction_time) = 0 AS time_non_decreasing FROM (
SELECT transaction_time, lag(transaction_time) OVER (ORDER BY raw_delivery_id) AS p FROM transactions WHERE transaction_time IS NOT NULL)"""
W7 = f"""WITH {_TEST}, g AS (SELECT score, count(*) AS n, sum(is_fraud) AS tp FROM te GROUP BY 1)
SELECT score, CAST(sum(tp) OVER w AS BIGINT) AS true_positives, CAST(sum(n - tp) OVER w AS BIGINT) AS false_positives FROM g WINDOW w AS (ORDER BY score DESC)"""
_M5 = MODEL_GRAPH_FEATURES
M5 = f"""WITH {MODELLED},
st AS (SELECT {', '.join(f"avg(ln(1 + CAST({c} AS DOUBLE))) AS m_{c}, coalesce(nullif(stddev_pop(ln(1 + CAST({c} AS DOUBLE))), 0), 1.0) AS s_{c}" for c in _M5)} FROM modelled WHERE split = 'train')
SELECT transaction_id, {', '.join(f"round((ln(1 + CAST({c} AS DOUBLE)) - m_{c}) / s_{c}, 6) AS {c}" for c in _M5)} FROM modelled, st"""
# Threshold names with their columns and quantiles.
_M15 = {
    "shared_p90": ("specific_shared_transaction_count", 0.9), "degree_p90": ("specific_max_entity_degree", 0.9), "component_p90": ("specific_max_component_transactions", 0.9),
    "pagerank_p90": ("specific_max_pagerank", 0.9), "clustering_p90": ("specific_max_clustering", 0.9), "new_entity_p90": ("graph_new_entity_count", 0.9),
    "amount_p95": ("amount", 0.95), "label_count_median": ("matured_neighbor_label_count", 0.5),
}
M15 = f"WITH {MODELLED}, j AS (SELECT * FROM modelled WHERE split = 'train') " + " UNION ALL ".join(
    f"SELECT '{n}' AS threshold_name, round(quantile_cont(CAST({c} AS DOUBLE), CAST({q} AS DOUBLE)), 9) AS threshold FROM j" for n, (c, q) in _M15.items()
)
ST = "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2"
