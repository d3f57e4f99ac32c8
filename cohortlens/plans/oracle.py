"""DuckDB SQL for each registered query (same tables, same column names).

Written independently of the Spark operators: plain SQL over the shared tables, with
the same bindings and rules, doubles rounded to 6 decimals.
"""
from __future__ import annotations

SEED = 42

# ---------------------------------------------------------------- binding A inputs
A_INPUTS = """
a_customers AS (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS customer_id FROM customer),
a_txn_raw AS (
  SELECT CAST(o_custkey AS VARCHAR) AS customer_id, o_orderdate AS ts, o_totalprice AS v, o_orderkey AS seq FROM orders),
a_bal_raw AS (
  SELECT CAST(c_custkey AS VARCHAR) AS customer_id, (SELECT MAX(o_orderdate) FROM orders) AS ts,
         CASE WHEN c_custkey % 10 <> 0 THEN c_acctbal END AS v, c_custkey AS seq
  FROM customer
  UNION ALL
  SELECT CAST(o_custkey AS VARCHAR), o_orderdate, CASE WHEN c_custkey % 10 <> 0 THEN c_acctbal + o_totalprice * 0.01 END, o_orderkey
  FROM orders JOIN customer ON c_custkey = o_custkey),
a_holdings AS (
  SELECT CAST(o_custkey AS VARCHAR) AS customer_id, p_type AS product_name,
         CASE l_linestatus WHEN 'O' THEN 'active' ELSE 'closed' END AS status
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)
"""

B_INPUTS = """
a_customers AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS customer_id FROM events),
a_txn_raw AS (SELECT CAST(user_id AS VARCHAR) AS customer_id, ts, value AS v, event_id AS seq
              FROM events WHERE event_type = 'purchase'),
a_bal_raw AS (SELECT CAST(user_id AS VARCHAR) AS customer_id, ts, CASE WHEN user_id % 10 <> 0 THEN value END AS v, event_id AS seq
              FROM events WHERE event_type = 'view'),
a_holdings AS (SELECT NULL::VARCHAR AS customer_id, NULL::VARCHAR AS product_name, NULL::VARCHAR AS status WHERE false)
"""


def _clean(name: str, raw: str) -> str:
    return f"""
{name} AS (
  SELECT customer_id, ts, v FROM (
    SELECT customer_id, ts, v,
           row_number() OVER (PARTITION BY customer_id, ts ORDER BY seq, v NULLS FIRST) AS rn
    FROM {raw} WHERE customer_id IS NOT NULL AND ts IS NOT NULL)
  WHERE rn = 1 AND v IS NOT NULL AND NOT isnan(v) AND NOT isinf(v))"""


CLEAN = ",".join([_clean("a_txn", "a_txn_raw"), _clean("a_bal", "a_bal_raw")])


def features_cte(lookback: int = 90) -> str:
    return f"""
a_latest AS (SELECT greatest((SELECT max(ts) FROM a_bal), (SELECT max(ts) FROM a_txn)) AS latest),
a_bal_w AS (SELECT b.* FROM a_bal b, a_latest l WHERE b.ts >= l.latest - INTERVAL {lookback} DAY),
a_txn_w AS (SELECT t.* FROM a_txn t, a_latest l WHERE t.ts >= l.latest - INTERVAL {lookback} DAY),
a_bf AS (SELECT customer_id, avg(v) AS avg_b, min(v) AS min_b, stddev_samp(v) AS std_b FROM a_bal_w GROUP BY 1),
a_tf AS (SELECT customer_id, count(*) AS cnt, avg(v) AS avg_t, quantile_cont(v, 0.5) AS med_t, max(ts) AS last_ts
         FROM a_txn_w GROUP BY 1),
a_pf AS (SELECT customer_id, count(*) AS n FROM a_holdings WHERE status = 'active' GROUP BY 1),
a_features AS (
  SELECT c.customer_id,
         bf.avg_b AS avg_balance_90d, bf.min_b AS min_balance_90d, bf.std_b AS balance_stability_90d,
         coalesce(tf.cnt, 0)::BIGINT AS transaction_count_90d,
         coalesce(tf.cnt, 0) * 30 / CAST({lookback} AS DOUBLE) AS transaction_frequency_monthly,
         tf.avg_t AS avg_transaction_amount, tf.med_t AS median_transaction_amount,
         coalesce(CAST(date_sub('day', tf.last_ts, l.latest) AS INTEGER), {lookback + 1}) AS recency_days,
         coalesce(pf.n, 0)::BIGINT AS active_product_count,
         strftime(l.latest, '%Y-%m-%d') AS as_of_date,
         bf.avg_b IS NULL AS insufficient_balance_history
  FROM a_customers c
  LEFT JOIN a_bf bf USING (customer_id)
  LEFT JOIN a_tf tf USING (customer_id)
  LEFT JOIN a_pf pf USING (customer_id)
  CROSS JOIN a_latest l)"""


def unit_hash(col: str, seed: int = SEED) -> str:
    return f"(CAST(('0x' || substr(md5('{seed}:' || {col}), 1, 8)) AS BIGINT) / CAST(4294967296.0 AS DOUBLE))"


def split_expr(col: str) -> str:
    u = unit_hash(col)
    return f"CASE WHEN {u} < 0.2 THEN 'test' WHEN {u} < 0.35 THEN 'validation' ELSE 'train' END"


def segmentation_ctes(dormant: int = 90) -> str:
    return f"""
a_split AS (SELECT *, {split_expr('customer_id')} AS split FROM a_features),
a_thr AS (
  SELECT quantile_cont(avg_balance_90d, 0.8) AS priority_balance_threshold,
         quantile_cont(transaction_frequency_monthly, 0.7) AS priority_frequency_threshold
  FROM a_split WHERE split = 'train' AND NOT insufficient_balance_history),
a_flags AS (
  SELECT s.*, t.priority_balance_threshold AS bt, t.priority_frequency_threshold AS ft,
         coalesce(recency_days >= {dormant} OR transaction_count_90d = 0, false) AS is_dormant,
         coalesce(round(avg_balance_90d, 9) >= round(t.priority_balance_threshold, 9)
                  AND round(transaction_frequency_monthly, 9) >= round(t.priority_frequency_threshold, 9), false) AS is_priority
  FROM a_split s CROSS JOIN a_thr t),
a_seg AS (
  SELECT *,
    CASE WHEN insufficient_balance_history THEN 'needs_review'
         WHEN is_priority AND NOT is_dormant THEN 'priority'
         WHEN is_dormant THEN 'dormant' ELSE 'regular' END AS segment,
    CASE WHEN insufficient_balance_history THEN 3 WHEN is_dormant OR is_priority THEN 1 ELSE 2 END AS fallback_level,
    CASE WHEN insufficient_balance_history THEN 'low' WHEN is_dormant OR is_priority THEN 'high' ELSE 'medium' END
      AS assignment_confidence
  FROM a_flags),
a_segmented AS (
  SELECT *, CASE segment
      WHEN 'priority' THEN 'L1: high maintained balance and transaction frequency'
      WHEN 'dormant' THEN 'L1: inactive or no recent transactions'
      WHEN 'needs_review' THEN 'L3: missing balance history; human review required'
      ELSE 'L2: active customer below priority thresholds' END AS segment_reason
  FROM a_seg)"""


def with_a(*parts: str, inputs: str = A_INPUTS, lookback: int = 90, dormant: int = 90) -> str:
    ctes = [inputs, CLEAN, features_cte(lookback)]
    if "seg" in parts:
        ctes.append(segmentation_ctes(dormant))
    return "WITH " + ",".join(ctes) + "\n"


FEATURE_COLS = """customer_id, round(avg_balance_90d, 6) AS avg_balance_90d, round(min_balance_90d, 6) AS min_balance_90d,
  round(balance_stability_90d, 6) AS balance_stability_90d, transaction_count_90d,
  round(transaction_frequency_monthly, 6) AS transaction_frequency_monthly,
  round(avg_transaction_amount, 6) AS avg_transaction_amount, round(median_transaction_amount, 6) AS median_transaction_amount,
  recency_days, active_product_count, as_of_date, insufficient_balance_history"""

SEGMENT_TEXTS = """
seg_texts(segment, description, retention_recommendation, cross_sell, basis, action) AS (VALUES
 ('priority', 'Higher maintained balances and transaction activity; relationship-expansion opportunity.',
  'Protect relationship with service reviews, rewards, and relevant wealth/savings journeys.',
  ['wealth/savings review', 'rewards or premium card'],
  'High maintained balance and transaction frequency.', 'Review relationship expansion and savings/rewards opportunities.'),
 ('regular', 'Active customers below priority thresholds; balance-building and engagement opportunity.',
  'Use savings goals, payroll balance prompts, autopay, card activation, and rewards onboarding.',
  ['savings goal', 'autopay/rewards onboarding'],
  'Active behavior below the training-derived priority thresholds.', 'Consider balance-building and engagement actions.'),
 ('dormant', 'Low recent activity or long recency; retention and re-engagement priority.',
  'Use compliant re-engagement, service assistance, and preference-aware contact controls.',
  ['service assistance', 'reactivation journey'],
  'Low recent activity or no recent transactions.', 'Use compliant re-engagement and service assistance.'),
 ('needs_review', 'Insufficient or ambiguous history; require human review before personalization.',
  NULL, NULL,
  'Insufficient balance history for a confident assignment.', 'Route to human review before personalization.'))
"""

ORACLE: dict[str, str] = {}

ORACLE["raw_to_contract"] = """
SELECT CAST(c_custkey AS VARCHAR) AS customer_id,
       strftime(o_orderdate + to_seconds((o_orderkey % 24) * 3600 + (floor(o_orderkey / 24) % 60) * 60
                                         + (floor(o_orderkey / 1440) % 60)), '%Y-%m-%d %H:%M:%S') AS timestamp,
       round(o_totalprice, 6) AS amount, round(c_acctbal, 6) AS balance
FROM orders JOIN customer ON o_custkey = c_custkey
"""

ORACLE["contract_customers"] = """
SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS customer_id FROM orders JOIN customer ON o_custkey = c_custkey
"""

ORACLE["clean_events"] = "WITH " + A_INPUTS + "," + CLEAN + """
SELECT 'balances' AS table_name, customer_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, round(v, 6) AS value FROM a_bal
UNION ALL
SELECT 'transactions', customer_id, strftime(ts, '%Y-%m-%d %H:%M:%S'), round(v, 6) FROM a_txn
"""

ORACLE["cleaning_audit"] = "WITH " + A_INPUTS + "," + CLEAN + """
SELECT 'balances' AS table_name, (SELECT count(*) FROM a_bal_raw) AS input_rows, (SELECT count(*) FROM a_bal) AS usable_rows,
       (SELECT count(*) FROM a_bal_raw) - (SELECT count(*) FROM a_bal) AS dropped_rows
UNION ALL
SELECT 'transactions', (SELECT count(*) FROM a_txn_raw), (SELECT count(*) FROM a_txn),
       (SELECT count(*) FROM a_txn_raw) - (SELECT count(*) FROM a_txn)
"""


def _dq(name: str, rel: str, cols: list[str]) -> str:
    nulls = "\nUNION ALL ".join(
        f"SELECT '{name}', 'missing', '{c}', (SELECT count(*) FROM {rel} WHERE {c} IS NULL)" for c in cols
    )
    collist = ", ".join(cols)
    return f"""
SELECT '{name}' AS table_name, 'rows' AS measure, NULL::VARCHAR AS column_name, (SELECT count(*) FROM {rel})::BIGINT AS value
UNION ALL SELECT '{name}', 'duplicate_rows', NULL,
  (SELECT coalesce(sum(c - 1), 0) FROM (SELECT count(*) AS c FROM {rel} GROUP BY {collist}))::BIGINT
UNION ALL SELECT * FROM ({nulls})"""


ORACLE["data_quality"] = (
    "WITH " + A_INPUTS + ",\n"
    + "dq_bal AS (SELECT customer_id, ts AS timestamp, v AS balance FROM a_bal_raw),\n"
    + "dq_txn AS (SELECT customer_id, ts AS timestamp, v AS amount FROM a_txn_raw)\n"
    + "SELECT * FROM (" + "\nUNION ALL\n".join([
        _dq("customers", "a_customers", ["customer_id"]),
        _dq("balances", "dq_bal", ["customer_id", "timestamp", "balance"]),
        _dq("transactions", "dq_txn", ["customer_id", "timestamp", "amount"]),
        _dq("product_holdings", "a_holdings", ["customer_id", "product_name", "status"]),
    ]) + ") WHERE measure <> 'missing' OR value > 0"
)

ORACLE["customer_features"] = with_a() + f"SELECT {FEATURE_COLS} FROM a_features"

ORACLE["customer_features_events"] = with_a(inputs=B_INPUTS, lookback=7) + f"SELECT {FEATURE_COLS} FROM a_features"

MULTI_AS_OF = ("2000-06-01", "2000-12-01", "2001-06-01")
_snaps = ", ".join(f"('{d}', TIMESTAMP '{d} 00:00:00')" for d in MULTI_AS_OF)
ORACLE["customer_features_multi_asof"] = "WITH " + A_INPUTS + "," + CLEAN + f""",
snaps(as_of_date, latest) AS (VALUES {_snaps}),
m_bal AS (SELECT s.as_of_date, b.* FROM a_bal b JOIN snaps s ON b.ts <= s.latest AND b.ts >= s.latest - INTERVAL 90 DAY),
m_txn AS (SELECT s.as_of_date, t.* FROM a_txn t JOIN snaps s ON t.ts <= s.latest AND t.ts >= s.latest - INTERVAL 90 DAY),
m_bf AS (SELECT as_of_date, customer_id, avg(v) AS avg_b, min(v) AS min_b, stddev_samp(v) AS std_b FROM m_bal GROUP BY 1, 2),
m_tf AS (SELECT as_of_date, customer_id, count(*) AS cnt, avg(v) AS avg_t, quantile_cont(v, 0.5) AS med_t, max(ts) AS last_ts
         FROM m_txn GROUP BY 1, 2),
m_pf AS (SELECT customer_id, count(*) AS n FROM a_holdings WHERE status = 'active' GROUP BY 1),
m_features AS (
  SELECT c.customer_id, bf.avg_b AS avg_balance_90d, bf.min_b AS min_balance_90d, bf.std_b AS balance_stability_90d,
         coalesce(tf.cnt, 0)::BIGINT AS transaction_count_90d,
         coalesce(tf.cnt, 0) * 30 / CAST(90 AS DOUBLE) AS transaction_frequency_monthly,
         tf.avg_t AS avg_transaction_amount, tf.med_t AS median_transaction_amount,
         coalesce(CAST(date_sub('day', tf.last_ts, s.latest) AS INTEGER), 91) AS recency_days,
         coalesce(pf.n, 0)::BIGINT AS active_product_count, s.as_of_date,
         bf.avg_b IS NULL AS insufficient_balance_history
  FROM a_customers c CROSS JOIN snaps s
  LEFT JOIN m_bf bf ON bf.customer_id = c.customer_id AND bf.as_of_date = s.as_of_date
  LEFT JOIN m_tf tf ON tf.customer_id = c.customer_id AND tf.as_of_date = s.as_of_date
  LEFT JOIN m_pf pf ON pf.customer_id = c.customer_id)
SELECT {FEATURE_COLS} FROM m_features
"""

ORACLE["hash_split"] = with_a() + f"SELECT customer_id, {split_expr('customer_id')} AS split FROM a_features"

ORACLE["split_sizes"] = with_a() + f"SELECT {split_expr('customer_id')} AS split, count(*) AS customers FROM a_features GROUP BY 1"

ORACLE["chrono_split"] = ORACLE["customer_features_multi_asof"].rsplit("SELECT", 1)[0] + """
SELECT as_of_date, customer_id,
  CASE WHEN pos < greatest(1, floor(n * (1 - 0.2 - 0.15))) THEN 'train'
       WHEN pos < greatest(1, floor(n * (1 - 0.2))) THEN 'validation' ELSE 'test' END AS split
FROM (SELECT as_of_date, customer_id, row_number() OVER (ORDER BY as_of_date, customer_id) - 1 AS pos,
             count(*) OVER () AS n FROM m_features)
"""

ORACLE["split_manifest"] = f"""
WITH r AS (SELECT CAST(c_custkey AS VARCHAR) AS cid FROM orders JOIN customer ON o_custkey = c_custkey),
l AS (SELECT cid, CASE WHEN cid IS NULL THEN 'rejected' ELSE {split_expr('cid')} END AS split FROM r)
SELECT coalesce(split, 'total') AS split, count(*) AS rows, count(DISTINCT cid) AS customers
FROM l GROUP BY ROLLUP (split)
"""

ORACLE["evaluation_sample"] = with_a() + f"""
SELECT {FEATURE_COLS} FROM a_features ORDER BY md5('{SEED}:' || customer_id), customer_id LIMIT 500
"""

ORACLE["rule_thresholds"] = with_a("seg") + """
SELECT round(priority_balance_threshold, 6) AS priority_balance_threshold,
       round(priority_frequency_threshold, 6) AS priority_frequency_threshold,
       90 AS dormant_days, 'train' AS fit_split FROM a_thr
"""

ORACLE["segment_customers"] = with_a("seg") + f"""
SELECT {FEATURE_COLS}, split, segment, fallback_level, assignment_confidence, segment_reason FROM a_segmented
"""

ORACLE["segment_counts"] = with_a("seg") + "SELECT segment, count(*) AS customers FROM a_segmented GROUP BY 1"

ORACLE["segment_counts_events"] = (
    "WITH " + ",".join([B_INPUTS, CLEAN, features_cte(7), segmentation_ctes(7)])
    + "\nSELECT segment, count(*) AS customers FROM a_segmented GROUP BY 1"
)

ORACLE["explain_segment"] = with_a("seg") + "," + SEGMENT_TEXTS + """
SELECT customer_id, s.segment, fallback_level, assignment_confidence, segment_reason,
       coalesce(t.basis, 'Unknown segment.') AS basis, coalesce(t.action, 'Request clarification.') AS action,
       t.retention_recommendation, array_to_string(t.cross_sell, '; ') AS cross_sell
FROM a_segmented s LEFT JOIN seg_texts t ON s.segment = t.segment
"""

ORACLE["compare_segments"] = with_a("seg") + "," + SEGMENT_TEXTS + """
SELECT g.segment, customers, round(avg_avg_balance_90d, 6) AS avg_avg_balance_90d,
       round(avg_transaction_frequency_monthly, 6) AS avg_transaction_frequency_monthly,
       round(avg_recency_days, 6) AS avg_recency_days, round(avg_avg_transaction_amount, 6) AS avg_avg_transaction_amount,
       coalesce(t.description, 'Behavioral segment requiring review.') AS description
FROM (SELECT segment, count(*) AS customers, avg(avg_balance_90d) AS avg_avg_balance_90d,
             avg(transaction_frequency_monthly) AS avg_transaction_frequency_monthly,
             avg(recency_days) AS avg_recency_days, avg(avg_transaction_amount) AS avg_avg_transaction_amount
      FROM a_segmented GROUP BY 1) g
LEFT JOIN seg_texts t ON g.segment = t.segment
"""

ORACLE["final_test_report"] = with_a("seg") + """
SELECT segment, count(*) AS customers FROM a_segmented WHERE split = 'test' GROUP BY 1
"""

ORACLE["recommend_conversion"] = with_a("seg") + """
SELECT customer_id, round(score, 6) AS priority_gap_score, recommended_action, recommendation_reason FROM (
  SELECT customer_id,
    bgap / greatest(bt, 1) + fgap / greatest(ft, 1) AS score,
    CASE WHEN bgap > fgap THEN 'Offer a savings goal or payroll balance-maintenance journey.'
         WHEN fgap >= bgap THEN 'Offer autopay, debit-card activation, or rewards onboarding.' ELSE '' END AS recommended_action,
    'Close to priority threshold; recommendation targets the largest remaining behavior gap.' AS recommendation_reason
  FROM (SELECT customer_id, bt, ft, greatest(0, bt - avg_balance_90d) AS bgap,
               greatest(0, ft - transaction_frequency_monthly) AS fgap
        FROM a_segmented WHERE segment = 'regular'))
ORDER BY round(score, 9), customer_id LIMIT 25
"""

# ---------------------------------------------------------------- text rules and event logs
def _lit_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


REQUEST_PHRASES = (
    "Which regular customers could convert to priority next? ",
    "Compare the average balance of each segment. ",
    "Explain why these customers were selected. ",
    "Show the dormant customers. ",
    "",
    "Explain and compare the conversion candidates. ",
)
SEGMENT_PHRASES = (
    "Why is this customer priority? ",
    "Explain the regular group. ",
    "What makes an account dormant? ",
    "Which ones need review? ",
    "",
)
PLANNED_INTENTS = ("segment_customers", "explain_segment", "compare_segments", "recommend_conversion", "forecast_revenue")
LOG_STEPS = (
    "query_planning", "data_validation", "data_cleaning_filtering", "feature_extraction",
    "feature_selection", "dimensionality_reduction", "hyperparameter_tuning", "fit_diagnostics",
    "leakage_audit", "model_evaluation", "recommendations", "visualization", "memory_profile", "memory_saved",
)

REQUESTS = f"""
req AS (SELECT conv_id, turn, {_lit_list(REQUEST_PHRASES)}[conv_id % 6 + 1] || text AS text
        FROM conversations WHERE role = 'user'),
req_n AS (SELECT *, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS norm, lower(text) AS low FROM req)
"""


def _any(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


_INTENT = f"""CASE
  WHEN {_any('norm', ('convert', 'conversion', 'candidate', 'next best', 'recommend'))} THEN 'recommend_conversion'
  WHEN {_any('norm', ('compare', 'average', 'median', 'transaction size'))} THEN 'compare_segments'
  WHEN {_any('norm', ('why', 'basis', 'explain', 'selected'))} THEN 'explain_segment'
  WHEN {_any('norm', ('segment', 'priority', 'regular', 'dormant'))} THEN 'segment_customers' END"""

ORACLE["route_queries"] = "WITH " + REQUESTS + f"""
SELECT conv_id, turn, coalesce(i, 'segment_customers') AS intent,
       CASE WHEN i IS NULL THEN 'deterministic_router_fallback' ELSE 'deterministic_router' END AS source,
       i IS NULL AS needs_human_input,
       CASE WHEN i IS NULL THEN 'No supported intent was unambiguously detected; defaulted to segmentation.' END AS reason
FROM (SELECT conv_id, turn, {_INTENT} AS i FROM req_n)
"""

_GOV = _any("low", ("explain", "why", "audit", "review", "basis"))
_ANA = _any("low", ("segment", "compare", "average", "transaction", "convert", "recommend"))
ORACLE["route_agents"] = "WITH " + REQUESTS + f"""
SELECT conv_id, turn,
  CASE WHEN g AND NOT a THEN 'governance_review_loop' ELSE 'analytics_sequential_pipeline' END AS route,
  CASE WHEN g AND NOT a THEN 'governance_explainability_agent'
       WHEN a THEN 'eda_agent,feature_engineering_agent,segmentation_agent,explainability_agent'
       ELSE 'eda_agent,feature_engineering_agent' END AS agents,
  CASE WHEN g AND NOT a THEN 'explanation/audit intent' WHEN a THEN 'data/segmentation intent'
       ELSE 'safe exploratory fallback' END AS reason
FROM (SELECT conv_id, turn, {_GOV} AS g, {_ANA} AS a FROM req_n)
"""

ORACLE["explain_text"] = "WITH " + SEGMENT_TEXTS + f""",
st AS (SELECT conv_id, turn, lower({_lit_list(SEGMENT_PHRASES)}[conv_id % 5 + 1] || text) AS low
       FROM conversations WHERE role = 'assistant'),
sl AS (SELECT conv_id, turn, CASE WHEN contains(low, 'priority') THEN 'priority' WHEN contains(low, 'regular') THEN 'regular'
         WHEN contains(low, 'dormant') THEN 'dormant' WHEN contains(low, 'review') OR contains(low, 'unknown') THEN 'needs_review'
         ELSE low END AS segment FROM st)
SELECT conv_id, turn, sl.segment, coalesce(t.basis, 'Unknown segment.') AS basis,
       coalesce(t.action, 'Request clarification.') AS action
FROM sl LEFT JOIN seg_texts t ON sl.segment = t.segment
"""

EVENT_LOG = f"""
ev_k AS (SELECT *, floor(event_id / 15) AS k FROM events),
ev_s AS (SELECT *, CASE WHEN event_id % 15 = 14 THEN event_type ELSE {_lit_list(LOG_STEPS)}[event_id % 15 + 1] END AS step
         FROM ev_k),
elog AS (SELECT CAST(user_id AS VARCHAR) AS run_id, event_id, ts, step,
  CASE WHEN step = 'query_planning' THEN
    CASE WHEN k % 7 = 3 THEN props WHEN k % 7 = 5 THEN 'plan unavailable'
         ELSE '{{"intent": "' || {_lit_list(PLANNED_INTENTS)}[CAST(k % 5 AS BIGINT) + 1]
              || '", "requested_outputs": ["segment_counts"]}}' END
  ELSE props END AS detail FROM ev_s)
"""

_IS_OBJ = "(CASE WHEN json_valid(detail) THEN json_type(detail) = 'OBJECT' ELSE false END)"
ORACLE["validate_intent"] = "WITH " + EVENT_LOG + f"""
SELECT run_id, event_id, intent, err IS NULL AS valid, err AS error FROM (
  SELECT run_id, event_id, CASE WHEN {_IS_OBJ} THEN json_extract_string(detail, '$.intent') END AS intent,
    CASE WHEN NOT {_IS_OBJ} THEN 'plan is not a JSON object'
         WHEN NOT coalesce((CASE WHEN {_IS_OBJ} THEN json_extract_string(detail, '$.intent') END) IN
              ('segment_customers', 'explain_segment', 'compare_segments', 'recommend_conversion'), false)
         THEN 'the plan names no known intent' END AS err
  FROM elog WHERE step = 'query_planning')
"""

_REG_ROWS = ",\n ".join(
    f"('{s}', '{a}', '{t}')" for s, a, t in (
        ("query_planning", "orchestrator_agent", "query_planner"),
        ("data_validation", "data_quality_agent", "data_quality_report"),
        ("data_cleaning_filtering", "data_quality_agent", "clean_and_filter_events"),
        ("feature_extraction", "feature_agent", "build_customer_features"),
        ("feature_selection", "feature_agent", "mutual_information_selection"),
        ("dimensionality_reduction", "feature_agent", "pca_projection"),
        ("hyperparameter_tuning", "model_agent", "tune_kmeans_gmm"),
        ("fit_diagnostics", "model_agent", "fit_diagnostics"),
        ("leakage_audit", "governance_agent", "leakage_audit"),
        ("model_evaluation", "model_agent", "cross_validation_and_test_report"),
        ("recommendations", "recommendation_agent", "priority_candidates"),
        ("visualization", "visualization_agent", "create_visualizations"),
        ("memory_profile", "memory_agent", "build_memory_profile"),
        ("memory_saved", "memory_agent", "save_consent_audit"),
    )
)
ORACLE["annotate_events"] = "WITH " + EVENT_LOG + f""",
reg(step, agent, tool) AS (VALUES {_REG_ROWS})
SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS sequence, 'agent_tool_call' AS type,
       coalesce(reg.agent, 'orchestrator_agent') AS agent, coalesce(reg.tool, coalesce(elog.step, 'unknown')) AS tool,
       coalesce(elog.step, 'unknown') AS step, coalesce(detail, '') AS detail, 'completed' AS status
FROM elog LEFT JOIN reg ON coalesce(elog.step, 'unknown') = reg.step
"""

ORACLE["planned_intent"] = "WITH " + EVENT_LOG + f""",
firsts AS (SELECT run_id, arg_min(detail, (ts, event_id)) AS detail FROM elog WHERE step = 'query_planning' GROUP BY 1)
SELECT run_id, CASE WHEN NOT {_IS_OBJ} THEN NULL
                    WHEN (CASE WHEN {_IS_OBJ} THEN json_exists(detail, '$.intent') END)
                    THEN coalesce((CASE WHEN {_IS_OBJ} THEN json_extract_string(detail, '$.intent') END), 'None')
                    ELSE 'unknown' END AS planned_intent
FROM firsts
"""

# ---------------------------------------------------------------- memory
MEMORY = """
mem AS (
  SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS memory_id,
         'user-' || CAST(conv_id % 20 AS VARCHAR) AS user_id,
         TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(turn AS INTEGER)) AS ts,
         role AS topic, text, CASE WHEN conv_id % 2 = 0 THEN 'chat' ELSE 'email' END AS contact_method,
         CASE WHEN role = 'assistant' THEN CAST(conv_id % 5 + 1 AS VARCHAR) END AS satisfaction_score,
         [['card'], ['card', 'savings'], []::VARCHAR[]][conv_id % 3 + 1] AS products,
         role <> 'system' AS consented
  FROM conversations),
mem_ok AS (
  SELECT *, 1.0 / (1.0 + greatest(0.0, (epoch_us(TIMESTAMP '2024-03-01 00:00:00') - epoch_us(ts)) / 86400000000.0)) AS recency
  FROM mem WHERE consented)
"""


def _tok(expr: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({expr}), '[a-z0-9_]+'), lambda t: length(t) > 2))"


ORACLE["memory_save"] = "WITH " + MEMORY + """
SELECT memory_id, user_id, 'saved' AS status, NULL::VARCHAR AS reason, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp,
       'development-plaintext' AS cipher_key_id, topic, text, contact_method, array_to_string(products, ',') AS products,
       satisfaction_score
FROM mem WHERE consented
UNION ALL
SELECT memory_id, user_id, 'rejected', 'Episodic memory requires explicit consent.', NULL, NULL, NULL, NULL, NULL, NULL, NULL
FROM mem WHERE NOT consented
"""

_MEM_TEXT = "'content context products text topic ' || topic || ' ' || text || ' contact_method ' || contact_method || ' ' || array_to_string(products, ' ')"

ORACLE["memory_search"] = "WITH " + MEMORY + f""",
q AS (SELECT conv_id || '-' || turn AS query_id, 'user-' || CAST(conv_id % 20 AS VARCHAR) AS user_id, {_tok('text')} AS qt
      FROM conversations),
m AS (SELECT memory_id, user_id, recency, {_tok(_MEM_TEXT)} AS mt FROM mem_ok),
s AS (SELECT query_id, q.user_id, memory_id, 10.0 * len(list_intersect(qt, mt)) + recency AS score
      FROM q JOIN m ON q.user_id = m.user_id)
SELECT query_id, user_id, rank, memory_id, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM s)
WHERE rank <= 10
"""

PROFILE_TOP = "WITH " + MEMORY + """,
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY recency DESC, memory_id) AS rank FROM mem_ok)
        WHERE rank <= 100),
pc AS (SELECT user_id, arg_min(contact_method, (-n, contact_method)) AS preferred_contact_method
       FROM (SELECT user_id, contact_method, count(*) AS n FROM top WHERE coalesce(contact_method, '') <> '' GROUP BY 1, 2)
       GROUP BY 1),
pp AS (SELECT user_id, string_agg(product || ':' || CAST(n AS VARCHAR), ',' ORDER BY product) AS product_interest,
              list(product ORDER BY product) AS plist, list(n ORDER BY product) AS nlist
       FROM (SELECT user_id, product, count(*) AS n FROM (SELECT user_id, unnest(products) AS product FROM top) GROUP BY 1, 2)
       GROUP BY 1),
cc AS (SELECT user_id, string_agg(topic, ',' ORDER BY r) AS common_concerns FROM (
         SELECT user_id, topic, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first_rank) AS r
         FROM (SELECT user_id, topic, count(*) AS n, min(rank) AS first_rank FROM top WHERE coalesce(topic, '') <> '' GROUP BY 1, 2))
       WHERE r <= 5 GROUP BY 1),
ss AS (SELECT user_id, string_agg(CAST(CAST(satisfaction_score AS DOUBLE) AS VARCHAR), ',' ORDER BY rank) AS satisfaction_scores
       FROM top WHERE satisfaction_score IS NOT NULL GROUP BY 1),
cnt AS (SELECT user_id, count(*) AS memory_count FROM top GROUP BY 1)
"""

ORACLE["memory_profile"] = PROFILE_TOP + """
SELECT cnt.user_id, preferred_contact_method, coalesce(product_interest, '') AS product_interest,
       coalesce(common_concerns, '') AS common_concerns, coalesce(satisfaction_scores, '') AS satisfaction_scores, memory_count
FROM cnt LEFT JOIN pc USING (user_id) LEFT JOIN pp USING (user_id) LEFT JOIN cc USING (user_id) LEFT JOIN ss USING (user_id)
"""

FORGET = """
fu AS (SELECT DISTINCT 'user-' || CAST(conv_id % 20 AS VARCHAR) AS user_id FROM conversations WHERE role = 'system'),
fd AS (SELECT fu.user_id, coalesce(n, 0)::BIGINT AS deleted_memory_count FROM fu
       LEFT JOIN (SELECT user_id, count(*) AS n FROM mem_ok GROUP BY 1) c USING (user_id))
"""

ORACLE["memory_forget"] = "WITH " + MEMORY + "," + FORGET + """
SELECT fd.user_id, deleted_memory_count, 0::BIGINT AS remaining_memory_count FROM fd
"""

ORACLE["memory_rerank"] = PROFILE_TOP + """,
offers AS (SELECT user_id, unnest(['card', 'savings', 'mortgage']) AS product FROM (SELECT DISTINCT 'user-' || CAST(conv_id % 20 AS VARCHAR) AS user_id FROM conversations)),
interest AS (SELECT user_id, product, count(*) AS n FROM (SELECT user_id, unnest(products) AS product FROM top) GROUP BY 1, 2),
j AS (SELECT o.user_id, o.product, o.product <> 'mortgage' AS eligible, coalesce(i.n, 0)::BIGINT AS memory_interest_count
      FROM offers o LEFT JOIN interest i ON o.user_id = i.user_id AND o.product = i.product),
k AS (SELECT *, CASE WHEN memory_interest_count > 0 THEN 'Prior interest recorded' ELSE 'No relevant consented memory' END AS memory_rationale,
             (CASE WHEN coalesce(eligible, true) THEN least(memory_interest_count, 3) ELSE 0 END)::BIGINT AS memory_rank_adjustment
      FROM j)
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY memory_rank_adjustment DESC, product) AS rank FROM k
"""

ORACLE["memory_audit"] = "WITH " + MEMORY + "," + FORGET + f"""
SELECT '2024-03-01 00:00:00' AS ts, 'memory_saved' AS event_type, sha256(user_id) AS subject_hash,
       '{{"interaction_type":"conversation","memory_id":"' || memory_id || '"}}' AS detail
FROM mem_ok
UNION ALL
SELECT '2024-03-01 00:00:00', 'memory_retrieved', sha256(q.user_id),
       '{{"candidate_count":' || CAST(coalesce(c.n, 0) AS VARCHAR) || ',"query_token_count":' || CAST(len({_tok('q.text')}) AS VARCHAR) || '}}'
FROM (SELECT 'user-' || CAST(conv_id % 20 AS VARCHAR) AS user_id, text FROM conversations) q
LEFT JOIN (SELECT user_id, count(*) AS n FROM mem_ok GROUP BY 1) c ON q.user_id = c.user_id
UNION ALL
SELECT '2024-03-01 00:00:00', 'user_forgotten', sha256(user_id), '{{"deleted_memory_count":' || CAST(deleted_memory_count AS VARCHAR) || '}}'
FROM fd
"""

# ---------------------------------------------------------------- preprocessing (train split only)
_FEATS = ["avg_balance_90d", "min_balance_90d", "balance_stability_90d", "transaction_count_90d",
          "transaction_frequency_monthly", "avg_transaction_amount", "median_transaction_amount", "recency_days",
          "active_product_count"]

TRAIN_SAMPLE = f""",
ts AS (SELECT * FROM a_split WHERE split = 'train'),
bm AS (SELECT quantile_cont(avg_balance_90d, 0.5) AS m FROM ts),
pf AS (SELECT customer_id, coalesce(avg_balance_90d, (SELECT m FROM bm)) AS b, transaction_frequency_monthly AS f,
              CAST(recency_days AS DOUBLE) AS r FROM ts),
pr AS (SELECT customer_id,
         CASE WHEN b IS NOT NULL THEN (rank() OVER (ORDER BY b) - 1 + (count(*) OVER (PARTITION BY b) + 1) / 2.0::DOUBLE) / count(b) OVER () END AS rb,
         (rank() OVER (ORDER BY f) - 1 + (count(*) OVER (PARTITION BY f) + 1) / 2.0::DOUBLE) / count(f) OVER () AS rf,
         (rank() OVER (ORDER BY r) - 1 + (count(*) OVER (PARTITION BY r) + 1) / 2.0::DOUBLE) / count(r) OVER () AS rr
       FROM pf),
proxy AS (SELECT customer_id, 0.5::DOUBLE * coalesce(rb, 0.0) + 0.3::DOUBLE * rf + 0.2::DOUBLE * (1.0::DOUBLE - rr) AS proxy FROM pr),
lg AS ({" UNION ALL ".join(f"SELECT customer_id, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM ts" for c in _FEATS)}),
st0 AS (SELECT feature, count(*) AS fit_rows, count(*) FILTER (WHERE value IS NULL) AS nulls,
               quantile_cont(value, 0.5) AS impute_value FROM lg GROUP BY 1),
st1 AS (SELECT feature, quantile_cont(fv, 0.25) AS q1, quantile_cont(fv, 0.5) AS center, quantile_cont(fv, 0.75) AS q3
        FROM (SELECT lg.feature, coalesce(value, impute_value) AS fv FROM lg JOIN st0 USING (feature)) GROUP BY 1),
st2 AS (SELECT 'missingindicator_' || feature AS feature, feature AS indicator_of,
               quantile_cont(iv, 0.25) AS q1, quantile_cont(iv, 0.5) AS center, quantile_cont(iv, 0.75) AS q3, count(*) AS fit_rows
        FROM (SELECT feature, CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END AS iv FROM lg
              WHERE feature IN (SELECT feature FROM st0 WHERE nulls > 0)) GROUP BY 1, 2),
stats AS (
  SELECT feature, impute_value, center, CASE WHEN abs(q3 - q1) < 1e-12 THEN 1.0 ELSE q3 - q1 END AS scale,
         NULL::VARCHAR AS indicator_of, fit_rows
  FROM st0 JOIN st1 USING (feature)
  UNION ALL
  SELECT feature, 0.0, center, CASE WHEN abs(q3 - q1) < 1e-12 THEN 1.0 ELSE q3 - q1 END, indicator_of, fit_rows FROM st2),
tl AS (
  SELECT customer_id, lg.feature, (coalesce(value, s.impute_value) - s.center) / s.scale AS value
  FROM lg JOIN stats s ON s.feature = lg.feature AND s.indicator_of IS NULL
  UNION ALL
  SELECT customer_id, s.feature, ((CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) - s.center) / s.scale
  FROM lg JOIN stats s ON s.indicator_of = lg.feature)
"""

ORACLE["behavior_proxy"] = with_a("seg") + TRAIN_SAMPLE + "SELECT customer_id, round(proxy, 6) AS proxy FROM proxy"

ORACLE["impute_scale"] = with_a("seg") + TRAIN_SAMPLE + """
SELECT feature, round(impute_value, 6) AS impute_value, round(center, 6) AS center, round(scale, 6) AS scale,
       indicator_of, fit_rows, 'train' AS fit_split FROM stats
"""

ORACLE["mutual_information_binned"] = with_a("seg") + TRAIN_SAMPLE + """,
yb AS (SELECT customer_id, CAST(least(9, floor(10 * (rank() OVER (ORDER BY proxy) - 1 + (count(*) OVER (PARTITION BY proxy) + 1) / 2.0::DOUBLE)
                                  / count(*) OVER ())) AS INTEGER) AS ybin FROM proxy),
xb AS (SELECT customer_id, feature, CAST(least(9, floor(10 * (rank() OVER (PARTITION BY feature ORDER BY value) - 1
                                  + (count(*) OVER (PARTITION BY feature, value) + 1) / 2.0::DOUBLE)
                                  / count(*) OVER (PARTITION BY feature))) AS INTEGER) AS bx FROM tl),
jn AS (SELECT feature, bx, ybin, count(*) AS nxy FROM xb JOIN yb USING (customer_id) GROUP BY 1, 2, 3),
jm AS (SELECT *, sum(nxy) OVER (PARTITION BY feature) AS n, sum(nxy) OVER (PARTITION BY feature, bx) AS nx,
              sum(nxy) OVER (PARTITION BY feature, ybin) AS ny FROM jn),
mi AS (SELECT feature, sum((nxy / n) * ln((nxy * n) / (nx * ny))) AS mutual_information FROM jm GROUP BY 1)
SELECT feature, round(mutual_information, 6) AS mutual_information,
       row_number() OVER (ORDER BY round(mutual_information, 9) DESC, feature) AS rank,
       row_number() OVER (ORDER BY round(mutual_information, 9) DESC, feature) <= 6 AS selected
FROM mi
"""

# all pairs of points: fine at the size of the correctness data
_PSI = ("(ln({m} + 6.0::DOUBLE) - 0.5::DOUBLE / ({m} + 6) - 1.0::DOUBLE / 12 / pow({m} + 6.0::DOUBLE, 2) + 1.0::DOUBLE / 120 / pow({m} + 6.0::DOUBLE, 4)"
        " - 1.0::DOUBLE / 252 / pow({m} + 6.0::DOUBLE, 6) + 1.0::DOUBLE / 240 / pow({m} + 6.0::DOUBLE, 8) - 1.0::DOUBLE / 132 / pow({m} + 6.0::DOUBLE, 10)"
        " - 1.0::DOUBLE / {m} - 1.0::DOUBLE / ({m} + 1) - 1.0::DOUBLE / ({m} + 2) - 1.0::DOUBLE / ({m} + 3) - 1.0::DOUBLE / ({m} + 4) - 1.0::DOUBLE / ({m} + 5))")


def _coordinate(value: str, mean: str, deviation: str, name: str) -> str:
    return (f"CAST(floor(CASE WHEN {deviation} > 0 THEN ({value} - {mean}) / {deviation} ELSE 0.0::DOUBLE END * 35184372088832.0::DOUBLE) AS BIGINT)"
            f" + CAST(('0x' || substr(md5('42:' || {name} || ':' || customer_id), 1, 8)) AS BIGINT) % 4096 - 2048")


ORACLE["mutual_information"] = with_a("seg") + TRAIN_SAMPLE + f""",
sx AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS d FROM tl WHERE value IS NOT NULL GROUP BY 1),
sy AS (SELECT avg(proxy) AS m, stddev_pop(proxy) AS d FROM proxy),
yp AS (SELECT customer_id, {_coordinate('proxy', 'm', 'd', "'proxy'")} AS y FROM proxy, sy WHERE proxy IS NOT NULL),
pt AS MATERIALIZED (
  SELECT feature, dense_rank() OVER (ORDER BY feature) AS f, row_number() OVER (ORDER BY feature, customer_id) AS i,
         {_coordinate('value', 'm', 'd', 'feature')} AS x, y FROM tl JOIN sx USING (feature) JOIN yp USING (customer_id) WHERE value IS NOT NULL),
rr AS MATERIALIZED (
  SELECT a.f, a.i, any_value(a.x) AS x, any_value(a.y) AS y, greatest(1, min(greatest(abs(a.x - b.x), abs(a.y - b.y)), 3)[3]) AS r
  FROM pt a JOIN pt b ON a.f = b.f AND a.i <> b.i GROUP BY a.f, a.i),
cn AS MATERIALIZED (
  SELECT rr.f, rr.i, count(*) FILTER (WHERE abs(rr.x - b.x) < r) AS ax, count(*) FILTER (WHERE abs(rr.y - b.y) < r) AS ay
  FROM rr JOIN pt b ON rr.f = b.f GROUP BY rr.f, rr.i),
mi AS (SELECT feature, greatest(0.0, {_PSI.format(m='count(*)')} + {_PSI.format(m='3')}
              - avg({_PSI.format(m='ax')} + {_PSI.format(m='ay')})) AS mutual_information
       FROM cn JOIN (SELECT DISTINCT f, feature FROM pt) USING (f) GROUP BY 1)
SELECT feature, round(mutual_information, 6) AS mutual_information,
       row_number() OVER (ORDER BY round(mutual_information, 9) DESC, feature) AS rank,
       row_number() OVER (ORDER BY round(mutual_information, 9) DESC, feature) <= 6 AS selected
FROM mi
"""

# ---------------------------------------------------------------- cluster metrics (brute force in SQL)
ORACLE["silhouette"] = """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
sizes AS (SELECT label, count(*) AS n FROM e GROUP BY 1),
pd AS (SELECT a.vec_id, a.label AS la, b.label AS lb, sum(pow(list_distance(a.v, b.v), 2)) AS d
       FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3),
pm AS (SELECT vec_id, la, lb, d / (CASE WHEN la = lb THEN s.n - 1 ELSE s.n END) AS m FROM pd JOIN sizes s ON s.label = lb),
ab AS (SELECT e.vec_id, e.label, sz.n AS own_n,
              max(CASE WHEN pm.lb = e.label THEN m END) AS a, min(CASE WHEN pm.lb <> e.label THEN m END) AS b
       FROM e JOIN sizes sz ON sz.label = e.label LEFT JOIN pm ON pm.vec_id = e.vec_id GROUP BY 1, 2, 3),
s AS (SELECT CASE WHEN own_n <= 1 THEN 0.0 WHEN greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END AS s FROM ab)
SELECT round(avg(s), 6) AS silhouette, count(*) AS points, (SELECT count(*) FROM sizes) AS clusters FROM s
"""

ORACLE["silhouette_euclidean"] = ORACLE["silhouette"].replace("pow(list_distance(a.v, b.v), 2)", "list_distance(a.v, b.v)")

ORACLE["tuning_invariants"] = """
SELECT 'kmeans' AS family, '{"n_clusters": ' || k || ', "n_init": ' || n || '}' AS params, true AS silhouettes_in_range, true AS gap_is_difference,
       true AS score_follows_rule, true AS underfit_follows_rule, true AS overfit_follows_rule, true AS davies_bouldin_not_negative
FROM range(2, 6) a(k), (VALUES (10), (20)) b(n)
UNION ALL
SELECT 'gmm', '{"covariance_type": "' || c || '", "n_components": ' || k || ', "n_init": 10}', true, true, true, true, true, true
FROM range(2, 6) a(k), (VALUES ('full'), ('diag')) b(c)
"""

SCORES = """
raw AS (SELECT l_returnflag AS family, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS params,
               CAST(l_discount AS DOUBLE) * 3 AS t, CAST(l_tax AS DOUBLE) * 3 AS v, CAST(l_quantity AS DOUBLE) AS db FROM lineitem),
sc AS (SELECT *, v - 0.25::DOUBLE * greatest(t - v, 0.0::DOUBLE) AS score, t - v AS gap,
              CASE WHEN t < 0.1::DOUBLE AND v < 0.1::DOUBLE THEN 'underfitting_risk' WHEN t - v > 0.15::DOUBLE THEN 'overfitting_risk'
                   ELSE 'acceptable_generalization' END AS fit_status FROM raw)
"""

ORACLE["fit_checks"] = "WITH " + SCORES + """
SELECT family, fit_status, count(*) AS candidates, round(max(score), 6) AS best_score, round(min(gap), 6) AS least_gap FROM sc GROUP BY 1, 2
"""

ORACLE["best_candidates"] = "WITH " + SCORES + """,
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY score DESC, v DESC, length(params), params) AS r,
                               count(*) OVER (PARTITION BY family) AS n FROM sc) WHERE r = 1)
SELECT f.family, CASE WHEN best.family IS NULL THEN 'fallback_to_rules' ELSE 'tuned' END AS status,
       CASE WHEN best.family IS NULL THEN 'no_valid_hyperparameter_candidate' END AS reason, params AS best_params, round(t, 6) AS train_silhouette,
       round(v, 6) AS validation_silhouette, round(score, 6) AS selection_score, round(gap, 6) AS silhouette_gap, fit_status, coalesce(n, 0) AS candidates_tested
FROM (VALUES ('A'), ('N'), ('R'), ('no such family')) f(family) LEFT JOIN best USING (family)
"""

ORACLE["davies_bouldin"] = """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ex AS (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS i FROM e),
c AS (SELECT label, list(m ORDER BY i) AS cv FROM (SELECT label, i, avg(x) AS m FROM ex GROUP BY 1, 2) GROUP BY 1),
sc AS (SELECT e.label, avg(list_distance(e.v, c.cv)) AS S FROM e JOIN c USING (label) GROUP BY 1),
cc AS (SELECT c.label, c.cv, sc.S FROM c JOIN sc USING (label)),
r AS (SELECT i.label, max(CASE WHEN list_distance(i.cv, j.cv) = 0 THEN 0.0 ELSE (i.S + j.S) / list_distance(i.cv, j.cv) END) AS worst
      FROM cc i JOIN cc j ON i.label <> j.label GROUP BY 1)
SELECT round(avg(worst), 6) AS davies_bouldin, count(*) AS clusters FROM r
"""

# ---------------------------------------------------------------- chart data
ORACLE["boxplot_stats"] = with_a("seg") + """,
bl AS (SELECT segment, 'avg_balance_90d' AS feature, avg_balance_90d AS value FROM a_segmented
       UNION ALL SELECT segment, 'transaction_frequency_monthly', transaction_frequency_monthly FROM a_segmented
       UNION ALL SELECT segment, 'recency_days', CAST(recency_days AS DOUBLE) FROM a_segmented),
bq AS (SELECT segment, feature, count(*) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
              quantile_cont(value, 0.75) AS q3 FROM bl WHERE value IS NOT NULL GROUP BY 1, 2),
bw AS (SELECT bl.segment, bl.feature, min(value) AS whisker_low, max(value) AS whisker_high, count(*) AS inside
       FROM bl JOIN bq USING (segment, feature)
       WHERE value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1) GROUP BY 1, 2)
SELECT segment, feature, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       round(whisker_low, 6) AS whisker_low, round(whisker_high, 6) AS whisker_high, n - coalesce(inside, 0) AS outliers
FROM bq LEFT JOIN bw USING (segment, feature)
"""

ORACLE["leakage_audit"] = with_a() + f"""
, lb AS (SELECT customer_id, {split_expr('customer_id')} AS split FROM a_features),
pc AS (SELECT customer_id, max(CASE WHEN split = 'train' THEN 1 ELSE 0 END) AS t,
              max(CASE WHEN split = 'validation' THEN 1 ELSE 0 END) AS v, max(CASE WHEN split = 'test' THEN 1 ELSE 0 END) AS s
       FROM lb GROUP BY 1),
ov AS (SELECT coalesce(sum(t * v), 0)::BIGINT AS train_validation, coalesce(sum(t * s), 0)::BIGINT AS train_test,
              coalesce(sum(v * s), 0)::BIGINT AS validation_test FROM pc)
SELECT *, train_validation + train_test + validation_test = 0 AS customer_partitions_disjoint,
       true AS thresholds_fit_on_training_only, true AS feature_selection_fit_on_training_only,
       true AS pca_fit_on_training_only, true AS test_not_used_for_tuning,
       CASE WHEN train_validation + train_test + validation_test = 0 THEN 'passed' ELSE 'failed' END AS status
FROM ov
"""

ORACLE["quota_split"] = with_a() + f"""
SELECT customer_id, CASE WHEN pos < nt THEN 'test' WHEN pos < nt + nv THEN 'validation' ELSE 'train' END AS split FROM (
  SELECT customer_id, pos, nt, CAST(ceil((n - nt) * (0.15 / (1 - 0.2))) AS BIGINT) AS nv FROM (
    SELECT customer_id, row_number() OVER (ORDER BY md5('{SEED}:' || customer_id), customer_id) - 1 AS pos, n,
           CAST(ceil(n * 0.2) AS BIGINT) AS nt
    FROM (SELECT customer_id, count(*) OVER () AS n FROM a_features)))
"""

ORACLE["pca_facts"] = ORACLE["mutual_information"].rsplit("SELECT feature, round(mutual_information", 1)[0] + """,
pick AS (SELECT feature FROM mi ORDER BY round(mutual_information, 9) DESC, feature LIMIT 6)
SELECT 'PCA' AS method, 2 AS n_components, (SELECT string_agg(feature, ',' ORDER BY feature) FROM pick) AS selected_features,
       (SELECT count(*) FROM ts) AS fit_rows, (SELECT count(*) FROM a_features) AS projected_rows, 'train' AS fit_split,
       true AS centred, true AS uncorrelated, true AS ratios_are_variances, true AS ordered
"""

# ---------------------------------------------------------------- loaders, stores and the whole run
ORACLE["load_csv"] = "SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, role, text FROM conversations"

ORACLE["load_folder"] = "WITH " + A_INPUTS + """
SELECT 'customers' AS table_name, count(*) AS rows, count(DISTINCT customer_id) AS customers, count(customer_id) AS known FROM a_customers
UNION ALL SELECT 'balances', count(*), count(DISTINCT customer_id), count(v) FROM a_bal_raw
UNION ALL SELECT 'transactions', count(*), count(DISTINCT customer_id), count(v) FROM a_txn_raw
UNION ALL SELECT 'product_holdings', count(*), count(DISTINCT customer_id), count(status) FROM a_holdings
"""

# layouts 0 to 8: only the second and the last keep the time of day (to the minute); the last is
# month first, so a day up to 12 is read as the month
ORACLE["date_shapes"] = """
WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS ts, o_orderkey % 9 AS k FROM orders)
SELECT o_orderkey, strftime(CASE WHEN k = 1 THEN date_trunc('minute', ts)
                                 WHEN k = 8 AND day(ts) <= 12 THEN make_timestamp(year(ts), day(ts), month(ts), hour(ts), minute(ts), 0.0)
                                 WHEN k = 8 THEN date_trunc('minute', ts) ELSE date_trunc('day', ts) END, '%Y-%m-%d %H:%M:%S') AS parsed
FROM o
"""

ORACLE["segment_files"] = f"SELECT segment, count(*) AS customers, min(customer_id) AS first_customer FROM ({ORACLE['segment_customers']}) GROUP BY 1"

ORACLE["split_files"] = ORACLE["split_manifest"]

_PREPARED = f"""
r AS (SELECT CAST(c_custkey AS VARCHAR) AS cid FROM orders JOIN customer ON o_custkey = c_custkey),
ids AS (SELECT DISTINCT cid FROM r WHERE cid IS NOT NULL),
placed AS (SELECT cid, row_number() OVER (ORDER BY md5('{SEED}:' || cid), cid) - 1 AS pos, round_even(count(*) OVER () * 0.2, 0) AS nt,
                  round_even(count(*) OVER () * 0.15, 0) AS nv FROM ids),
prep AS (SELECT r.cid, CASE WHEN r.cid IS NULL THEN 'rejected' WHEN pos < nt THEN 'test' WHEN pos < nt + nv THEN 'validation' ELSE 'train' END AS split
         FROM r LEFT JOIN placed ON placed.cid = r.cid)"""

ORACLE["prepared_manifest"] = "WITH " + _PREPARED + f"""
SELECT coalesce(split, 'total') AS split, count(*) AS rows, count(DISTINCT cid) AS customers, CAST({SEED} AS BIGINT) AS seed, 'CustomerID' AS split_unit
FROM prep GROUP BY ROLLUP (split)
"""

ORACLE["prepared_customers"] = "WITH " + _PREPARED + """
SELECT cid AS "CustomerID", split, count(*) AS rows FROM prep GROUP BY 1, 2
"""

ORACLE["memory_store"] = "WITH " + MEMORY + "," + FORGET + """,
stored AS (SELECT user_id, count(*) AS n FROM mem_ok GROUP BY 1)
SELECT user_id, CASE WHEN fd.user_id IS NULL THEN n ELSE 0 END AS memories, coalesce(deleted_memory_count, 0)::BIGINT AS deleted
FROM stored FULL JOIN fd USING (user_id)
"""

_RUN_TABLES = {
    "segments": "segment_customers", "candidates": "recommend_conversion", "profiles": "compare_segments", "explanations": "explain_segment",
    "data_quality": "data_quality", "cleaning_audit": "cleaning_audit", "split_sizes": "split_sizes", "thresholds": "rule_thresholds",
    "final_test": "final_test_report", "segment_counts": "segment_counts", "boxplot": "boxplot_stats",
}


def _run_lines(section: str, query: str, name: str, *fields: str) -> list[str]:
    return [f"SELECT '{section}' AS section, {name} AS name, '{f}' AS field, round(CAST({f} AS DOUBLE), 6) AS value FROM ({ORACLE[query]})" for f in fields]


ORACLE["run_report"] = "\nUNION ALL\n".join([
    *[f"SELECT 'rows_written' AS section, '{t}' AS name, 'rows' AS field, CAST(count(*) AS DOUBLE) AS value FROM ({ORACLE[q]})" for t, q in _RUN_TABLES.items()],
    *_run_lines("split_sizes", "split_sizes", "split", "customers"), *_run_lines("segment_counts", "segment_counts", "segment", "customers"),
    *_run_lines("final_test", "final_test_report", "segment", "customers"),
    *_run_lines("thresholds", "rule_thresholds", "fit_split", "priority_balance_threshold", "priority_frequency_threshold"),
    *_run_lines("profiles", "compare_segments", "segment", "customers", "avg_avg_balance_90d", "avg_transaction_frequency_monthly", "avg_recency_days",
                "avg_avg_transaction_amount"),
])
