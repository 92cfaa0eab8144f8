"""Registered queries: cleaning and behaviour mining."""

from __future__ import annotations

from ..functions.timefn import duration_us
from ..operators import behaviour as B
from ..operators import cleaning as C
from ..sources.tables import read_table
from . import params as P
from .registry import query

GAP_US = duration_us(P.SESSION_GAP)
WITHIN_US = duration_us(P.FUNNEL_WITHIN)
DAY_US = duration_us("1d")
SLIDE_US = duration_us(P.WINDOW_SLIDE)
WIDTH_US = duration_us(P.WINDOW_WIDTH)

SESSIONIZED_SQL = f"""
SELECT event_id, user_id, ts, event_type, value,
  sum(CASE WHEN prev IS NULL OR epoch_us(ts) - epoch_us(prev) > {GAP_US} THEN 1 ELSE 0 END)
    OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session_no
FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)
"""

_LI_REST = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
            "l_returnflag", "l_linestatus"]


def events(spark, d):
    return read_table(spark, d, "events")


@query("dedup_lineitem_latest", f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_shipdate DESC, {', '.join(c + ' DESC' for c in _LI_REST)}) AS rn
  FROM lineitem) WHERE rn = 1
""")
def q_dedup(spark, d):
    return C.dedup_latest(read_table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"],
                          ["l_shipdate"])


def _rule(table, name, cond):
    return (f"SELECT '{table}.{name}' AS rule, count(*)::BIGINT AS n_checked, "
            f"count_if(NOT coalesce({cond}, false))::BIGINT AS n_failed FROM {table}")


RULES_SQL = "\nUNION ALL ".join([
    _rule("orders", "totalprice_positive", "o_totalprice > 0"),
    _rule("orders", "status_known", "o_orderstatus IN ('F', 'O', 'P')"),
    _rule("orders", "orderdate_present", "o_orderdate IS NOT NULL"),
    _rule("lineitem", "quantity_positive", "l_quantity > 0"),
    _rule("lineitem", "discount_in_0_1", "l_discount BETWEEN 0 AND 1"),
    _rule("lineitem", "tax_in_0_1", "l_tax BETWEEN 0 AND 1"),
    _rule("lineitem", "extendedprice_positive", "l_extendedprice > 0"),
    """SELECT 'orders.duplicate_key', sum(c)::BIGINT, sum(c - 1)::BIGINT
       FROM (SELECT count(*) AS c FROM orders GROUP BY o_orderkey)""",
    """SELECT 'lineitem.duplicate_key', sum(c)::BIGINT, sum(c - 1)::BIGINT
       FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber)""",
    """SELECT 'orders.custkey_orphan', count(*)::BIGINT,
       count_if(NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey))::BIGINT
       FROM orders o""",
    """SELECT 'lineitem.orderkey_orphan', count(*)::BIGINT,
       count_if(NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey))::BIGINT
       FROM lineitem l""",
    """SELECT 'lineitem.partkey_orphan', count(*)::BIGINT,
       count_if(NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey))::BIGINT
       FROM lineitem l""",
    """SELECT 'lineitem.ships_before_order', count(*)::BIGINT,
       count_if(l.l_shipdate < o.o_orderdate)::BIGINT
       FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""",
])


@query("rule_violations", RULES_SQL)
def q_rules(spark, d):
    t = {n: read_table(spark, d, n) for n in ("orders", "lineitem", "customer", "part")}
    return C.order_table_rules(t["orders"], t["lineitem"], t["customer"], t["part"])


@query("sessionize", f"SELECT event_id, user_id, ts, session_no FROM ({SESSIONIZED_SQL})")
def q_sessionize(spark, d):
    return B.sessionize(events(spark, d).select("event_id", "user_id", "ts"), P.SESSION_GAP)


@query("session_summary", f"""
SELECT user_id, session_no, min(ts) AS session_start, max(ts) AS last_event,
  count(*)::BIGINT AS n_events, count(DISTINCT event_type)::BIGINT AS n_types,
  max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END)::INTEGER AS has_purchase,
  sum(value::DECIMAL(18,2))::DOUBLE AS value_sum
FROM ({SESSIONIZED_SQL}) GROUP BY user_id, session_no
""")
def q_session_summary(spark, d):
    return B.session_summary(events(spark, d), P.SESSION_GAP)


_S = P.FUNNEL_STEPS


@query("funnel", f"""
WITH a AS (SELECT user_id, ts AS t0 FROM events WHERE event_type = '{_S[0]}'),
a1 AS (SELECT a.*, (SELECT min(e.ts) FROM events e WHERE e.user_id = a.user_id
         AND e.event_type = '{_S[1]}' AND e.ts > a.t0) AS t1 FROM a),
a2 AS (SELECT a1.*, (SELECT min(e.ts) FROM events e WHERE e.user_id = a1.user_id
         AND e.event_type = '{_S[2]}' AND e.ts > a1.t1) AS t2 FROM a1)
SELECT user_id, max(1 + CASE WHEN epoch_us(t1) - epoch_us(t0) <= {WITHIN_US}
    THEN 1 + CASE WHEN epoch_us(t2) - epoch_us(t0) <= {WITHIN_US} THEN 1 ELSE 0 END
    ELSE 0 END)::INTEGER AS depth
FROM a2 GROUP BY user_id
""")
def q_funnel(spark, d):
    return B.funnel(events(spark, d), P.FUNNEL_STEPS, P.FUNNEL_WITHIN)


@query("window_counts_tumbling", f"""
SELECT make_timestamp(ws) AS window_start, make_timestamp(ws + {WIDTH_US}) AS window_end,
  event_type, count(*)::BIGINT AS n, sum(value::DECIMAL(18,2))::DOUBLE AS value_sum
FROM (SELECT *, (epoch_us(ts) // {WIDTH_US}) * {WIDTH_US} AS ws FROM events)
GROUP BY ws, event_type
""")
def q_window_tumbling(spark, d):
    return B.window_counts(events(spark, d), P.WINDOW_WIDTH)


@query("window_counts_sliding", f"""
SELECT make_timestamp(ws) AS window_start, make_timestamp(ws + {WIDTH_US}) AS window_end,
  event_type, count(*)::BIGINT AS n, sum(value::DECIMAL(18,2))::DOUBLE AS value_sum
FROM (SELECT e.*, (epoch_us(ts) // {SLIDE_US} - r.k) * {SLIDE_US} AS ws
      FROM events e, range(0, {WIDTH_US // SLIDE_US}) r(k))
GROUP BY ws, event_type
""")
def q_window_sliding(spark, d):
    return B.window_counts(events(spark, d), P.WINDOW_WIDTH, P.WINDOW_SLIDE)


_TR = {n: duration_us(h) for n, h in P.TRAILING.items()}
_TR_SQL = ",\n  ".join(
    f"count(*) OVER w{n} AS n_{n}, coalesce(sum(value::DECIMAL(18,2)) OVER w{n}, 0)::DOUBLE AS value_{n}"
    for n in _TR)
_TR_WIN = ", ".join(
    f"w{n} AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN {h} PRECEDING AND 1 PRECEDING)"
    for n, h in _TR.items())


@query("trailing_features", f"""
SELECT user_id, event_id, ts,
  {_TR_SQL}
FROM events WINDOW {_TR_WIN}
""")
def q_trailing(spark, d):
    return B.trailing_features(events(spark, d), P.TRAILING)


@query("gap_stats", """
WITH g AS (SELECT user_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id
             ORDER BY ts, event_id)) AS gap_us FROM events)
SELECT user_id, count(*)::BIGINT AS n_gaps,
  round(quantile_cont(gap_us, 0.5), 1) / 1e6 AS p50_s,
  round(quantile_cont(gap_us, 0.9), 1) / 1e6 AS p90_s,
  sum(gap_us) / count(*) / 1e6 AS mean_s
FROM g WHERE gap_us IS NOT NULL GROUP BY user_id
""")
def q_gap_stats(spark, d):
    return B.gap_stats(events(spark, d))


@query("transitions", """
WITH t AS (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_type,
             event_type AS to_type FROM events)
SELECT from_type, to_type, count(*)::BIGINT AS n,
  round(count(*) / sum(count(*)) OVER (PARTITION BY from_type), 9) AS share
FROM t WHERE from_type IS NOT NULL GROUP BY from_type, to_type
""")
def q_transitions(spark, d):
    return B.transitions(events(spark, d))


@query("retention_weekly", """
WITH a AS (SELECT DISTINCT user_id, date_trunc('week', ts) AS period FROM events),
f AS (SELECT user_id, min(period) AS cohort FROM a GROUP BY user_id)
SELECT f.cohort, (datediff('day', f.cohort, a.period) // 7)::INTEGER AS period_offset,
  count(*)::BIGINT AS n_users
FROM a JOIN f USING (user_id) GROUP BY f.cohort, period_offset
""")
def q_retention(spark, d):
    return B.retention(events(spark, d), P.RETENTION_PERIOD)


_A, _B = P.AUDIENCE_A, P.AUDIENCE_B


@query("audience_diff", f"""
WITH a AS (SELECT DISTINCT user_id FROM events WHERE ts >= TIMESTAMP '{_A[0]}' AND ts < TIMESTAMP '{_A[1]}'),
     b AS (SELECT DISTINCT user_id FROM events WHERE ts >= TIMESTAMP '{_B[0]}' AND ts < TIMESTAMP '{_B[1]}')
SELECT user_id, 'kept' AS status FROM (SELECT user_id FROM a INTERSECT SELECT user_id FROM b)
UNION ALL SELECT user_id, 'lost' FROM (SELECT user_id FROM a EXCEPT SELECT user_id FROM b)
UNION ALL SELECT user_id, 'new' FROM (SELECT user_id FROM b EXCEPT SELECT user_id FROM a)
""")
def q_audience(spark, d):
    return B.audience_diff(events(spark, d), P.AUDIENCE_A, P.AUDIENCE_B)





GAP30_US = duration_us("30m")
SESSIONIZED_30M_SQL = SESSIONIZED_SQL.replace(f"> {GAP_US}", f"> {GAP30_US}")


@query("sessionize_30m", f"SELECT event_id, user_id, ts, session_no FROM ({SESSIONIZED_30M_SQL})")
def q_sessionize_30m(spark, d):
    s = B.sessionize(events(spark, d), "30m", bucket="6h")
    return s.select("event_id", "user_id", "ts", "session_no")


@query("trailing_features_halo", f"""
SELECT user_id, event_id, ts,
  {_TR_SQL}
FROM events WINDOW {_TR_WIN}
""")
def q_trailing_halo(spark, d):
    """The same contract over wide buckets (the longest horizon)."""
    return B.trailing_features(events(spark, d), P.TRAILING, bucket=max(P.TRAILING.values(), key=duration_us))


_S2 = ["signup", "view", "purchase"]
WITHIN72_US = duration_us("72h")


@query("funnel_signup_72h", f"""
WITH a AS (SELECT user_id, ts AS t0 FROM events WHERE event_type = '{_S2[0]}'),
a1 AS (SELECT a.*, (SELECT min(e.ts) FROM events e WHERE e.user_id = a.user_id
         AND e.event_type = '{_S2[1]}' AND e.ts > a.t0) AS t1 FROM a),
a2 AS (SELECT a1.*, (SELECT min(e.ts) FROM events e WHERE e.user_id = a1.user_id
         AND e.event_type = '{_S2[2]}' AND e.ts > a1.t1) AS t2 FROM a1)
SELECT user_id, max(1 + CASE WHEN epoch_us(t1) - epoch_us(t0) <= {WITHIN72_US}
    THEN 1 + CASE WHEN epoch_us(t2) - epoch_us(t0) <= {WITHIN72_US} THEN 1 ELSE 0 END
    ELSE 0 END)::INTEGER AS depth
FROM a2 GROUP BY user_id
""")
def q_funnel_72h(spark, d):
    return B.funnel(events(spark, d), _S2, "72h")


_GAPS_SQL = """
WITH g AS (SELECT user_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id
             ORDER BY ts, event_id)) AS gap_us FROM events)
SELECT user_id, count(*)::BIGINT AS n_gaps,
  quantile_disc(gap_us, 0.5) / 1e6 AS p50_s, quantile_disc(gap_us, 0.9) / 1e6 AS p90_s,
  sum(gap_us) / count(*) / 1e6 AS mean_s
FROM g WHERE gap_us IS NOT NULL GROUP BY user_id
"""


@query("gap_stats_approx", _GAPS_SQL)
def q_gap_stats_approx(spark, d):
    """P10's large-data option: percentile_approx sketches per user (observed
    gaps, not interpolated). A user with fewer gaps than the sketch's accuracy
    has exact ranks, which the SQL checks."""
    return B.gap_stats(events(spark, d), method="approx")


@query("gap_stats_by_day", _GAPS_SQL)
def q_gap_stats_by_day(spark, d):
    """P10 from one kept KLL sketch per user and day."""
    return B.gap_stats_of(B.gap_sketches(events(spark, d)))
