"""Registered queries: Structured Streaming.

Each builder runs its stream with ``trigger(availableNow=True)`` into a
parquet sink under the shared checkpoint folder and returns the sink as a
batch DataFrame."""

from __future__ import annotations

from ..functions.timefn import duration_us
from ..streaming import events as ST
from . import params as P
from .catalog_behaviour import SESSIONIZED_SQL
from .registry import query

DELAY_US = duration_us(P.STREAM_DELAY)
WIDTH_US = duration_us(P.WINDOW_WIDTH)
GAP_US = duration_us(P.SESSION_GAP)
TTL_US = duration_us(P.STATE_TTL)


@query("stream_window_counts", f"""
WITH w AS (SELECT (epoch_us(ts) // {WIDTH_US}) * {WIDTH_US} AS ws, event_type, value FROM events),
wm AS (SELECT max(epoch_us(ts)) - {DELAY_US} AS wm FROM events)
SELECT make_timestamp(ws) AS window_start, make_timestamp(ws + {WIDTH_US}) AS window_end,
  event_type, count(*)::BIGINT AS n, sum(value::DECIMAL(18,2))::DOUBLE AS value_sum
FROM w, wm WHERE ws + {WIDTH_US} <= wm.wm GROUP BY ws, event_type
""")
def q_stream_windows(spark, d):
    return ST.replay(spark, d, lambda s: ST.stream_window_counts(s, P.WINDOW_WIDTH, P.STREAM_DELAY), "window-counts")


@query("stream_sessions", f"""
WITH s AS (SELECT user_id, min(ts) AS session_start,
             make_timestamp(epoch_us(max(ts)) + {GAP_US}) AS session_end, count(*)::BIGINT AS n_events
           FROM ({SESSIONIZED_SQL}) GROUP BY user_id, session_no)
SELECT s.* FROM s, (SELECT max(epoch_us(ts)) - {DELAY_US} AS wm FROM events) m
WHERE epoch_us(s.session_end) <= m.wm
""")
def q_stream_sessions(spark, d):
    return ST.replay(spark, d, lambda s: ST.stream_sessions(s, P.SESSION_GAP, P.STREAM_DELAY), "sessions")


@query("stream_dedup", "SELECT * FROM events")
def q_stream_dedup(spark, d):
    """The event feed delivered twice (each micro-batch holds every row two
    times): every event must come out once."""
    return ST.replay(spark, d, lambda s: ST.stream_dedup(s.unionByName(s), ["event_id"], P.STREAM_DELAY), "dedup")


_USER_STATE_SQL = f"""
WITH g AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events),
sp AS (SELECT user_id, max(CASE WHEN gap IS NULL OR gap > {TTL_US} THEN ts END) AS since FROM g GROUP BY user_id),
u AS (SELECT user_id, count(*)::BIGINT AS n_events,
             count_if(event_type = 'purchase')::BIGINT AS n_purchases, max(ts) AS last_event,
             max(CASE WHEN event_type = 'purchase' THEN ts END) AS last_purchase
           FROM events JOIN sp USING (user_id) WHERE ts >= since GROUP BY user_id),
m AS (SELECT epoch_ms(max(ts)) - {DELAY_US // 1000} AS wm FROM events)
SELECT u.user_id, u.last_event AS as_of,
  epoch_ms(u.last_event) + {TTL_US // 1000} < m.wm AS expired,
  u.n_events, u.n_purchases, u.last_event, u.last_purchase,
  ((epoch_us(u.last_event) - epoch_us(u.last_purchase)) // 86400000000)::BIGINT AS days_since_purchase
FROM u, m
"""


@query("stream_user_state", _USER_STATE_SQL)
def q_stream_user_state(spark, d):
    """The state of each user's last spell, expired when its last event + TTL
    is behind the final watermark."""
    return ST.latest_user_state(
        ST.replay(spark, d, lambda s: ST.stream_user_state(s, P.STATE_TTL, P.STREAM_DELAY), "user-state"))


@query("stream_user_timers", _USER_STATE_SQL)
def q_stream_user_timers(spark, d):
    """The same from value state and event-time timers on RocksDB."""
    with ST.rocksdb_state(spark):
        return ST.latest_user_state(
            ST.replay(spark, d, lambda s: ST.stream_user_timers(s, P.STATE_TTL, P.STREAM_DELAY), "user-timers"))
