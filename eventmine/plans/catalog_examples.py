"""Registered queries: ingest, examples and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.props import parse_props, props_quality
from ..operators import examples as X
from ..sources.tables import read_table
from . import params as P
from .registry import query

CUTOFF_VALUES = ", ".join(f"(TIMESTAMP '{c}', {i})" for i, c in enumerate(P.CUTOFFS))
CUTOFFS_CTE = f"cutoffs(cutoff, ci) AS (VALUES {CUTOFF_VALUES})"
TYPE_COUNTS_SQL = ",\n  ".join(
    f"count_if(e.event_type = '{t}')::BIGINT AS n_{t}" for t in X.EVENT_TYPES)

FEATURES_SQL = f"""
WITH {CUTOFFS_CTE}
SELECT e.user_id, c.cutoff,
  count(*)::BIGINT AS n_events,
  {TYPE_COUNTS_SQL},
  sum(e.value::DECIMAL(18,2))::DOUBLE AS value_sum,
  (epoch_us(c.cutoff) - epoch_us(max(e.ts))) / 1e6 AS recency_s,
  count(DISTINCT e.ts::DATE)::BIGINT AS active_days
FROM events e JOIN cutoffs c ON e.ts < c.cutoff
GROUP BY e.user_id, c.cutoff
"""

LABELS_SQL = f"""
WITH {CUTOFFS_CTE}
SELECT e.user_id, c.cutoff,
  max(CASE WHEN e.event_type = 'purchase' AND e.ts >= c.cutoff
            AND e.ts < c.cutoff + INTERVAL 1 DAY THEN 1 ELSE 0 END)::INTEGER AS label
FROM events e CROSS JOIN cutoffs c
GROUP BY e.user_id, c.cutoff
HAVING min(e.ts) < c.cutoff
"""

EXAMPLES_SQL = f"""
WITH f AS ({FEATURES_SQL}), l AS ({LABELS_SQL})
SELECT f.*, l.label FROM f JOIN l USING (user_id, cutoff)
"""


def events(spark, d):
    return read_table(spark, d, "events")


@query("read_orders", """
SELECT * FROM orders
""")
def q_read_orders(spark, d):
    return read_table(spark, d, "orders")


@query("parse_props", """
SELECT event_id, user_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
FROM events
""")
def q_parse_props(spark, d):
    return parse_props(events(spark, d).select("event_id", "user_id", "props")).drop("props")


@query("props_quality", """
SELECT count(*)::BIGINT AS n_rows,
  count_if(props IS NULL)::BIGINT AS n_null,
  count_if(props IS NOT NULL AND NOT json_valid(props))::BIGINT AS n_malformed,
  count_if(json_valid(props) AND TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) IS NULL)::BIGINT AS n_missing,
  count_if(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) IS NOT NULL)::BIGINT AS n_parsed
FROM events
""")
def q_props_quality(spark, d):
    return props_quality(events(spark, d))


@query("features_at_cutoff", FEATURES_SQL)
def q_features(spark, d):
    return X.features_at_cutoff(events(spark, d), P.CUTOFFS)


@query("label_examples", LABELS_SQL)
def q_labels(spark, d):
    return X.label_examples(events(spark, d), P.CUTOFFS, P.HORIZON)


@query("examples_with_features", EXAMPLES_SQL)
def q_examples(spark, d):
    return X.examples_with_features(events(spark, d), P.CUTOFFS, P.HORIZON)


@query("as_of_last_view", """
WITH v AS (SELECT user_id, ts, max(event_id) AS event_id FROM events
           WHERE event_type = 'view' GROUP BY user_id, ts),
     vv AS (SELECT v.user_id, v.ts, v.event_id, e.value FROM v JOIN events e USING (event_id))
SELECT p.event_id, p.user_id, p.ts, p.value,
       vv.event_id AS r_event_id, vv.ts AS r_ts, vv.value AS r_value
FROM (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN vv ON p.user_id = vv.user_id AND p.ts >= vv.ts
""")
def q_as_of(spark, d):
    ev = events(spark, d)
    purchases = ev.where(F.col("event_type") == "purchase").select("event_id", "user_id", "ts", "value")
    views = ev.where(F.col("event_type") == "view").select("event_id", "user_id", "ts", "value")
    return X.as_of_join(purchases, views, by="user_id", left_ts="ts", right_ts="ts",
                        right_id="event_id", right_cols=["value"])


@query("split_examples", f"""
WITH ex AS ({LABELS_SQL}),
b AS (SELECT *, (('0x' || substr(md5(user_id::VARCHAR), 1, 8))::BIGINT % {P.SPLIT_BUCKETS}) AS bk FROM ex)
SELECT user_id, cutoff, label,
  CASE WHEN bk >= {P.SPLIT_BUCKETS - 1} THEN 'test'
       WHEN bk >= {P.SPLIT_BUCKETS - 2} THEN 'valid' ELSE 'train' END AS split
FROM b
""")
def q_split(spark, d):
    ex = X.label_examples(events(spark, d), P.CUTOFFS, P.HORIZON)
    return X.split_examples(ex, by="hash", n_buckets=P.SPLIT_BUCKETS)


@query("negative_sample", f"""
WITH ex AS ({LABELS_SQL}),
q AS (SELECT cutoff, floor(count(*) * {P.NEG_RATIO})::BIGINT AS quota FROM ex WHERE label = 1 GROUP BY cutoff),
r AS (SELECT ex.*, row_number() OVER (PARTITION BY ex.cutoff
        ORDER BY md5(ex.user_id::VARCHAR || ':{P.NEG_SEED}'), ex.user_id) AS rn
      FROM ex WHERE label <> 1)
SELECT user_id, cutoff, label FROM ex WHERE label = 1
UNION ALL
SELECT r.user_id, r.cutoff, r.label FROM r JOIN q USING (cutoff) WHERE r.rn <= q.quota
""")
def q_negative_sample(spark, d):
    ex = X.label_examples(events(spark, d), P.CUTOFFS, P.HORIZON)
    return X.negative_sample(ex, P.NEG_RATIO, P.NEG_SEED)


@query("target_encode_segment", f"""
WITH ex AS (SELECT l.*, c.c_mktsegment FROM ({LABELS_SQL}) l JOIN customer c ON l.user_id = c.c_custkey),
per AS (SELECT c_mktsegment, cutoff, count(*) AS n, sum(label) AS pos FROM ex GROUP BY 1, 2),
per2 AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY c_mktsegment ORDER BY cutoff
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n_prev,
               coalesce(sum(pos) OVER (PARTITION BY c_mktsegment ORDER BY cutoff
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos_prev FROM per),
tot AS (SELECT cutoff, sum(pos) OVER w / sum(n) OVER w AS prior FROM
          (SELECT cutoff, count(*) AS n, sum(label) AS pos FROM ex GROUP BY cutoff)
        WINDOW w AS (ORDER BY cutoff ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT ex.user_id, ex.cutoff, ex.label, ex.c_mktsegment,
  round((per2.pos_prev + {P.PRIOR_WEIGHT} * tot.prior) / (per2.n_prev + {P.PRIOR_WEIGHT}), 9) AS te
FROM ex JOIN per2 USING (c_mktsegment, cutoff) JOIN tot USING (cutoff)
""")
def q_target_encode(spark, d):
    ex = X.label_examples(events(spark, d), P.CUTOFFS, P.HORIZON)
    cust = read_table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    ex = ex.join(cust, "user_id")
    out = X.target_encode(ex, "c_mktsegment", prior_weight=P.PRIOR_WEIGHT, horizon=P.HORIZON)
    return out.select("user_id", "cutoff", "label", "c_mktsegment", F.round("te", 9).alias("te"))


@query("split_examples_time", f"""
SELECT user_id, cutoff, label,
  CASE WHEN cutoff >= TIMESTAMP '{P.CUTOFFS[-1]}' THEN 'test'
       WHEN cutoff >= TIMESTAMP '{P.CUTOFFS[-2]}' THEN 'valid' ELSE 'train' END AS split
FROM ({LABELS_SQL})
""")
def q_split_time(spark, d):
    ex = X.label_examples(events(spark, d), P.CUTOFFS, P.HORIZON)
    return X.split_examples(ex, by="time", test_cutoff=P.CUTOFFS[-1], valid_cutoff=P.CUTOFFS[-2], horizon=P.HORIZON)


@query("as_of_last_view_strict", """
WITH v AS (SELECT user_id, ts, max(event_id) AS event_id FROM events
           WHERE event_type = 'view' GROUP BY user_id, ts),
     vv AS (SELECT v.user_id, v.ts, v.event_id, e.value FROM v JOIN events e USING (event_id))
SELECT p.event_id, p.user_id, p.ts, p.value,
       vv.event_id AS r_event_id, vv.ts AS r_ts, vv.value AS r_value
FROM (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN vv ON p.user_id = vv.user_id AND p.ts > vv.ts
""")
def q_as_of_strict(spark, d):
    ev = events(spark, d)
    purchases = ev.where(F.col("event_type") == "purchase").select("event_id", "user_id", "ts", "value")
    views = ev.where(F.col("event_type") == "view").select("event_id", "user_id", "ts", "value")
    return X.as_of_join(purchases, views, by="user_id", left_ts="ts", right_ts="ts",
                        right_id="event_id", right_cols=["value"], strict=True)


_DAILY = [f"2024-01-{n:02d} 00:00:00" for n in range(8, 18)]
_DAILY_CTE = f"cutoffs(cutoff) AS (VALUES {', '.join(f'(TIMESTAMP {c!r})' for c in _DAILY)})"


@query("target_encode_segment_overlap", f"""
WITH {_DAILY_CTE},
ex AS (SELECT e.user_id, c.cutoff, cu.c_mktsegment,
         max(CASE WHEN e.event_type = 'purchase' AND e.ts >= c.cutoff AND e.ts < c.cutoff + INTERVAL 3 DAY THEN 1 ELSE 0 END)::INTEGER AS label
       FROM events e CROSS JOIN cutoffs c JOIN customer cu ON cu.c_custkey = e.user_id
       GROUP BY 1, 2, 3 HAVING min(e.ts) < c.cutoff),
prev AS (SELECT s.c_mktsegment, c.cutoff, coalesce(sum(x.label), 0) AS pos, count(x.label) AS n
         FROM (SELECT DISTINCT c_mktsegment FROM ex) s CROSS JOIN cutoffs c
         LEFT JOIN ex x ON x.c_mktsegment = s.c_mktsegment AND x.cutoff + INTERVAL 3 DAY <= c.cutoff GROUP BY 1, 2),
tot AS (SELECT cutoff, sum(pos) / nullif(sum(n), 0) AS prior FROM prev GROUP BY cutoff)
SELECT ex.user_id, ex.cutoff, ex.label, ex.c_mktsegment,
  round((pos + {P.PRIOR_WEIGHT} * prior) / (n + {P.PRIOR_WEIGHT}), 9) AS te
FROM ex JOIN prev USING (c_mktsegment, cutoff) JOIN tot USING (cutoff)
""")
def q_target_encode_overlap(spark, d):
    """Daily cutoffs with label windows of three days: only closed windows count."""
    ex = X.label_examples(events(spark, d), _DAILY, "3d")
    cust = read_table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    out = X.target_encode(ex.join(cust, "user_id"), "c_mktsegment", prior_weight=P.PRIOR_WEIGHT, horizon="3d")
    return out.select("user_id", "cutoff", "label", "c_mktsegment", F.round("te", 9).alias("te"))
