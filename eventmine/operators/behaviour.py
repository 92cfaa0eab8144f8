"""Behaviour mining over the event log.

Per-user ordered work runs per (user, time bucket) — see ``ordered`` — so a
user with a third of all events is spread over many tasks. They cut the whole
order (user, time) into equal ranges unless a fixed time ``bucket`` is given,
to be picked so that one user-bucket fits comfortably in a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timefn import duration_us, floor_div, micros, ntz_literal
from .ordered import (BUCKET, TS_US, in_ranges, keyed_quantiles, lag_across_buckets,
                      running_sum_across_buckets, with_bucket)

ORDER = [TS_US, "event_id"]


def sessionize(events: DataFrame, gap: str = "8h", bucket: str | None = None,
               key: str = "user_id") -> DataFrame:
    """P05. Add ``session_no`` (1, 2, … per user). A new session starts iff the
    time since the user's previous event is strictly greater than ``gap``.
    Events without a user or a time are kept with a NULL ``session_no``. All
    columns of ``events`` are written once on the way: give those needed.

    Inside each (user, bucket): lag and a running count of session starts.
    Per (user, bucket) summary: first and last time, starts inside. A scan of
    the summary per user decides whether each bucket's first event starts a
    session and gives the count of sessions before the bucket."""
    g = duration_us(gap)
    has_key = F.col(key).isNotNull() & F.col("ts").isNotNull()
    ev = with_bucket(events.where(has_key), key, "ts", "event_id", bucket)
    # stated here, the join's inferred not-null filters add nothing, so the
    # window and summary branches plan identically and share one exchange
    ev = ev.where(F.col(BUCKET).isNotNull())
    w = Window.partitionBy(key, BUCKET).orderBy(*ORDER)
    prev_in = F.lag(TS_US).over(w)
    inner = (ev.withColumn("_prev_in", prev_in)
               .withColumn("_start_in", (F.col(TS_US) - F.col("_prev_in") > F.lit(g)).cast("int"))
               .withColumn("_cum_in", F.coalesce(F.sum("_start_in").over(
                   w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))))
    # first/last from ``ts`` (same order as the micros): the summary branch
    # then reads the same columns as the window branch
    summ = inner.groupBy(key, BUCKET).agg(
        micros(F.min("ts")).alias("_first"), micros(F.max("ts")).alias("_last"),
        F.coalesce(F.sum("_start_in"), F.lit(0)).alias("_n_in"))
    wb = Window.partitionBy(key).orderBy(BUCKET)
    prev_last = F.lag("_last").over(wb)
    summ = (summ.withColumn("_first_start",
                            (prev_last.isNull() | (F.col("_first") - prev_last > F.lit(g))).cast("int"))
                .withColumn("_off", F.coalesce(F.sum(F.col("_n_in") + F.col("_first_start")).over(
                    wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
                .select(key, BUCKET, "_first_start", "_off"))
    # The join moves only the summary (one row per user-bucket); the big side
    # is already partitioned by (user, bucket).
    out = inner.join(summ, [key, BUCKET])
    sessions = out.select(*events.columns,
                          (F.col("_off") + F.col("_first_start") + F.col("_cum_in"))
                          .cast("bigint").alias("session_no"))
    # Events without a user or a time are kept, unsessionized.
    rest = events.where(~has_key).withColumn("session_no", F.lit(None).cast("bigint"))
    return sessions.unionByName(rest)


def session_summary(events: DataFrame, gap: str = "8h", bucket: str | None = None,
                    key: str = "user_id", positive_type: str = "purchase") -> DataFrame:
    """P06. One row per session: start, last event, event count, distinct
    event types, whether it contains ``positive_type``, value sum. A plain
    ``groupBy`` on the sessionized log — partial aggregation, no single-key
    task."""
    events = events.select(key, "event_id", "ts", "event_type", "value")
    s = sessionize(events, gap, bucket, key).where(F.col("session_no").isNotNull())
    return s.groupBy(key, "session_no").agg(
        F.min("ts").alias("session_start"),
        F.max("ts").alias("last_event"),
        F.count(F.lit(1)).alias("n_events"),
        F.size(F.collect_set("event_type")).cast("bigint").alias("n_types"),
        F.max((F.col("event_type") == positive_type).cast("int")).alias("has_purchase"),
        F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value_sum"))


def funnel(events: DataFrame, steps: list[str], within: str, bucket: str | None = None,
           key: str = "user_id") -> DataFrame:
    """P07. Per user with at least one ``steps[0]`` event: the deepest step
    reached. From each anchor (a ``steps[0]`` event) the chain takes the
    earliest later ``steps[1]`` event, then the earliest ``steps[2]`` event
    after that, and so on; a step counts if it is within ``within`` of the
    anchor. Depth is the maximum over anchors.

    "Later" is strictly later: events at one instant don't follow each other.
    Events without a user or a time take no part.

    Chains are built last step to first. In reverse time order "the earliest
    later event" is the last one seen so far, a growing frame that each of the
    k−1 window passes on one partitioning reads once, however many events a
    user has. Partitions are (user, bucket), where buckets are equal ranges of
    (user, time), or of width ``bucket`` if given; a summary row per
    partition says where a chain that enters a bucket from before leaves for,
    and the summaries are scanned along the buckets. So chains cross buckets
    without copies, and a user's day is as many tasks as its rows need.
    Events of one user, instant and type count once."""
    wu = duration_us(within)
    ev = (events.where(F.col("event_type").isin(steps) & F.col(key).isNotNull() & F.col("ts").isNotNull())
                .select(key, "event_type", micros("ts").alias(TS_US)).distinct())
    if bucket is None:
        ev = in_ranges(ev, [key, TS_US])  # an instant is never cut
    else:
        ev = ev.withColumn(BUCKET, floor_div(F.col(TS_US), duration_us(bucket)))
    ev = ev.withColumn("_back", -F.col(TS_US))
    inside = Window.partitionBy(key, BUCKET).orderBy("_back").rangeBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy(key).orderBy(F.col(BUCKET).desc()).rowsBetween(Window.unboundedPreceding, -1)
    # _c.t{i} = time of step i reached by the greedy chain that starts at the
    # first steps[i-1] event after the current row
    k = len(steps)
    for i in range(k - 1, 0, -1):
        here = F.struct(F.col(TS_US).alias(f"t{i}"),
                        *[F.col(f"_c.t{j}").alias(f"t{j}") for j in range(i + 1, k)])
        cand = F.when(F.col("event_type") == steps[i], here)
        firsts = ev.groupBy(key, BUCKET).agg(F.min(cand).alias("_first"))
        firsts = firsts.select(key, BUCKET, F.last("_first", ignorenulls=True).over(behind).alias("_c_behind"))
        ev = ev.withColumn("_c_next", F.last(cand, ignorenulls=True).over(inside)).join(firsts, [key, BUCKET])
        ev = ev.select(key, BUCKET, "event_type", TS_US, "_back", F.coalesce("_c_next", "_c_behind").alias("_c"))
    anchors = ev.where(F.col("event_type") == steps[0])
    depth = F.lit(1)
    ok = F.lit(True)
    for i in range(1, k):
        ok = ok & F.coalesce(F.col(f"_c.t{i}") - F.col(TS_US) <= F.lit(wu), F.lit(False))
        depth = depth + ok.cast("int")
    return anchors.groupBy(key).agg(F.max(depth).alias("depth"))


def window_counts(events: DataFrame, width: str, slide: str | None = None) -> DataFrame:
    """P08. Count and value sum per (window, event type); tumbling if
    ``slide`` is None, else sliding. Windows align to the epoch."""
    win = F.window("ts", _interval(width), _interval(slide) if slide else None)
    return (events.groupBy(win.alias("w"), "event_type")
                  .agg(F.count(F.lit(1)).alias("n"),
                       F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value_sum"))
                  .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                          "event_type", "n", "value_sum"))


def _interval(spec: str) -> str:
    us = duration_us(spec)
    return f"{us // 1_000_000} seconds" if us % 1_000_000 == 0 else f"{us} microseconds"


def trailing_features(events: DataFrame, horizons: dict[str, str], bucket: str | None = None,
                      key: str = "user_id") -> DataFrame:
    """P09. Per event, the count and value sum of the same user's events in
    ``[ts - h, ts)`` for each horizon ``h`` — the event itself and others at
    the same instant excluded. One row per event that has a user and a time
    (repeated event ids are separate rows); the others are left out.

    A trailing count is count(ts' < t) − count(ts' < t − h). Events are
    summed per (user, instant) first; each instant adds a probe at t and one
    at t − h per horizon, and running sums over (user, bucket) partitions with
    bucket hand-over (two-level scan) give the sums before every probe. Buckets
    are equal ranges of events and probes together by (user, time), or of width
    ``bucket`` if given, so each probe is in the range its time falls in and a
    hot user's day splits like any other. Work is linear in the events,
    whatever the horizon."""
    hs = {n: duration_us(h) for n, h in horizons.items()}
    own = events.where(F.col(key).isNotNull() & F.col("ts").isNotNull()).select(key, "event_id", "ts", "value")
    at = own.groupBy(key, micros("ts").alias("_at")).agg(
        F.count(F.lit(1)).alias("_c"), F.coalesce(F.sum(F.col("value").cast("decimal(18,2)")), F.lit(0)).alias("_v"))
    probes = F.array(*[F.struct(F.lit(n).alias("pn"), (F.col("_at") - F.lit(h)).alias("t"), F.lit(0).cast("bigint").alias("c"),
                                F.lit(0).cast("decimal(28,2)").alias("v")) for n, h in [("_self", 0), *hs.items()]],
                     F.struct(F.lit(None).cast("string").alias("pn"), F.col("_at").alias("t"), F.col("_c").alias("c"),
                              F.col("_v").cast("decimal(28,2)").alias("v")))
    u = at.select(key, "_at", F.inline(probes)).withColumn("_kind", F.col("pn").isNull().cast("int"))
    u = in_ranges(u, [key, "t", "_kind", "_at", "pn"]) if bucket is None else u.withColumn(BUCKET, floor_div(F.col("t"), duration_us(bucket)))
    # probes sort before events at the same instant: their running sums
    # count events strictly before the probe time
    rs = running_sum_across_buckets(u, key, ["t", "_kind", "_at", "pn"], {"_cc": F.col("c"), "_vv": F.col("v")})
    pr = rs.where(F.col("_kind") == 0)
    aggs = [F.max(F.when(F.col("pn") == n, F.col(c))).alias(f"{c}{n}")
            for n in ["_self", *hs] for c in ("_cc", "_vv")]
    per = pr.groupBy(key, "_at").agg(*aggs)
    cols = []
    for n in hs:
        cols += [(F.col("_cc_self") - F.col(f"_cc{n}")).cast("bigint").alias(f"n_{n}"),
                 (F.col("_vv_self") - F.col(f"_vv{n}")).cast("double").alias(f"value_{n}")]
    per = per.select(key, "_at", *cols)
    return own.withColumn("_at", micros("ts")).join(per, [key, "_at"]).select(key, "event_id", "ts", *[
        f"{c}_{n}" for n in hs for c in ("n", "value")])


def gap_stats(events: DataFrame, bucket: str | None = None, key: str = "user_id",
              method: str = "exact", accuracy: int = 10_000) -> DataFrame:
    """P10. Per user: number of gaps, p50 / p90 and mean of the seconds
    between consecutive events. The previous event comes from the bucketed
    lag. ``method='exact'``: interpolated quantiles from ``keyed_quantiles``
    (no user's gaps gathered in one buffer). ``method='approx'``:
    ``percentile_approx`` — a fixed-size mergeable sketch per user, one
    partially-aggregated ``groupBy``; values are actual gaps, not
    interpolated, within 1/``accuracy`` in rank."""
    ev = with_bucket(events.select(key, "event_id", "ts"), key, "ts", "event_id", bucket)
    ev = lag_across_buckets(ev, key, ORDER, {"_prev_us": F.col(TS_US)})
    gaps = (ev.where(F.col("_prev_us").isNotNull())
              .select(key, (F.col(TS_US) - F.col("_prev_us")).alias("_gap_us")))
    if method == "approx":
        sec = F.col("_gap_us") / 1e6
        return gaps.groupBy(key).agg(
            F.count(F.lit(1)).alias("n_gaps"),
            F.percentile_approx(sec, 0.5, accuracy).alias("p50_s"),
            F.percentile_approx(sec, 0.9, accuracy).alias("p90_s"),
            (F.sum("_gap_us") / F.count(F.lit(1)) / 1e6).alias("mean_s"))
    q = keyed_quantiles(gaps, key, "_gap_us", {"_p50": 0.5, "_p90": 0.9}, mean="_mean")
    # integer sum / count / 1e6: the same IEEE result in any engine, no rounding
    return q.select(
        key, F.col("n").alias("n_gaps"),
        (F.round("_p50", 1) / 1e6).alias("p50_s"), (F.round("_p90", 1) / 1e6).alias("p90_s"),
        (F.col("_mean") / 1e6).alias("mean_s"))


def gap_sketches(events: DataFrame, key: str = "user_id", k: int = 800, bucket: str | None = None) -> DataFrame:
    """P10, to be kept: one row per (user, day) with the number and sum of the
    gaps between the day's events, a KLL sketch of them (microseconds), and the
    day's first and last instant. A new day's events give new rows; no earlier
    day is read again (:func:`gap_stats_of`). A day with one event has no gaps
    and a NULL sketch; events without a user or a time have no row. ``k`` is the
    sketch's size: the rank error shrinks about as 1 / ``k``, and up to ``k``
    gaps are held exactly. A hot user's day is many parts, each of which sends
    one sketch."""
    ev = events.where(F.col(key).isNotNull() & F.col("ts").isNotNull()).select(key, "event_id", "ts", F.to_date("ts").alias("day"))
    ev = with_bucket(ev, key, "ts", "event_id", bucket)
    ev = lag_across_buckets(ev, [key, "day"], ORDER, {"_prev_us": F.col(TS_US)})
    gap = F.col(TS_US) - F.col("_prev_us")
    return ev.groupBy(key, "day").agg(
        F.count("_prev_us").alias("n_gaps"), F.coalesce(F.sum(gap), F.lit(0)).alias("gaps_us"),
        F.when(F.count("_prev_us") > 0, F.kll_sketch_agg_bigint(gap, F.lit(k))).alias("sketch"),
        F.min(TS_US).alias("first_us"), F.max(TS_US).alias("last_us"))


def gap_stats_of(sketches: DataFrame, key: str = "user_id", k: int = 800) -> DataFrame:
    """P10 from the rows of :func:`gap_sketches`, of however many runs: number
    of gaps and their mean exactly, p50 / p90 as observed gaps within the
    sketches' rank error (exact while a user has at most ``k`` gaps). The gap
    from a day to the user's next day with events comes from the days' first and
    last instants. Users without gaps have no row. One row per (user, day)
    moves, never an event."""
    days = Window.partitionBy(key).orderBy("day")
    rows = sketches.withColumn("_over", F.col("first_us") - F.lag("last_us").over(days))
    per = rows.groupBy(key).agg(
        (F.sum("n_gaps") + F.count("_over")).alias("n_gaps"),
        (F.sum("gaps_us") + F.coalesce(F.sum("_over"), F.lit(0))).alias("_us"),
        F.when(F.sum("n_gaps") > 0, F.kll_merge_agg_bigint("sketch", F.lit(k))).alias("_within"),
        F.when(F.count("_over") > 0, F.kll_sketch_agg_bigint("_over", F.lit(k))).alias("_across"))
    both = F.when(F.col("_within").isNotNull() & F.col("_across").isNotNull(),
                  F.kll_sketch_merge_bigint("_within", "_across")).otherwise(F.coalesce("_within", "_across"))
    return per.where(F.col("n_gaps") > 0).withColumn("_all", both).select(
        key, "n_gaps",
        *[(F.kll_sketch_get_quantile_bigint("_all", F.lit(p)) / 1e6).alias(f"p{int(p * 100)}_s") for p in (0.5, 0.9)],
        (F.col("_us") / F.col("n_gaps") / 1e6).alias("mean_s"))


def transitions(events: DataFrame, bucket: str | None = None, key: str = "user_id") -> DataFrame:
    """P11. Counts of (from_type, to_type) between consecutive events of a
    user and each pair's share of its ``from_type`` row."""
    ev = with_bucket(events.select(key, "event_id", "ts", "event_type"), key, "ts", "event_id", bucket)
    ev = lag_across_buckets(ev, key, ORDER, {"from_type": F.col("event_type")})
    pairs = (ev.where(F.col("from_type").isNotNull())
               .groupBy("from_type", F.col("event_type").alias("to_type"))
               .agg(F.count(F.lit(1)).alias("n")))
    row = Window.partitionBy("from_type")
    return pairs.withColumn("share", F.round(F.col("n") / F.sum("n").over(row), 9))


def retention(events: DataFrame, period: str = "week", key: str = "user_id") -> DataFrame:
    """P12. Cohort = period (day, week, month, quarter or year) of a user's first event; for each cohort and
    offset (periods since the cohort), distinct active users.

    One ``groupBy(user)`` collects the user's distinct active periods (at most
    one per period of the time span, whatever the user's row count; combined
    map-side), the earliest is the cohort, and the (cohort, offset) counts
    come from exploding those few periods."""
    per = F.date_trunc(period, "ts").cast("timestamp_ntz")
    users = events.groupBy(key).agg(F.collect_set(per).alias("_ps"))
    ex = users.select(F.array_min("_ps").alias("cohort"), F.explode("_ps").alias("_p"))
    if period in ("day", "week"):
        off = F.floor(F.datediff("_p", "cohort") / F.lit({"week": 7, "day": 1}[period])).cast("int")
    else:
        months = (F.year("_p") - F.year("cohort")) * 12 + F.month("_p") - F.month("cohort")
        off = F.floor(months / F.lit({"month": 1, "quarter": 3, "year": 12}[period])).cast("int")
    return (ex.groupBy("cohort", off.alias("period_offset"))
              .agg(F.count(F.lit(1)).alias("n_users")))


def audience_diff(events: DataFrame, period_a: tuple[str, str], period_b: tuple[str, str],
                  key: str = "user_id") -> DataFrame:
    """P13. Users active in period A and/or B, tagged ``kept`` (both),
    ``lost`` (A only) or ``new`` (B only) — the set operations A ∩ B, A − B,
    B − A computed in one pass: one flag pair per user from a partially
    aggregated ``groupBy``, instead of three set operations that each scan
    and shuffle both sides."""
    ts = F.col("ts")
    in_a = (ts >= ntz_literal(period_a[0])) & (ts < ntz_literal(period_a[1]))
    in_b = (ts >= ntz_literal(period_b[0])) & (ts < ntz_literal(period_b[1]))
    per = (events.where(in_a | in_b).groupBy(key)
                 .agg(F.max(in_a).alias("_a"), F.max(in_b).alias("_b")))
    status = (F.when(F.col("_a") & F.col("_b"), "kept").when(F.col("_a"), "lost")
               .otherwise("new"))
    return per.select(key, status.alias("status"))
