import pytest
import datetime as dt

from pyspark.sql import functions as F

from eventmine.operators import examples as X

from support import SF001, make_events, ts

CUT = ["2024-01-02 00:00:00", "2024-01-03 00:00:00"]
C1 = dt.datetime(2024, 1, 2)
C2 = dt.datetime(2024, 1, 3)


def test_event_exactly_at_cutoff_and_one_micro_before(spark):
    rows = [(1, C1 - dt.timedelta(microseconds=1), 1, "view", 2.0),
            (2, C1, 1, "purchase", 3.0),               # at the cutoff: label, not feature
            (3, C1 + dt.timedelta(hours=23), 2, "view"),
            (4, C2, 2, "purchase")]
    df = make_events(spark, rows)
    f = {(r.user_id, r.cutoff): r for r in X.features_at_cutoff(df, CUT).collect()}
    assert f[(1, C1)].n_events == 1 and f[(1, C1)].n_purchase == 0 and f[(1, C1)].value_sum == 2.0
    assert f[(1, C1)].recency_s == 1e-6
    assert f[(1, C2)].n_events == 2 and f[(1, C2)].n_purchase == 1
    assert (2, C1) not in f and f[(2, C2)].n_events == 1
    lab = {(r.user_id, r.cutoff): r.label for r in X.label_examples(df, CUT, "1d").collect()}
    assert lab == {(1, C1): 1, (1, C2): 0, (2, C2): 1}


def test_active_days_across_segments(spark):
    rows = [(1, ts(hours=1), 1, "view"), (2, ts(hours=25), 1, "view"), (3, ts(hours=26), 1, "view"),
            (4, ts(hours=49), 1, "view")]
    cut = ["2024-01-02 02:00:00", "2024-01-03 12:00:00"]
    got = {r.cutoff.isoformat(): r.active_days for r in X.features_at_cutoff(make_events(spark, rows), cut).collect()}
    assert got == {"2024-01-02T02:00:00": 2, "2024-01-03T12:00:00": 3}


def test_no_leakage_from_rows_at_or_after_cutoff(spark):
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    cut = ["2024-01-16 00:00:00"]
    base = X.features_at_cutoff(ev, cut)
    changed = ev.withColumn("value", F.when(F.col("ts") >= F.lit(C1.replace(day=16)).cast("timestamp_ntz"),
                                            F.col("value") * 100 + 7).otherwise(F.col("value"))) \
                .withColumn("event_type", F.when(F.col("ts") >= F.lit(C1.replace(day=16)).cast("timestamp_ntz"),
                                                 F.lit("purchase")).otherwise(F.col("event_type")))
    a = sorted(map(tuple, base.collect()))
    b = sorted(map(tuple, X.features_at_cutoff(changed, cut).collect()))
    assert a == b


def test_as_of_ties_strict_and_unmatched(spark):
    left = spark.createDataFrame([(1, ts(10), 100), (1, ts(5), 101), (2, ts(10), 102), (1, ts(0), 103)],
                                 "k long, t timestamp_ntz, id long")
    right = spark.createDataFrame([(1, ts(5), 1, "a"), (1, ts(5), 2, "b"), (1, ts(7), 3, "c"),
                                   (3, ts(1), 4, "d")],
                                  "k long, t timestamp_ntz, rid long, v string")
    got = {r.id: r.r_rid for r in X.as_of_join(left, right, "k", "t", "t", "rid", ["v"]).collect()}
    assert got == {100: 3, 101: 2, 102: None, 103: None}
    strict = {r.id: r.r_rid for r in
              X.as_of_join(left, right, "k", "t", "t", "rid", ["v"], strict=True).collect()}
    assert strict == {100: 3, 101: None, 102: None, 103: None}


def test_as_of_across_buckets_matches_brute_force(spark):
    import random
    rnd = random.Random(3)
    L = [(rnd.randint(0, 2), ts(rnd.randint(0, 3000)), i) for i in range(80)]
    R = [(rnd.randint(0, 2), ts(rnd.randint(0, 3000)), 1000 + i, "x") for i in range(60)]
    left = spark.createDataFrame(L, "k long, t timestamp_ntz, id long")
    right = spark.createDataFrame(R, "k long, t timestamp_ntz, rid long, v string")
    got = {r.id: r.r_rid for r in
           X.as_of_join(left, right, "k", "t", "t", "rid", ["v"], bucket="1h").collect()}
    exp = {}
    for k, t, i in L:
        c = [(rt, rid) for rk, rt, rid, _ in R if rk == k and rt <= t]
        exp[i] = max(c)[1] if c else None
    assert got == exp


def test_negative_sample_matches_rank_definition(spark):
    import hashlib
    rows = [(u, C1, 1 if u % 7 == 0 else 0) for u in range(300)] + \
           [(u, C2, 1 if u % 5 == 0 else 0) for u in range(300)]
    ex = spark.createDataFrame(rows, "user_id long, cutoff timestamp_ntz, label int")
    got = sorted((r.user_id, r.cutoff, r.label) for r in
                 X.negative_sample(ex, 1.5, seed=11, prefix_len=1).collect())
    exp = []
    for c in (C1, C2):
        pos = [r for r in rows if r[1] == c and r[2] == 1]
        neg = sorted((r for r in rows if r[1] == c and r[2] == 0),
                     key=lambda r: (hashlib.md5(f"{r[0]}:11".encode()).hexdigest(), r[0]))
        exp += pos + neg[: int(len(pos) * 1.5)]
    assert got == sorted(exp)


def test_split_is_stable_and_target_encoding_uses_earlier_only(spark):
    rows = [(u, c, lab, "A" if u % 2 else "B") for u in range(40) for c, lab in
            ((C1, u % 3 == 0), (C2, u % 4 == 0))]
    ex = spark.createDataFrame([(u, c, int(l), s) for u, c, l, s in rows],
                               "user_id long, cutoff timestamp_ntz, label int, seg string")
    s1 = {r.user_id: r.split for r in X.split_examples(ex).collect()}
    s2 = {r.user_id: r.split for r in X.split_examples(ex.repartition(7)).collect()}
    assert s1 == s2 and set(s1.values()) <= {"train", "valid", "test"}
    te = X.target_encode(ex, "seg", prior_weight=2.0).collect()
    assert all(r.te is None for r in te if r.cutoff == C1)
    a_c1 = [r for r in rows if r[3] == "A" and r[1] == C1]
    all_c1 = [r for r in rows if r[1] == C1]
    prior = sum(r[2] for r in all_c1) / len(all_c1)
    want = (sum(r[2] for r in a_c1) + 2.0 * prior) / (len(a_c1) + 2.0)
    got = {r.te for r in te if r.cutoff == C2 and r.seg == "A"}
    assert len(got) == 1 and abs(got.pop() - want) < 1e-12


def test_as_of_null_keys_match_nothing(spark):
    left = spark.createDataFrame([(None, ts(10), 1), (1, ts(10), 2)], "k long, t timestamp_ntz, id long")
    right = spark.createDataFrame([(None, ts(5), 10, "a"), (1, ts(5), 11, "b")],
                                  "k long, t timestamp_ntz, rid long, v string")
    got = {r.id: r.r_rid for r in X.as_of_join(left, right, "k", "t", "t", "rid", ["v"]).collect()}
    assert got == {1: None, 2: 11}


def test_examples_with_features_equals_join_of_parts(spark):
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    cut = ["2024-01-05 12:00:00", "2024-01-06 00:00:00", "2024-01-20 00:00:00"]
    joined = X.features_at_cutoff(ev, cut).join(X.label_examples(ev, cut, "2d"), ["user_id", "cutoff"])
    one_pass = X.examples_with_features(ev, cut, "2d")
    cols = joined.columns
    assert sorted(map(tuple, one_pass.select(*cols).collect())) == sorted(map(tuple, joined.collect()))


def test_many_cutoffs_match_sql(spark):
    """28 daily cutoffs: the running-sum expansion equals the SQL join."""
    import duckdb
    cut = [f"2024-01-{d:02d} 06:00:00" for d in range(2, 30)]
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    got = X.examples_with_features(ev, cut, "1d").collect()
    values = ", ".join(f"(TIMESTAMP '{c}')" for c in cut)
    types = ", ".join(f"count_if(e.event_type = '{t}')::BIGINT AS n_{t}" for t in X.EVENT_TYPES)
    sql = f"""
    WITH c(cutoff) AS (VALUES {values}),
    f AS (SELECT e.user_id, c.cutoff, count(*)::BIGINT AS n_events, {types},
            sum(e.value::DECIMAL(18,2))::DOUBLE AS value_sum,
            (epoch_us(c.cutoff) - epoch_us(max(e.ts))) / 1e6 AS recency_s,
            count(DISTINCT e.ts::DATE)::BIGINT AS active_days
          FROM events e JOIN c ON e.ts < c.cutoff GROUP BY 1, 2),
    l AS (SELECT e.user_id, c.cutoff,
            max(CASE WHEN e.event_type = 'purchase' AND e.ts >= c.cutoff
                     AND e.ts < c.cutoff + INTERVAL 1 DAY THEN 1 ELSE 0 END)::INTEGER AS label
          FROM events e CROSS JOIN c GROUP BY 1, 2)
    SELECT f.*, l.label FROM f JOIN l USING (user_id, cutoff)"""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF001}/events.parquet')")
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    want = sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in res.fetchall())
    have = sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in (r[c] for c in cols))
                  for r in got)
    assert len(have) == len(want) and have == want


def test_labels_many_overlapping_cutoffs_match_sql(spark):
    import duckdb
    cut = [f"2024-01-{d:02d} {hh:02d}:00:00" for d in range(2, 29) for hh in (0, 12)]
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    got = sorted(tuple(r) for r in X.label_examples(ev, cut, "2d").collect())
    values = ", ".join(f"(TIMESTAMP '{c}')" for c in cut)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF001}/events.parquet')")
    want = sorted(con.execute(f"""
      WITH c(cutoff) AS (VALUES {values})
      SELECT e.user_id, c.cutoff,
        max(CASE WHEN e.event_type = 'purchase' AND e.ts >= c.cutoff
                 AND e.ts < c.cutoff + INTERVAL 2 DAY THEN 1 ELSE 0 END)::INTEGER AS label
      FROM events e CROSS JOIN c GROUP BY 1, 2 HAVING min(e.ts) < c.cutoff""").fetchall())
    assert got == want


def test_target_encode_uses_closed_label_windows_only(spark):
    """With windows that overlap the next cutoffs, labels of open windows
    change nothing."""
    import datetime as dt
    day = lambda n: dt.datetime(2024, 1, n)

    def encoded(open_label):
        rows = [(u, day(n), 1 if n == 1 and u < 2 else open_label if n > 1 else 0, "a" if u < 3 else None)
                for u in range(5) for n in (1, 2, 3, 8)]
        df = spark.createDataFrame(rows, "user_id long, cutoff timestamp_ntz, label int, seg string")
        te = X.target_encode(df, "seg", prior_weight=2.0, horizon="7d").collect()
        assert len(te) == len(rows)
        return {(r.user_id, r.cutoff.day): r.te for r in te}

    none, all_ = encoded(0), encoded(1)
    assert none == all_
    assert all(none[u, n] is None for u in range(5) for n in (1, 2, 3))
    # only cutoff 1 is closed on day 8; a missing segment is one of its own
    assert none[0, 8] == pytest.approx((2 + 2 * 2 / 5) / (3 + 2)) and none[4, 8] == pytest.approx((0 + 2 * 2 / 5) / (2 + 2))


def test_time_split_leaves_a_gap_for_open_labels(spark):
    import datetime as dt
    rows = [(n, dt.datetime(2024, 1, n)) for n in range(1, 12)]
    df = spark.createDataFrame(rows, "user_id long, cutoff timestamp_ntz")
    got = {r.user_id: r.split for r in X.split_examples(df, by="time", valid_cutoff="2024-01-05 00:00:00",
                                                        test_cutoff="2024-01-09 00:00:00", horizon="2d").collect()}
    assert got == {1: "train", 2: "train", 3: "train", 4: "gap", 5: "valid", 6: "valid", 7: "valid", 8: "gap",
                   9: "test", 10: "test", 11: "test"}
