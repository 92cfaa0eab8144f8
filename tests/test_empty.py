"""Empty inputs: every operator returns an empty (or all-zero) result, no error."""
from eventmine.operators import behaviour as B
from eventmine.operators import cleaning as C
from eventmine.operators import evaluation as V
from eventmine.operators import examples as X
from eventmine.operators import items as I
from eventmine.operators import sales as S
from eventmine.sources.tables import SCHEMAS

CUT = ["2024-01-11 00:00:00", "2024-01-16 00:00:00"]


def test_event_operators_on_empty_input(spark):
    ev = spark.createDataFrame([], SCHEMAS["events"])
    for df in [B.sessionize(ev), B.session_summary(ev), B.funnel(ev, ["view", "click"], "1h"),
               B.window_counts(ev, "1d"), B.trailing_features(ev, {"1d": "1d"}, bucket="1d"),
               B.trailing_features(ev, {"1d": "1d"}), B.gap_stats(ev),
               B.transitions(ev), B.retention(ev),
               B.audience_diff(ev, ("2024-01-01 00:00:00", "2024-01-08 00:00:00"),
                               ("2024-01-08 00:00:00", "2024-01-15 00:00:00")),
               X.features_at_cutoff(ev, CUT), X.label_examples(ev, CUT),
               X.examples_with_features(ev, CUT),
               X.as_of_join(ev, ev, "user_id", "ts", "ts", "event_id", ["value"])]:
        assert df.count() == 0


def test_other_operators_on_empty_input(spark):
    ex = spark.createDataFrame([], "user_id long, cutoff timestamp_ntz, label int, seg string")
    assert X.negative_sample(ex, 1.0).count() == 0
    assert X.target_encode(ex, "seg").count() == 0
    scored = spark.createDataFrame([], "user_id long, score double, label int")
    m = V.binary_metrics(scored).first()
    assert m.n is None or m.n == 0
    assert V.threshold_metrics(scored).count() == 0
    assert V.lift_by_decile(scored, "user_id").count() == 0
    checks = {r.check: r.n_bad for r in V.prediction_checks(scored, scored.select("user_id")).collect()}
    assert set(checks.values()) == {0}
    li = spark.createDataFrame([], SCHEMAS["lineitem"])
    assert C.dedup_latest(li, ["l_orderkey", "l_linenumber"], ["l_shipdate"]).count() == 0
    bi = spark.createDataFrame([], "basket long, item string")
    assert I.pair_rules(bi, 1).count() == 0
    assert I.top_k(bi, "basket", "item", 2).count() == 0
    orders = spark.createDataFrame([], SCHEMAS["orders"])
    assert S.rfm(orders, "2001-08-02 00:00:00").count() == 0


def test_single_row_metrics(spark):
    df = spark.createDataFrame([(1, 0.7, 1)], "user_id long, score double, label int")
    m = V.binary_metrics(df).first()
    assert m.n == 1 and m.n_pos == 1 and m.auc is None and m.logloss > 0


def test_rules_on_empty_tables_count_zero(spark):
    t = {n: spark.createDataFrame([], SCHEMAS[n]) for n in ("orders", "lineitem", "customer", "part")}
    res = C.order_table_rules(t["orders"], t["lineitem"], t["customer"], t["part"]).collect()
    assert len(res) == 13 and all((r.n_checked, r.n_failed) == (0, 0) for r in res)


def test_metrics_of_one_class(spark):
    for label in (0, 1):
        df = spark.createDataFrame([(k, k / 10, label) for k in range(6)], "user_id long, score double, label int")
        assert V.binary_metrics(df).first().auc is None
        rows = V.threshold_metrics(df).collect()
        assert len(rows) == 6 and all((r.recall is None) == (label == 0) for r in rows)
        assert all(r.f1 == 0 for r in rows if r.tp == 0)
        lift = V.lift_by_decile(df, "user_id").collect()
        assert sum(r.n for r in lift) == 6 and all((r.lift is None) == (label == 0) for r in lift)


def test_flagship_labels_and_features_agree_on_events_without_a_user(spark):
    from support import make_events, ts
    rows = [(1, ts(days=1), None, "view"), (2, ts(days=10, hours=1), None, "purchase"), (3, ts(days=1), 1, "view"),
            (4, ts(days=10, hours=1), 1, "purchase")]
    ev = make_events(spark, rows)
    labels = sorted((r.user_id, r.label) for r in X.label_examples(ev, CUT[:1]).collect())
    flagship = sorted((r.user_id, r.label) for r in X.examples_with_features(ev, CUT[:1]).collect())
    assert labels == flagship == [(1, 1)] and [r.user_id for r in X.features_at_cutoff(ev, CUT[:1]).collect()] == [1]
