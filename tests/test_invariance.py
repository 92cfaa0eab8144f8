"""H2: results must not depend on how the input is partitioned."""
from pyspark.sql import functions as F

from eventmine.operators import behaviour as B
from eventmine.operators import cleaning as C
from eventmine.operators import examples as X
from eventmine.operators import items as I

from support import SF001

CUT = ["2024-01-11 00:00:00", "2024-01-16 00:00:00", "2024-01-21 00:00:00"]


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_outputs_do_not_depend_on_partitioning(spark):
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    li = spark.read.parquet(f"{SF001}/lineitem.parquet")
    variants = [ev, ev.repartition(7), ev.repartition(3, "event_type").sortWithinPartitions(F.rand(1))]
    ops = [
        lambda e: B.sessionize(e, "8h", bucket="6h").select("event_id", "session_no"),
        lambda e: B.funnel(e, ["view", "click", "purchase"], "6h", bucket="3h"),
        lambda e: B.trailing_features(e, {"1d": "1d"}, bucket="12h"),
        lambda e: B.gap_stats(e, bucket="6h"),
        lambda e: X.examples_with_features(e, CUT),
        lambda e: X.negative_sample(X.label_examples(e, CUT), 1.0, seed=3, prefix_len=1),
    ]
    for op in ops:
        base = _rows(op(variants[0]))
        for v in variants[1:]:
            assert _rows(op(v)) == base
    d1 = _rows(C.dedup_latest(li, ["l_orderkey", "l_linenumber"], ["l_shipdate"]))
    d2 = _rows(C.dedup_latest(li.repartition(5), ["l_orderkey", "l_linenumber"], ["l_shipdate"]))
    assert d1 == d2
    t1 = _rows(I.top_k(li, "l_returnflag", "l_extendedprice", 3, "break", ["l_orderkey", "l_linenumber", "l_partkey"]))
    t2 = _rows(I.top_k(li.repartition(9), "l_returnflag", "l_extendedprice", 3, "break",
                       ["l_orderkey", "l_linenumber", "l_partkey"]))
    assert t1 == t2
