"""One user holding a third of all events: results must still equal the SQL."""
import math
import os
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402

from support import SF01  # noqa: E402

HOT = 999_999
QUERIES = ["sessionize", "session_summary", "funnel", "trailing_features", "gap_stats",
           "transitions", "as_of_last_view", "features_at_cutoff", "label_examples",
           "window_counts_sliding", "retention_weekly", "stream_sessions", "stream_user_state"]


def _norm(rows):
    def n(v):
        if isinstance(v, float):
            v = None if math.isnan(v) else round(v, 6)
        return (1, 0) if v is None else (0, v)
    return sorted(tuple(n(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def skewed_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("skew")
    ev = spark.read.parquet(f"{SF01}/events.parquet")
    hot = ev.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(HOT))
                        .otherwise(F.col("user_id")))
    hot.write.parquet(str(d / "events.parquet"))
    return str(d)


@pytest.mark.parametrize("name", QUERIES)
def test_hot_user_matches_sql(spark, skewed_dir, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{skewed_dir}/events.parquet/*.parquet')")
    res = con.execute(E.oracle_sql()[name])
    cols = [c[0] for c in res.description]
    want = res.fetchall()
    df = E.queries()[name](spark, skewed_dir)
    got = df.select(*cols).collect()
    assert len(got) == len(want)
    assert _norm(got) == _norm(want)


ORDER_QUERIES = ["pair_rules_brand", "dedup_lineitem_latest", "rule_violations",
                 "top_customers_by_nation", "rfm", "ranking_metrics_brands", "sales_rollup",
                 "frequent_pairs_fpgrowth"]


@pytest.fixture(scope="module")
def skewed_orders_dir(spark, tmp_path_factory):
    """A third of the line items moved to order 0, a third of the orders to
    customer 0 (all other tables unchanged)."""
    d = tmp_path_factory.mktemp("skew_orders")
    li = spark.read.parquet(f"{SF01}/lineitem.parquet")
    li.withColumn("l_orderkey", F.when(F.col("l_partkey") % 3 == 0, F.lit(0))
                  .otherwise(F.col("l_orderkey"))).write.parquet(str(d / "lineitem.parquet"))
    o = spark.read.parquet(f"{SF01}/orders.parquet")
    o.withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(0))
                 .otherwise(F.col("o_custkey"))).write.parquet(str(d / "orders.parquet"))
    for t in ("customer", "part", "nation", "region", "events"):
        spark.read.parquet(f"{SF01}/{t}.parquet").write.parquet(str(d / f"{t}.parquet"))
    return str(d)


@pytest.mark.parametrize("name", ORDER_QUERIES)
def test_hot_order_and_customer_match_sql(spark, skewed_orders_dir, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "customer", "part", "nation", "region", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM "
                    f"read_parquet('{skewed_orders_dir}/{t}.parquet/*.parquet')")
    res = con.execute(E.oracle_sql()[name])
    cols = [c[0] for c in res.description]
    want = res.fetchall()
    got = E.queries()[name](spark, skewed_orders_dir).select(*cols).collect()
    assert len(got) == len(want)
    assert _norm(got) == _norm(want)


def test_hot_basket_pairs_without_expanding_it(spark, skewed_orders_dir):
    """Part-level pairs with one order holding a third of the line items:
    the set-aside baskets and the block pairs give what the plain self-join over
    every basket gives."""
    from eventmine.operators import items as I
    li = spark.read.parquet(f"{skewed_orders_dir}/lineitem.parquet")
    part = spark.read.parquet(f"{skewed_orders_dir}/part.parquet")
    bi = I.basket_items(li, part, "p_partkey")
    rows = bi.distinct().toPandas()
    con = duckdb.connect()
    con.register("bi", rows)
    for min_count in (2, 3):
        want = con.execute(f"SELECT x.item, y.item, count(*) FROM bi x JOIN bi y ON x.basket = y.basket AND x.item < y.item "
                           f"GROUP BY 1, 2 HAVING count(*) >= {min_count}").fetchall()
        for block in (1000, 3):
            got = I.pair_rules(bi, min_count, block=block).collect()
            assert len(want) > 0 and sorted(map(tuple, want)) == sorted((r.item_a, r.item_b, r.n_ab) for r in got)


def test_no_task_holds_a_hot_users_day(spark):
    """A third of the rows are one user's, all in one day and some at one
    instant: the parts that the per-user scans run over stay even."""
    from eventmine.operators.ordered import BUCKET, _in_order, with_range_bucket
    ev = spark.range(24_000).selectExpr(
        "id AS event_id", "CASE WHEN id % 3 = 0 THEN 1L ELSE 10 + id % 500 END AS user_id",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, CASE WHEN id % 3 = 0 THEN (id % 900) * 90 ELSE id * 100 END) AS ts")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = [r["count"] for r in with_range_bucket(ev, "user_id", "ts", "event_id").groupBy("user_id", BUCKET).count().collect()]
    assert sum(sizes) == 24_000 and max(sizes) < 2 * 24_000 / n
    # near-constant gaps: few distinct values, all alike
    gaps = spark.range(24_000).selectExpr("1L AS k", "90000000 + id % 6000 AS v").distinct()
    sizes = [r["count"] for r in _in_order(gaps, [F.col("k"), F.col("v")], 8).groupBy("_gb").count().collect()]
    assert max(sizes) < 2 * 6000 / 8


@pytest.mark.parametrize("what", ["funnel", "trailing"])
def test_a_hot_users_day_is_many_parts(spark, what, monkeypatch):
    """A third of the rows are one user's and one day's: no part of the ordered
    passes holds more than twice its share, and wide time buckets agree."""
    from eventmine.operators import behaviour as B
    ev = spark.range(18_000).selectExpr(
        "id AS event_id", "CASE WHEN id % 3 = 0 THEN 1L ELSE 10 + id % 500 END AS user_id",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, CASE WHEN id % 3 = 0 THEN id * 4 ELSE id * 100 END) AS ts",
        "element_at(array('view', 'click', 'purchase'), cast((id div 3) * 7919 % 3 + 1 AS int)) AS event_type", "cast(id % 7 AS double) AS value", "'' AS props")
    parts, orig = [], B.in_ranges
    monkeypatch.setattr(B, "in_ranges", lambda *a: parts.append(orig(*a)) or parts[-1])

    def run(bucket):
        if what == "funnel":
            return B.funnel(ev, ["view", "click", "purchase"], "30m", bucket=bucket)
        return B.trailing_features(ev, {"1h": "1h", "2d": "2d"}, bucket=bucket)

    got = sorted(map(tuple, run(None).collect()))
    sizes = [r["count"] for r in parts[0].groupBy("user_id", B.BUCKET).count().collect()]
    assert max(sizes) < 2 * sum(sizes) / int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert got == sorted(map(tuple, run("40d").collect()))
