from pyspark.sql import functions as F

from eventmine.operators import cleaning as C

from support import SF001


def test_dedup_latest_total_order_and_invariance(spark):
    df = spark.createDataFrame([(1, 1, "a", 5), (1, 1, "b", 7), (1, 1, "c", 7), (2, 1, "z", 1)],
                               "k long, n int, s string, t int")
    got = {(r.k, r.n): (r.s, r.t) for r in C.dedup_latest(df, ["k", "n"], ["t"]).collect()}
    assert got == {(1, 1): ("c", 7), (2, 1): ("z", 1)}
    again = {(r.k, r.n): (r.s, r.t) for r in C.dedup_latest(df.repartition(3), ["k", "n"], ["t"]).collect()}
    assert again == got


def test_rule_violations_catch_planted_problems(spark):
    t = {n: spark.read.parquet(f"{SF001}/{n}.parquet") for n in ("orders", "lineitem", "customer", "part")}
    orders = t["orders"].unionByName(t["orders"].limit(2))  # duplicate keys
    orders = orders.withColumn("o_totalprice", F.when(F.col("o_orderkey") == 0, -1.0)
                               .otherwise(F.col("o_totalprice")))
    cust = t["customer"].where("c_custkey <> 899")
    res = {r.rule: (r.n_checked, r.n_failed) for r in
           C.order_table_rules(orders, t["lineitem"], cust, t["part"]).collect()}
    assert res["orders.duplicate_key"] == (1502, 2)
    assert res["orders.totalprice_positive"][1] >= 1
    n_orphan = orders.where("o_custkey = 899").count()
    assert res["orders.custkey_orphan"] == (1502, n_orphan)
    assert res["lineitem.partkey_orphan"][1] == 0


def test_rules_are_a_parameter(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, -1), (None, 2)], "k int, v int")
    rules = {"v_positive": F.col("v") > 0, "k_present": F.col("k").isNotNull(),
             "v_small_if_there": C.Scoped(F.col("v").isNotNull(), F.col("v") < 3)}
    got = {r.rule: (r.n_checked, r.n_failed) for r in C.rule_violations(df, rules).collect()}
    assert got == {"v_positive": (4, 2), "k_present": (4, 1), "v_small_if_there": (3, 1)}
