"""Order reporting: roll-ups and RFM."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sizing import bounded_broadcast
from ..functions.timefn import micros, ntz_literal
from .evaluation import ntile_of
from .ordered import positions_of_each

DIM_MAX_ROWS = 10_000


def sales_rollup(orders: DataFrame, customer: DataFrame, nation: DataFrame, region: DataFrame,
                 mode: str = "rollup") -> DataFrame:
    """P28. Order count and revenue by region / market segment / order status
    with subtotals (``rollup``, ``cube`` or explicit grouping sets);
    ``gid`` is ``grouping_id()`` (bit set = column rolled up).

    Orders are summed to the finest cells first, money as decimals; the
    subtotals are rolled up from these few rows, so no order is copied for
    each grouping set. Region and nation are broadcast after a row-count check;
    customer is joined by the planner (sort-merge at scale, adaptive broadcast
    when small)."""
    geo = (bounded_broadcast(nation, DIM_MAX_ROWS)
           .join(bounded_broadcast(region, DIM_MAX_ROWS), F.col("n_regionkey") == F.col("r_regionkey"))
           .select("n_nationkey", "r_name"))
    cust = customer.select("c_custkey", "c_nationkey", "c_mktsegment").join(
        bounded_broadcast(geo, DIM_MAX_ROWS), F.col("c_nationkey") == F.col("n_nationkey"))
    j = orders.select("o_custkey", "o_orderstatus", "o_totalprice").join(
        cust, F.col("o_custkey") == F.col("c_custkey"))
    dims = ["r_name", "c_mktsegment", "o_orderstatus"]
    cells = j.groupBy(*dims).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("_revenue"))
    if mode == "rollup":
        g = cells.rollup(*dims)
    elif mode == "cube":
        g = cells.cube(*dims)
    elif mode == "sets":
        g = cells.groupingSets([["r_name"], ["c_mktsegment"], ["o_orderstatus"], []], *dims)
    else:
        raise ValueError(mode)
    return g.agg(F.grouping_id().cast("bigint").alias("gid"),
                 F.sum("_n").alias("n_orders"),
                 F.sum("_revenue").cast("double").alias("revenue"))


def rfm(orders: DataFrame, as_of: str, n_buckets: int | None = None) -> DataFrame:
    """P29. Per customer: days since the last order at ``as_of``, order count,
    spend, and a 1–5 score on each — ``ntile(5)`` by (metric, customer) with
    recency reversed, so 5 is best.

    ``ntile`` over all customers would be one task; the three positions come
    from ``positions_of_each`` (one write of narrow rows, range buckets and
    offsets for all metrics) and the ntile bucket is computed from position and
    count."""
    per = orders.groupBy(F.col("o_custkey").alias("custkey")).agg(
        F.max("o_orderdate").alias("_last"),
        F.count(F.lit(1)).alias("frequency"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("monetary"))
    per = per.withColumn(
        "recency_days",
        F.floor((micros(ntz_literal(as_of)) - micros("_last")) / F.lit(86_400_000_000)).cast("bigint"))
    r = positions_of_each(per, "custkey", {"recency_days": True, "frequency": False, "monetary": False}, n_buckets)
    n = F.col("_total")
    return r.select("custkey", "recency_days", "frequency", "monetary",
                    ntile_of(F.col("_pos_recency_days"), n, 5).alias("r_score"),
                    ntile_of(F.col("_pos_frequency"), n, 5).alias("f_score"),
                    ntile_of(F.col("_pos_monetary"), n, 5).alias("m_score"))
