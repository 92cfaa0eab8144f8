"""Cleaning (P03, P04)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedup_latest(df: DataFrame, keys: list[str], order_cols: list[str]) -> DataFrame:
    """P03. One row per key: the last by ``order_cols``, ties broken by the
    remaining columns in table order (all descending), so the choice is total
    and does not depend on partitioning.

    ``row_number() == 1`` lets Catalyst put a partial window-group limit
    before the shuffle: each map task keeps one row per key, so a key holding
    a third of the rows is reduced before it moves."""
    rest = [c for c in df.columns if c not in keys and c not in order_cols]
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order_cols + rest])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def rule_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """P04. ``(rule, n_checked, n_failed)`` for row rules (name → condition; a
    NULL condition fails), all in one pass. Rules that only some rows are held
    to are ``when(<applies>, <condition>).otherwise(True)``, or a
    :class:`Scoped` pair, which also counts just those rows."""
    scoped = {n: r if isinstance(r, Scoped) else Scoped(F.lit(True), r) for n, r in rules.items()}
    aggs = []
    for k, r in enumerate(scoped.values()):
        aggs += [F.count_if(r.applies).alias(f"c{k}"),
                 F.count_if(r.applies & ~F.coalesce(r.condition, F.lit(False))).alias(f"f{k}")]
    one = df.agg(*aggs)
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("rule"), F.col(f"c{k}").cast("bigint").alias("n_checked"),
                 F.col(f"f{k}").cast("bigint").alias("n_failed")) for k, n in enumerate(scoped)])))


class Scoped(NamedTuple):
    """A rule for the rows where ``applies`` holds."""
    applies: Column
    condition: Column


def duplicate_keys(df: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """Rows beyond the first per key; counts are 0 on an empty table."""
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    return per.agg(F.lit(rule).alias("rule"), F.coalesce(F.sum("_c"), F.lit(0)).cast("bigint").alias("n_checked"),
                   F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).cast("bigint").alias("n_failed"))


def order_table_rules(orders: DataFrame, lineitem: DataFrame, customer: DataFrame,
                      part: DataFrame) -> DataFrame:
    """The rules of the order tables: row rules, duplicate keys, orphan foreign
    keys and time inversions. Row rules, orphans and inversions of a table
    share one pass over it: its rows are joined to one row per parent key
    (with the parent's first date), and every rule is a count in one
    aggregate. An inversion is a line shipped before its order's date (the
    earliest, should an order be there twice)."""
    def parent(df, key, *aggs):
        p = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"_{key}"))
        return p.agg(F.lit(True).alias(f"_has_{key}"), *aggs)

    o = orders.join(parent(customer, "c_custkey"), F.col("o_custkey") == F.col("_c_custkey"), "left")
    o_rules = rule_violations(o, {
        "orders.totalprice_positive": F.col("o_totalprice") > 0,
        "orders.status_known": F.col("o_orderstatus").isin("F", "O", "P"),
        "orders.orderdate_present": F.col("o_orderdate").isNotNull(),
        "orders.custkey_orphan": F.col("_has_c_custkey")})
    li = lineitem.join(parent(orders, "o_orderkey", F.min("o_orderdate").alias("_date")),
                       F.col("l_orderkey") == F.col("_o_orderkey"), "left")
    li = li.join(parent(part, "p_partkey"), F.col("l_partkey") == F.col("_p_partkey"), "left")
    l_rules = rule_violations(li, {
        "lineitem.quantity_positive": F.col("l_quantity") > 0,
        "lineitem.discount_in_0_1": F.col("l_discount").between(0, 1),
        "lineitem.tax_in_0_1": F.col("l_tax").between(0, 1),
        "lineitem.extendedprice_positive": F.col("l_extendedprice") > 0,
        "lineitem.orderkey_orphan": F.col("_has_o_orderkey"),
        "lineitem.partkey_orphan": F.col("_has_p_partkey"),
        "lineitem.ships_before_order": Scoped(F.coalesce(F.col("_has_o_orderkey"), F.lit(False)),
                                              ~F.coalesce(F.col("l_shipdate") < F.col("_date"), F.lit(False)))})
    return (o_rules.unionByName(l_rules)
            .unionByName(duplicate_keys(orders, ["o_orderkey"], "orders.duplicate_key"))
            .unionByName(duplicate_keys(lineitem, ["l_orderkey", "l_linenumber"], "lineitem.duplicate_key")))
