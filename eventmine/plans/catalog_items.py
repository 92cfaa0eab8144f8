"""Registered queries: items, models, evaluation and reporting."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.timefn import ntz_literal
from ..operators import evaluation as V
from ..operators import examples as X
from ..operators import items as I
from ..operators import models as M
from ..operators import sales as S
from ..session import checkpoint_dir, scratch_path
from ..sources.tables import read_table
from . import params as P
from .catalog_examples import EXAMPLES_SQL
from .registry import query


def t(spark, d, name):
    return read_table(spark, d, name)


@query("top_customers_by_nation", f"""
WITH spend AS (SELECT o_custkey, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS spend
               FROM orders GROUP BY o_custkey),
j AS (SELECT c.c_nationkey, s.o_custkey AS c_custkey, s.spend FROM spend s
      JOIN customer c ON c.c_custkey = s.o_custkey)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey
                 ORDER BY spend DESC, c_custkey) AS rank FROM j) WHERE rank <= {P.TOP_K}
""")
def q_top_customers(spark, d):
    spend = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("spend"))
    j = spend.join(t(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    return I.top_k(j, "c_nationkey", "spend", P.TOP_K, "break", ["c_custkey"]).withColumn(
        "rank", F.col("rank").cast("bigint"))


@query("top_order_counts_keep_ties", f"""
WITH c AS (SELECT o_orderpriority, o_custkey, count(*)::BIGINT AS n_orders FROM orders
           GROUP BY o_orderpriority, o_custkey)
SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY o_orderpriority
                 ORDER BY n_orders DESC) AS rank FROM c) WHERE rank <= {P.TOP_K}
""")
def q_top_keep(spark, d):
    c = t(spark, d, "orders").groupBy("o_orderpriority", "o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"))
    return I.top_k(c, "o_orderpriority", "n_orders", P.TOP_K, "keep").withColumn(
        "rank", F.col("rank").cast("bigint"))


BASKET_SQL = """
SELECT DISTINCT l.l_orderkey AS basket, p.p_brand AS item
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
"""


@query("pair_rules_brand", f"""
WITH bi AS ({BASKET_SQL}),
nb AS (SELECT count(DISTINCT basket) AS n FROM bi),
fi AS (SELECT item, count(*) AS n FROM bi GROUP BY item HAVING count(*) >= {P.PAIR_MIN_COUNT}),
pr AS (SELECT x.item AS item_a, y.item AS item_b, count(*) AS n_ab
       FROM bi x JOIN bi y ON x.basket = y.basket AND x.item < y.item
       WHERE x.item IN (SELECT item FROM fi) AND y.item IN (SELECT item FROM fi)
       GROUP BY 1, 2 HAVING count(*) >= {P.PAIR_MIN_COUNT})
SELECT pr.item_a, pr.item_b, pr.n_ab::BIGINT AS n_ab, a.n::BIGINT AS n_a, b.n::BIGINT AS n_b,
  round(pr.n_ab / nb.n, 9) AS support, round(pr.n_ab / a.n, 9) AS conf_ab,
  round(pr.n_ab / b.n, 9) AS conf_ba, round(pr.n_ab * nb.n / (a.n * b.n), 9) AS lift
FROM pr JOIN fi a ON pr.item_a = a.item JOIN fi b ON pr.item_b = b.item, nb
""")
def q_pairs(spark, d):
    bi = I.basket_items(t(spark, d, "lineitem"), t(spark, d, "part"))
    return I.pair_rules(bi, P.PAIR_MIN_COUNT)


def _itemsets_sql(most: int) -> str:
    """Itemsets of one to ``most`` items; a set one larger is in none, or the
    sizes here would not be all (the tests look)."""
    parts = []
    for k in range(1, most + 1):
        names = [f"x{i}" for i in range(k)]
        joins = "bi x0" + "".join(f" JOIN bi {n} ON {n}.basket = x0.basket AND {m}.item < {n}.item" for m, n in zip(names, names[1:]))
        parts.append(f"SELECT list_value({', '.join(n + '.item' for n in names)}) AS items, {k}::INTEGER AS size, count(*)::BIGINT AS freq "
                     f"FROM {joins} GROUP BY {', '.join(n + '.item' for n in names)} HAVING count(*) >= (SELECT ceil({P.FP_MIN_SUPPORT} * n) FROM nb)")
    return f"WITH bi AS ({BASKET_SQL}), nb AS (SELECT count(DISTINCT basket) AS n FROM bi) " + " UNION ALL ".join(parts)


@query("frequent_itemsets_brand", _itemsets_sql(4))
def q_fpgrowth(spark, d):
    bi = I.basket_items(t(spark, d, "lineitem"), t(spark, d, "part"))
    return I.frequent_itemsets(bi, P.FP_MIN_SUPPORT)


@query("frequent_pairs_fpgrowth", f"""
WITH bi AS ({BASKET_SQL}),
nb AS (SELECT count(DISTINCT basket) AS n FROM bi)
SELECT x.item AS item_a, y.item AS item_b, count(*)::BIGINT AS freq
FROM bi x JOIN bi y ON x.basket = y.basket AND x.item < y.item
GROUP BY 1, 2 HAVING count(*) >= (SELECT ceil({P.FP_MIN_SUPPORT} * n) FROM nb)
""")
def q_fp_pairs(spark, d):
    """Size-2 rows of FP-growth; must equal the pair counts of the self-join."""
    bi = I.basket_items(t(spark, d, "lineitem"), t(spark, d, "part"))
    fi = I.frequent_itemsets(bi, P.FP_MIN_SUPPORT).where(F.col("size") == 2)
    return fi.select(F.col("items")[0].alias("item_a"), F.col("items")[1].alias("item_b"), "freq")


def customer_brand_counts(spark, d, split: str | None = None):
    """Lines per customer and brand; with ``split``, before and since then."""
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey", *(["o_orderdate"] if split else []))
    li = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    p = t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("item"))
    per = o.join(li, "o_orderkey").join(p, "l_partkey").groupBy(F.col("o_custkey").alias("user_id"), "item")
    if not split:
        return per.agg(F.count(F.lit(1)).alias("n"))
    at = F.col("o_orderdate")
    return per.agg(F.count_if(at < ntz_literal(split)).alias("n_before"), F.count_if(at >= ntz_literal(split)).alias("n_since"))


@query("recommend_brands")
def q_recommend(spark, d):
    return I.recommend(customer_brand_counts(spark, d), 5)


SCORED_SQL = f"""
SELECT user_id, cutoff, label, (n_purchase + 1) / (n_events + 2) AS score
FROM ({EXAMPLES_SQL})
"""

RECOMMENDED = 5


@query("recommend_brands_checks", f"""
WITH u AS (SELECT o.o_custkey AS user_id FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey
           JOIN part p ON p.p_partkey = l.l_partkey GROUP BY 1),
b AS (SELECT least({RECOMMENDED}, count(DISTINCT p.p_brand)) AS k FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey JOIN orders o ON l.l_orderkey = o.o_orderkey)
SELECT u.user_id, b.k::BIGINT AS n_items, (b.k * (b.k + 1) // 2)::BIGINT AS rank_sum, true AS scores_fall, 0::BIGINT AS n_wrong_scores,
       0::BIGINT AS n_better FROM u, b
""")
def q_recommend_checks(spark, d):
    """Every user has the same number of different items, at ranks 1 to k,
    with scores that don't rise with the rank, that are the products of the
    factors (``n_wrong_scores``) and that nothing the user bought beats (``n_better``)."""
    counts = customer_brand_counts(spark, d)
    users, items = I.als_factors(counts)
    r = I.top_by_product(users, items, RECOMMENDED)
    w = Window.partitionBy("user_id").orderBy("rank")
    r = r.withColumn("_rise", F.coalesce(F.col("score") > F.lag("score").over(w), F.lit(False)))
    # what a user bought or is recommended, with its product
    seen = counts.select("user_id", "item").unionAll(r.select("user_id", "item")).distinct()
    product = F.aggregate(F.zip_with("_u", "_i", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, x: a + x)
    seen = (seen.join(users.select("user_id", F.col("features").alias("_u")), "user_id").join(items.select("item", F.col("features").alias("_i")), "item")
            .select("user_id", "item", product.alias("_product")))
    last = r.groupBy("user_id").agg(F.min("score").alias("_last"))
    both = seen.join(r, ["user_id", "item"], "left").join(last, "user_id")
    return both.groupBy("user_id").agg(
        F.count("rank").alias("n_items"), F.sum("rank").cast("bigint").alias("rank_sum"), (~F.max("_rise")).alias("scores_fall"),
        F.count_if(F.abs(F.col("score") - F.col("_product")) > 1e-6).alias("n_wrong_scores"),
        F.count_if(F.col("score").isNull() & (F.col("_product") > F.col("_last") + 1e-6)).alias("n_better"))


_FEATURES = ["n_events", "n_click", "n_error", "n_purchase", "n_signup", "n_view", "value_sum",
             "recency_s", "active_days"]


@query("train_score_checks", f"""
SELECT user_id, cutoff, label, true AS score_in_0_1, true AS score_is_the_models, true AS model_is_optimal
FROM ({EXAMPLES_SQL}) WHERE cutoff >= TIMESTAMP '{P.CUTOFFS[-1]}'
""")
def q_train_score_checks(spark, d):
    """Every test example is scored once, with a probability, which the
    weights give by plain arithmetic too; the weights are the optimum of the
    penalised likelihood (its gradient over the training rows is 0)."""
    model, train, rest = M.fit_model(training_examples(spark, d), _FEATURES)
    optimal = M.logistic_residual(model, train) < 1e-4
    s = M.logistic_scores_by_hand(model, rest, _FEATURES, ["user_id", "cutoff", "label"])
    return s.select("user_id", "cutoff", "label", F.col("score").between(0, 1).alias("score_in_0_1"),
                    (F.abs(F.col("score") - F.col("by_hand")) < 1e-9).alias("score_is_the_models"),
                    F.lit(optimal).alias("model_is_optimal"))


@query("write_predictions", f"""
SELECT user_id, score FROM ({SCORED_SQL}) WHERE cutoff = TIMESTAMP '{P.CUTOFFS[-1]}'
""")
def q_write_predictions(spark, d):
    """Checked, written and read back."""
    pred = scored_examples(spark, d).where(F.col("cutoff") == ntz_literal(P.CUTOFFS[-1])).select("user_id", "score")
    path = scratch_path(spark, "predictions")
    V.write_predictions(pred, path, pred.select("user_id"))
    return spark.read.parquet(path)


def training_examples(spark, d):
    ex = X.examples_with_features(t(spark, d, "events"), P.CUTOFFS, P.HORIZON)
    return X.split_examples(ex, by="time", test_cutoff=P.CUTOFFS[-1], horizon=P.HORIZON)


@query("train_score_logistic")
def q_train_score(spark, d):
    return M.train_score(training_examples(spark, d), _FEATURES, keep=["user_id", "cutoff", "label"])


@query("train_score_gbt")
def q_train_score_gbt(spark, d):
    return M.train_score(training_examples(spark, d), _FEATURES, kind="gbt", keep=["user_id", "cutoff", "label"])


def scored_examples(spark, d):
    ex = X.examples_with_features(t(spark, d, "events"), P.CUTOFFS, P.HORIZON)
    return ex.select("user_id", "cutoff", "label",
                     ((F.col("n_purchase") + 1) / (F.col("n_events") + 2)).alias("score"))


@query("binary_metrics", f"""
WITH s AS ({SCORED_SQL}),
per AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM s GROUP BY score),
c AS (SELECT *, sum(neg) OVER (ORDER BY score ROWS UNBOUNDED PRECEDING) AS neg_le FROM per)
SELECT (sum(pos) + sum(neg))::BIGINT AS n, sum(pos)::BIGINT AS n_pos,
  round(sum(pos * (neg_le - neg * 0.5)) / (sum(pos) * sum(neg)), 9) AS auc,
  round(-(sum(pos * ln(greatest(least(score, 1 - 1e-15), 1e-15))
        + neg * ln(1 - greatest(least(score, 1 - 1e-15), 1e-15)))) / (sum(pos) + sum(neg)), 9) AS logloss
FROM c
""")
def q_binary_metrics(spark, d):
    return V.binary_metrics(scored_examples(spark, d))


@query("threshold_metrics", f"""
WITH s AS ({SCORED_SQL}),
per AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM s GROUP BY score),
c AS (SELECT score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p FROM per
      WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT score AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp,
  round(tp / (tp + fp), 9) AS precision, round(tp / nullif(p, 0), 9) AS recall,
  CASE WHEN tp = 0 THEN 0.0 ELSE
    round(2 * (tp / (tp + fp)) * (tp / p) / ((tp / (tp + fp)) + (tp / p)), 9) END AS f1
FROM c
""")
def q_threshold_metrics(spark, d):
    return V.threshold_metrics(scored_examples(spark, d))


@query("lift_by_decile", f"""
WITH s AS (SELECT user_id * 100 + ci AS k, label, score FROM ({SCORED_SQL}) x
           JOIN (VALUES {', '.join(f"(TIMESTAMP '{c}', {i})" for i, c in enumerate(P.CUTOFFS))}) cc(cutoff, ci)
           USING (cutoff)),
d AS (SELECT *, ntile(10) OVER (ORDER BY score DESC, k) AS decile FROM s)
SELECT decile::INTEGER AS decile, count(*)::BIGINT AS n, sum(label)::BIGINT AS n_pos,
  round(avg(label), 9) AS rate, round(avg(label) / nullif((SELECT avg(label) FROM s), 0), 9) AS lift
FROM d GROUP BY decile
""")
def q_lift(spark, d):
    s = scored_examples(spark, d)
    idx = F.array_position(F.array(*[ntz_literal(c) for c in P.CUTOFFS]), F.col("cutoff")) - 1
    s = s.withColumn("k", F.col("user_id") * 100 + idx)
    return V.lift_by_decile(s, "k")


@query("ranking_metrics_brands", f"""
WITH hist AS (
  SELECT o.o_custkey AS user_id, p.p_brand AS item, count(*) AS n
  FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN part p ON p.p_partkey = l.l_partkey
  WHERE o.o_orderdate < TIMESTAMP '{P.RANK_SPLIT}' GROUP BY 1, 2),
ranked AS (SELECT * FROM (SELECT user_id, item, row_number() OVER (PARTITION BY user_id
             ORDER BY n DESC, item) AS rank FROM hist) WHERE rank <= 5),
truth AS (SELECT DISTINCT o.o_custkey AS user_id, p.p_brand AS item
  FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN part p ON p.p_partkey = l.l_partkey
  WHERE o.o_orderdate >= TIMESTAMP '{P.RANK_SPLIT}'),
nt AS (SELECT user_id, count(*) AS nt FROM truth GROUP BY user_id),
h AS (SELECT r.user_id, r.rank, CASE WHEN t.item IS NULL THEN 0 ELSE 1 END AS rel
      FROM ranked r LEFT JOIN truth t USING (user_id, item)),
h2 AS (SELECT *, sum(rel) OVER (PARTITION BY user_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS cum FROM h),
pu AS (SELECT user_id, sum(rel) AS hh, sum(CASE WHEN rel = 1 THEN cum / rank END) AS ap,
              sum(rel / log2(rank + 1)) AS dcg FROM h2 GROUP BY user_id),
u AS (SELECT nt.user_id, nt.nt, coalesce(pu.hh, 0) AS hh, coalesce(pu.ap, 0) AS ap,
             coalesce(pu.dcg, 0) AS dcg,
             (SELECT sum(1 / log2(i + 1)) FROM range(1, least(nt.nt, 5) + 1) r(i)) AS idcg
      FROM nt LEFT JOIN pu USING (user_id))
SELECT count(*)::BIGINT AS n_users, round(avg(hh / 5), 9) AS precision_at_k,
  round(avg(hh / nt), 9) AS recall_at_k, round(avg(ap / least(nt, 5)), 9) AS map_at_k,
  round(avg(dcg / idcg), 6) AS ndcg_at_k
FROM u
""")
def q_ranking(spark, d):
    n = customer_brand_counts(spark, d, P.RANK_SPLIT)
    checkpoint_dir(spark)
    n = n.checkpoint(eager=True)  # both periods, from one join of orders to lines
    hist = n.where("n_before > 0").select("user_id", "item", F.col("n_before").alias("n"))
    ranked = I.top_k(hist, "user_id", "n", 5, "break", ["item"])
    return V.ranking_metrics(ranked, n.where("n_since > 0").select("user_id", "item"), 5)


@query("prediction_checks", f"""
WITH pred AS (SELECT user_id, score FROM ({SCORED_SQL}) WHERE cutoff = TIMESTAMP '{P.CUTOFFS[-1]}'),
exp AS (SELECT DISTINCT c_custkey AS user_id FROM customer)
SELECT 'duplicate_key' AS "check", coalesce(sum(c - 1), 0)::BIGINT AS n_bad
  FROM (SELECT count(*) AS c FROM pred GROUP BY user_id)
UNION ALL SELECT 'missing_key', count(*)::BIGINT FROM exp
  WHERE user_id NOT IN (SELECT user_id FROM pred)
UNION ALL SELECT 'unexpected_key', count(*)::BIGINT FROM (SELECT DISTINCT user_id FROM pred) p
  WHERE user_id NOT IN (SELECT user_id FROM exp)
UNION ALL SELECT 'null_or_nan_score', count_if(score IS NULL OR isnan(score))::BIGINT FROM pred
""")
def q_prediction_checks(spark, d):
    pred = scored_examples(spark, d).where(F.col("cutoff") == ntz_literal(P.CUTOFFS[-1]))
    exp = t(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return V.prediction_checks(pred.select("user_id", "score"), exp)


ROLLUP_BASE = """
SELECT r.r_name, c.c_mktsegment, o.o_orderstatus, o.o_totalprice
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
"""


@query("sales_rollup", f"""
SELECT r_name, c_mktsegment, o_orderstatus,
  grouping(r_name, c_mktsegment, o_orderstatus)::BIGINT AS gid,
  count(*)::BIGINT AS n_orders, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS revenue
FROM ({ROLLUP_BASE}) GROUP BY ROLLUP (r_name, c_mktsegment, o_orderstatus)
""")
def q_rollup(spark, d):
    return S.sales_rollup(t(spark, d, "orders"), t(spark, d, "customer"), t(spark, d, "nation"),
                          t(spark, d, "region"), "rollup")


@query("sales_cube", f"""
SELECT r_name, c_mktsegment, o_orderstatus,
  grouping(r_name, c_mktsegment, o_orderstatus)::BIGINT AS gid,
  count(*)::BIGINT AS n_orders, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS revenue
FROM ({ROLLUP_BASE}) GROUP BY CUBE (r_name, c_mktsegment, o_orderstatus)
""")
def q_cube(spark, d):
    return S.sales_rollup(t(spark, d, "orders"), t(spark, d, "customer"), t(spark, d, "nation"),
                          t(spark, d, "region"), "cube")


@query("sales_grouping_sets", f"""
SELECT r_name, c_mktsegment, o_orderstatus,
  grouping(r_name, c_mktsegment, o_orderstatus)::BIGINT AS gid,
  count(*)::BIGINT AS n_orders, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS revenue
FROM ({ROLLUP_BASE}) GROUP BY GROUPING SETS ((r_name), (c_mktsegment), (o_orderstatus), ())
""")
def q_sets(spark, d):
    return S.sales_rollup(t(spark, d, "orders"), t(spark, d, "customer"), t(spark, d, "nation"),
                          t(spark, d, "region"), "sets")


@query("rfm", f"""
WITH per AS (SELECT o_custkey AS custkey,
  ((epoch_us(TIMESTAMP '{P.RFM_AS_OF}') - epoch_us(max(o_orderdate))) // 86400000000)::BIGINT AS recency_days,
  count(*)::BIGINT AS frequency, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS monetary
  FROM orders GROUP BY o_custkey)
SELECT *, ntile(5) OVER (ORDER BY recency_days DESC, custkey)::INTEGER AS r_score,
  ntile(5) OVER (ORDER BY frequency, custkey)::INTEGER AS f_score,
  ntile(5) OVER (ORDER BY monetary, custkey)::INTEGER AS m_score
FROM per
""")
def q_rfm(spark, d):
    return S.rfm(t(spark, d, "orders"), P.RFM_AS_OF)
