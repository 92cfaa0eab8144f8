"""Evaluation and output checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from ..sources.sinks import write_csv, write_parquet
from .ordered import global_positions

EPS = 1e-15


def _per_score(scored: DataFrame, score: str, label: str) -> DataFrame:
    """One row per distinct score; rows without a score or label are not
    evaluated."""
    scored = scored.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    return scored.groupBy(F.col(score).alias("score")).agg(
        F.sum(F.col(label).cast("long")).alias("pos"),
        F.sum((1 - F.col(label)).cast("long")).alias("neg"))


def binary_metrics(scored: DataFrame, score: str = "score", label: str = "label",
                   n_buckets: int | None = None) -> DataFrame:
    """P25. One row: n, n_pos, AUC (tied scores count one half) and log loss
    (scores clipped to [1e-15, 1 - 1e-15]). AUC is NULL when only one class
    is present.

    Examples collapse to one row per distinct score (partial aggregation),
    then negatives below each score come from a global running sum over
    range buckets (``global_positions``) — no single-task window."""
    per = _per_score(scored, score, label)
    cum = global_positions(per, "score", [], out="_pos_ix", n_buckets=n_buckets,
                           sums={"neg_le": F.col("neg")})
    p = F.least(F.greatest(F.col("score"), F.lit(EPS)), F.lit(1 - EPS))
    return cum.agg(
        (F.sum("pos") + F.sum("neg")).alias("n"),
        F.sum("pos").alias("n_pos"),
        F.round(F.try_divide(F.sum(F.col("pos") * (F.col("neg_le") - F.col("neg") * 0.5)),
                             F.sum("pos") * F.sum("neg")), 9).alias("auc"),
        F.round(-(F.sum(F.col("pos") * F.log(p) + F.col("neg") * F.log(1 - p)))
                / (F.sum("pos") + F.sum("neg")), 9).alias("logloss"))


def threshold_metrics(scored: DataFrame, score: str = "score", label: str = "label",
                      n_buckets: int | None = None) -> DataFrame:
    """P25. Per distinct score t (predict positive iff score >= t): tp, fp,
    precision, recall, F1 (0 where tp = 0). Without any positive, recall has
    no value (NULL)."""
    per = _per_score(scored, score, label)
    cum = global_positions(per, "score", [], out="_ix", descending=True, n_buckets=n_buckets,
                           sums={"tp": F.col("pos"), "fp": F.col("neg")}, totals=True)
    prec = F.col("tp") / (F.col("tp") + F.col("fp"))
    rec = F.try_divide(F.col("tp").cast("double"), F.col("total_tp").cast("double"))
    return cum.select(
        F.col("score").alias("threshold"), "tp", "fp",
        F.round(prec, 9).alias("precision"), F.round(rec, 9).alias("recall"),
        F.round(F.when(F.col("tp") == 0, F.lit(0.0)).otherwise(2 * prec * rec / (prec + rec)),
                9).alias("f1"))


def ntile_of(pos, n, k: int):
    """Spark/SQL ``ntile(k)`` bucket for 1-based position ``pos`` of ``n``
    rows: the first n % k buckets hold one row more."""
    q = F.floor(n / k)
    r = n % k
    big = r * (q + 1)
    return F.when(pos <= big, F.ceil(pos / (q + 1))).otherwise(
        r + F.ceil((pos - big) / q)).cast("int")


def lift_by_decile(scored: DataFrame, key: str, score: str = "score", label: str = "label",
                   n_buckets: int | None = None) -> DataFrame:
    """P25. Deciles by descending score (ties by ``key``): rows, positives,
    positive rate and lift over the overall rate (NULL if no row is positive)."""
    ranked = global_positions(scored.select(key, score, label), score, [key], out="_pos",
                              descending=True, n_buckets=n_buckets, totals=True)
    dec = ranked.withColumn("decile", ntile_of(F.col("_pos"), F.col("_pos_total"), 10))
    per = dec.groupBy("decile").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("n_pos"))
    # ten rows: the overall rate comes from a window over the decile table
    allw = Window.partitionBy(F.lit(1))
    overall = F.sum("n_pos").over(allw) / F.sum("n").over(allw)
    return per.select("decile", "n", "n_pos", F.round(F.col("n_pos") / F.col("n"), 9).alias("rate"),
                      F.round(F.try_divide(F.col("n_pos") / F.col("n"), overall), 9).alias("lift"))


def ranking_metrics(ranked: DataFrame, truth: DataFrame, k: int, user: str = "user_id",
                    item: str = "item", rank: str = "rank") -> DataFrame:
    """P26. Mean precision@k, recall@k, MAP@k and NDCG@k over users with a
    non-empty truth set. ``ranked`` holds (user, item, rank) with ranks 1..;
    per user work is bounded by k rows."""
    r = ranked.where(F.col(rank) <= k).select(user, item, rank)
    t = truth.select(user, item).distinct()
    n_true = t.groupBy(user).agg(F.count(F.lit(1)).alias("_nt"))
    hits = r.join(t.withColumn("_rel", F.lit(1)), [user, item], "left").fillna(0, ["_rel"])
    w = Window.partitionBy(user).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    hits = hits.withColumn("_cum", F.sum("_rel").over(w))
    per_user = hits.groupBy(user).agg(
        F.sum("_rel").alias("_h"),
        F.sum(F.when(F.col("_rel") == 1, F.col("_cum") / F.col(rank))).alias("_ap"),
        F.sum(F.col("_rel") / F.log2(F.col(rank) + 1)).alias("_dcg"))
    u = n_true.join(per_user, user, "left").fillna(0, ["_h", "_ap", "_dcg"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("_nt"), F.lit(k))), F.lit(0.0),
                        lambda acc, i: acc + 1.0 / F.log2(i + 1))
    u = u.select(user, (F.col("_h") / k).alias("p"), (F.col("_h") / F.col("_nt")).alias("r"),
                 (F.col("_ap") / F.least(F.col("_nt"), F.lit(k))).alias("ap"),
                 (F.col("_dcg") / ideal).alias("ndcg"))
    return u.agg(F.count(F.lit(1)).alias("n_users"),
                 F.round(F.avg("p"), 9).alias("precision_at_k"),
                 F.round(F.avg("r"), 9).alias("recall_at_k"),
                 F.round(F.avg("ap"), 9).alias("map_at_k"),
                 F.round(F.avg("ndcg"), 6).alias("ndcg_at_k"))


def prediction_checks(pred: DataFrame, expected_keys: DataFrame, key: str = "user_id",
                      score: str = "score") -> DataFrame:
    """P27. (check, n_bad) for a prediction table: duplicate keys, expected
    keys missing, unexpected keys, NULL or NaN scores.

    One pass over the predictions (count and bad scores per key, combined
    map-side), one full outer join with the distinct expected keys, one
    global aggregate."""
    sc = F.col(score)
    per = pred.groupBy(key).agg(F.count(F.lit(1)).alias("_c"),
                                F.count_if(sc.isNull() | F.isnan(sc)).alias("_bad"))
    exp = expected_keys.select(key).distinct().withColumn("_e", F.lit(True))
    j = per.join(exp, key, "full_outer")
    one = j.agg(
        F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).cast("bigint").alias("duplicate_key"),
        F.count_if(F.col("_c").isNull()).cast("bigint").alias("missing_key"),
        F.count_if(F.col("_e").isNull()).cast("bigint").alias("unexpected_key"),
        F.coalesce(F.sum("_bad"), F.lit(0)).cast("bigint").alias("null_or_nan_score"))
    names = ["duplicate_key", "missing_key", "unexpected_key", "null_or_nan_score"]
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("check"), F.col(n).alias("n_bad")) for n in names])).alias("r")
    ).select("r.*")


class PredictionCheckFailed(ValueError):
    pass


def write_predictions(pred: DataFrame, path: str, expected_keys: DataFrame,
                      key: str = "user_id", score: str = "score", fmt: str = "parquet",
                      mode: str = "errorifexists") -> DataFrame:
    """P27. Refuse to write unless every check in ``prediction_checks`` is
    zero; then write ``pred`` to ``path``. Returns the check table.

    The predictions are worked out once, into the shared checkpoint folder:
    the rows checked are the rows written."""
    checkpoint_dir(pred.sparkSession)
    pred = pred.checkpoint(eager=True)
    checks = prediction_checks(pred, expected_keys, key, score).checkpoint(eager=True)
    failed = {r["check"]: r["n_bad"] for r in checks.collect() if r["n_bad"]}  # four rows
    if failed:
        raise PredictionCheckFailed(f"not written: {failed}")
    {"csv": write_csv, "parquet": write_parquet}[fmt](pred, path, mode)
    return checks
