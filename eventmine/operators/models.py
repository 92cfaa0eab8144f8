"""Model training and scoring on examples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


LOGISTIC_PENALTY = 0.01


def train_score(examples: DataFrame, features: list[str], label: str = "label",
                split_col: str = "split", train_value: str = "train", kind: str = "logistic",
                seed: int = 42, keep: list[str] | None = None) -> DataFrame:
    """P24. Fit on rows with ``split_col == train_value``, score the others.

    ``VectorAssembler`` + ``StandardScaler`` + ``LogisticRegression`` (or
    ``GBTClassifier`` with ``kind='gbt'``); the vector stays inside the ML
    pipeline and the output has a plain ``score`` column (probability of 1).
    The examples are checkpointed to the shared checkpoint folder before
    ``fit``: every optimizer iteration and the scoring pass read them instead
    of recomputing the feature pipeline. A missing feature (NULL or NaN) takes
    the mean of the training rows that have it, or 0 if none has; training
    rows without a label are left out."""
    keep = keep or [c for c in examples.columns if c not in features]
    model, _, rest = fit_model(examples, features, label, split_col, train_value, kind, seed)
    return score_rows(model, rest, keep)


def fit_model(examples: DataFrame, features: list[str], label: str = "label", split_col: str = "split",
              train_value: str = "train", kind: str = "logistic", seed: int = 42):
    """The fitted pipeline of :func:`train_score`, the rows it was fitted on
    and the rows to score (both with the columns of ``examples``)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    from ..session import checkpoint_dir

    checkpoint_dir(examples.sparkSession)
    data = examples.withColumn("_y", F.col(label).cast("double")).checkpoint(eager=True)
    given = {f: F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")) for f in features}
    means = data.where(F.col(split_col) == train_value).agg(*[F.avg(c).alias(f) for f, c in given.items()]).first()
    data = data.withColumns({f"_f_{f}": F.coalesce(c, F.lit(float(means[f] or 0.0))) for f, c in given.items()})
    train = data.where((F.col(split_col) == train_value) & F.col("_y").isNotNull())
    rest = data.where(F.col(split_col) != train_value)
    stages = [VectorAssembler(inputCols=[f"_f_{f}" for f in features], outputCol="_raw"),
              StandardScaler(inputCol="_raw", outputCol="_x")]
    if kind == "logistic":
        stages.append(LogisticRegression(featuresCol="_x", labelCol="_y", maxIter=50, regParam=LOGISTIC_PENALTY))
    elif kind == "gbt":
        stages.append(GBTClassifier(featuresCol="_x", labelCol="_y", maxIter=20, seed=seed))
    else:
        raise ValueError(kind)
    return Pipeline(stages=stages).fit(train), train, rest


def score_rows(model, rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the ``score`` of rows that :func:`fit_model` gave."""
    from pyspark.ml.functions import vector_to_array

    return model.transform(rows).select(*keep, vector_to_array("probability")[1].alias("score"))


def logistic_residual(model, train: DataFrame) -> float:
    """How far a logistic model is from the optimum of its own objective: the
    largest component of the gradient over the rows it was fitted on. At the
    optimum mean((score - label) * x) + penalty * weight is 0 for each scaled
    feature, and mean(score - label) is 0 for the intercept, which carries no
    penalty. One aggregation of as many numbers as there are features; scores
    that are not the fitted model's, or a fit that stopped early, show here."""
    from pyspark.ml.functions import vector_to_array

    weights = [float(w) for w in model.stages[-1].coefficients]
    off = vector_to_array("probability")[1] - F.col("_y")
    x = vector_to_array("_x")
    row = model.transform(train).agg(F.avg(off), *[F.avg(off * x[i]) for i in range(len(weights))]).first()
    if row[0] is None:
        return 0.0
    return max(abs(row[0]), *[abs(g + LOGISTIC_PENALTY * w) for g, w in zip(row[1:], weights)])


def logistic_scores_by_hand(model, rows: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """``keep``, the model's ``score`` and ``by_hand``: the same from the
    weights, deviations and plain column arithmetic. A feature that never varied
    counts for nothing."""
    from pyspark.ml.functions import vector_to_array

    weights, devs = model.stages[-1].coefficients, model.stages[1].std
    logit = F.lit(float(model.stages[-1].intercept))
    for f, w, s in zip(features, weights, devs):
        if s:
            logit = logit + F.col(f"_f_{f}") * float(w) / float(s)
    return model.transform(rows).select(*keep, vector_to_array("probability")[1].alias("score"),
                                        (1 / (1 + F.exp(-logit))).alias("by_hand"))
