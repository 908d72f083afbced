"""Linear classifiers, their predictions and F1."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.config import AuditConfig
from plumbline.functions.columns import c
from plumbline.operators.encoding import Design
from plumbline.operators.logit import fit_logistic
from plumbline.operators.svm import GAP, fit_svm

# Model names as users give them, and their short forms.
MODEL_REGISTRY = {"Logistic Regression": "logistic", "Support Vector Machine": "svm"}

# Inverse penalty and iteration limit of both models.
INVERSE_PENALTY = 1.0
MAX_ITERATIONS = 10_000

# Relative change of the objective at which fitting of designs too wide for a matrix stops. The
# hinge loss has kinks, and closing in on them costs many passes for little.
TOLERANCE = {"logistic": 1e-7, "svm": 1e-4}


def model_type(name: str) -> str:
    """Short form of a model name; unknown names are refused."""
    if name in MODEL_REGISTRY:
        return MODEL_REGISTRY[name]
    if name in MODEL_REGISTRY.values():
        return name
    raise ValueError(f"unknown model {name!r}, choose from {sorted(MODEL_REGISTRY)}")


@dataclass(frozen=True)
class LinearModel:
    kind: str
    weights: tuple[float, ...]
    intercept: float

    def margin(self, design: Design) -> Column:
        return design.dot(self.weights) + F.lit(float(self.intercept))

    def probability(self, design: Design) -> Column:
        return 1 / (1 + F.exp(-self.margin(design)))

    def predict(self, design: Design) -> Column:
        return (self.margin(design) > 0).cast("int")


def fit(
    df: DataFrame,
    kind: str,
    design: Design,
    label: str = "label",
    features: str = "features",
    gap: float = GAP,
) -> LinearModel:
    """Fit on ``features`` and ``label``; each iteration is one pass over the rows.

    Penalty and loss are weighed as for C = 1: the penalty shrinks with the row count, and
    features are penalised in the units they come in. The logistic loss is minimised by Newton steps
    (:mod:`plumbline.operators.logit`) to the precision of doubles and the hinge loss with a certificate
    (:mod:`plumbline.operators.svm`) down to the duality ``gap``, unless the design is too wide for a matrix of its squared width.
    """
    kind = model_type(kind)
    stats = df.agg(F.count(F.lit(1)).alias("n"), F.sum(c(label).cast("double")).alias("ones")).first()
    if not stats.n or stats.ones in (0, stats.n):
        raise ValueError("training rows hold one class only")
    settings = dict(
        featuresCol=features, labelCol=label, regParam=1.0 / (INVERSE_PENALTY * stats.n),
        maxIter=MAX_ITERATIONS, tol=TOLERANCE[kind], standardization=False,
    )
    narrow = len(design.names) <= AuditConfig().max_dense_features
    if kind == "logistic" and narrow:
        *weights, intercept = fit_logistic(df, settings["regParam"], features, label)
        return LinearModel(kind, tuple(float(w) for w in weights), float(intercept))
    if kind == "logistic":
        model = LogisticRegression(elasticNetParam=0.0, family="binomial", **settings).fit(df)
    elif narrow:
        found = fit_svm(df, settings["regParam"], features, label, gap=gap)
        return LinearModel(kind, tuple(float(w) for w in found.weights), found.intercept)
    else:
        model = LinearSVC(**settings).fit(df)
    return LinearModel(kind, tuple(float(w) for w in model.coefficients.toArray()), float(model.intercept))


def f1_score(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row ``f1``: of class 1 for two classes, else the mean over classes by support.

    Classes are counted among the labels. A class without hits scores 0.
    """
    y, p = c(label), c(prediction)
    pairs = df.groupBy(y.alias("y"), p.alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select(F.inline(F.array(
        F.struct(c("y").alias("cls"), c("n").alias("real"), F.lit(0).cast("long").alias("said"),
                 F.when(c("y") == c("p"), c("n")).otherwise(0).alias("hit")),
        F.struct(c("p").alias("cls"), F.lit(0).cast("long").alias("real"), c("n").alias("said"),
                 F.lit(0).cast("long").alias("hit")),
    )))
    per_class = sides.groupBy("cls").agg(
        F.sum("real").alias("real"), F.sum("said").alias("said"), F.sum("hit").alias("hit"))
    one = F.coalesce(F.try_divide(2.0 * c("hit"), c("real") + c("said")), F.lit(0.0))
    sums = per_class.agg(
        F.count_if(c("real") > 0).alias("classes"),
        F.coalesce(F.max(F.when(c("cls") == 1, one)), F.lit(0.0)).alias("binary"),
        F.try_divide(F.sum(one * c("real")), F.sum("real")).alias("weighted"),
    )
    return sums.select(F.when(c("classes") == 2, c("binary")).otherwise(c("weighted")).alias("f1"))


def binary_f1(label: Column, prediction: Column) -> Column:
    """F1 of class 1 as an aggregate, so several models can be scored in one pass."""
    hit = F.count_if((label == 1) & (prediction == 1))
    both = F.count_if(label == 1) + F.count_if(prediction == 1)
    return F.coalesce(F.try_divide(2.0 * hit, both), F.lit(0.0))
