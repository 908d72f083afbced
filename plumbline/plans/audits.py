"""The three audits of one table: profile, quality, fairness."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.config import AuditConfig
from plumbline.functions.columns import c
from plumbline.operators import fairness as groups
from plumbline.operators import outliers, profile
from plumbline.operators.influence import influence_bound, influence_score
from plumbline.operators.models import LinearModel, binary_f1, fit, model_type
from plumbline.operators.patterns import pattern_items, top_patterns
from plumbline.operators.split import first_test_rows, stratified_split
from plumbline.plans.features import Prepared, build_features
from plumbline.session import materialise


def profile_audit(df: DataFrame) -> dict[str, DataFrame]:
    """Summary, role counts, column statistics and alerts of a table."""
    return {
        "overview": profile.dataset_summary(df),
        "column_types": profile.role_counts(profile.column_roles(df)),
        "columns": profile.column_statistics(df),
        "alerts": profile.alerts(df),
    }


@dataclass(frozen=True)
class Fitted:
    """A prepared table with its split, written once, and the model of its training rows."""

    prepared: Prepared
    data: DataFrame
    model: LinearModel
    cfg: AuditConfig

    @property
    def train(self) -> DataFrame:
        return self.data.where(~c("is_test"))

    @property
    def test(self) -> DataFrame:
        return self.data.where(c("is_test"))

    def score(self) -> Column:
        n = self.cfg.influence_test_rows
        test = self.test if n is None else first_test_rows(
            self.data, self.prepared.row_id, n, self.cfg.seed)
        return influence_score(self.train, test, self.model, self.prepared.design, cfg=self.cfg)

    def influence(self) -> DataFrame:
        """Training rows, raw columns included, with their ``influence``."""
        return self.train.withColumn("influence", self.score())


def fit_audit(
    df: DataFrame, row_id: str, target: str, model: str, mode: str,
    cfg: AuditConfig = AuditConfig(), **options,
) -> Fitted:
    """Features, split and model. The prepared table is written once and read by all steps."""
    kind = model_type(model)
    prepared = build_features(df, row_id, target, mode, cfg=cfg, **options)
    data = materialise(stratified_split(prepared.data, prepared.row_id, "label", cfg), f"features_{mode}")
    return Fitted(prepared, data, fit(data.where(~c("is_test")), kind, prepared.design), cfg)


def flag_outliers(fitted: Fitted) -> DataFrame:
    """All rows with ``stat_outlier`` (Mahalanobis) and ``infl_outlier`` (training rows only).

    Both flags are expressions on the same rows, so no join brings them together.
    """
    cfg, numeric = fitted.cfg, fitted.prepared.numeric
    if numeric:
        marked = outliers.mahalanobis(fitted.data, numeric, cfg.alpha)
        marked = marked.drop("d2").withColumnRenamed("is_outlier", "stat_outlier")
    else:
        marked = fitted.data.withColumn("stat_outlier", F.lit(False))
    score = fitted.score()
    bound = influence_bound(fitted.train.select(score.alias("influence")), cfg.sigma_multiplier)
    return marked.withColumn("infl_outlier", ~c("is_test") & (score > F.lit(bound)))


def compare_f1(fitted: Fitted, flagged: DataFrame) -> DataFrame:
    """F1 on the same test rows after training on all rows and without either outlier set.

    The first model is the one already fitted, the other two are fitted side by side, and
    all predictions are scored in one pass.
    """
    design, kind = fitted.prepared.design, fitted.model.kind
    train = flagged.where(~c("is_test"))
    refit = inheritable_thread_target(train.sparkSession)(
        lambda flag: fit(outliers.drop_flagged(train, flag), kind, design))
    with ThreadPoolExecutor(2) as pool:
        stat, infl = pool.map(refit, ["stat_outlier", "infl_outlier"])
    scores = {"f1_orig": fitted.model, "f1_statistic": stat, "f1_influence": infl}
    return fitted.test.agg(*[
        F.round(binary_f1(c("label"), m.predict(design)), 4).alias(n) for n, m in scores.items()
    ])


def quality_audit(
    df: DataFrame, row_id: str, target: str, model: str = "logistic",
    cfg: AuditConfig = AuditConfig(), **options,
) -> dict[str, DataFrame]:
    """F1 with and without outliers, and the outlier counts."""
    fitted = fit_audit(df, row_id, target, model, "quality", cfg, **options)
    flagged = flag_outliers(fitted)
    return {
        "f1_report": compare_f1(fitted, flagged),
        "outlier_summary": outliers.outlier_summary(flagged, "infl_outlier", "stat_outlier"),
    }


def fairness_audit(
    df: DataFrame, row_id: str, target: str, model: str = "logistic",
    cfg: AuditConfig = AuditConfig(), **options,
) -> dict[str, DataFrame]:
    """Most influential subgroups, group fairness of the predictions, and of influence.

    One split and one model serve both halves. Subgroups are looked for in the raw columns
    of the training rows, with gaps filled.
    """
    fitted = fit_audit(df, row_id, target, model, "fairness", cfg, **options)
    prepared = fitted.prepared
    raw = prepared.raw
    mined = fitted.influence().select(*[c(n) for n in raw], "influence")
    items = pattern_items(mined, [])
    wide = tuple(n for n in prepared.roles.text if n in raw)
    found = top_patterns(mined, [], cfg.min_support, cfg.top_k, cfg.max_predicates, wide=wide, items=items)
    top = found.collect()  # at most top_k rows
    given = prepared.given_names
    shown = df.sparkSession.createDataFrame(top, found.schema)
    out = {"top_patterns": _given_names(shown, given, "pattern_col_1", "pattern_col_2")}
    if prepared.sensitive:
        judged = fitted.test.withColumn("prediction", fitted.model.predict(prepared.design))
        args = judged, prepared.sensitive, "label", "prediction"
        out["group_fairness"] = _given_names(groups.fairness_records(*args, cfg), given, "sensitive_feature")
        precision = _given_names(groups.predictive_parity(*args, cfg.ppv_tol), given, "feature")
        out["precision_by_group"] = precision.withColumn("group", F.concat_ws(" = ", "feature", "grp"))
    if top:
        pairs = [(r.pattern_col_1, r.pattern_val_1) for r in top]
        effects = groups.influence_effects(mined, pairs, cfg.d_tol, items)
        out["influence_fairness"] = _given_names(effects, given, "group_col")
    return out


def _given_names(df: DataFrame, given: dict[str, str], *columns: str) -> DataFrame:
    """Show renamed raw columns under the names they came with."""
    if not given:
        return df
    names = F.create_map(*[F.lit(x) for pair in given.items() for x in pair])
    return df.withColumns({n: F.coalesce(F.try_element_at(names, c(n)), c(n)) for n in columns})
