"""Group fairness of a classifier, and of influence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.config import AuditConfig
from plumbline.functions.columns import c, known
from plumbline.operators.patterns import Items, predicate

# Name of the group of unknown values, and the bound on relative influence gaps.
UNKNOWN_GROUP = "nan"
INFLUENCE_RATIO = 3.0


def _long_groups(df: DataFrame, sensitive: list[str], keep: list[Column]) -> DataFrame:
    """One row per row and sensitive column, with its group as text."""
    groups = [
        F.coalesce(known(n, df.schema[n].dataType).cast("string"), F.lit(UNKNOWN_GROUP)).alias(n)
        for n in sensitive
    ]
    wide = df.select(*keep, *groups)
    kept = [n for n in wide.columns if n not in sensitive]
    return wide.unpivot([c(n) for n in kept], [c(n) for n in sensitive], "feature", "grp")


def group_confusion(df: DataFrame, sensitive: list[str], label: str, prediction: str) -> DataFrame:
    """Confusion counts per group of every sensitive column, in one grouped sum."""
    long = _long_groups(df, sensitive, [c(label).cast("int").alias("_y"), c(prediction).cast("int").alias("_p")])
    y, p = c("_y") == 1, c("_p") == 1
    return long.groupBy("feature", "grp").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(p).alias("predicted"),
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"),
    )


def _rate(part: Column, whole: Column) -> Column:
    """A share that is 0 if there is nothing to share."""
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def group_rates(confusion: DataFrame) -> DataFrame:
    """Selection rate, true and false positive rate, and precision per group."""
    return confusion.select(
        "*",
        _rate(c("predicted"), c("n")).alias("selection_rate"),
        _rate(c("tp"), c("tp") + c("fn")).alias("tpr"),
        _rate(c("fp"), c("fp") + c("tn")).alias("fpr"),
        _rate(c("tp"), c("predicted")).alias("ppv"),
    )


def _spread(name: str) -> Column:
    return F.max(name) - F.min(name)


def fairness_records(
    df: DataFrame, sensitive: list[str], label: str, prediction: str,
    cfg: AuditConfig = AuditConfig(),
) -> DataFrame:
    """One row per sensitive column: parity gaps and flags.

    DPD is the spread of selection rates, EOD the larger spread of true and false positive
    rates, PPV_diff the spread of precision. Precision per group, with its flag, is one row per
    group (``predictive_parity``), so it is complete for any number of groups.
    """
    rates = group_rates(group_confusion(df, sensitive, label, prediction))
    gaps = rates.groupBy("feature").agg(
        _spread("selection_rate").alias("DPD"),
        F.greatest(_spread("tpr"), _spread("fpr")).alias("EOD"),
        _spread("ppv").alias("PPV_diff"),
    )
    return gaps.select(
        c("feature").alias("sensitive_feature"),
        "DPD", (F.abs("DPD") <= cfg.dpd_tol).alias("DPD_fair"),
        "EOD", (F.abs("EOD") <= cfg.eod_tol).alias("EOD_fair"),
        "PPV_diff", (F.abs("PPV_diff") <= cfg.ppv_tol).alias("PPV_fair"),
    )


def demographic_parity(df: DataFrame, sensitive: list[str], prediction: str) -> DataFrame:
    """Spread of the share of positive predictions over the groups of each column."""
    long = _long_groups(df, sensitive, [c(prediction).cast("int").alias("_p")])
    rates = long.groupBy("feature", "grp").agg(F.avg(c("_p").cast("double")).alias("rate"))
    return rates.groupBy("feature").agg(_spread("rate").alias("DPD"))


def equalised_odds(df: DataFrame, sensitive: list[str], label: str, prediction: str) -> DataFrame:
    """The larger spread of true and false positive rates over the groups of each column."""
    rates = group_rates(group_confusion(df, sensitive, label, prediction))
    return rates.groupBy("feature").agg(F.greatest(_spread("tpr"), _spread("fpr")).alias("EOD"))


def predictive_parity(
    df: DataFrame, sensitive: list[str], label: str, prediction: str, tolerance: float = 0.1
) -> DataFrame:
    """Precision per group, its distance to the best group of the column, and a flag."""
    rates = group_rates(group_confusion(df, sensitive, label, prediction))
    best = rates.groupBy("feature").agg(F.max("ppv").alias("best"))
    return rates.join(best, "feature").select(
        "feature", "grp", "ppv", (c("best") - c("ppv")).alias("gap"),
        (c("best") - c("ppv") <= tolerance).alias("fair"),
    )


def group_metric(df: DataFrame, group: str, **metrics: Column) -> DataFrame:
    """Any aggregates per group of one column, in one grouped pass."""
    value = F.coalesce(known(group, df.schema[group].dataType).cast("string"), F.lit(UNKNOWN_GROUP))
    return df.groupBy(value.alias("grp")).agg(*[m.alias(n) for n, m in metrics.items()])


def _effect(n1: Column, m1: Column, s1: Column, n2: Column, m2: Column, s2: Column, d_tol: float) -> list[Column]:
    """Means, their difference, Cohen's d with pooled sample deviation, and both flags."""
    delta = m1 - m2
    freedom = F.greatest(n1 + n2 - 2, F.lit(1))
    pooled = F.sqrt(((n1 - 1) * s1 * s1 + (n2 - 1) * s2 * s2) / freedom)
    # A group without rows, or without others, has no effect size and is not fair.
    d = F.when((n1 > 0) & (n2 > 0), F.when(pooled > 0, delta / pooled).otherwise(F.lit(0.0)))
    ratio = F.try_divide(delta, m2)
    return [
        m1.alias("mean_positive_group"), m2.alias("mean_other"), delta.alias("inf_mean_diff"),
        d.alias("cohen_d"),
        F.coalesce(F.abs(ratio) <= INFLUENCE_RATIO, F.lit(False)).alias("inf_fair"),
        F.coalesce(F.abs(d) <= d_tol, F.lit(False)).alias("cohen_fair"),
    ]


def influence_effects(
    df: DataFrame, groups: list[tuple[str, str]], d_tol: float = 0.2, items: Items | None = None
) -> DataFrame:
    """Mean influence inside and outside each given group, with effect size and flags.

    All groups share one aggregate over the rows.
    """
    aggs, rows = [], []
    for i, (name, value) in enumerate(groups):
        inside = items.predicate(name, value, df.schema) if items else predicate(name, value, df.schema)
        for side, mask in (("a", inside), ("b", ~inside)):
            x = F.when(mask, c("influence"))
            aggs += [F.count(x).alias(f"{side}n{i}"), F.avg(x).alias(f"{side}m{i}"),
                     F.stddev_samp(x).alias(f"{side}s{i}")]
        rows.append(F.struct(
            F.lit(name).alias("group_col"), F.lit(value).alias("positive_group"),
            *[c(f"{side}{k}{i}").alias(f"{side}{k}") for side in "ab" for k in "nms"],
        ))
    if not rows:
        raise ValueError("no groups given")
    sides = df.agg(*aggs).select(F.inline(F.array(*rows)))
    return sides.select(
        "group_col", "positive_group",
        *_effect(c("an"), c("am"), c("as"), c("bn"), c("bm"), c("bs"), d_tol),
    )


def influence_effects_by_value(df: DataFrame, columns: list[str], d_tol: float = 0.2) -> DataFrame:
    """Effect size of every value of every column against the rest of the rows.

    The rest is the column total less the group, from counts, means and centred squares,
    so all groups cost one grouped pass.
    """
    long = _long_groups(df, columns, [c("influence").cast("double").alias("_inf")])
    parts = long.groupBy("feature", "grp").agg(
        F.count("_inf").alias("n"), F.avg("_inf").alias("m"),
        (F.var_pop("_inf") * F.count("_inf")).alias("q"),
    )
    whole = df.agg(
        F.count("influence").alias("tn"), F.avg("influence").alias("tm"),
        (F.var_pop("influence") * F.count("influence")).alias("tq"),
    )
    total = whole.first()
    n, m, q = c("n"), c("m"), c("q")
    rest = F.lit(total.tn) - n
    rest_mean = F.try_divide(F.lit(total.tm) * F.lit(total.tn) - m * n, rest)
    shift = (m - rest_mean) * (m - rest_mean) * n * rest / F.lit(total.tn)
    rest_q = F.greatest(F.lit(total.tq) - q - shift, F.lit(0.0))
    dev = F.sqrt(F.try_divide(q, n - 1))
    rest_dev = F.sqrt(F.try_divide(rest_q, rest - 1))
    return parts.select(
        c("feature").alias("group_col"), c("grp").alias("positive_group"),
        *_effect(n, m, dev, rest, rest_mean, rest_dev, d_tol),
    )
