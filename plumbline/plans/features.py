"""From a raw table to a design matrix, for the quality and for the fairness audit."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.config import AuditConfig
from plumbline.functions.columns import c, without_clashes
from plumbline.functions.missing import normalise_missing
from plumbline.operators import scaling
from plumbline.operators.binning import age_group, quantile_bins, range_labels
from plumbline.operators.encoding import Design, Term, categories, one_hot
from plumbline.operators.impute import PLACEHOLDER, modes
from plumbline.operators.profile import Roles, collect_roles
from plumbline.operators.quantiles import medians, number
from plumbline.operators.target import binary_label, label_from_class
from plumbline.operators.text import COMPONENTS, fit_text, text_components

# Feature columns stand next to the raw columns, under plain names of their own. Raw columns of
# reserved names are renamed before anything is prepared, so none can pass for the target.
PREFIX = "f_"
RESERVED = (
    "label", "features", "is_test", "influence", "prediction", "stat_outlier", "infl_outlier", "d2", "is_outlier",
)


def feature_columns(df: DataFrame) -> dict[str, str]:
    """Name of the feature column of each raw column."""
    return {n: f"{PREFIX}{i}" for i, n in enumerate(df.columns)}


@dataclass(frozen=True)
class Prepared:
    """Raw columns with gaps filled, feature columns, ``label`` and ``features`` in one table."""

    data: DataFrame
    row_id: str
    roles: Roles
    numeric: list[str]  # numeric feature columns
    categorical: list[str]
    text: list[str]  # text component columns
    sensitive: list[str]  # raw names
    design: Design = field(repr=False, default=Design(()))
    raw: list[str] = field(default_factory=list)  # raw columns as named here, without id and target
    given_names: dict[str, str] = field(default_factory=dict)  # renamed raw columns: {here: as given}

    def given(self, name: str) -> str:
        return self.given_names.get(name, name)


def build_features(
    df: DataFrame, row_id: str, target: str, mode: str, one_hot_encode: bool = True,
    positive: object = None, cfg: AuditConfig = AuditConfig(), **role_options,
) -> Prepared:
    """Prepare a table for the ``quality`` or the ``fairness`` audit.

    quality: medians for numeric gaps, categories and text as they are. fairness: numeric
    columns are also winsorised and scaled, and sensitive columns become groups. All fitted
    values are aggregates; applying them is a chain of projections without a shuffle.
    """
    if mode not in ("quality", "fairness"):
        raise ValueError(f"unknown mode {mode!r}, choose quality or fairness")
    df, given = without_clashes(df, RESERVED, PREFIX)
    here = {old: new for new, old in given.items()}
    row_id, target = here.get(row_id, row_id), here.get(target, target)
    raw = df.drop(c(row_id))
    own = [n for n in raw.columns if n != target]
    roles = collect_roles(raw, target, **role_options)
    sensitive = list(roles.sensitive) if mode == "fairness" else []
    numeric = [n for n in roles.numeric if n not in sensitive]
    plain = [n for n in roles.categorical if n not in sensitive]
    texts = [n for n in roles.text if n not in sensitive]

    clean = normalise_missing(df, raw.columns)
    label = (
        label_from_class(target, positive) if positive is not None
        else binary_label(clean, target, roles)
    )
    cleaned = _fill_gaps(clean, roles.numeric, plain, texts).withColumn("label", label)

    spot = feature_columns(df)
    data = cleaned.withColumns({spot[n]: number(n) for n in numeric})
    features = [spot[n] for n in numeric]
    if mode == "fairness" and features:
        data = scaling.clamp(data, scaling.winsor_bounds(data, features))
        data = scaling.standardise(data, scaling.moments(data, features))
    data = data.withColumns({spot[n]: c(n) for n in plain})
    if sensitive:
        data = _encode_sensitive(data, {n: spot[n] for n in sensitive}, roles)
    components = {}
    for n in texts:
        model = fit_text(cleaned, n)
        data = text_components(data.withColumn(spot[n], c(n)), spot[n], model)
        components |= {f"{spot[n]}_svd_{k}": f"{n}_svd_{k}" for k in range(COMPONENTS)}
    groups = {spot[n]: n for n in [*sensitive, *plain]}
    if not one_hot_encode:
        return Prepared(data, row_id, roles, features, list(groups), list(components), sensitive, raw=own, given_names=given)

    levels = categories(data, list(groups), cfg.max_categories)
    terms = [Term(k, tuple(levels[k]), title=n) for k, n in groups.items()]
    terms += [Term(spot[n], title=n) for n in numeric]
    terms += [Term(k, title=n) for k, n in components.items()]
    design = Design(tuple(terms))
    if not len(design):
        raise ValueError("no usable feature column")
    data = design.with_vector(design.with_indices(data))
    return Prepared(data, row_id, roles, features, list(groups), list(components), sensitive, design, own, given)


def _fill_gaps(df: DataFrame, numeric: list[str], plain: list[str], texts: list[str]) -> DataFrame:
    """Medians for numbers, a placeholder category, and empty texts, in one projection."""
    middle = medians(df, numeric)
    out = []
    for f in df.schema.fields:
        name, x = f.name, c(f.name)
        if name in middle:
            if isinstance(f.dataType, T.IntegralType) and middle[name].is_integer():
                x = F.coalesce(x, F.lit(int(middle[name])).cast(f.dataType))
            else:
                x = F.coalesce(number(name), F.lit(middle[name]))
        elif name in plain:
            x = F.coalesce(x.cast("string"), F.lit(PLACEHOLDER))
        elif name in texts:
            x = F.coalesce(x, F.lit(""))
        out.append(x.alias(name))
    return df.select(*out)


def _encode_sensitive(df: DataFrame, names: dict[str, str], roles: Roles) -> DataFrame:
    """Add groups of sensitive columns, under the given names.

    Ages become decades, other numbers tenths, and other values stay, with gaps filled.
    """
    ages = [n for n in names if n in roles.numeric and roles.sensitive[n] == "age"]
    others = [n for n in names if n in roles.numeric and n not in ages]
    values = [n for n in names if n not in roles.numeric]
    out = {names[n]: age_group(number(n)) for n in ages}
    if others:
        for n, bins in quantile_bins(df, others, 10).items():
            labels = range_labels(bins, isinstance(df.schema[n].dataType, T.IntegralType))
            out[names[n]] = bins.label_of(number(n), labels)
    found = modes(df, values)
    for n in values:
        out[names[n]] = F.coalesce(c(n).cast("string"), F.lit(found[n]))
    return df.withColumns(out)


def encode_sensitive(df: DataFrame, columns: list[str], target: str | None = None) -> DataFrame:
    """Replace sensitive columns by their groups."""
    roles = collect_roles(df, target, extra_sensitive=columns)
    spot = feature_columns(df)
    encoded = _encode_sensitive(df, {n: spot[n] for n in columns}, roles)
    return encoded.select(*[c(spot[n]).alias(n) if n in columns else c(n) for n in df.columns])


def one_hot_standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    """One-hot the given columns, then standardise every column of the result."""
    wide = one_hot(df, columns)
    return scaling.standard_scale(wide, wide.columns)
