"""Settings of an audit."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class AuditConfig:
    # The defaults every audit starts from.
    seed: int = 42
    test_size: float = 0.2
    alpha: float = 0.01
    sigma_multiplier: float = 1.0
    min_support: float = 0.05
    top_k: int = 5
    max_predicates: int = 1
    dpd_tol: float = 0.1
    eod_tol: float = 0.1
    ppv_tol: float = 0.1
    d_tol: float = 0.2

    # None: average the influence over every test row, which costs one narrow pass.
    influence_test_rows: int | None = None
    # One-hot width a column may reach before the audit refuses it (never silently cut).
    max_categories: int = 50_000
    # Widest Hessian solved on the driver; wider ones use conjugate gradients.
    max_dense_features: int = 512
    # Rows of a quantile bracket that may be sorted out exactly in one aggregate.
    exact_quantile_rows: int = 250_000
