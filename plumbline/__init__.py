"""Spark-native data-quality and fairness audits of tabular data."""

from plumbline.config import AuditConfig

__all__ = ["AuditConfig"]
