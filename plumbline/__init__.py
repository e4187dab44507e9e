"""Tabular data quality as Spark jobs: profile, audit, score, clean, redact, report."""

from plumbline.plans.assessment import Assessment, assess

__all__ = ["Assessment", "assess"]
