"""All named queries and their SQL."""

from cohortlens.plans import cohort, domain, history, projects, records, stores, structure, summaries, texts  # noqa: F401  register their queries
from cohortlens.plans.queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
