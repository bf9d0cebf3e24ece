"""Registered queries and their SQL twins, grouped by area."""

from riskloom.catalog import audit, cohort, features, report, storage

MODULES = (storage, cohort, features, audit, report)
