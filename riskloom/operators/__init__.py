"""Cohort, feature, split, score, audit and report operators (DataFrame -> DataFrame)."""
