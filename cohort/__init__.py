"""Cohort analytics on PySpark: one clean row per subject, and models of a binary outcome on it."""
