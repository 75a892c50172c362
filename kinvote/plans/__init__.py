"""Whole plans: feature tables, experiments, and the catalogue of registered queries."""
