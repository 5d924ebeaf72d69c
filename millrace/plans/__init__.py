"""Whole jobs built from operators: fit, score, evaluate."""
