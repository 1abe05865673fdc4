"""Whole jobs built from the operators: train, report, score."""
