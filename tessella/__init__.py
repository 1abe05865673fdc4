"""Tabular preparation and modelling on Spark DataFrames."""
