"""Operators of a training-data pipeline and their queries. Nothing outside this folder imports it."""
