"""Continuous-profiling analytics as PySpark DataFrame operators."""
