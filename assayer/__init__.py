"""Calibrated, typed decisions over text and JSON records, computed with Spark."""
