"""Marrow: calibrated-risk analytics expressed as PySpark DataFrame plans."""
