"""Operators of a large-scale training-data pipeline. Nothing outside this subpackage imports it."""
