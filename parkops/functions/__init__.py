"""Scalar column functions built from Spark built-ins."""
