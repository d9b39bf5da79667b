"""Variant-call analytics and corpus preparation as plain Spark DataFrame plans."""
