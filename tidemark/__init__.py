"""Lineage change-impact analytics expressed as Spark DataFrame plans."""
