"""Declarative mapping between graphs and nested rows, compiled to Spark DataFrame plans."""
