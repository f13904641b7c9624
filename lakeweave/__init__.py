"""Spark-first lakehouse operators."""
