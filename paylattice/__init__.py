"""Counterparty recommendation analytics expressed as Spark DataFrame operators."""
