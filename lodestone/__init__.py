"""Lodestone: document and product analytics expressed as Spark DataFrame plans."""
