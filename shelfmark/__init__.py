"""Catalogue lakehouse on Spark: raw payloads to clean tables, facts, history and checks."""
