"""Auditable retrieval analytics on Spark."""
