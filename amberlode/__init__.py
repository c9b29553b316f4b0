"""Replica-aware asset analytics, written for Spark's DataFrame API."""
