"""Exact-duplicate detection and consolidation planning on Spark."""
