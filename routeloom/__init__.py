"""Spark jobs for routing and network tables."""
