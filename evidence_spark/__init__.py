"""Spark jobs for digital-investigation data at scale."""
