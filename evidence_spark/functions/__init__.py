"""Part of evidence_spark."""
