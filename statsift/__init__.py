"""Bulk triage of summary-statistics tables as Spark DataFrame operators."""
