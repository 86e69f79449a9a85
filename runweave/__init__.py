"""Workflow-run history, event and log analytics as Spark DataFrame operations."""
