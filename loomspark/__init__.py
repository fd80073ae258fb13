"""Declarative dataflows and workflow-state analytics on Apache Spark."""
