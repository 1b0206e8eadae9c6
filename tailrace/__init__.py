"""Piped log analytics on Spark."""
