"""Hierarchy matching, catalog retrieval and request-log analytics as Spark DataFrame operators."""
