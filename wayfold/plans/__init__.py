"""Staged tables, the mapping from the test tables to the data model, and the query registry."""
