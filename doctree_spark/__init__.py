"""Spark jobs for tree-organised document retrieval over many documents and queries."""
