"""Drydock: knowledge-graph and retrieval analytics as Spark DataFrame operators."""
