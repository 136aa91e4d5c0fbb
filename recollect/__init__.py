"""Conversational-retrieval analytics as Spark DataFrame operators."""
