"""Retrieval and knowledge-graph analytics expressed as Spark plans."""
