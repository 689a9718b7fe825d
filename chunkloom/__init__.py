"""Chunkloom: documents, chunks, their identity, changes and graph as Spark plans."""
