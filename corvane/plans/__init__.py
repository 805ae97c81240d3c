"""Composed pipelines: providers, ingestion, question answering."""
