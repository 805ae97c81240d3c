"""Structured Streaming forms of the stateful operators (an extension: batch is the reference)."""
