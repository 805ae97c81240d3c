"""Relational operators over questions, passages, answers and runs."""
