"""Structured Streaming variants of the mergeable operators."""
