"""Registered queries, their SQL equivalents and plan-level helpers."""
