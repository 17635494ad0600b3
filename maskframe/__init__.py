"""Labelled-corpus analytics on Spark: audits, splits, mask algebra, metrics and data cleaning."""
