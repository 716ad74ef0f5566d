"""Relational operators: extraction, merging, grouping, dedup, metrics, audits."""
