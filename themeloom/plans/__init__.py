"""Helpers that shape plans: cutting lineage and joining without hot tasks."""
