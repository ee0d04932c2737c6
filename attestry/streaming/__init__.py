"""Incremental work over arriving files."""
