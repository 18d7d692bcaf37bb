"""Whole pipelines: input preparation, judging, comparison."""
