"""Transformations of alignments, coverage and estimates."""
