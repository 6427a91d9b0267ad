"""Readers and writers of alignment, sequence and result files."""
