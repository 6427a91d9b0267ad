"""Numerical helpers."""
