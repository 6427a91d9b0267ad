"""Whole jobs: projections, the registered queries and the command line."""
