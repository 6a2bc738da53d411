"""Composite evaluations: prefixes, merges, sweeps, experiment grids and reports."""
