"""Numerical kernels of one entity's ion x sample matrix."""
