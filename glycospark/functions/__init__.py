"""Column-level helpers: time arithmetic, units, ids, response kernels, soft-DTW."""
