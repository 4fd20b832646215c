"""Spark jobs for multi-parametric measurements on stacked grids."""
