"""Column functions and dense kernels."""
