"""Column functions and pixel kernels."""
