"""Column functions and pure worker-side functions."""
