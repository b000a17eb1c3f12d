"""Column expressions and small numeric kernels that several operators share."""
