"""Scalar functions as Column expressions; Arrow UDFs only where no built-in exists."""
