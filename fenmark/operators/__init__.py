"""Relational operators, DataFrame in and DataFrame out, and the kernels that models need."""
