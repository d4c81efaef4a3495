"""Columns, exact ordering, curves and numpy kernels used by the operators."""
