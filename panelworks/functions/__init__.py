"""Column functions: scalars, and windows over panels in the order of their dates."""
