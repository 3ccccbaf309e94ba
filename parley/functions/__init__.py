"""Column-level functions: patterns (fixed values), text scalars, dialogue splitting."""
