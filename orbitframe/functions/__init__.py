"""Column functions, and the few vectorised Python functions that columns cannot express."""
