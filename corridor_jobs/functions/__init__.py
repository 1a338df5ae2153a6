"""Column functions: geometry text, projection, bearings, line referencing."""
