"""Named queries that apply the operators to the driver's tables."""
