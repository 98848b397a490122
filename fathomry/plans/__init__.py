"""Registered queries over the driver's tables, their SQL, and build generations."""
