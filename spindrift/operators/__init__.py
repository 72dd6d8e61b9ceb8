"""Graph operators as compositions of DataFrame operations."""
