"""Reading and writing graphs and tables."""
