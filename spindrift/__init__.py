"""A Spark-first property-graph analytics engine: graphs are DataFrames."""
