"""A content-addressed archive engine on Spark DataFrames."""
