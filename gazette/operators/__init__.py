"""DataFrame operators of the digest pipeline (DataFrames in, DataFrame out)."""
