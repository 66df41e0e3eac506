"""DataFrame operators.  Every function takes and returns lazy DataFrames."""
