"""Column-level functions: elapsed time, composite keys, text normalisation."""
