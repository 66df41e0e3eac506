"""Helpers shared by the tests."""

def rows(df, *columns):
    """Sorted tuples of the given columns (all if none)."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda r: tuple(map(str, r)))
