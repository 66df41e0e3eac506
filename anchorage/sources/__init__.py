"""Table scans, delimited files, annotation XML and result tables."""
