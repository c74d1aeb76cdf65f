"""Sessions, sizes and physical plans."""
