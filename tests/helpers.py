"""What several tests use."""


def rows(df):
    """A DataFrame's rows as a sorted list of tuples of strings."""
    return sorted(tuple(map(str, r)) for r in df.collect())
