"""Names that the test modules share."""

SMALL = "/root/testdata/sf0.001"


def as_set(df):
    return {tuple(r) for r in df.collect()}
