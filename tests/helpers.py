"""Result rows in forms that compare easily."""


def rows(df):
    """Rows as sorted tuples, NULL first."""
    return sorted((tuple(r) for r in df.collect()), key=lambda t: [(v is not None, str(v)) for v in t])


def by(df, key="column"):
    return {r[key]: r.asDict() for r in df.collect()}
