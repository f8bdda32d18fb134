"""How results of two engines are compared."""


def rows_of(frame):
    """Rows as comparable tuples, columns by name, doubles to six digits, in order."""

    def plain(v):
        if v is None or v != v:
            return ""
        if isinstance(v, bool):
            return str(v)
        return f"{float(v):.6g}" if isinstance(v, float) else str(v)

    columns = sorted(frame.columns)
    return sorted(tuple(plain(v) for v in row) for row in frame[columns].itertuples(index=False))
