"""Comparing result frames."""


def same_rows(spark_frame, duck_frame):
    """Rows as sorted tuples of comparable texts, columns by name."""

    def plain(frame):
        cols = sorted(frame.columns)
        frame = frame[cols].astype(object).where(frame[cols].notna(), None)
        show = lambda v: str(round(float(v), 9)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
        return cols, sorted(tuple(map(show, row)) for row in frame.itertuples(index=False))

    return plain(spark_frame) == plain(duck_frame)
