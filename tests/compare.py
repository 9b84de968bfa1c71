"""Comparison of a Spark result with SQL's: rows in any order, numbers to six places."""

import math


def cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    if type(x).__name__ == "NAType":
        return "null"
    if isinstance(x, bool) or type(x).__name__ == "bool_":
        return str(bool(x))
    if isinstance(x, (float, int)) or hasattr(x, "dtype") or type(x).__name__ == "Decimal":
        return f"{round(float(x), 6) + 0.0:.6f}"
    return str(x)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(cell(x) for x in r) for r in frame[columns].itertuples(index=False))


def assert_same(spark_frame, sql_frame):
    a, b = rows(spark_frame), rows(sql_frame)
    assert a[0] == b[0]
    assert len(a[1]) == len(b[1])
    for x, y in zip(a[1], b[1], strict=True):
        assert x == y
