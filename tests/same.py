"""Two tables compared by column name, in any row order."""

import math


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, (int, float)):
        return (2, float(v))
    return (3, str(v))


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


def assert_same(a_columns, a, b_columns, b, tolerance=2e-6):
    assert sorted(a_columns) == sorted(b_columns)
    assert len(a) == len(b)
    for x, y in zip(rows(a_columns, a), rows(b_columns, b)):
        for (k, v), (m, w) in zip(x, y):
            assert k == m and (v == w or k == 2 and math.isclose(v, w, rel_tol=1e-9, abs_tol=tolerance)), (x, y)
