"""Rows of a DataFrame against rows of SQL, without order."""

import math


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v.isoformat() if hasattr(v, "isoformat") else v


def rows(names, records):
    order = sorted(names)
    at = [list(names).index(n) for n in order]
    return order, sorted((tuple(plain(r[i]) for i in at) for r in records), key=repr)


def assert_same(df, relation):
    mine, theirs = rows(df.columns, df.collect()), rows(relation.columns, relation.fetchall())
    assert mine[0] == theirs[0]
    assert len(mine[1]) == len(theirs[1])
    assert mine[1] == theirs[1]
