"""What the tests share."""

from __future__ import annotations

SF = "/root/testdata/sf0.001"


def normal(rows, columns):
    """Rows as comparable tuples, by column name, floats rounded."""
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    fix = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(([fix(r[k]) for k in order] for r in rows), key=repr)


def same(spark_df, duck_relation):
    names = [d[0] for d in duck_relation.description] if hasattr(duck_relation, "description") else duck_relation.columns
    assert sorted(spark_df.columns) == sorted(names)
    a = normal([tuple(r) for r in spark_df.collect()], spark_df.columns)
    b = normal(duck_relation.fetchall(), list(names))
    assert len(a) == len(b)
    assert a == b
