"""Runs a query and its SQL side by side."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(sf_dir):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def rows(pdf, digits=6):
    pdf = pdf[sorted(pdf.columns)]
    plain = lambda v: round(v, digits) if isinstance(v, float) else [plain(x) for x in v] if hasattr(v, "tolist") and getattr(v, "ndim", 0) else v
    return sorted(str(tuple(plain(v) for v in r)) for r in pdf.itertuples(index=False, name=None))


def same(df, sql, sf_dir):
    a, b = df.toPandas(), views(sf_dir).execute(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)


def same_tables(df, sql, tables):
    """As same(), over the given tables."""
    c = duckdb.connect()
    for name, t in tables.items():
        arrow = t.toArrow()
        c.register(name, arrow)
    a, b = df.toArrow(), c.execute(sql).to_arrow_table()
    assert sorted(a.column_names) == sorted(b.column_names)
    plain = lambda t: sorted(str([r[k] for k in sorted(r)]) for r in t.to_pylist())
    assert plain(a) == plain(b)
