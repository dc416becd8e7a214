"""SQL of a query over small tables, to compare with its DataFrame."""

import duckdb


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def rows_of_sql(sql, **frames):
    con = duckdb.connect()
    for name, df in frames.items():
        con.register(name, df.toArrow())
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str([plain(r[i]) for i in at]) for r in found.fetchall())


def rows_of(df):
    names = sorted(df.columns)
    return sorted(str([plain(r[n]) for n in names]) for r in df.select(*[f"`{n}`" for n in names]).collect())
